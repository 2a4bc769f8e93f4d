"""Result exports: semicolon CSV with decimal comma, and the seven-table report bundle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Tables of the report bundle, the result each one shows, and its columns (an
# empty list keeps all of them).
BUNDLE = {
    "Resumen": ("evol_v", ["Anio_mes", "Ingresos", "Margen", "Mg_pct", "Descuento"]),
    "Categorias": ("treemap", ["Categoria", "Ingresos", "Unidades", "Margen", "Mg_pct",
                               "Mix_promo", "Desc_pct"]),
    "SKU_Ranking": ("sku_ranking", ["Producto", "Categoria", "Ingresos", "Unidades", "Margen",
                                    "Mg_pct", "Precio_ef", "Desc_pct", "Primer_mes",
                                    "Ultimo_mes"]),
    "Tiendas": ("tiendas_v", ["Tiendas", "Ingresos", "Unidades", "Margen", "Mg_pct", "Mix_promo",
                              "Desc_pct", "Precio_ef"]),
    "Promociones": ("promos", ["Promo", "Primer_mes", "Ultimo_mes", "Meses", "Tiendas",
                               "Ingresos", "Unidades", "Margen", "Mg_pct", "Desc_pct", "ROI"]),
    "YoY": ("yoy_mes", ["Anio_mes", "Anio", "Mes", "Ingresos", "Unidades", "Margen", "Mg_pct",
                        "Mix_promo"]),
    "Datos": ("resumen_export", []),
}


def _decimal_comma(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = value.cast("decimal(38,10)")  # plain digits, no exponent
    elif not isinstance(field.dataType, T.DecimalType):
        return value
    # 12.3400 -> 12,34 and 5.0000 -> 5,0
    digits = F.regexp_replace(value.cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return F.replace(digits, F.lit("."), F.lit(",")).alias(field.name)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """Header, ``;`` between fields, ``,`` as decimal mark, amounts and ratios with as many decimals as
    they need and one at least; one file per task.  ``mark`` puts a byte-order mark before the header,
    as spreadsheets like it."""
    text = df.select(*[_decimal_comma(f) for f in df.schema.fields])
    if mark:
        first = text.columns[0]
        text = text.withColumnRenamed(first, "\ufeff" + first)
    text.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def bundle_table(results: Mapping[str, DataFrame], name: str) -> DataFrame:
    """One table of the bundle, with those of its columns that the result has."""
    source, columns = BUNDLE[name]
    result = results[source]
    return result.select(*[c for c in columns or result.columns if c in result.columns])


def write_bundle(results: Mapping[str, DataFrame], folder: str) -> None:
    for name in BUNDLE:
        bundle_table(results, name).write.mode("overwrite").parquet(f"{folder}/{name}")
