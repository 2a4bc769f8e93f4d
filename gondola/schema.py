"""Column lists, keys and Spark types shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# The positional layout of a raw sales file (no header).
RAW_COLUMNS = [
    "Tiendas", "Transaccion", "Fecha_raw", "skip1", "Cod_prod", "Nom_prod", "skip2", "Categoria",
    "Cantidad", "Precio", "Importe", "skip3", "Cod_promo", "Nom_promo", "skip4", "Costo_unit",
    "Tipo", "Sistema",
]
KEPT_COLUMNS = [c for c in RAW_COLUMNS if not c.startswith("skip")]

# Additive measures.  Numbers of a line are read as DECIMAL(24,4), their products are DECIMAL(34,4),
# and so are the amounts of the rollup tables.  Decimal sums are exact and do not depend on the
# order in which tasks finish.
MEASURES = ["Importe", "Cantidad", "Precio_x_Cant", "Costo_total"]
LINE_NUMBER = T.DecimalType(24, 4)
LINE_PRODUCT = T.DecimalType(34, 4)
ROLLUP_AMOUNT = T.DecimalType(34, 4)

# The grouping keys of the rollup tables.
ROLLUP_KEYS = {
    "ventas": ["Anio_mes", "Tiendas", "Categoria", "Cod_promo", "Nom_promo", "Tipo", "Sistema"],
    "productos": ["Anio_mes", "Cod_prod", "Nom_prod", "Categoria"],
    "promo_prod": ["Anio_mes", "Cod_prod", "Nom_prod", "Categoria", "has_promo"],
    "ventas_dia": ["Fecha", "Semana", "Anio_mes", "CicloAno_mes", "Categoria", "Cod_promo",
                   "Nom_promo", "Tipo"],
    "tickets": ["Anio_mes", "Tiendas"],
}
ROLLUPS = list(ROLLUP_KEYS)
MONTH = "Anio_mes"

# The columns of the store and catalogue files.
STORE_COLUMNS = ["FileCORR", "Region", "Comuna", "Formato", "Segmento"]
CATALOG_COLUMNS = ["Cod_promo", "Nom_promo", "Formato_promo", "Unidades_por_promo"]


def raw_schema() -> T.StructType:
    """Everything is text at read time; conversion happens in ``operators.normalize``."""
    return T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def rollup_schema(name: str) -> T.StructType:
    """Schema of a stored rollup, used on read so no file is opened to infer it."""
    fields = [
        T.StructField(k, T.IntegerType() if k == "has_promo" else T.StringType())
        for k in ROLLUP_KEYS[name]
    ]
    if name == "tickets":
        fields += [T.StructField(c, T.LongType()) for c in ("n_tickets", "n_tkt_promo")]
    else:
        fields += [T.StructField(c, ROLLUP_AMOUNT) for c in MEASURES]
    return T.StructType(fields)


def store_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in STORE_COLUMNS])


def catalog_schema() -> T.StructType:
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in CATALOG_COLUMNS[:3]]
        + [T.StructField(CATALOG_COLUMNS[3], T.LongType())]
    )
