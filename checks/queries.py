"""Every registered query, over the test tables of one input folder.

A query returns whole results.  ``present`` gives both engines the same output types: exact
decimals become DOUBLE rounded to 4 places, ratios are rounded to 6.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from gondola.functions import text
from gondola.functions.cycles import attach_cycle, cycle_calendar, month_cycles, week_label
from gondola.functions.measures import measures, over
from gondola.operators import filters as flt
from gondola.operators import normalize as norm
from gondola.operators.filters import FilterSpec, apply_filters
from gondola.operators.rollup import build_rollup, roll_to_grain
from gondola.plans import alerts, crosses, margin, overview, promotions, skus, yoy
from gondola.plans import stores as store_plans
from gondola.plans.lattice import shared
from gondola.plans.reports import (
    REPORT_NAMES, all_reports, promo_drill_months, promo_drill_stores, report,
)
from gondola.schema import KEPT_COLUMNS, MEASURES, RAW_COLUMNS, ROLLUPS
from gondola.sinks.exports import BUNDLE, write_bundle, write_csv
from gondola.sinks.rollups import ingest_batch, merge_batch, write_rollups
from gondola.sources.dimensions import load_catalog, load_stores
from gondola.sources.lines import scan_sales_csv
from gondola.sources.rollups import Rollups, read_rollup
from gondola.testbed import Testbed, catalog, stores, text_lines

Query = Callable[[SparkSession, str], DataFrame]

#: Of derived line files, one per task: a fifth of the bytes.  Files that have to be split are written plain.
TEXT_CODEC = "gzip"


def present(df: DataFrame) -> DataFrame:
    def column(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return F.round(value.cast("double"), 4).alias(field.name)
        if isinstance(field.dataType, T.DoubleType):
            # By way of a DECIMAL, so that a tie is decided by decimal digits in both engines.
            return F.round(value.cast("decimal(38,9)"), 6).cast("double").alias(field.name)
        return value

    return df.select(*[column(f) for f in df.schema.fields])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- derived files ----------------------------------------------------------------------------

def _csv_lines(tb: Testbed) -> DataFrame:
    """Raw text lines, written as headerless CSV and scanned back."""
    def write(path: str) -> None:
        rows = text_lines(tb.spark, tb.sf_dir).select(*RAW_COLUMNS)
        writer = rows.write.mode("overwrite").option("sep", ";").option("header", False)
        writer = writer.option("compression", TEXT_CODEC)
        for side in ("Leading", "Trailing"):  # keep the padding of the text
            writer = writer.option(f"ignore{side}WhiteSpace", False)
        writer.csv(path)

    return scan_sales_csv(tb.spark, tb.once("texto", write))


def s01_breaks(tb: Testbed) -> DataFrame:
    """The same lines with line breaks, quotes and separators in some product names."""
    def write(path: str) -> None:
        name = F.concat("Nom_prod", F.lit('\nde "'), "Cod_prod", F.lit('";\n'))
        rows = text_lines(tb.spark, tb.sf_dir).withColumn(
            "Nom_prod", F.when(F.expr("CAST(Cod_prod AS INT) % 7 = 0"), name).otherwise(F.col("Nom_prod")))
        writer = rows.select(*RAW_COLUMNS).write.mode("overwrite").option("sep", ";").option("escape", '"')
        for side in ("Leading", "Trailing"):
            writer = writer.option(f"ignore{side}WhiteSpace", False)
        writer.csv(path)

    return scan_sales_csv(tb.spark, tb.once("texto_con_saltos", write)).select(*KEPT_COLUMNS)


def _typed_lines(tb: Testbed) -> DataFrame:
    lines = norm.strict(norm.with_amounts(norm.with_dates(norm.dated_lines(_csv_lines(tb)))))
    return norm.with_promo_flag(lines)


def _flawed_batch(tb: Testbed) -> tuple[str, str]:
    """Rollups and staging folder of a batch in which some amounts, and some products of amounts that are
    none too large by themselves, do not fit."""
    def write(path: str) -> None:
        part, huge = F.expr("CAST(Cod_prod AS INT)"), "99999999999999999999"
        rows = text_lines(tb.spark, tb.sf_dir).withColumns({
            "Importe": F.when(part % 83 == 0, "1e30").otherwise(F.col("Importe")),
            **{c: F.when(part % 79 == 0, huge).otherwise(F.col(c)) for c in ("Precio", "Cantidad")}})
        rows.select(*RAW_COLUMNS).write.mode("overwrite").option("sep", ";").option(
            "compression", TEXT_CODEC).csv(f"{path}/texto")
        ingest_batch(tb.spark, f"{path}/texto", f"{path}/tablas", f"{path}/lote")

    folder = tb.once("lote_con_fallas", write)
    return f"{folder}/tablas", f"{folder}/lote"


def n04_rejected(tb: Testbed) -> DataFrame:
    """The amounts put aside, with their column and reason."""
    aside = tb.spark.read.parquet(f"{_flawed_batch(tb)[1]}/rechazos")
    return aside.select("Transaccion", "Cod_prod", "Columna", "Motivo")


def n05_loaded(tb: Testbed) -> DataFrame:
    """What was loaded of the same batch."""
    rows = read_rollup(tb.spark, _flawed_batch(tb)[0], "ventas")
    return rows.groupBy("Anio_mes").agg(*measures("Ingresos Unidades"))


def _catalog_file(tb: Testbed, name: str, only_type: str = "") -> str:
    """A catalogue file made from the sold promos: other headers, padded lower-case codes, several
    names per code, pack sizes that are not always numbers."""
    def write(path: str) -> None:
        rows = tb.lines().where(F.col("Cod_promo").isNotNull())
        if only_type:
            rows = rows.where(F.col("Cod_promo").endswith(only_type))
        rows = rows.select("Cod_promo", "Nom_promo").distinct().selectExpr(
            "concat(' ', lower(Cod_promo), ' ') AS `Código promoción`",
            "Nom_promo AS `Promoción nombre promo`",
            "CASE WHEN Nom_promo LIKE '2x%' THEN '2x' ELSE '3x' END AS `Formato`",
            "CASE WHEN Nom_promo LIKE '2x%' THEN '2' WHEN Nom_promo LIKE 'Combo%' THEN 'varias' "
            "ELSE '3.0' END AS `Unidades por pack`",
        )
        ordered = rows.orderBy("`Código promoción`", F.col("`Promoción nombre promo`")
                               .asc_nulls_last())
        ordered.write.mode("overwrite").option("header", True).option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)

    return tb.once(name, write)


def _store_file(tb: Testbed) -> str:
    def write(path: str) -> None:
        stores(tb.spark, tb.sf_dir).selectExpr(
            "CASE WHEN Formato = 'Kiosco' THEN concat(' K', FileCORR, ' ') "
            "ELSE concat(FileCORR, '.0') END AS FileCORR",
            "Region AS `Región`", "Comuna", "Formato", "Segmento",
        ).write.mode("overwrite").option("header", True).option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)

    return tb.once("tiendas", write)


# --- sources and sinks ------------------------------------------------------------------------

def _table_sums(tables: Rollups) -> DataFrame:
    """Row count and sums of each rollup per month."""
    def sums(name: str) -> DataFrame:
        df = tables.table(name)
        amount = "Importe" if name != "tickets" else "n_tickets"
        return df.groupBy("Anio_mes").agg(
            F.count(F.lit(1)).alias("filas"), F.sum(amount).cast("double").alias("total"),
        ).select(F.lit(name).alias("tabla"), "Anio_mes", "filas", "total")

    return _union([sums(n) for n in ROLLUPS])


def _read_all(tb: Testbed, folder: str) -> Rollups:
    return Rollups(**{n: read_rollup(tb.spark, folder, n) for n in ROLLUPS})


def s02(tb: Testbed) -> DataFrame:
    """All five tables as stored, and a sixth folder that does not exist."""
    stored = _table_sums(tb.stored_rollups()).groupBy("tabla").agg(
        F.sum("filas").alias("filas"), F.sum("total").alias("total"))
    missing = read_rollup(tb.spark, f"{tb.folder}/nada", "ventas")
    return stored.unionByName(missing.agg(
        F.lit("nada").alias("tabla"), F.count(F.lit(1)).alias("filas"),
        F.sum("Importe").cast("double").alias("total")))


def s06(tb: Testbed) -> DataFrame:
    """The last quarter of 2025 arrives again, without returned goods, and replaces itself."""
    def write(path: str) -> None:
        write_rollups(tb.lines(), path)
        batch = tb.lines().where(
            F.col("Anio_mes").isin("2025-10", "2025-11", "2025-12") & (F.col("Tipo") != "R"))
        merge_batch(batch, path)

    return _table_sums(_read_all(tb, tb.once("merge", write)))


def s07(tb: Testbed) -> DataFrame:
    """Exported summary: the text of its fields."""
    path = tb.once("export", lambda p: write_csv(report(tb.rollups(), "resumen_export"), p))
    back = tb.spark.read.option("sep", ";").option("header", True).csv(path)
    return back.select("Anio_mes", "Tiendas", "Categoria", "Tipo", "Sistema",
                       "Ingresos", "Unidades", "Costo", "Margen", "Margen_pct")


def s07_products(tb: Testbed) -> DataFrame:
    """The product rollup, exported and read back."""
    path = tb.once("export_productos", lambda p: write_csv(tb.rollups().productos, p))
    back = tb.spark.read.option("sep", ";").option("header", True).csv(path)
    amount = F.replace("Importe", F.lit(","), F.lit(".")).cast("decimal(28,4)")
    return back.groupBy("Anio_mes").agg(
        F.count(F.lit(1)).alias("filas"), F.sum(amount).alias("Ingresos"))


def s08(tb: Testbed) -> DataFrame:
    """The seven tables of the bundle, from shared sub-aggregates, written and read back: rows, columns,
    revenue."""
    def write(path: str) -> None:
        with shared(tb.rollups()) as tables:
            write_bundle(all_reports(tables), path)

    folder = tb.once("bundle", write)

    def line(name: str) -> DataFrame:
        table = tb.spark.read.parquet(f"{folder}/{name}")
        return table.agg(
            F.lit(name).alias("tabla"), F.count(F.lit(1)).alias("filas"),
            F.lit(len(table.columns)).alias("columnas"), F.sum("Ingresos").alias("Ingresos"))

    return _union([line(n) for n in BUNDLE])


def s09(tb: Testbed) -> DataFrame:
    """Catalogue with and without an override file."""
    default = _catalog_file(tb, "catalogo")
    custom = _catalog_file(tb, "catalogo_crm", "-CRM")

    def load(label: str, override: str | None) -> DataFrame:
        return load_catalog(tb.spark, default, override).withColumn("origen", F.lit(label))

    return _union([load("propio", custom), load("inexistente", f"{custom}_no"),
                   load("defecto", None)])


# --- row operators ----------------------------------------------------------------------------

def n07(tb: Testbed) -> DataFrame:
    rows = tb.lines().where(norm.in_model(F.col("Categoria")))
    return rows.groupBy("Categoria").agg(F.count(F.lit(1)).alias("lineas"))


def n08(tb: Testbed) -> DataFrame:
    rows = norm.with_store_code(_csv_lines(tb))
    return rows.groupBy("Tiendas").agg(F.count(F.lit(1)).alias("lineas"))


def d01(tb: Testbed) -> DataFrame:
    """Calendar with the revenue of each cycle's months; a cycle without sales shows NULL."""
    calendar = cycle_calendar(tb.spark)
    months = month_cycles(calendar)
    sold = report(tb.rollups(), "evol_v")
    per_cycle = months.join(sold, "Anio_mes").groupBy("CicloAno_mes").agg(
        F.count(F.lit(1)).alias("meses"), F.sum("Ingresos").alias("Ingresos"))
    rows = calendar.withColumn("CicloAno_mes", F.concat_ws("-", "ciclo", "anio"))
    return rows.join(per_cycle, "CicloAno_mes", "left").select(
        "ciclo", "anio", F.col("ini").cast("string").alias("ini"),
        F.col("fin").cast("string").alias("fin"), "meses", "Ingresos")


def d02(tb: Testbed) -> DataFrame:
    """Month-to-cycle table beside the revenue of the month."""
    sold = report(tb.rollups(), "evol_v").select("Anio_mes", "Ingresos")
    return month_cycles(cycle_calendar(tb.spark)).join(sold, "Anio_mes", "full")


def d04(tb: Testbed) -> DataFrame:
    rows = tb.rollups().ventas
    keys = ["Cod_promo", *norm.PROMO_CODE_COLUMNS]
    return rows.groupBy(*keys).agg(*measures("Ingresos"))


def d05(tb: Testbed) -> DataFrame:
    rows = tb.rollups().ventas
    return rows.groupBy("Nom_promo", text.mechanic(F.col("Nom_promo")).alias("Mecanica")).agg(
        *measures("Ingresos"))


# --- filters ----------------------------------------------------------------------------------

# The specification behind each filter query; the oracle states the same choices in SQL.
SPECS = {
    "f01": FilterSpec(cycle_numbers=("C2", "C3"), years=("2024", "2025")),
    "f01_cycle": FilterSpec(months=("2024-01", "2024-02", "2024-03", "2024-04"),
                            cycle_years=("C1-2024",)),
    "f01_empty": FilterSpec(cycle_years=("C1-2024",), years=("2026",)),
    "f02": FilterSpec(categories=("Brand#11", "Brand#12", "Brand#13"), types=("A", "N"),
                      systems=("F",)),
    "f03": FilterSpec(promo_text="LLEVA|combo"),
    "f04": FilterSpec(promo_types=("CIRM", "CRG"), promo_cycles=("C1-2024", "C2-2025"),
                      promo_numbers=("05", "06")),
    "f05": FilterSpec(regions=("ASIA", "EUROPE"), formats=("Express",), segments=("A", "B")),
    "f05_none": FilterSpec(regions=("ATLANTIS",)),
    "f06": FilterSpec(stores=("1", "5", "7")),
    "f07": FilterSpec(products=("cold anvil", "large rod")),
    "f08": FilterSpec(regions=("ASIA",), types=("R",), promo_numbers=("09",)),
    "f09": FilterSpec(product_text="^cold", years=("2025",)),
    "f09_code": FilterSpec(product_code_text="^1.7$"),
    "f09_none": FilterSpec(product_text="no such product"),
    "f10": FilterSpec(stores=("3",), products=("cold rod",), cycle_numbers=("C4",)),
}


def _filtered(tb: Testbed, key: str) -> Rollups:
    """Filtered rollups of one specification, prepared once per session."""
    return tb._open(key, lambda: apply_filters(
        tb.rollups(), stores(tb.spark, tb.sf_dir), SPECS[key]))


def _filter_effect(table: str, key: str) -> Callable[[Testbed], DataFrame]:
    """Rows of one filtered table, summed per month (and category, where it has one)."""
    def run(tb: Testbed) -> DataFrame:
        rows = _filtered(tb, key).table(table)
        if table == "tickets":
            return rows.groupBy("Anio_mes").agg(*measures("Tickets Tkt_promo"))
        return rows.groupBy("Anio_mes", "Categoria").agg(*measures("Ingresos Unidades"))

    return run


def f00(tb: Testbed) -> DataFrame:
    """Every facet list, stacked."""
    t, s = tb.rollups(), stores(tb.spark, tb.sf_dir)
    lists = {c: flt.facet(t.ventas, c) for c in ("Anio_mes", "Categoria", "Tipo", "Sistema",
                                                 "Tiendas")}
    lists |= {c: flt.facet(t.ventas, c, skip_blank=True)
              for c in ("TipoPromo", "CicloAno_p", "PromoNum")}
    lists |= {c: flt.facet(s, c) for c in ("Region", "Comuna", "Formato", "Segmento")}
    lists |= {"Nom_prod": flt.facet(t.productos, "Nom_prod"), "Anio": flt.year_facet(t.ventas)}
    return _union([
        df.select(F.lit(name).alias("columna"), F.col(df.columns[0]).alias("valor"))
        for name, df in lists.items()
    ])


def f13(tb: Testbed) -> DataFrame:
    return flt.between(report(tb.rollups(), "alertas"), "Mg_pct", 0, 0.25).select(
        "Producto", "Categoria", "Ingresos", "Mg_pct")


def f14(tb: Testbed) -> DataFrame:
    rows = tb.rollups().ventas.select("Categoria", "Cod_promo", "Tiendas", "Importe", "Cantidad")
    kept = flt.complete(rows, ["Categoria", "Cod_promo"])
    return kept.groupBy("Categoria").agg(*measures("Ingresos Unidades N_promos"))


# --- scalar expressions -----------------------------------------------------------------------

def x01(tb: Testbed) -> DataFrame:
    return tb.rollups().productos.groupBy(text.product_label().alias("Producto")).agg(
        *measures("Ingresos"))


def x02(tb: Testbed) -> DataFrame:
    return tb.rollups().ventas.groupBy(text.promo_label().alias("Promo")).agg(
        *measures("Ingresos"))


def x03(tb: Testbed) -> DataFrame:
    return tb.rollups().ventas.groupBy(
        text.category_label().alias("Cat_guion"),
        text.category_label("Sin cat.").alias("Cat_sin")).agg(*measures("Ingresos"))


def x04(tb: Testbed) -> DataFrame:
    name = F.col("Nom_promo")
    rows = tb.rollups().ventas.where("Nom_promo IS NOT NULL").select(
        name, F.upper(F.trim(name)).alias("mayus"), F.lower(name).alias("minus"),
        F.substring(name, 1, 3).alias("inicio"), F.length(name).alias("largo"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("cambio"),
        F.get(F.split(name, " "), F.lit(0)).alias("palabra"),
        name.startswith("2x").alias("es_2x"), name.like("%off%").alias("es_off"),
        text.matches(name, "brand#1[0-9]$").alias("busca"),
        F.concat(F.lit("["), name, F.lit("]")).alias("marco"),
    )
    return rows.distinct()


def x05(tb: Testbed) -> DataFrame:
    r = report(tb.rollups(), "cat_promo_cross")
    mg = F.col("Mg_pct")
    return r.select(
        "Categoria", over(F.col("Ingresos"), F.lit(0)).alias("div_cero"),
        F.round(mg * 100, 0).alias("r0"), F.round(mg * 100, 1).alias("r1"),
        F.round(mg * 100, 2).alias("r2"), F.round(mg, 3).alias("r3"),
        F.bround(mg * 100, 1).alias("par"),
        F.greatest(mg - F.lit(0.2), F.lit(0.01)).alias("piso"))


def x06(tb: Testbed) -> DataFrame:
    p = tb.rollups().promo_prod
    kind = (
        F.when(F.col("has_promo") == 1, "con promo")
        .when(F.coalesce(F.col("Categoria"), F.lit("-")) == "-", "sin categoria")
        .otherwise(F.coalesce(F.nullif(F.col("Nom_prod"), F.lit("")), F.lit("sin nombre")))
    )
    return p.groupBy(kind.alias("Clase")).agg(*measures("Ingresos Unidades"))


def x07(tb: Testbed) -> DataFrame:
    day = F.try_to_date(F.col("Fecha"), "yyyy-MM-dd")
    return tb.rollups().ventas_dia.select(
        "Fecha", week_label(F.col("Fecha")).alias("Semana"), F.weekofyear(day).alias("nro"),
        F.date_format(F.add_months(F.trunc(day, "MM"), 1), "yyyy-MM").alias("mes_sig"),
    ).distinct()


def x08(tb: Testbed) -> DataFrame:
    return tb.rollups().ventas.select(
        "Cod_promo", text.code_cycle(F.col("Cod_promo")).alias("Ciclo")).distinct()


_VENTAS_MEASURES = (
    "Ingresos Unidades Costo Ing_lista Margen Descuento Mg_pct Desc_pct ROI Markup Precio_ef "
    "Precio_lista Costo_unit Mix_promo Ing_con_codigo Ing_sin_codigo Und_con_codigo Und_sin_codigo "
    "Ing_codigo_no_vacio N_tiendas N_promos"
)
_FLAG_MEASURES = (
    "Cant_promo Cant_sin_promo Ing_promo Ing_sin_promo Costo_promo Costo_sin_promo Penetracion "
    "Penetracion_ing Primer_mes Ultimo_mes Meses"
)

DRILL_PROMO = "Combo Brand#13"

# --- registry ---------------------------------------------------------------------------------

# Reports in inventory order; 40 and 41 are the promo drill-down.
REPORT_ORDER = [
    "kpis_v", "kpis_t", "treemap", "pareto", "evol_v", "evol_t", "prod_mg", "precio_evol", "pvol",
    "compresion", "promos", "heatmap_promo", "mecanica", "tiendas_v", "tiendas_t", "heat_tiendas",
    "alertas", "alertas_promo", "ticket_promo_mes", "ticket_promo_cat", "sku_por_promo",
    "evo_ciclo", "modalidad_venta", "pen_cat_v", "promo_por_cat_ciclo", "penetracion_prod",
    "penetracion_mes", "penetracion_cat", "penetracion_cat_mes", "mg_cat_mes", "desc_mg_prod",
    "cat_promo_cross", "precio_gap", "yoy_mes", "yoy_cat", "sku_ranking", "price_ladder",
    "cobertura_prod", "resumen_export",
]
assert sorted(REPORT_ORDER) == sorted(REPORT_NAMES)


def _r(tb: Testbed, name: str) -> DataFrame:
    return report(tb.rollups(), name)


def _shared(tb: Testbed) -> Rollups:
    """Shared sub-aggregates of the rollups, kept for the session."""
    return tb._open("shared", lambda: shared(tb.rollups()))


def _rows(tb: Testbed, name: str) -> DataFrame:
    """A report as input of another plan, which orders its own result."""
    return report(tb.rollups(), name, ordered=False)


def _ranking(tb: Testbed, **kw) -> DataFrame:
    return promotions.promo_ranking(_r(tb, "sku_por_promo"), catalog(tb.spark), **kw)


def _catalog_rows(tb: Testbed) -> DataFrame:
    return promotions.catalog_transactions(_r(tb, "sku_por_promo"), catalog(tb.spark))


def _unsold(tb: Testbed) -> DataFrame:
    return promotions.unsold_promos(catalog(tb.spark), _r(tb, "sku_por_promo"))


def _zones(tb: Testbed) -> DataFrame:
    return crosses.discount_zones(_r(tb, "desc_mg_prod"))


def _store_rank(tb: Testbed) -> DataFrame:
    return store_plans.store_ranking(_r(tb, "tiendas_v"), _r(tb, "tiendas_t"))


def _coverage(tb: Testbed) -> DataFrame:
    return promotions.promo_coverage(_r(tb, "promos"), _r(tb, "kpis_t"))


def _skus(tb: Testbed) -> DataFrame:
    return skus.selection(_r(tb, "sku_ranking"))


SOURCES_AND_ROWS: dict[str, Callable[[Testbed], DataFrame]] = {
    "s01_quoted_line_breaks": s01_breaks,
    "s01_sales_csv_scan": lambda tb: _csv_lines(tb).select(*KEPT_COLUMNS),
    "s02_rollup_scan": s02,
    "s03_catalog_load": lambda tb: load_catalog(tb.spark, _catalog_file(tb, "catalogo")),
    "s04_store_load": lambda tb: load_stores(tb.spark, _store_file(tb)),
    "s05_rollup_write": lambda tb: _table_sums(tb.stored_rollups()),
    "s06_month_replace": s06,
    "s07_export_summary_csv": s07,
    "s07_export_products_csv": s07_products,
    "s08_report_bundle": s08,
    "s09_catalog_override": s09,
    "n01_dated_lines": lambda tb: norm.dated_lines(_csv_lines(tb)).select(
        "Transaccion", "Cod_prod", "Fecha_raw"),
    "n02_month_and_day": lambda tb: _typed_lines(tb).groupBy("Anio_mes", "Fecha").agg(
        F.count(F.lit(1)).alias("lineas")),
    "n03_week_label": lambda tb: norm.with_week(_typed_lines(tb).groupBy("Fecha").agg(
        F.count(F.lit(1)).alias("lineas"))),
    "n04_numeric_text": lambda tb: _typed_lines(tb).select(
        "Transaccion", "Cod_prod", "Cantidad", "Precio", "Importe", "Costo_unit"),
    "n04_rejected_amounts": n04_rejected,
    "n05_loaded_without_rejected": n05_loaded,
    "n05_line_extensions": lambda tb: _typed_lines(tb).groupBy("Cod_prod").agg(
        *[F.sum(m).alias(m) for m in MEASURES]),
    "n06_promo_flag": lambda tb: _typed_lines(tb).groupBy(
        "Cod_promo", "Nom_promo", "has_promo").agg(F.count(F.lit(1)).alias("lineas")),
    "n07_excluded_categories": n07,
    "n08_store_code": n08,
    "d01_cycle_calendar": d01,
    "d02_month_cycle": d02,
    "d03_attach_cycle": lambda tb: attach_cycle(tb.lines().groupBy("Anio_mes").agg(
        F.count(F.lit(1)).alias("lineas"))),
    "d04_promo_code_parts": d04,
    "d05_promo_mechanic": d05,
    **{
        f"a0{i}_{name}": (lambda name: lambda tb: build_rollup(tb.lines(), name))(name)
        for i, name in enumerate(["ventas", "productos", "promo_prod", "ventas_dia", "tickets"], 1)
    },
    "a06_daily": lambda tb: roll_to_grain(tb.rollups().ventas_dia, "Diario"),
    "a06_weekly_by_category": lambda tb: roll_to_grain(
        tb.rollups().ventas_dia, "Semanal", ["Categoria"]),
    "a06_monthly_by_type": lambda tb: roll_to_grain(tb.rollups().ventas_dia, "Mensual", ["Tipo"]),
    "a06_cycle": lambda tb: roll_to_grain(tb.rollups().ventas_dia, "Ciclo"),
}

FILTERS_AND_COLUMNS: dict[str, Callable[[Testbed], DataFrame]] = {
    "f00_facets": f00,
    "f01_cycle_numbers_and_years": _filter_effect("ventas", "f01"),
    "f01_months_and_cycle_year": _filter_effect("productos", "f01_cycle"),
    "f01_empty_intersection": _filter_effect("ventas", "f01_empty"),
    "f02_categorical": _filter_effect("ventas", "f02"),
    "f02_categorical_products": _filter_effect("productos", "f02"),
    "f03_text_search": _filter_effect("ventas", "f03"),
    "f04_promo_code": _filter_effect("ventas", "f04"),
    "f05_store_attributes": _filter_effect("ventas", "f05"),
    "f05_store_attributes_tickets": _filter_effect("tickets", "f05"),
    "f05_no_such_store": _filter_effect("ventas", "f05_none"),
    "f06_stores": _filter_effect("ventas", "f06"),
    "f06_stores_tickets": _filter_effect("tickets", "f06"),
    "f07_products": _filter_effect("productos", "f07"),
    "f08_stores_to_products": _filter_effect("productos", "f08"),
    "f09_products_to_sales": _filter_effect("ventas", "f09"),
    "f09_products_to_tickets": _filter_effect("tickets", "f09"),
    "f09_product_code": _filter_effect("ventas", "f09_code"),
    "f09_no_such_product": _filter_effect("ventas", "f09_none"),
    "f10_sales_to_promo_products": _filter_effect("promo_prod", "f10"),
    "f11_promo_only": lambda tb: flt.only_promos(tb.rollups().ventas).groupBy("Tipo").agg(
        *measures("Ingresos N_promos")),
    "f12_having": lambda tb: _r(tb, "desc_mg_prod").select("Producto", "Categoria", "Ingresos"),
    "f13_between": f13,
    "f14_drop_null": f14,
    "x01_product_label": x01,
    "x02_promo_label": x02,
    "x03_category_label": x03,
    "x04_text_functions": x04,
    "x05_math": x05,
    "x06_conditional": x06,
    "x07_dates": x07,
    "x08_code_cycle": x08,
    "m01_sales_measures": lambda tb: tb.rollups().ventas.groupBy("Anio_mes").agg(
        *measures(_VENTAS_MEASURES)),
    "m02_flag_measures": lambda tb: tb.rollups().promo_prod.groupBy("Categoria").agg(
        *measures(_FLAG_MEASURES)),
}

REPORT_QUERIES: dict[str, Callable[[Testbed], DataFrame]] = {
    **{
        f"q{i:02d}_{name}": (lambda name: lambda tb: _r(tb, name))(name)
        for i, name in enumerate(REPORT_ORDER, 1)
    },
    "q40_promo_drill_months": lambda tb: promo_drill_months(
        flt.drill_filter(tb.rollups().ventas, FilterSpec(years=("2024", "2025"), types=("A", "N"))),
        DRILL_PROMO),
    "q41_promo_drill_stores": lambda tb: promo_drill_stores(tb.rollups().ventas, DRILL_PROMO),
    "q05_evol_v_filtered": lambda tb: report(_filtered(tb, "f05"), "evol_v"),
    "q07_prod_mg_filtered": lambda tb: report(_filtered(tb, "f08"), "prod_mg"),
    "q19_ticket_promo_mes_filtered": lambda tb: report(_filtered(tb, "f09"), "ticket_promo_mes"),
    "q28_penetracion_cat_filtered": lambda tb: report(_filtered(tb, "f10"), "penetracion_cat"),
}

# Reports by way of shared sub-aggregates; each must agree with the SQL of the report itself.
SHARED = {f"{q}_shared": q for q in (
    "q01_kpis_v", "q03_treemap", "q11_promos", "q14_tiendas_v", "q19_ticket_promo_mes", "q21_sku_por_promo",
    "q22_evo_ciclo", "q24_pen_cat_v", "q26_penetracion_prod", "q29_penetracion_cat_mes", "q34_yoy_mes",
    "q36_sku_ranking", "q38_cobertura_prod")}
SHARED_QUERIES: dict[str, Callable[[Testbed], DataFrame]] = {
    name: (lambda report_name: lambda tb: report(_shared(tb), report_name))(source.split("_", 1)[1])
    for name, source in SHARED.items()
}

ANALYTICS: dict[str, Callable[[Testbed], DataFrame]] = {
    "p01_header_kpis": lambda tb: overview.header_kpis(_r(tb, "kpis_v"), _r(tb, "kpis_t")),
    "p01_header_period": lambda tb: overview.period(tb.rollups().ventas, SPECS["f01"]),
    "p02_monthly_evolution": lambda tb: overview.monthly_evolution(
        _r(tb, "evol_v"), _r(tb, "evol_t")),
    "p03_category_health": lambda tb: overview.category_health(_r(tb, "treemap")),
    "p04_top_margin": lambda tb: margin.top_margin(_r(tb, "prod_mg")),
    "p04_bottom_margin": lambda tb: margin.bottom_margin(_r(tb, "prod_mg")),
    "p05_portfolio": lambda tb: margin.portfolio(_r(tb, "prod_mg")),
    "p06_margin_composition": lambda tb: overview.margin_composition(_r(tb, "prod_mg")),
    "p07_product_list": lambda tb: margin.product_list(_r(tb, "prod_mg")),
    "p08_price_evolution": lambda tb: margin.price_evolution(_r(tb, "precio_evol")),
    "p08_price_evolution_one": lambda tb: margin.price_evolution(
        _r(tb, "precio_evol"), "Brand#11"),
    "p09_compressed": lambda tb: margin.compressed(_r(tb, "compresion")),
    "p09_expanded": lambda tb: margin.expanded(_r(tb, "compresion")),
    "p10_raise_price": lambda tb: margin.raise_price(_r(tb, "compresion")),
    "p10_lower_price": lambda tb: margin.lower_price(_r(tb, "compresion")),
    "p11_promo_coverage": _coverage,
    "p12_promo_totals": lambda tb: promotions.promo_totals(_coverage(tb)),
    "p13_promo_month_matrix": lambda tb: promotions.promo_month_matrix(
        _r(tb, "heatmap_promo"), flt.month_list(tb.rollups(), "ventas")),
    "p14_promo_fatigue": lambda tb: promotions.promo_fatigue(tb.rollups().ventas),
    "p15_store_ranking": _store_rank,
    "p16_store_means": lambda tb: store_plans.store_means(_store_rank(tb)),
    "p16_store_scatter": lambda tb: store_plans.store_scatter(_store_rank(tb)),
    "p17_category_coverage": lambda tb: store_plans.category_coverage(_r(tb, "cobertura_prod")),
    "p18_negative_margin": lambda tb: alerts.negative_margin(_r(tb, "alertas")),
    "p19_low_margin": lambda tb: alerts.low_margin(_r(tb, "alertas")),
    "p20_high_discount": lambda tb: alerts.high_discount(_r(tb, "alertas")),
    "p21_below_cost": lambda tb: alerts.below_cost(_r(tb, "alertas")),
    "p22_low_roi": lambda tb: alerts.low_roi(_r(tb, "alertas_promo")),
    "p23_excessive_discount": lambda tb: alerts.excessive_discount(_r(tb, "alertas_promo")),
    "p24_alert_counts": lambda tb: alerts.alert_counts(_r(tb, "alertas"), _r(tb, "alertas_promo")),
    "p25_margin_band_top": lambda tb: alerts.margin_band_top(_r(tb, "alertas")),
    "p26_category_alerts": lambda tb: alerts.category_alerts(_r(tb, "alertas")),
    "p27_margin_matrix": lambda tb: crosses.margin_matrix(
        _r(tb, "mg_cat_mes"), flt.month_list(tb.rollups(), "ventas")),
    "p28_margin_trend": lambda tb: crosses.margin_trend(_rows(tb, "mg_cat_mes")),
    "p29_margin_volatility": lambda tb: crosses.margin_volatility(_r(tb, "mg_cat_mes")),
    "p30_discount_zones": _zones,
    "p30_zone_counts": lambda tb: crosses.zone_counts(_zones(tb)),
    "p31_danger_zone": lambda tb: crosses.danger_zone(_zones(tb)),
    "p32_promo_intensity": lambda tb: crosses.promo_intensity(_rows(tb, "cat_promo_cross")),
    "p33_price_gap_by_month": lambda tb: crosses.price_gap_by_month(_rows(tb, "precio_gap")),
    "p33_price_gap_one_category": lambda tb: crosses.price_gap_by_month(
        _r(tb, "precio_gap"), "Sin cat."),
    "p34_price_gap_by_category": lambda tb: crosses.price_gap_by_category(_r(tb, "precio_gap")),
    "p35_price_volume_correlation": lambda tb: crosses.price_volume_correlation(
        _r(tb, "precio_evol")),
    "p36_penetration_totals": lambda tb: promotions.penetration_totals(
        _r(tb, "penetracion_prod")),
    "p37_penetration_by_month": lambda tb: promotions.penetration_by_month(
        _r(tb, "penetracion_mes")),
    "p38_penetration_matrix": lambda tb: promotions.penetration_matrix(
        _r(tb, "penetracion_cat_mes"), flt.month_list(tb.rollups(), "promo_prod")),
    "p39_penetrated_products": lambda tb: promotions.penetrated_products(
        _r(tb, "penetracion_prod")),
    "p39_penetrated_products_one": lambda tb: promotions.penetrated_products(
        _r(tb, "penetracion_prod"), 0.5, "Brand#12", complete_only=True),
    "p40_penetration_table": lambda tb: promotions.penetration_table(_r(tb, "penetracion_prod")),
    "p41_price_ladder": lambda tb: crosses.price_ladder(_r(tb, "price_ladder")),
    "p42_promo_kpis": lambda tb: promotions.promo_kpis(
        _r(tb, "sku_por_promo"), _r(tb, "pen_cat_v"), catalog(tb.spark)),
    "p43_promo_ranking": _ranking,
    "p43_promo_ranking_by_revenue": lambda tb: _ranking(
        tb, order="Ingresos", n=30, category="Brand#13"),
    "p43_promo_ranking_search": lambda tb: _ranking(tb, order="Participacion", text="combo"),
    "p44_category_penetration": lambda tb: promotions.category_penetration(_r(tb, "pen_cat_v")),
    "p45_modality_units": lambda tb: promotions.modality_mix(_r(tb, "modalidad_venta")),
    "p45_modality_revenue_one": lambda tb: promotions.modality_mix(
        _r(tb, "modalidad_venta"), "Ingresos", "Brand#14"),
    "p46_daily_revenue": lambda tb: promotions.daily_evolution(tb.rollups().ventas_dia, "Diario"),
    "p46_weekly_units_by_category": lambda tb: promotions.daily_evolution(
        tb.rollups().ventas_dia, "Semanal", "Unidades", "Categoria"),
    "p46_daily_promos": lambda tb: promotions.daily_evolution(
        tb.rollups().ventas_dia, "Diario", "N_promos"),
    "p47_monthly_revenue_by_promo": lambda tb: promotions.daily_evolution(
        tb.rollups().ventas_dia, "Mensual", "Ingresos", "Promo"),
    "p47_monthly_promos_by_category": lambda tb: promotions.daily_evolution(
        tb.rollups().ventas_dia, "Mensual", "N_promos", "Categoria"),
    "p48_cycle_revenue": lambda tb: promotions.cycle_evolution(_r(tb, "evo_ciclo")),
    "p48_cycle_promos_by_category": lambda tb: promotions.cycle_evolution(
        _r(tb, "evo_ciclo"), "N_promos", "Categoria"),
    "p48_cycle_units_by_promo": lambda tb: promotions.cycle_evolution(
        _r(tb, "evo_ciclo"), "Unidades", "Promo", text="lleva"),
    "p49_promo_lines": lambda tb: promotions.promo_lines(_r(tb, "evo_ciclo"), "brand#2"),
    "p50_ticket_uplift": lambda tb: promotions.ticket_uplift(_r(tb, "ticket_promo_mes")),
    "p50_ticket_uplift_by_month": lambda tb: promotions.ticket_uplift_by_month(
        _r(tb, "ticket_promo_mes")),
    "p51_catalog_transactions": _catalog_rows,
    "p51_top_catalog_transactions": lambda tb: promotions.top_catalog_transactions(
        _catalog_rows(tb)),
    "p52_unsold_promos": _unsold,
    "p53_catalog_coverage": lambda tb: promotions.catalog_coverage(
        _r(tb, "sku_por_promo"), catalog(tb.spark)),
    "p54_yoy_totals": lambda tb: yoy.yoy_totals(_r(tb, "yoy_mes")),
    "p55_yoy_by_category": lambda tb: yoy.yoy_by_category(_rows(tb, "yoy_cat")),
    "p56_sku_best": lambda tb: skus.best(_skus(tb)),
    "p56_sku_best_discount": lambda tb: skus.best(_skus(tb), "Desc_pct", 40),
    "p56_sku_worst": lambda tb: skus.worst(_skus(tb), "Margen"),
    "p56_sku_lowest_margin": lambda tb: skus.lowest_margin(_skus(tb)),
    "p57_sku_kpis": lambda tb: skus.selection_kpis(_skus(tb)),
    "p58_sku_position": lambda tb: skus.position_map(_skus(tb)),
    "p59_sku_terciles": lambda tb: skus.tercile_table(_skus(tb)),
    "p60_ranking_mix": lambda tb: promotions.ranking_mix(_ranking(tb)),
}


def _as_query(build: Callable[[Testbed], DataFrame]) -> Query:
    return lambda spark, sf_dir: present(build(Testbed(spark, sf_dir.rstrip("/"))))


def all_queries() -> dict[str, Query]:
    groups = {**SOURCES_AND_ROWS, **FILTERS_AND_COLUMNS, **REPORT_QUERIES, **SHARED_QUERIES,
              **ANALYTICS}
    return {name: _as_query(build) for name, build in groups.items()}
