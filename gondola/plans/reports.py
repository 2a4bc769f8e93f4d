"""The aggregation reports over the filtered rollups.

Most reports are one ``groupBy().agg()`` that differs only in table, keys, measures, HAVING, order
and limit, so they are rows of ``REPORTS``.  The rest follow as functions.  A limited report ends in
``orderBy().limit()`` (Spark's take-ordered operator: each task keeps its own top rows), with the
group keys as tie-break so the cut is the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gondola.functions.bits import MAX_WORDS
from gondola.functions.measures import measures, month_key, over, total
from gondola.functions.text import (
    category_label, mechanic, or_dash, product_label, promo_label,
)
from gondola.functions.whole import beside
from gondola.operators.filters import only_promos
from gondola.plans.layout import PLACE, by_month, in_order
from gondola.schema import MEASURES as AMOUNTS
from gondola.sources.rollups import Rollups

Key = Callable[[], Column]


def _column(name: str) -> Key:
    return lambda: F.col(name)


# Group keys shared by the reports, by short name.
KEYS: dict[str, tuple[str, Key]] = {
    "month": ("Anio_mes", _column("Anio_mes")),
    "year": ("Anio", lambda: F.substring("Anio_mes", 1, 4)),
    "month_no": ("Mes", lambda: F.substring("Anio_mes", 6, 2)),
    "store": ("Tiendas", _column("Tiendas")),
    "cat": ("Categoria", category_label),
    "sin_cat": ("Categoria", lambda: category_label("Sin cat.")),
    "prod": ("Producto", product_label),
    "prod_short": ("Prod", product_label),
    "prod_code": ("Codigo", _column("Cod_prod")),
    "promo": ("Promo", promo_label),
    "promo_code": ("Cod_promo", _column("Cod_promo")),
    "cycle": ("Ciclo", _column("CicloAno_p")),
    "mechanic": ("Mecanica", lambda: mechanic(F.col("Nom_promo"))),
    "modality": ("Modalidad",
                 lambda: F.coalesce(F.nullif(F.trim("TipoPromo"), F.lit("")), F.lit("Sin promo"))),
    "type": ("Tipo", lambda: or_dash("Tipo")),
    "system": ("Sistema", lambda: or_dash("Sistema")),
}


def no_condition(rows: DataFrame) -> DataFrame:
    return rows


@dataclass(frozen=True)
class Report:
    table: str
    keys: str
    measures: str
    order: str = ""  # space-separated; "-" in front means descending
    limit: int = 0
    above: tuple[str, float] | None = None  # HAVING measure > bound
    where: Callable[[DataFrame], DataFrame] = no_condition
    by: tuple[str, ...] = ()  # dimensions whose distinct values are counted


def sorted_by(df: DataFrame, order: str, ties: list[str] = ()) -> DataFrame:
    """Order with NULLs last in both directions; ``ties`` make it total."""
    columns = []
    for name in order.split():
        key = F.col(name.lstrip("-"))
        columns.append(key.desc_nulls_last() if name[0] == "-" else key.asc_nulls_last())
    named = {n.lstrip("-") for n in order.split()}
    columns += [F.col(t).asc_nulls_last() for t in ties if t not in named]
    return df.orderBy(*columns) if columns else df


#: Measures that count the distinct values of a dimension.
COUNTS = {"Anio_mes": "Meses", "Tiendas": "N_tiendas"}


def run_report(
    tables: Rollups, report: Report, ordered: bool = True,
    place: Callable[[DataFrame, Rollups], DataFrame] | None = None,
) -> DataFrame:
    """A report from the smallest shared sub-aggregate that covers it, or else from its rollup.

    ``place`` deals the rows out before they are grouped, by a column ``PLACE`` that follows from the keys and
    stays in the result."""
    given = tables.shared.source(report) if tables.shared else None
    rows, counts = given or (tables.table(report.table), {})
    rows = report.where(rows)
    names = [KEYS[k][0] for k in report.keys.split()]
    keys = [KEYS[k][1]().alias(KEYS[k][0]) for k in report.keys.split()]
    if report.by and not given:
        dimensions = [tables.dimension(c) for c in report.by]
        if all(d.words() <= MAX_WORDS for d in dimensions):
            for d in dimensions:
                rows = d.numbered(rows)
            counts = {COUNTS[d.column]: d.count() for d in dimensions}
        else:  # more values than bits are kept for: rows are summed by them first
            rows = rows.groupBy(*keys, *[F.col(c).alias(f"por_{c}") for c in report.by]).agg(
                *[F.sum(m).alias(m) for m in AMOUNTS])
            rows = rows.withColumnsRenamed({f"por_{c}": c for c in report.by if c not in names})
            keys = [F.col(n) for n in names]
    if place:
        rows, keys = place(rows, tables), [F.col(PLACE), *keys]
    out = rows.groupBy(*keys).agg(*measures(report.measures, counts))
    if report.above:
        out = out.where(F.col(report.above[0]) > F.lit(report.above[1]))
    if report.order and (ordered or report.limit):
        out = sorted_by(out, report.order, names)
    return out.limit(report.limit) if report.limit else out


def with_store(ventas: DataFrame) -> DataFrame:
    return ventas.where(F.col("Tiendas").isNotNull())


def with_promo_cycle(ventas: DataFrame) -> DataFrame:
    return only_promos(ventas).where(F.col("CicloAno_p") != "")


_PROMO_SPLIT = "Cant_promo Cant_sin_promo Cant_total=Unidades Penetracion"

REPORTS: dict[str, Report] = {
    "kpis_v": Report(
        "ventas", "",
        "ing=Ingresos und=Unidades costo=Costo margen=Margen mg_pct=Mg_pct ing_lista=Ing_lista "
        "desc_total=Descuento desc_pct=Desc_pct ing_promo=Ing_con_codigo n_promos=N_promos"),
    "kpis_t": Report("tickets", "", "tkt=Tickets tkt_p=Tkt_promo tiendas=N_tiendas"),
    "treemap": Report("ventas", "sin_cat", "Ingresos Margen Mg_pct", "-Ingresos"),
    "pareto": Report("productos", "prod_short", "Margen", "-Margen", 150, ("Margen", 0)),
    "evol_v": Report("ventas", "month", "Ingresos Margen Mg_pct Descuento", "Anio_mes"),
    "evol_t": Report("tickets", "month", "Tickets"),
    "prod_mg": Report(
        "productos", "prod prod_code cat",
        "Ingresos Unidades Costo Margen Mg_pct Markup Precio_ef Costo_unit", "-Ingresos", 500),
    "precio_evol": Report(
        "ventas", "month sin_cat", "Precio_ef Precio_lista Costo_unit Mg_pct Ingresos Unidades",
        "Anio_mes Categoria"),
    "pvol": Report(
        "productos", "prod cat", "Precio_ef Unidades Ingresos Mg_pct", "-Ingresos", 300),
    "promos": Report(
        "ventas", "promo promo_code",
        "Primer_mes Ultimo_mes Meses Tiendas=N_tiendas Ingresos Unidades Margen Mg_pct Descuento "
        "Desc_pct ROI", "-Ingresos", where=only_promos, by=("Anio_mes", "Tiendas")),
    "mecanica": Report(
        "ventas", "mechanic", "Promos=N_promos Ingresos Margen Mg_pct Inversion=Descuento ROI",
        "-Ingresos", where=only_promos),
    "tiendas_v": Report(
        "ventas", "store",
        "Ingresos Unidades Costo Margen Mg_pct Desc_pct Precio_lista Precio_ef Mix_promo",
        "-Ingresos", where=with_store),
    "tiendas_t": Report("tickets", "store", "Tickets Tkt_promo"),
    "alertas": Report(
        "productos", "prod cat",
        "Ingresos Unidades Margen Mg_pct Precio_lista Precio_ef Costo_unit Desc_pct",
        above=("Ingresos", 100)),
    "alertas_promo": Report(
        "ventas", "promo", "Ingresos Inversion=Descuento ROI Desc_pct Mg_pct",
        above=("Ingresos", 100), where=only_promos),
    "sku_por_promo": Report(
        "ventas", "promo promo_code cat",
        "Tiendas=N_tiendas Ingresos Unidades Mg_pct Desc_pct ROI Primer_mes Ultimo_mes",
        "-Ingresos", where=only_promos, by=("Anio_mes", "Tiendas")),
    "evo_ciclo": Report(
        "ventas", "cycle cat promo promo_code", "Ingresos Unidades Tiendas=N_tiendas Mg_pct",
        "Ciclo Categoria", where=with_promo_cycle),
    "modalidad_venta": Report(
        "ventas", "modality cat", "Ingresos Unidades", "-Unidades", where=only_promos),
    "pen_cat_v": Report(
        "ventas", "cat",
        "Unidades_total=Unidades Unidades_promo=Und_con_codigo Unidades_sin_promo=Und_sin_codigo "
        "Ingresos_total=Ingresos Ingresos_promo=Ing_codigo_no_vacio", "-Unidades_total"),
    "promo_por_cat_ciclo": Report(
        "ventas", "cat promo month", "Ingresos Unidades Tiendas=N_tiendas Mg_pct",
        "Categoria Promo Anio_mes", where=only_promos),
    "penetracion_prod": Report(
        "promo_prod", "prod cat",
        _PROMO_SPLIT + " Ing_promo Ing_sin_promo Ingresos Costo_promo Costo_sin_promo",
        "-Ingresos", above=("Cant_total", 0)),
    "penetracion_mes": Report(
        "promo_prod", "month", _PROMO_SPLIT + " Ing_promo Ing_sin_promo Ingresos", "Anio_mes"),
    "penetracion_cat": Report(
        "promo_prod", "cat", _PROMO_SPLIT + " Penetracion_ing Ingresos", "-Penetracion"),
    "penetracion_cat_mes": Report(
        "promo_prod", "cat month", "Penetracion", "Categoria Anio_mes"),
    "mg_cat_mes": Report("ventas", "sin_cat month", "Mg_pct Ingresos", "Categoria Anio_mes"),
    "desc_mg_prod": Report(
        "productos", "prod cat", "Desc_pct Mg_pct Ingresos Unidades", "-Ingresos",
        above=("Ingresos", 10000)),
    "cat_promo_cross": Report(
        "ventas", "sin_cat", "Ingresos Mix_promo Mg_pct Desc_pct", "-Ingresos"),
    "precio_gap": Report(
        "ventas", "month sin_cat", "Precio_lista Precio_ef Gap_pct=Desc_pct Ingresos",
        "Anio_mes Categoria"),
    "yoy_mes": Report(
        "ventas", "month year month_no", "Ingresos Unidades Margen Mg_pct Mix_promo", "Anio_mes"),
    "yoy_cat": Report(
        "ventas", "cat year", "Ingresos Unidades Margen Mg_pct", "Categoria Anio"),
    "sku_ranking": Report(
        "productos", "prod cat",
        "Ingresos Unidades Margen Mg_pct Precio_lista Precio_ef Desc_pct Primer_mes Ultimo_mes",
        "-Ingresos", 500, ("Ingresos", 0)),
    "price_ladder": Report(
        "productos", "prod cat", "Precio_ef Precio_lista Ingresos Unidades Mg_pct",
        "Categoria Precio_ef", above=("Ingresos", 10000)),
    "cobertura_prod": Report(
        "ventas", "cat", "N_tiendas Ingresos Unidades Mg_pct Desc_pct", "-N_tiendas",
        above=("Ingresos", 0)),
}


def margin_compression(tables: Rollups, limit: int = 200) -> DataFrame:
    """Price, cost and margin in a product's first and last month, and how they moved.

    Monthly figures come first, so the second aggregation sees at most one row per product and
    month, however hot a product is.  ``min_by``/``max_by`` keep a NULL figure of the first or
    last month, as an ordered FIRST/LAST does.
    """
    figures = ("Precio_ef", "Costo_unit", "Mg_pct")
    monthly = run_report(
        tables, Report("productos", "prod cat month", "Precio_ef Costo_unit Mg_pct"))
    ends = monthly.groupBy("Producto", "Categoria").agg(
        F.count("Anio_mes").alias("n_meses"),
        *[F.min_by(c, month_key()).alias(f"a_{c}") for c in figures],
        *[F.max_by(c, month_key()).alias(f"z_{c}") for c in figures],
    )
    ends = ends.select("Producto", "Categoria", "n_meses", *[
        F.struct(*[F.col(f"{end}_{c}").alias(c) for c in figures]).alias(end) for end in ("a", "z")])
    rows = ends.where("n_meses >= 3 AND a.Costo_unit > 0 AND a.Precio_ef > 0")

    def change(name: str) -> Column:
        return F.round(over(F.col(f"z.{name}") - F.col(f"a.{name}"), F.col(f"a.{name}")) * 100, 1)

    out = rows.select(
        "Producto", "Categoria", "n_meses",
        F.round("a.Precio_ef", 0).alias("Precio_inicio"),
        F.round("z.Precio_ef", 0).alias("Precio_fin"),
        F.round("a.Costo_unit", 0).alias("Costo_inicio"),
        F.round("z.Costo_unit", 0).alias("Costo_fin"),
        change("Precio_ef").alias("Cambio_precio_pct"),
        change("Costo_unit").alias("Cambio_costo_pct"),
        F.round(F.col("a.Mg_pct") * 100, 1).alias("Mg_inicio_pct"),
        F.round(F.col("z.Mg_pct") * 100, 1).alias("Mg_fin_pct"),
        F.round(F.col("z.Mg_pct") - F.col("a.Mg_pct"), 3).alias("Delta_mg"),
    )
    return sorted_by(out, "Delta_mg", ["Producto", "Categoria"]).limit(limit)


def _best(monthly: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The keys with the highest revenue over all months.  The test of the month, which always holds,
    keeps the column in the plan, so that both uses of the monthly rows share one shuffle."""
    sums = monthly.groupBy(*keys).agg(
        F.sum("Ingresos").alias("Ingresos"), F.count("Anio_mes").alias("_meses"))
    return sorted_by(sums.where("_meses > 0"), "-Ingresos", keys).limit(top)


def promo_heatmap(tables: Rollups, top: int = 20) -> DataFrame:
    """Revenue per month of the labels behind the ``top`` best-selling promo rows.

    The table is aggregated once, by promo, code and month; the top rows (at most ``top``) come out
    of that and are broadcast.
    """
    fine = run_report(tables, Report("ventas", "promo promo_code month", "Ingresos", where=only_promos))
    best = _best(fine, ["Promo", "Cod_promo"], top)
    monthly = fine.groupBy("Promo", "Anio_mes").agg(F.sum("Ingresos").alias("Ingresos"))
    # An inner join on distinct labels: a semi-join would be pushed below the aggregation.
    kept = monthly.join(F.broadcast(best.select("Promo").distinct()), "Promo")
    return sorted_by(kept, "Promo Anio_mes")


def store_heatmap(tables: Rollups, top: int = 20) -> DataFrame:
    """Revenue per month of the ``top`` stores."""
    monthly = run_report(tables, Report("ventas", "store month", "Ingresos", where=with_store))
    best = _best(monthly, ["Tiendas"], top)
    kept = monthly.join(F.broadcast(best.select("Tiendas")), "Tiendas")
    return sorted_by(kept, "Tiendas Anio_mes")


def ticket_by_month(tables: Rollups) -> DataFrame:
    """Revenue and tickets with and without promo per month, with the three ticket averages."""
    income = run_report(tables, Report(
        "ventas", "month",
        "Ing_promo=Ing_con_codigo Ing_sin_promo=Ing_sin_codigo Ing_total=Ingresos"))
    counts = run_report(tables, Report(
        "tickets", "month", "Tkts_total=Tickets Tkts_promo=Tkt_promo"))
    plain = F.col("Tkts_total") - F.col("Tkts_promo")
    both = income.join(counts, "Anio_mes").withColumn("Tkts_sin_promo", plain)
    out = both.withColumns({
        "Tkt_con_promo": over(F.col("Ing_promo"), F.col("Tkts_promo")),
        "Tkt_sin_promo": over(F.col("Ing_sin_promo"), plain),
        "Tkt_promedio": over(F.col("Ing_total"), F.col("Tkts_total")),
    })
    return sorted_by(out, "Anio_mes")


def ticket_by_category(tables: Rollups) -> DataFrame:
    """Promo revenue per category against all promo tickets and all promo revenue."""
    income = run_report(tables, Report(
        "ventas", "cat",
        "Ing_promo=Ing_con_codigo Ing_sin_promo=Ing_sin_codigo Ing_total=Ingresos"))
    promo_tickets = tables.tickets.agg(total("n_tkt_promo")).scalar()
    all_promo = beside(income, promo=total("Ing_promo")).getField("promo")
    out = income.withColumns({
        "Tkt_con_promo_ref": over(F.col("Ing_promo"), promo_tickets),
        "Ing_promo_total": all_promo,
        "Mix_cat_promo": over(F.col("Ing_promo"), all_promo),
    })
    return sorted_by(out, "-Ing_promo", ["Categoria"])


def export_summary(tables: Rollups, ordered: bool = True) -> DataFrame:
    """Month, store, category, type and system summary for export, in that order.  The sales are shuffled
    once: to the month's partition, where they are grouped and sorted."""
    out = run_report(tables, Report(
        "ventas", "month store cat type system",
        "Ingresos Unidades Costo Margen Mg_pct Descuento Promos_distintas=N_promos"),
        place=by_month if ordered else None)
    out = in_order(out, ["Categoria", "Tipo", "Sistema"]) if ordered else out
    return out.select(
        "Anio_mes", "Tiendas", "Categoria", "Tipo", "Sistema", "Ingresos", "Unidades", "Costo",
        "Margen", F.round(F.col("Mg_pct") * 100, 2).alias("Margen_pct"), "Descuento",
        "Promos_distintas",
    )


def promo_drill_months(ventas: DataFrame, promo: str | None = None) -> DataFrame:
    """Monthly evolution of one promo label, or of every label at once when none is given."""
    rows = ventas.withColumn("Promo", promo_label())
    if promo is not None:
        rows = rows.where(F.col("Promo") == promo)
    out = rows.groupBy("Promo", "Anio_mes").agg(
        *measures("Ingresos Unidades Tiendas=N_tiendas Mg_pct ROI"))
    return sorted_by(out, "Promo Anio_mes")


def promo_drill_stores(ventas: DataFrame, promo: str, limit: int = 20) -> DataFrame:
    """Best stores of one promo label."""
    rows = ventas.where(promo_label() == promo)
    out = rows.groupBy("Tiendas").agg(*measures("Ingresos Mg_pct"))
    return sorted_by(out, "-Ingresos", ["Tiendas"]).limit(limit)


_SHAPED: dict[str, Callable[[Rollups], DataFrame]] = {
    "compresion": margin_compression,
    "heatmap_promo": promo_heatmap,
    "heat_tiendas": store_heatmap,
    "ticket_promo_mes": ticket_by_month,
    "ticket_promo_cat": ticket_by_category,
    "resumen_export": export_summary,
}

REPORT_NAMES = [*REPORTS, *_SHAPED]


def report(tables: Rollups, name: str, ordered: bool = True) -> DataFrame:
    """Any report by name; lazy, but for the numbers of months and stores that distinct counts need once
    for a set of tables.  ``ordered=False`` saves the final sort where the report feeds another
    plan (a limited report needs it all the same)."""
    if name == "resumen_export":
        return export_summary(tables, ordered)
    if name in _SHAPED:
        return _SHAPED[name](tables)
    return run_report(tables, REPORTS[name], ordered)


def all_reports(tables: Rollups) -> dict[str, DataFrame]:
    """Every report of one filtered set of rollups, as lazy DataFrames."""
    return {name: report(tables, name) for name in REPORT_NAMES}
