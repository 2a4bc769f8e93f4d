"""Header figures, monthly evolution and category health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gondola.functions import bands
from gondola.functions.measures import over
from gondola.functions.whole import one_row, share_of_total
from gondola.operators.filters import FilterSpec, filter_months
from gondola.plans.reports import sorted_by


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def header_kpis(kpis_v: DataFrame, kpis_t: DataFrame) -> DataFrame:
    """One row of header figures; a missing figure counts as zero.

    ``markup`` is revenue minus cost over revenue, as the header has always shown it.
    """
    t = one_row(kpis_t)
    income = F.col("ing")
    return kpis_v.select(
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ing", "und", "costo", "margen")],
        _or_zero(F.col("mg_pct")).alias("mg_pct"),
        _or_zero(1 - over(F.coalesce("costo", F.lit(0)), income)).alias("markup"),
        F.coalesce(t.getField("tkt"), F.lit(0)).alias("tickets"),
        F.coalesce(t.getField("tiendas"), F.lit(0)).alias("tiendas"),
        _or_zero(over(income, t.getField("tkt"))).alias("ticket_prom"),
        _or_zero(over(F.col("ing_promo"), income)).alias("mix_promo"),
        _or_zero(F.col("desc_pct")).alias("desc_pct"),
        F.coalesce("desc_total", F.lit(0)).alias("desc_total"),
        "n_promos",
    )


def period(ventas: DataFrame, spec: FilterSpec) -> DataFrame:
    """First, last and number of months the specification leaves of the stored ones."""
    months = filter_months(ventas.select("Anio_mes").distinct(), spec)
    return months.agg(
        F.count("Anio_mes").alias("Meses"),
        F.min("Anio_mes").alias("Primer_mes"),
        F.max("Anio_mes").alias("Ultimo_mes"),
    )


def monthly_evolution(evol_v: DataFrame, evol_t: DataFrame) -> DataFrame:
    return sorted_by(evol_v.join(evol_t, "Anio_mes", "left"), "Anio_mes")


def category_health(treemap: DataFrame) -> DataFrame:
    out = treemap.withColumns({
        "Pct_total": share_of_total(treemap, "Ingresos"),
        "Estado": bands.category_health(F.col("Mg_pct")),
    })
    return sorted_by(out, "-Ingresos", ["Categoria"])


def margin_composition(prod_mg: DataFrame) -> DataFrame:
    """Products that add margin, for the category/product breakdown."""
    return prod_mg.where("Margen > 0").select(
        "Categoria", "Producto", "Codigo", "Margen", "Mg_pct", "Ingresos")
