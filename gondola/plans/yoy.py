"""Year against year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gondola.functions.measures import over
from gondola.functions.whole import beside
from gondola.plans.reports import sorted_by


def _change(now: Column, before: Column) -> Column:
    return over(now, before) - 1


def yoy_totals(yoy_mes: DataFrame) -> DataFrame:
    """Totals of the last two years present and their change; no row with a single year.

    The window runs over one row per year.
    """
    per_year = yoy_mes.groupBy("Anio").agg(
        *[F.sum(c).alias(c) for c in ("Ingresos", "Margen", "Unidades")])
    years = Window.orderBy("Anio")
    before = {f"{c}_prev": F.lag(c).over(years) for c in ("Anio", "Ingresos", "Margen", "Unidades")}
    last = per_year.withColumns(before).orderBy(F.col("Anio").desc()).limit(1)
    changes = {
        f"Var_{c}": F.coalesce(_change(F.col(c), F.col(f"{c}_prev")), F.lit(0.0))
        for c in ("Ingresos", "Margen", "Unidades")
    }
    return last.where("Anio_prev IS NOT NULL").withColumns(changes)


def yoy_by_category(yoy_cat: DataFrame) -> DataFrame:
    """Revenue of the last two years per category; a category new this year has no change.

    Both years come out of one conditional aggregation, which gives the rows of a full outer join
    of the two years without reading the report twice.  The list of years is as short as the history.
    """
    years = beside(yoy_cat, years=F.sort_array(F.collect_set("Anio"), asc=False)).getField("years")
    last, prev = F.try_element_at(years, F.lit(1)), F.try_element_at(years, F.lit(2))
    rows = yoy_cat.withColumns({"_last": last, "_prev": prev}).where(
        "_prev IS NOT NULL AND Anio IN (_last, _prev)")

    def income(year: str) -> Column:
        return F.sum(F.when(F.col("Anio") == F.col(year), F.col("Ingresos")).otherwise(F.lit(0)))

    out = rows.groupBy("Categoria").agg(
        income("_last").alias("Ing_last"), income("_prev").alias("Ing_prev"))
    out = out.withColumn("Var_pct", _change(F.col("Ing_last"), F.col("Ing_prev")))
    return sorted_by(out, "-Var_pct", ["Categoria"])
