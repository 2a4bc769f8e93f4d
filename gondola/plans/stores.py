"""Store ranking and category coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gondola.functions.measures import over
from gondola.functions.whole import beside
from gondola.operators.filters import complete
from gondola.plans.reports import sorted_by


def store_ranking(tiendas_v: DataFrame, tiendas_t: DataFrame, n: int = 15) -> DataFrame:
    """Top stores by revenue with their tickets.

    The limit comes before the join, which neither drops nor repeats a store: ``n`` rows meet a
    table that its own aggregation has already partitioned by store.
    """
    top = sorted_by(tiendas_v, "-Ingresos", ["Tiendas"]).limit(n)
    out = top.join(tiendas_t, "Tiendas", "left")
    ticket = over(F.col("Ingresos"), F.col("Tickets"))
    return sorted_by(out.withColumn("Ticket_prom", ticket), "-Ingresos", ["Tiendas"])


def store_means(ranking: DataFrame) -> DataFrame:
    return ranking.agg(
        F.count(F.lit(1)).alias("Tiendas"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in ("Ingresos", "Mg_pct", "Mix_promo")],
    )


def store_scatter(ranking: DataFrame) -> DataFrame:
    return complete(ranking, ["Precio_ef", "Ticket_prom"])


def category_coverage(cobertura_prod: DataFrame) -> DataFrame:
    """Stores per category against the best covered category."""
    most = beside(cobertura_prod, n=F.max("N_tiendas")).getField("n")
    out = cobertura_prod.withColumn("Cobertura_pct", over(F.col("N_tiendas"), most))
    return sorted_by(out, "-N_tiendas", ["Categoria"])
