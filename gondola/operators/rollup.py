"""Aggregation of sales lines into the five additive rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gondola.functions.cycles import attach_cycle
from gondola.operators.normalize import with_week
from gondola.schema import MEASURES, ROLLUP_AMOUNT, ROLLUP_KEYS


def _sums() -> list[Column]:
    return [F.sum(m).cast(ROLLUP_AMOUNT).alias(m) for m in MEASURES]


def additive_rollup(lines: DataFrame, name: str, part: list[str] | None = None) -> DataFrame:
    """One pass: partial sums in the scan tasks, one shuffle of partial rows, final sums.

    A key that holds a third of the lines arrives at its reducer as one row per map task.  Lines that are
    dealt out already, by the column ``part`` that follows from the keys, are summed where they are.
    ``productos`` may be built from ``promo_prod`` as well as from lines, since its keys are a
    subset of that table's keys.
    """
    return lines.groupBy(*(part or []), *ROLLUP_KEYS[name]).agg(*_sums())


#: Grouping columns of the detail that the sales and daily rollups have in common.
DETAIL_KEYS = ["Fecha", *ROLLUP_KEYS["ventas"]]


def detail(lines: DataFrame, part: list[str] | None = None) -> DataFrame:
    """Sums per day, store, category, promo, type and system: ``ventas`` and ``ventas_dia`` are sums of
    these, so both come from one pass over the lines."""
    return lines.groupBy(*(part or []), *DETAIL_KEYS).agg(*_sums())


def daily_rollup(lines: DataFrame) -> DataFrame:
    """Rollup per day.  Month, week and cycle follow from the day, so the lines are grouped by the
    day alone and the other three are added to the result."""
    derived = ("Anio_mes", "Semana", "CicloAno_mes")
    keys = [k for k in ROLLUP_KEYS["ventas_dia"] if k not in derived]
    days = lines.groupBy(*keys).agg(*_sums())
    days = attach_cycle(with_week(days.withColumn("Anio_mes", F.substring("Fecha", 1, 7))))
    return days.select(*ROLLUP_KEYS["ventas_dia"], *MEASURES)


def ticket_rollup(lines: DataFrame) -> DataFrame:
    """Tickets and promo tickets per month and store.

    A ticket counts once per file; the first of its lines decides whether it is a promo ticket.
    Stores and ticket ids that are NULL: the store's tickets are left out, and a NULL ticket id is
    not counted as a ticket although its promo flag is.  ``min_by`` over fixed-width values keeps
    the first step a hash aggregation that combines on the map side.
    """
    file = [c for c in ("Archivo",) if c in lines.columns]
    per_ticket = (
        lines.where(F.col("Tiendas").isNotNull())
        .groupBy(*file, "Anio_mes", "Tiendas", "Transaccion")
        .agg(F.min_by("has_promo", "Orden").alias("_promo"))
    )
    return per_ticket.groupBy("Anio_mes", "Tiendas").agg(
        F.count("Transaccion").alias("n_tickets"),
        F.sum("_promo").alias("n_tkt_promo"),
    )


def build_rollup(source: DataFrame, name: str, part: list[str] | None = None) -> DataFrame:
    if name == "tickets":
        return ticket_rollup(source)
    return daily_rollup(source) if name == "ventas_dia" else additive_rollup(source, name, part)


# Column that holds the period at each grain of the daily rollup.
_GRAINS = {
    "Diario": "Fecha",
    "Semanal": "Semana",
    "Mensual": "Anio_mes",
    "Ciclo": "CicloAno_mes",
}


def period(grain: str) -> Column:
    column = F.col(_GRAINS[grain])
    return F.when(column == "", "Sin ciclo").otherwise(column) if grain == "Ciclo" else column


def roll_to_grain(daily: DataFrame, grain: str, extra: list[str] | None = None) -> DataFrame:
    """Daily rollup at day, week, month or cycle grain, optionally split by further keys."""
    keys = [c for c in (extra or []) if c in daily.columns]
    return (
        daily.groupBy(period(grain).alias("Periodo"), *keys)
        .agg(*[F.sum(m).alias(m) for m in MEASURES])
        .orderBy("Periodo", *keys)
    )
