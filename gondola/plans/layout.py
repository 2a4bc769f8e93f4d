"""Whole tables in order without a sort of the whole."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from gondola.operators.filters import known_months
from gondola.sources.rollups import Rollups


#: Column with the partition of a row.
PLACE = "_lugar"


def by_month(rows: DataFrame, tables: Rollups) -> DataFrame:
    """``rows`` of the sales dealt out to one partition for each month, in the order of the months, with its
    number as a column.  Grouped by it, the month, the store and more, they need no further shuffle.

    The months are known from the folders: ``orderBy`` would run the report a first time to sample its ranges.
    With more shuffle partitions than months a month is split further, by the numbers of its stores, which are
    in their order.
    """
    months = known_months(tables, "ventas")
    place = F.array_position(F.lit(months).cast("array<string>"), F.col("Anio_mes"))
    unknown = F.raise_error(F.concat(F.lit("a month without a folder: "), F.col("Anio_mes"))).cast("int")
    place = F.when(F.col("Anio_mes").isNull(), len(months)).when(place == 0, unknown).otherwise(place - 1)
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, math.ceil(wanted / (len(months) + 1)))
    part, placed = F.lit(0), rows
    if parts > 1:
        stores = tables.dimension("Tiendas")
        placed = stores.numbered(rows)
        share = F.floor(F.col(stores.number) * F.lit(parts) / F.lit(stores.size()))
        part = F.coalesce(share, F.lit(parts - 1))
    number = (place * parts + part).cast("int")
    return placed.select(*rows.columns, number.alias(PLACE)).repartitionById(
        (len(months) + 1) * parts, F.col(PLACE))


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows placed ``by_month``, sorted by month, store and the other columns of ``order``, NULLs last, within
    their partitions.  Partitions, and so files, are in order; files read by name give the whole table in order."""
    return rows.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in ("Anio_mes", "Tiendas", *order)])
