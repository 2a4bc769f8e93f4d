"""Rollup tables: the five-table bundle and its reader."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from gondola.functions.bits import Dimension
from gondola.schema import ROLLUPS, rollup_schema
from gondola.sources.versions import Snapshot, read_version, snapshot


@dataclass(frozen=True)
class Rollups:
    """The additive tables every report is computed from."""

    ventas: DataFrame
    productos: DataFrame
    tickets: DataFrame
    promo_prod: DataFrame
    ventas_dia: DataFrame
    held: tuple[DataFrame, ...] = ()  # key sets cached for a filtered set
    dimensions: dict[str, Dimension] = field(default_factory=dict)  # of the sales before any filter
    shared: object = None  # sub-aggregates that answer reports (plans.lattice)
    months: dict[str, tuple[str, ...]] = field(default_factory=dict)  # of the folders each table is read from
    narrowed: bool = False  # whether rows of those months were left out by more than their month

    def with_tables(self, **tables: DataFrame) -> "Rollups":
        return replace(self, **tables)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def dimension(self, column: str) -> Dimension:
        """Numbers of the months or stores of the sales; kept where ``numbered`` was called."""
        return self.dimensions.get(column) or Dimension(self.ventas, column)

    def numbered(self) -> "Rollups":
        """The same tables, which number their months and stores once and keep that through filters."""
        return replace(self, dimensions={c: Dimension(self.ventas, c) for c in ("Anio_mes", "Tiendas")})

    def holding(self, keys: list[DataFrame]) -> "Rollups":
        return replace(self, held=(*self.held, *keys))

    def release(self) -> None:
        """Drop the cached key sets of a filtered set; its tables can be used on and are then
        filtered by recomputed sets."""
        for keys in self.held:
            keys.unpersist()

    def __enter__(self) -> "Rollups":
        return self

    def __exit__(self, *error) -> None:
        self.release()


def read_rollup(
    spark: SparkSession, folder: str, name: str, state: Snapshot | None = None,
) -> DataFrame:
    """One stored rollup in schema column order; a table never written reads as empty.

    Tables to be used together take one ``state`` of their folder, so that all are of the same batch.
    """
    schema = rollup_schema(name)
    table = read_version(spark, folder, name, (state or snapshot(spark, folder)).of(name))
    if name == "productos":
        # Tables written before the list price existed fall back to net revenue.
        table = table.withColumn("Precio_x_Cant", F.coalesce("Precio_x_Cant", "Importe"))
    if name == "tickets":
        table = table.where(F.col("Tiendas").isNotNull())  # rows of tables without a manifest
    return table.select(*schema.names)


def read_rollups(spark: SparkSession, folder: str, number: int | None = None) -> Rollups:
    """All five rollups of one snapshot of a folder: the current one, or an earlier one by its number."""
    state = snapshot(spark, folder, number)
    months = {name: tuple(sorted(state.of(name))) for name in ROLLUPS}
    return Rollups(**{name: read_rollup(spark, folder, name, state) for name in ROLLUPS}, months=months)
