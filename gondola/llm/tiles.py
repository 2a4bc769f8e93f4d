"""Vectors in tiles: rows near each other in a few thousand rows each, packed as one row of a table.

Rows (row, id, label, vector) become tiles by sort-tile-recursive slabs: quantiles of the label, then of
two coordinates within it.  What quantiles cannot part (equal values, tables beyond the largest number of
slabs) is dealt to chunks by a hash of the row, so a tile holds about ``tile_rows`` rows whatever the data.
Tiles are numbered in the order of their slabs.  Queries travel in blocks to the tiles they have to see;
a task reads one tile and then its blocks, one after another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gondola.llm.common import Scratch

TILE_ROWS = 4_096
#: Slabs of an axis: with three axes the cuts are 32 * 32 rows of 32 numbers at most, a quarter of a MB.
MAX_SLABS = 32
#: Stands for a null id, which sorts last.
NO_ID = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null or not finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def tiled(scratch: Scratch, rows: DataFrame, labelled: bool, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``rows`` with ``dim``, the number of their ``tile`` and the first and last tile, ``first`` and
    ``last``, of rows that can have their label.  Vectors of different length share no tile."""
    rows = rows.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()})
    rows = scratch.write("rows", rows)
    count = max(1, math.ceil(rows.count() / tile_rows))
    kinds = min(MAX_SLABS, count) if labelled else 1
    sides = min(MAX_SLABS, math.ceil(math.sqrt(count / kinds)))
    out = _cut(rows.withColumn("slab", F.lit(0)), F.col("label").cast("double"), 1, kinds)
    out = out.withColumn("kind", F.col("slab"))
    for axis in (1, 2):
        value = F.coalesce(F.try_element_at("vector", F.lit(axis)), F.lit(0.0))
        out = _cut(out, value, kinds * sides ** (axis - 1), sides)
    out = scratch.write("slabs", out)
    chunks = out.groupBy("dim", "kind", "slab").agg(F.ceil(F.count("*") / tile_rows).alias("chunks"))
    kind = Window.partitionBy("dim", "kind")  # over slabs, not rows: their number is bounded
    chunks = chunks.withColumn("next", F.sum("chunks").over(Window.orderBy("dim", "slab"))).withColumn(
        "offset", F.col("next") - F.col("chunks")).select(
        F.col("dim").alias("_dim"), F.col("slab").alias("_slab"), "chunks", "offset",
        F.min("offset").over(kind).alias("first"), (F.max("next").over(kind) - 1).alias("last"))
    return out.join(chunks, (F.col("dim") == F.col("_dim")) & (F.col("slab") == F.col("_slab"))).select(
        *rows.columns, "first", "last",
        (F.col("offset") + F.pmod(F.xxhash64("row"), F.col("chunks"))).alias("tile"))


def _cut(rows: DataFrame, axis: Column, slabs: int, parts: int) -> DataFrame:
    """``rows`` with each of their ``slabs`` cut by quantiles of ``axis`` within it; equal values stay together."""
    if parts < 2:
        return rows
    at = F.percentile_approx(axis, [k / parts for k in range(1, parts)], 2_000).alias("cuts")
    if slabs == 1:
        cuts = rows.agg(at).first()["cuts"] or []
        return rows.withColumn("slab", F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < axis)))
    cuts = rows.groupBy(F.col("slab").alias("_slab")).agg(at)
    met = rows.join(F.broadcast(cuts), F.col("slab") == F.col("_slab"))  # MAX_SLABS ** 2 rows at most
    below = F.size(F.filter("cuts", lambda c: c < axis))
    return met.withColumn("slab", F.col("slab") * parts + below).drop("_slab", "cuts")


PACKED = "tile long, dim int, ids binary, labels binary, vectors binary"


def pack(part: pd.DataFrame) -> dict:
    """One tile or block as columns of ``PACKED``; null ids as ``NO_ID``, null labels as 0."""
    ids = np.array([NO_ID if pd.isna(i) else int(i) for i in part["id"]], dtype=np.int64)
    labels = np.array([0 if pd.isna(x) else int(x) for x in part["label"]], dtype=np.int64)
    vectors = np.array(part["vector"].tolist(), dtype=np.float64)
    return {"tile": int(part["tile"].iloc[0]), "dim": int(part["dim"].iloc[0]), "ids": ids.tobytes(),
            "labels": labels.tobytes(), "vectors": vectors.tobytes()}


def unpack(record: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors (one a row)."""
    return (np.frombuffer(record["ids"], dtype=np.int64), np.frombuffer(record["labels"], dtype=np.int64),
            np.frombuffer(record["vectors"], dtype=np.float64).reshape(-1, record["dim"]))


def visit(tiles: DataFrame, blocks: DataFrame, first: Column, last: Column, build: Callable,
          search: Callable[..., Iterator[dict]], out: str) -> DataFrame:
    """Rows of schema ``out`` that ``search(build(tile), block)`` yields for every block and every tile of
    its own ``dim`` numbered from ``first`` to ``last`` of the block.

    A tile is shuffled once.  Blocks (their columns besides ``tile`` are those of ``tiles`` and more) are
    sent to each tile they visit and stream past it, so a task holds one tile and one batch of blocks.
    """
    more = [c for c in blocks.columns if c not in tiles.columns]
    types = dict(blocks.dtypes)
    stops = blocks.withColumn("tile", F.explode(F.sequence(first, last))).withColumn("visits", F.lit(True))
    parts = tiles.withColumns({**{c: F.lit(None).cast(types[c]) for c in more}, "visits": F.lit(False)})
    names = [*tiles.columns, *more, "visits"]
    stream = parts.select(names).unionByName(stops.select(names)).repartition("tile").sortWithinPartitions(
        "tile", "visits")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile = index = dim = None
        for part in parts:
            for record in part.to_dict("records"):
                if not record["visits"]:
                    tile, dim, index = record["tile"], record["dim"], build(record)
                elif record["tile"] == tile and record["dim"] == dim:
                    found = list(search(index, record))
                    if found:
                        yield pd.DataFrame(found)

    return stream.mapInPandas(run, out)
