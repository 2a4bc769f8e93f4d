"""Approximate nearest neighbours by collision counting: the greatest inner products with every query.

Vectors get one more coordinate, so that all have the length of the longest; then the greatest inner
product is the least distance.  A vector is projected on ``projections`` random directions and a tile
(``tiles``) keeps one sorted array of each.  A query opens a window around its own projection in every
array and counts how often a vector falls in one; vectors with as many collisions as a near one would have
are verified, that is scored on the original vectors.  Windows then widen (virtual rehashing: the arrays
stay, only ends of windows move and only what is new is counted) until they fit the distance of the k-th
best found.  A query is first searched in its own tile; the k-th distance there is the widest radius that
the other tiles need.  Tiles whose projections lie outside the windows have no collisions and verify nothing.

The threshold of collisions is the least for which a vector at the radius misses with a chance of ``miss``
at most, nearer ones with a smaller one; nothing else is left out.  No step caps the candidates.

Defined results: vectors that are null, empty, zero, or hold a component that is null or not finite, or
whose length is beyond double precision, take no part.  Rows with the id of the query are the query itself;
a repeated row else counts as often as it occurs, and a repeated query is a query each time.  A null id is
no query and sorts last.  Vectors of different length do not meet.  Columns besides id and vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gondola.llm.common import Scratch, ship
from gondola.llm.tiles import NO_ID, PACKED, TILE_ROWS, pack, tiled, unpack, usable, visit

BLOCK_ROWS = 256
PROJECTIONS = 32
#: Half the width of a window, in radii.
WIDTH = 1.0
MISS = 0.15
#: Growth of the radius from one rehashing to the next.
GROWTH = 1.25
SEED = 20
#: Between the arrays of two projections.  Vectors are as long as 1 and directions as sqrt(dim), so this
#: holds any of them for vectors of up to a million components.
APART = 4_096.0
FOUND = "row long, query_id long, other long, score double"
#: A tile with the queries in it, as blocks, and what they find within it.
TILE = f"{PACKED}, blocks array<struct<rows: binary, floors: binary, ids: binary, labels: binary, " \
       "vectors: binary>>, home array<struct<row: long, query_id: long, other: long, score: double>>"


def directions(dim: int, count: int) -> np.ndarray:
    """``count`` random directions of ``dim`` coordinates: seeded, orthogonal as far as ``dim`` allows, and
    scaled so that the projection of a difference is as long as the difference, in the mean of squares."""
    rng, parts = np.random.default_rng(SEED), []
    while sum(map(len, parts)) < count:
        parts.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0].T * math.sqrt(dim))
    return np.concatenate(parts)[:count]


def threshold(projections: int, width: float, miss: float) -> int:
    """Collisions that a vector at the radius has with a chance of 1 - ``miss`` or more."""
    hit = 2 * NormalDist().cdf(width) - 1
    at = projections * hit + NormalDist().inv_cdf(miss) * math.sqrt(projections * hit * (1 - hit))
    return max(1, math.floor(at))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed in one order for every row, so that equal vectors have equal scores."""
    return (vectors * query).sum(axis=1)


class CollisionIndex:
    """Sorted projections of the vectors of one tile; ``longest`` is the length all are filled up to."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, projections: int = PROJECTIONS,
                 width: float = WIDTH, miss: float = MISS):
        self.ids, self.vectors, self.longest, self.width = ids, vectors, longest, width
        self.planes = directions(vectors.shape[1] + 1, projections)
        rest = 1.0 - np.square(vectors / longest).sum(axis=1)
        full = np.column_stack([vectors / longest, np.sqrt(np.maximum(rest, 0.0))])
        shadows = full @ self.planes.T
        order = np.argsort(shadows, axis=0, kind="stable")
        # One array after the other, each with its own offset, so that one search finds all windows.
        self.offsets = np.arange(len(self.planes)) * APART
        self.order = np.ascontiguousarray(order.T).ravel()
        self.sorted = (np.take_along_axis(shadows, order, axis=0).T + self.offsets[:, None]).ravel()
        self.ends = np.arange(len(self.planes) + 1) * len(ids)
        self.needed = threshold(projections, width, miss)

    def distance(self, score: float, query: np.ndarray) -> float:
        """Distance in units of ``longest`` that belongs to an inner product with ``query``."""
        length = math.sqrt(float(np.square(query / self.longest).sum()))
        return math.sqrt(max(0.0, 2.0 - 2.0 * (score / self.longest / self.longest) / length))

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -math.inf) -> list[tuple[float, int]]:
        """The best ``k`` (score, id) found among rows of other ids with a score of ``floor`` or more."""
        size = len(self.ids)
        scaled = query / self.longest
        at = self.planes[:, :-1] @ (scaled / math.sqrt(float(np.square(scaled).sum()))) + self.offsets
        widest = self.distance(floor, query) if floor > -math.inf else math.inf
        counts, fresh = np.zeros(size, dtype=np.int64), self.ids != own
        left = right = np.searchsorted(self.sorted, at)
        best: list[tuple[float, int]] = []
        goal, radius = widest, min(widest / GROWTH ** 2, 0.5 * GROWTH ** 2)
        while True:
            reach = min(self.width * radius * (1 + 1e-12), APART / 2)
            low = np.maximum(np.searchsorted(self.sorted, at - reach), self.ends[:-1])
            high = np.minimum(np.searchsorted(self.sorted, at + reach), self.ends[1:])
            parts = [self.order[a:b] for a, b in zip([*low, *right], [*left, *high])]
            left, right = np.minimum(left, low), np.maximum(right, high)
            counts += np.bincount(np.concatenate(parts), minlength=size)
            if math.isinf(radius):  # fewer than k rows came near: all that are left
                chosen = np.flatnonzero(fresh)
            else:
                chosen = np.flatnonzero(fresh & (counts >= self.needed))
            if len(chosen):
                fresh[chosen] = False
                least = max(floor, best[-1][0]) if len(best) == k else floor
                about = self.vectors[chosen] @ query
                chosen = chosen[about >= least - 1e-9 * abs(least)] if math.isfinite(least) else chosen
                scores = products(self.vectors[chosen], query)
                good = scores >= least
                best = sorted([*best, *zip(scores[good].tolist(), self.ids[chosen][good].tolist())],
                              key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k:
                goal = min(widest, self.distance(best[-1][0], query))
            if radius >= goal or not fresh.any():
                return best
            radius = math.inf if radius > 4 and math.isinf(goal) else min(radius * GROWTH, goal)


def nearest(spark: SparkSession, rows: DataFrame, query: Column, k: int = 20, tile_rows: int = TILE_ROWS,
            projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest found for every row (id, vector) that meets ``query``."""
    ship(spark)
    scratch = Scratch(spark, "neighbours")
    vector = F.col("vector").cast("array<double>")
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))
    rows = rows.where(usable(F.col("vector"))).select(
        F.col("id").cast("long"), F.lit(0).cast("long").alias("label"), vector.alias("vector"),
        F.coalesce(query, F.lit(False)).alias("query"), length.alias("length"))
    rows = rows.where((F.col("length") > 0) & (F.col("length") < 1e150))
    placed = scratch.write("placed", tiled(scratch, rows, labelled=False, tile_rows=tile_rows))
    bounds = placed.agg(F.max("length"), F.max("tile")).first()
    if bounds[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    longest, last = float(bounds[0]), int(bounds[1])

    def build(record: dict) -> CollisionIndex:
        ids, _, vectors = unpack(record)
        return CollisionIndex(ids, vectors, longest, projections, width, miss)

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        """A tile, the queries in it with what they find within it, and these as blocks."""
        tile = pack(part)
        index, chosen, home, floors = build(tile), part[part["query"]], [], []
        ids, _, vectors = unpack(pack(chosen)) if len(chosen) else ((), (), ())
        for row, own, vector in zip(chosen["row"], ids, vectors):
            best = index.search(vector, int(own), k)
            home += [{"row": int(row), "query_id": int(own), "other": other, "score": s} for s, other in best]
            floors.append(best[-1][0] if len(best) == k else -math.inf)
        blocks = []
        for start in range(0, len(chosen), BLOCK_ROWS):
            some = chosen.iloc[start:start + BLOCK_ROWS]
            blocks.append({"rows": some["row"].to_numpy(np.int64).tobytes(),
                           "floors": np.array(floors[start:start + BLOCK_ROWS]).tobytes(),
                           **{c: v for c, v in pack(some).items() if c in ("ids", "labels", "vectors")}})
        return pd.DataFrame([{**tile, "blocks": blocks, "home": home}])

    table = scratch.write("tiles", placed.groupBy("tile").applyInPandas(packed, TILE))
    blocks = table.select(F.col("tile").alias("own"), "dim", F.explode("blocks").alias("b")).select(
        "own", "dim", "b.*")

    def others(index: CollisionIndex, block: dict) -> Iterator[dict]:
        if block["own"] == block["tile"]:
            return  # searched when it was packed
        ids, _, vectors = unpack(block)
        for row, own, vector, floor in zip(
                np.frombuffer(block["rows"], dtype=np.int64), ids, vectors, np.frombuffer(block["floors"])):
            for score, other in index.search(vector, int(own), k, float(floor)):
                yield {"row": int(row), "query_id": int(own), "other": other, "score": score}

    found = visit(table.drop("blocks", "home"), blocks, F.lit(0), F.lit(last), build, others, FOUND)
    found = found.unionByName(table.select(F.inline("home")))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.nullif("other", F.lit(NO_ID)).alias("id"), "score")
