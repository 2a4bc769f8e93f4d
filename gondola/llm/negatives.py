"""Hard-negative mining: rows of another label whose inner product with an anchor comes near a positive's.

``mine`` takes rows (id, label, vector of whole numbers) and the anchors among them.  The positives of an
anchor are its nearest other rows of the same label; the negatives of an anchor and positive are the
nearest rows of other labels within a window of scores, given in hundredths of the positive's score.
Nearness is the inner product, ties go to the smaller id.

Rows are packed into tiles of an R-tree (``tiles``, ``rtree``): the slabs of labels and coordinates are its
upper levels, each tile is a subtree with minimum bounding boxes.  A box bounds the inner product of every
row in it, coordinate by coordinate; a best-first queue takes the box with the greatest bound and leaves
boxes outside all windows, of the wrong labels, or strictly below the k-th score found.  Positives and
negatives are first searched in the anchor's own tile; the k-th score there prunes in all others.

Defined results: rows with a null label, a null or empty vector or a component that is null or not finite
take no part.  Rows that share the anchor's id are the anchor itself, and so neither its positives nor its
negatives; a repeated row else counts as often as it occurs, and a repeated anchor is an anchor each time.
A null id is no anchor and sorts last.  Vectors of different length do not meet.  Components are held to
64 bits, and so are the scores returned; the order is that of the exact scores within a tile.  Anchors
without positives, or positives without negatives, give no row.  Columns besides the three are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gondola.llm.common import Scratch, ship
from gondola.llm.rtree import EXACT, RTree
from gondola.llm.tiles import NO_ID, PACKED, TILE_ROWS, pack, tiled, unpack, usable, visit

BLOCK_ROWS = 256
LONGEST = (1 << 63) - 1
NO_FLOOR = -LONGEST - 1
FOUND = "row long, other long, score long"
#: A tile with the anchors in it, as blocks, and what they find within it.
TILE = f"{PACKED}, blocks array<struct<rows: binary, floors: binary, ids: binary, labels: binary, " \
       "vectors: binary, first: long, last: long>>, home array<struct<row: long, other: long, score: long>>"
HARD = "row long, pair int, other long, score long"
#: Anchors with their positives, and what they find in their own tile.
BLOCK_COLUMNS = ["own long", "dim int", "rows binary", "ids binary", "labels binary", "vectors binary",
                 "scores array<array<long>>", "pairs array<array<int>>", "floors array<array<long>>",
                 "home array<struct<row: long, pair: int, other: long, score: long>>"]


class Best:
    """The best ``k`` of (score, id), greatest score and then smallest id first; ``pair`` tells which."""

    def __init__(self, k: int, floor: float = -np.inf):
        self.k, self.floor, self.heap = k, floor, []

    def least(self) -> float:
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.k else self.floor

    def add(self, score, other: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -other))
        else:
            heapq.heappushpop(self.heap, (score, -other))

    def sorted(self) -> list[tuple[int, int]]:
        return [(int(score), -other) for score, other in sorted(self.heap, reverse=True)]


def quantized(vector: Column, steps: int = 256) -> Column:
    """Components as whole numbers of 1 / ``steps``, rounded down and held to 64 bits."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * steps).cast("double"))


def nearest(tree: RTree, queries: np.ndarray, own: np.ndarray, labels: np.ndarray, same: bool, k: int,
            floors: list[list], tops: list[list]) -> list[list[Best]]:
    """For each query and each of its windows of scores the best ``k`` rows of a tile, of the query's label
    or of others, besides those with its own id.  A window is closed if its floor is above its top."""
    found = [[Best(k, floor) for floor in of_query] for of_query in floors]
    exact = tree.exact(queries)
    kind = np.float64 if exact else object
    width = max(map(len, floors))
    low, high = (np.array([[*x, *[fill] * (width - len(x))] for x in of], dtype=kind)
                 for of, fill in ((floors, np.inf), (tops, -np.inf)))
    low = np.where((low > high).astype(bool), np.inf, low)

    def admits(fewest, most, small, large):
        of_label = (small <= labels) & (large >= labels) if same else ~((small == labels) & (large == labels))
        return of_label & ((fewest[:, None] <= high) & (most[:, None] >= low)).astype(bool).any(axis=1)

    for rows, active in tree.best_first(queries, admits, lambda: low.min(axis=1)):
        scores = tree.scores(rows, queries if len(active) == len(queries) else queries[active])
        if not exact:
            scores = scores.astype(object)
        good = (scores >= low[active].min(axis=1)).astype(bool) & (scores <= high[active].max(axis=1)).astype(bool)
        row, at = np.nonzero(good)
        of_label = tree.labels[rows][row] == labels[active][at]
        keep = np.flatnonzero((of_label == same) & (tree.ids[rows][row] != own[active][at]))
        row, at = row[keep], at[keep]
        value, query, ids = scores[row, at], active[at], tree.ids[rows][row]
        hit = ((value[:, None] >= low[query]) & (value[:, None] <= high[query])).astype(bool)
        for i, w in zip(*(x.tolist() for x in np.nonzero(hit))):
            best, score = found[query[i]][w], value[i]
            if score >= best.least():
                best.add(score, int(ids[i]))
                low[query[i], w] = best.least()
    return found


def held(value: int) -> int:
    return max(NO_FLOOR, min(LONGEST, int(value)))


def below(value: float) -> float:
    """The same or a little less in double precision, so that rounding lifts no floor."""
    return float(value) if abs(value) < EXACT else float(np.nextafter(float(value), -np.inf))


def mine(spark: SparkSession, rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3,
         window: tuple[int, int] = (50, 95), tile_rows: int = TILE_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (id, label,
    vector); ``anchor`` is a condition over id and label."""
    ship(spark)
    scratch = Scratch(spark, "negatives")
    rows = rows.where(F.col("label").isNotNull() & usable(F.col("vector"))).select(
        F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
    placed = scratch.write("placed", tiled(scratch, rows, labelled=True, tile_rows=tile_rows))

    def build(record: dict) -> RTree:
        return RTree(*unpack(record))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        """A tile, the anchors in it with their best positives within it, and these as blocks."""
        tile = pack(part)
        tree, chosen, home, floors = RTree(*unpack(tile)), part[part["anchor"]], [], []
        ids, labels, vectors = unpack(pack(chosen)) if len(chosen) else ((), (), ())
        anyone = [[-np.inf]] * len(chosen), [[np.inf]] * len(chosen)
        found = nearest(tree, vectors, ids, labels, True, positives, *anyone) if len(chosen) else []
        for row, (best,) in zip(chosen["row"], found):
            home += [{"row": int(row), "other": other, "score": held(s)} for s, other in best.sorted()]
            floors.append(below(best.least()))
        blocks = []
        for k in range(0, len(chosen), BLOCK_ROWS):
            some = chosen.iloc[k:k + BLOCK_ROWS]
            blocks.append({"rows": some["row"].to_numpy(np.int64).tobytes(),
                           "floors": np.array(floors[k:k + BLOCK_ROWS]).tobytes(),
                           **{c: v for c, v in pack(some).items() if c in ("ids", "labels", "vectors")},
                           "first": int(some["first"].iloc[0]), "last": int(some["last"].iloc[0])})
        return pd.DataFrame([{**tile, "blocks": blocks, "home": home}])

    table = scratch.write("tiles", placed.groupBy("tile").applyInPandas(packed, TILE))
    tiles = table.drop("blocks", "home")
    blocks = table.select(F.col("tile").alias("own"), "dim", F.explode("blocks").alias("b")).select(
        "own", "dim", "b.*")

    def others(tree: RTree, block: dict) -> Iterator[dict]:
        if block["own"] == block["tile"]:
            return  # searched when it was packed
        ids, labels, vectors = unpack(block)
        floors = np.frombuffer(block["floors"])[:, None].tolist()
        found = nearest(tree, vectors, ids, labels, True, positives, floors, [[np.inf]] * len(ids))
        for row, (best,) in zip(np.frombuffer(block["rows"], dtype=np.int64).tolist(), found):
            yield from ({"row": row, "other": other, "score": held(s)} for s, other in best.sorted())

    near = visit(tiles, blocks, F.col("first"), F.col("last"), build, others, FOUND).unionByName(
        table.select(F.inline("home")))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "other")
    near = near.withColumn("pair", F.row_number().over(order)).where(F.col("pair") <= positives)
    pairs = placed.where("anchor").select(
        "tile", "row", F.col("id").alias("anchor_id"), "label", "vector").join(near, "row").select(
        "tile", "row", "anchor_id", "label", "vector", "pair", F.col("other").alias("positive_id"),
        F.col("score").alias("positive_score"))
    pairs = scratch.write("positives", pairs)
    least, most = window

    def searched(tree: RTree, block: dict) -> Iterator[tuple[int, int, int, Best]]:
        """What each anchor and positive of a block finds in a tile: (anchor, row, pair, best)."""
        ids, labels, vectors = unpack(block)
        lows = [[max(-(-least * int(s) // 100), int(f)) for s, f in zip(*x)]
                for x in zip(block["scores"], block["floors"])]
        highs = [[most * int(s) // 100 for s in x] for x in block["scores"]]
        found = nearest(tree, vectors, ids, labels, False, negatives, lows, highs)
        for at, row in enumerate(np.frombuffer(block["rows"], dtype=np.int64).tolist()):
            yield from ((at, row, int(pair), best) for pair, best in zip(block["pairs"][at], found[at]))

    def bundled(tile: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        """The anchors of a tile as blocks, with the windows of their positives and what they find in the
        tile, whose k-th score is the floor elsewhere."""
        if not len(part):
            return pd.DataFrame(columns=[c.split()[0] for c in BLOCK_COLUMNS])
        record = tile.to_dict("records")[0]
        tree, part, out = build(record), part.sort_values(["row", "pair"]), []
        heads = part.drop_duplicates("row")
        lists = [part.groupby("row")[c].apply(list).tolist() for c in ("positive_score", "pair")]
        for k in range(0, len(heads), BLOCK_ROWS):
            some = heads.iloc[k:k + BLOCK_ROWS]
            scores, numbers = (x[k:k + BLOCK_ROWS] for x in lists)
            block = {"own": record["tile"], "dim": record["dim"], "rows": some["row"].to_numpy(np.int64).tobytes(),
                     "ids": some["anchor_id"].to_numpy(np.int64).tobytes(),
                     "labels": some["label"].to_numpy(np.int64).tobytes(),
                     "vectors": np.array(some["vector"].tolist(), dtype=np.float64).tobytes(),
                     "scores": scores, "pairs": numbers, "floors": [[NO_FLOOR] * len(n) for n in numbers], "home": []}
            floors = [[NO_FLOOR] * len(n) for n in numbers]
            for at, row, pair, best in searched(tree, block):
                block["home"] += [{"row": row, "pair": pair, "other": other, "score": held(s)}
                                  for s, other in best.sorted()]
                if len(best.heap) == negatives and best.least() > NO_FLOOR:
                    floors[at][numbers[at].index(pair)] = held(best.least())
            out.append(block | {"floors": floors})
        return pd.DataFrame(out)

    blocks = scratch.write("blocks", tiles.groupBy("tile").cogroup(pairs.groupBy("tile")).applyInPandas(
        bundled, ", ".join(BLOCK_COLUMNS)))

    def mined(tree: RTree, block: dict) -> Iterator[dict]:
        if block["own"] == block["tile"]:
            return  # searched when it was bundled
        for _, row, pair, best in searched(tree, block):
            yield from ({"row": row, "pair": pair, "other": other, "score": held(s)} for s, other in best.sorted())

    total = int(placed.agg(F.coalesce(F.max("tile"), F.lit(0))).first()[0])
    hard = visit(tiles, blocks.drop("home"), F.lit(0), F.lit(total), build, mined, HARD).unionByName(
        blocks.select(F.inline("home")))
    order = Window.partitionBy("row", "pair").orderBy(F.desc("score"), "other")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return hard.join(pairs.drop("vector", "label", "tile"), ["row", "pair"]).select(
        "anchor_id", known("positive_id").alias("positive_id"), "rank", known("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
