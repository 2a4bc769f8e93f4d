"""Hard negatives, neighbours and the prefix trie against plain versions, on awkward rows too."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.llm import negatives, neighbours, prefix_trie
from gondola.llm.common import Scratch
from gondola.llm.queries import QUERIES
from gondola.llm.rtree import RTree
from gondola.llm.tiles import tiled, usable

#: Names that the operators use inside.
CLASHING = ["row", "tile", "slab", "dim", "first", "score", "query", "anchor", "length", "rank"]
VECTORS = "id long, label long, vector array<double>, " + ", ".join(f"{c} string" for c in CLASHING)


def _vectors(seed=5, size=400, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dim))
    out = []
    for i in range(size):
        v = centres[i % 5] + 0.4 * rng.standard_normal(dim)
        out.append((i, int(rng.integers(0, 4)), [float(x) for x in v]))
    same = out[7][2]
    out += [(1_000 + i, i % 3, list(same)) for i in range(200)]  # a third of all rows are one vector
    out += [out[0], out[50], (2_000, None, same), (2_001, 1, None), (2_002, 1, []), (2_003, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
            (2_004, 1, [math.nan] + [0.0] * 5), (2_005, 1, [math.inf] + [0.0] * 5), (2_050, 1, [0.0] * 6),
            (2_100, 2, [1.0, 2.0]), (2_101, 2, [1.0, 1.5]), (2_102, 1, [0.5, 2.0]), (None, 1, same), (-50, 0, same)]
    return out


AWKWARD = _vectors()


def _table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], VECTORS).repartition(4)


def _usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


def brute_negatives(rows, step=50, positives=5, negatives=3):
    rows = [(LAST if i is None else i, x, [math.floor(256 * c) for c in v]) for i, x, v in rows
            if x is not None and _usable(v)]
    out = Counter()
    for i, x, v in rows:
        if i == LAST or i % step:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, y) for j, y, w in rows if j != i and len(w) == len(v)))
        for s, j, _ in [r for r in scored if r[2] == x][:positives]:
            good = [r for r in scored if r[2] != x and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            for rank, (t, n, _) in enumerate(good, 1):
                out[(i, j, rank, n, -s, -t)] += 1
    return Counter({tuple(None if x == LAST else x for x in k): n for k, n in out.items()})


LAST = (1 << 63) - 1


@pytest.mark.parametrize("tile_rows", [16, 100, 4_096])
def test_negatives_awkward(spark, tile_rows):
    table = _table(spark, AWKWARD).where(usable(F.col("vector"))).withColumn("vector", negatives.quantized(F.col("vector")))
    found = negatives.mine(spark, table, anchor=F.col("id") % 50 == 0, tile_rows=tile_rows)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in found.select(columns).collect()) == brute_negatives(AWKWARD)


def test_negatives_without_rows(spark):
    nothing = _table(spark, AWKWARD).where("false")
    assert negatives.mine(spark, nothing, F.lit(True)).count() == 0
    alone = _table(spark, [(50, 1, [1.0, 2.0]), (51, 1, [1.0, 2.0])])
    assert negatives.mine(spark, alone, F.col("id") == 50).count() == 0


def test_huge_components_are_exact(spark):
    """Products beyond double precision are compared as whole numbers."""
    big = float(1 << 28)
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 1, [big, 2.0]), (3, 2, [big * 0.75, 5.0]), (4, 2, [big * 0.75, 6.0])]
    found = negatives.mine(spark, _table(spark, rows), F.col("id") == 0, window=(50, 95)).collect()
    got = sorted((r["positive_id"], r["rank"], r["negative_id"]) for r in found)
    assert got == [(1, 1, 4), (1, 2, 3), (2, 1, 4), (2, 2, 3)]


def test_boxes_prune_and_miss_nothing():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 4)) * 10
    vectors = np.floor(256 * (np.repeat(centres, 100, axis=0) + rng.standard_normal((3_000, 4)) * 0.1))
    labels = np.repeat(np.arange(30) % 3, 100)
    tree, query = RTree(np.arange(3_000), labels, vectors, leaf=64), vectors[17]
    best = negatives.Best(5)
    visited = 0
    least = lambda: np.array([best.least()])
    for rows, _ in tree.best_first(query[None], lambda low, high, small, large: high >= least(), least):
        visited += 1
        for s, i in zip(tree.scores(rows, query[None])[:, 0], tree.ids[rows]):
            best.add(s, int(i))
    scores = vectors @ query
    assert best.sorted() == [(int(scores[i]), i) for i in sorted(range(3_000), key=lambda i: (-scores[i], i))[:5]]
    assert visited * 64 < 600  # of 3,000 rows


def test_tiles_are_bounded(spark):
    """Equal vectors, labels and coordinates are dealt to more tiles, and a label's tiles are one range."""
    rows = _table(spark, AWKWARD).where(usable(F.col("vector")) & F.col("label").isNotNull()).select("id", "label", "vector")
    placed = tiled(Scratch(spark, "test"), rows, labelled=True, tile_rows=50).collect()
    assert len(placed) == rows.count()
    assert max(Counter(r["tile"] for r in placed).values()) <= 100
    for r in placed:
        assert r["first"] <= r["tile"] <= r["last"]
    spread = defaultdict(set)
    for r in placed:
        spread[(r["dim"], r["label"])].add((r["first"], r["last"]))
    assert all(len(x) == 1 for x in spread.values())


def brute_neighbours(rows, step, k):
    rows = [(LAST if i is None else i, np.array(v)) for i, _, v in rows if _usable(v) and any(v)]
    out = defaultdict(list)
    for i, v in rows:
        if i != LAST and i % step == 0:
            scored = sorted((-float((w * v).sum()), j) for j, w in rows if j != i and len(w) == len(v))
            out[i].append([(None if j == LAST else j, -s) for s, j in scored[:k]])
    return out


@pytest.mark.parametrize("tile_rows", [60, 4_096])
def test_neighbours_awkward(spark, tile_rows):
    expected = brute_neighbours(AWKWARD, 20, 20)
    found = defaultdict(list)
    for r in neighbours.nearest(spark, _table(spark, AWKWARD), F.col("id") % 20 == 0, tile_rows=tile_rows).collect():
        found[r["query_id"]].append(r)
    assert set(found) == {q for q, lists in expected.items() if any(lists)}
    hit = total = 0
    scores = {(i, j): s for i, lists in brute_neighbours(AWKWARD, 20, 10_000).items() for x in lists for j, s in x}
    for q, rows in found.items():
        lists = expected[q]
        want = Counter(x for y in lists for x in y)
        got = Counter((r["id"], r["score"]) for r in rows)
        assert sum(got.values()) == sum(want.values())  # all candidates, if fewer
        assert all(scores[(q, r["id"])] == r["score"] for r in rows)
        hit, total = hit + sum((got & want).values()), total + sum(want.values())
        for r, s in zip(*[iter(sorted(rows, key=lambda r: r["rank"]))] * 2) if len(lists) == 1 else ():
            assert (-r["score"], LAST if r["id"] is None else r["id"]) <= (-s["score"], LAST if s["id"] is None else s["id"])
    assert hit / total >= 0.95


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet'").fetchall()
    expected = brute_neighbours([(i, 0, v) for i, v in rows], 20, 20)
    found = defaultdict(set)
    for r in QUERIES["op13_neighbours"](spark, folder).collect():
        found[r["query_id"]].add(r["vec_id"])
    assert all(len(x) == 20 for x in found.values()) and set(found) == set(expected)
    assert sum(len(found[q] & {j for j, _ in x[0]}) for q, x in expected.items()) / (20 * len(expected)) >= 0.9


def test_neighbours_without_rows(spark):
    assert neighbours.nearest(spark, _table(spark, AWKWARD).where("false"), F.lit(True)).count() == 0


def _conversations():
    rng, rows = random.Random(3), []
    for c in [*range(60), 1_000, -3, -5]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, t if rng.random() > 0.1 else None, rng.choice(["u", None, "a"]) if t > 1 else "u",
                         rng.choice(["x", "yy", None, "zé"]) if t > 2 else "hi"))
    rows += [(200, t, "u", f"turn {t}") for t in range(300)]  # a long one, and copies of it
    rows += [(c, t, "u", f"turn {t}") for c in range(205, 260, 5) for t in range(300)]
    return rows + rows[:7] + [(None, 1, "u", "x")]


def brute_trie(rows):
    conversations = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
            conversations[c].append((t is not None, t or 0, digest, (r, x)))
    conversations = {c: [y[3] for y in sorted(v)] for c, v in conversations.items()}
    rebuilt, members, children = {}, defaultdict(list), defaultdict(list)
    for c, v in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(conversations.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    below = {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        below[k] = (own + sum(below[c][0] for c in children[k]), sum(below[c][1] for c in children[k]) or 1)
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), below[k][1], below[k][0],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items())


@pytest.mark.parametrize("part_bytes", [1 << 20, 5_000, 400, 16])
def test_trie_awkward(spark, part_bytes):
    rows = _conversations()
    table = spark.createDataFrame([(*r, "x", "y") for r in rows],
                                  "conv_id long, turn long, role string, text string, depth string, part string")
    whole = prefix_trie.grafted(prefix_trie.turns(table.repartition(3)), F.col("conv_id") - F.col("conv_id") % 5,
                                F.crc32(F.col("conv_id").cast("string")) % 9, 8)
    found = prefix_trie.trie(spark, whole, part_bytes)
    assert Counter(tuple(r) for r in found.collect()) == brute_trie(rows)


def test_trie_of_many_members(spark):
    """Ids of one sequence are hashed in numeric order across ranges."""
    ids = [*range(-200_000, 200_000, 997), 1 << 40]
    table = spark.createDataFrame([(i, 1, "u", "same") for i in ids], "conv_id long, turn long, role string, text string")
    found = {r["depth"]: r for r in prefix_trie.trie(spark, prefix_trie.turns(table)).collect()}
    assert found[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert (found[0]["n_convs"], found[0]["n_children"], found[0]["n_leaves"]) == (len(ids), 1, 1)
    assert found[0]["saved_tokens"] == (len(ids) - 1) * 4


def test_trie_without_rows(spark):
    nothing = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(spark, prefix_trie.turns(nothing)).count() == 0
