"""Prefix trie of conversations: every distinct sequence of first turns is a node.

``trie`` takes sequences (conv_id, digests, sizes): a 16-byte digest of every turn and the bytes of its text.
Equal sequences collapse before anything is sorted.  The rest is range-partitioned by the digests one after
another, so that sequences with a common start are neighbours, and every partition is a group of its own:

* Edges join sorted neighbours and carry the turns they share (their common prefix).  They are taken in
  descending depth and a union-find merges what they join; a merge of components that reach deeper is a
  branching node.  The turns between two branching nodes are a path of nodes with the same members.
* The first and last sequence of a partition also have edges to the neighbouring partitions.  A node that
  such an edge reaches is open: it may have members on the other side.  What a partition knows of an open
  node is additive, with each shared turn counted by the leftmost partition of its node; that partition
  follows from the shared depths at the boundaries alone.  Open nodes (no more than the depths at the two
  boundaries, whatever the partition holds) are then summed across partitions.

Sizes: a partition holds ``part_bytes`` of digests, one long conversation at least, at 16 bytes a turn.  The
driver sees the first and last sequence of each partition.

Defined results: turns are ordered by turn, null first, then by role and text digest; a null role or text is
empty; rows with a null conv_id are in no conversation; a repeated row is a turn each time it occurs; an
empty table has no conversation and so no root.  Columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gondola.llm.common import Scratch, ship

DIGEST = 16
PART_BYTES = 32 << 20
#: Members of one sequence whose ids are joined into one text at a time, by ranges of conv_id.
ID_RANGE = 1 << 16
NODES = "open_part int, depth long, conv_id long, parent_conv_id long, parent_part int, n_convs long, " \
        "n_children long, n_leaves long, saved_tokens long, sequence binary"


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows (conv_id, turn, role, text): structs (turn, digest, size) in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    one = F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), one.alias("one")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("one")).alias("turns"))


def grafted(conversations: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Every conversation with its first ``heads`` (``most`` at most) turns replaced by those of ``base``."""
    starts = conversations.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_starts"))
    met = conversations.withColumns({"_of": base, "_heads": heads.cast("int")}).join(
        starts, F.col("_of") == F.col("_base"), "left")
    start = F.coalesce(F.slice("_starts", F.lit(1), F.col("_heads")), F.slice("turns", 1, 0))
    return met.select("conv_id", F.concat(start, F.slice("turns", F.col("_heads") + 1, F.size("turns"))).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their start."""
    size = min(len(a), len(b)) // DIGEST
    one, two = (np.frombuffer(x, dtype=np.uint64, count=size * 2).reshape(-1, 2) for x in (a, b))
    differ = (one != two).any(axis=1)
    return int(differ.argmax()) if differ.any() else size


class Components:
    """Sets of neighbouring sequences: the node they make, and what is below it."""

    def __init__(self, depths: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        size = len(depths)
        self.parent = list(range(size))
        self.depth, self.least, self.members = depths.tolist(), ids.tolist(), counts.tolist()
        self.children, self.leaves, self.saved = [0] * size, [0] * size, [0] * size
        self.sequence = list(range(size))  # that ends at the node itself
        self.sample = list(range(size))  # any member
        self.waiting: list[list[int]] = [[] for _ in range(size)]  # child nodes that need this one's id
        self.left, self.right = [False] * size, [False] * size  # open to the neighbouring partition

    def find(self, item: int) -> int:
        while self.parent[item] != item:
            self.parent[item] = item = self.parent[self.parent[item]]
        return item

    def merge(self, a: int, b: int) -> int:
        """Union of two components that stand at the same depth."""
        if len(self.waiting[a]) < len(self.waiting[b]):
            a, b = b, a
        self.parent[b] = a
        self.waiting[a] += self.waiting[b]
        self.waiting[b] = []
        for x in (self.members, self.children, self.leaves, self.saved):
            x[a] += x[b]
        for x in (self.left, self.right):
            x[a] |= x[b]
        self.least[a] = min(self.least[a], self.least[b])
        self.sequence[a] = max(self.sequence[a], self.sequence[b])  # one of the two is -1
        return a


class Forest:
    """The trie of one partition; ``before`` and ``after`` are the depths shared with its neighbours, -1 if
    there is none, ``leftmost(depth)`` the first partition of an open node on the left."""

    def __init__(self, part: int, keys: list[bytes], ids: np.ndarray, counts: np.ndarray, sizes: list,
                 before: int, after: int, leftmost):
        self.part, self.keys, self.sizes = part, keys, sizes
        self.before, self.after, self.leftmost = before, after, leftmost
        self.sets = Components(np.array([len(k) // DIGEST for k in keys]), ids, counts)
        self.rows: list[list] = []

    def nodes(self) -> list[list]:
        last = len(self.keys) - 1
        edges = [(shared(a, b), k, k + 1) for k, (a, b) in enumerate(zip(self.keys, self.keys[1:]))]
        edges += [(self.before, 0, -1)] * (self.before >= 0) + [(self.after, last, -2)] * (self.after >= 0)
        for depth, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
            a = self.rise(self.sets.find(a), depth)
            if b >= 0:
                self.sets.merge(a, self.rise(self.sets.find(b), depth))
            else:
                (self.sets.left if b == -1 else self.sets.right)[a] = True
        root = self.rise(self.sets.find(0), 0)
        self.emit(root)
        return self.rows

    def key(self, one: int) -> int | None:
        """The partition that an open node belongs to."""
        sets = self.sets
        return self.leftmost(sets.depth[one]) if sets.left[one] else self.part if sets.right[one] else None

    def emit(self, one: int) -> int:
        """Give out the node a component stands at; 1 if it begins in this partition, else 0."""
        sets, depth = self.sets, self.sets.depth[one]
        key, size = self.key(one), 0
        if depth:
            size = int(self.sizes[sets.sample[one]][depth - 1])
        begins = key is None or key == self.part
        # a closed node saves (members - 1) * size; an open one leaves the "- 1" to its first partition
        sets.saved[one] += sets.members[one] * size - (size if begins else 0)
        if key is None and not sets.children[one]:
            sets.leaves[one] = 1  # an open node goes on in another partition
        ends = sets.sequence[one]
        row = len(self.rows)
        self.rows.append([key, depth, sets.least[one], None, None, sets.members[one], sets.children[one],
                          sets.leaves[one], sets.saved[one],
                          hashlib.md5(self.keys[ends]).digest() if ends >= 0 else None])
        for child in sets.waiting[one]:
            if key is None:
                self.rows[child][3] = sets.least[one]
            else:
                self.rows[child][4] = key
        sets.waiting[one] = [row]
        return int(begins)

    def rise(self, one: int, depth: int) -> int:
        """Emit the nodes of a component above ``depth`` and let it stand there."""
        sets = self.sets
        while sets.depth[one] > depth:
            new = self.emit(one)
            sets.depth[one] -= 1
            sets.children[one], sets.sequence[one] = new, -1
        return one


def trie(spark: SparkSession, sequences: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """All nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of
    sequences (conv_id, turns)."""
    ship(spark)
    scratch = Scratch(spark, "trie")
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    whole = scratch.write("sequences", sequences.select(
        "conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes")).withColumn(
        "sequence", F.unhex(F.md5("key"))))
    distinct = whole.groupBy("sequence", "key", "sizes").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("members"))
    total = whole.agg(F.sum(F.octet_length("key") + DIGEST)).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    dealt = scratch.write("dealt", distinct.repartitionByRange(parts, "key").withColumn(
        "part", F.spark_partition_id()))
    edges = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("part")
    ends = [(r["part"], bytes(r["first"]), bytes(r["last"])) for r in edges.collect()]
    number = {part: k for k, (part, _, _) in enumerate(ends)}
    inner = [shared(first, last) for _, first, last in ends]  # what all sequences of a partition share
    bound = [-1, *(shared(a[2], b[1]) for a, b in zip(ends, ends[1:])), -1]

    def begins(k: int):
        """Gives the leftmost partition of the node at some depth that partition ``k`` shares to its left."""
        def leftmost(depth: int) -> int:
            at = k
            while bound[at] >= depth:
                at -= 1
                if inner[at] < depth:
                    break
            return at
        return leftmost

    def grown(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", key=lambda keys: keys.map(bytes))
        k = number[int(group["part"].iloc[0])]
        forest = Forest(k, [bytes(x) for x in group["key"]], group["conv_id"].to_numpy(np.int64),
                        group["members"].to_numpy(np.int64), group["sizes"].tolist(),
                        bound[k], bound[k + 1], begins(k))
        return pd.DataFrame(forest.nodes(), columns=[c.split()[0] for c in NODES.split(", ")], dtype=object)

    found = scratch.write("nodes", dealt.groupBy("part").applyInPandas(grown, NODES))
    closed, partial = found.where("open_part IS NULL"), found.where("open_part IS NOT NULL")
    merged = scratch.write("open", partial.groupBy("open_part", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.min("parent_part").alias("parent_part"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("sequence").alias("sequence")))
    above = merged.select(F.col("open_part").alias("_part"), (F.col("depth") + 1).alias("_depth"),
                          F.col("conv_id").alias("_parent"))
    nodes = closed.unionByName(merged.select(closed.columns)).join(
        above, (F.col("parent_part") == F.col("_part")) & (F.col("depth") == F.col("_depth")), "left")
    hashes = member_hashes(whole).withColumnRenamed("sequence", "_sequence")
    return nodes.join(hashes, F.col("sequence") == F.col("_sequence"), "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def member_hashes(whole: DataFrame) -> DataFrame:
    """(sequence, ends_sha256): SHA-256 of the ascending conv_ids of each sequence, comma-joined.

    Ids are joined by ranges of conv_id first, so a sequence with very many members reaches the task that
    hashes it, chunk after chunk and holding one, in few rows.
    """
    chunk = F.floor(F.col("conv_id") / ID_RANGE)
    chunks = whole.groupBy("sequence", chunk.alias("chunk")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence, state = None, None
        for part in parts:
            done = []
            for one, ids in zip(part["sequence"], part["ids"]):
                if bytes(one) == sequence:
                    state.update(b"," + ids.encode())
                    continue
                if sequence is not None:
                    done.append((sequence, state.hexdigest()))
                sequence, state = bytes(one), hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["sequence", "ends_sha256"])
        if sequence is not None:
            yield pd.DataFrame([(sequence, state.hexdigest())], columns=["sequence", "ends_sha256"])

    return chunks.repartition("sequence").sortWithinPartitions("sequence", "chunk").mapInPandas(
        run, "sequence binary, ends_sha256 string")
