"""SimHash near-dedup by deletion-variant signatures.

Fingerprints of 64 bits link at two or fewer differing bits.  Cut into two segments, two linked
fingerprints have a segment in which they differ by at most one bit.  So every distinct fingerprint
is indexed, per segment, under the segment itself and under its 32 one-wildcard variants (one bit
masked out); an equality join on these keys finds every candidate, and the differing bits of the
whole fingerprint are counted.  A wildcard key only joins fingerprints that do differ in the masked
bit, so a pair is found once per segment.

Size: the index holds 66 keys per distinct fingerprint and is never broadcast: Spark sizes a table after an
explode as the one before it, so joins of the index say that they shuffle.  A key with more than
``dense`` fingerprints would emit too many pairs; its fingerprints are indexed once more by the other
segment, in a way that any two which share such a key are linked (see ``_dense_links``), and each is
linked to the smallest of its key.  That is linear, drops no link's connection, and needs no limit.
Rows with equal fingerprints are one node of the graph.

Defined results: a null or empty text, or one without words, has fingerprint 0 and is linked like any
other; fewer words than a shingle make one shingle; null doc_ids never name a component unless all of
its rows have none; repeated rows share a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from gondola.llm.common import Scratch, ship
from gondola.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
DENSE = 64
_BLOCK = 1 << 14


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text, as an unsigned number."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        part = [of(joined[a:b], HASH_SEED) for a, b in zip(starts[at:at + _BLOCK], ends[at:at + _BLOCK])]
        hashes = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """Fingerprint column, as a signed long with the same bits."""

    @F.pandas_udf(LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
            yield pd.Series(prints.view(np.int64))

    return of(text)


def _segment(fp: Column, segment: int) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)) if segment == 0 else F.shiftrightunsigned(fp, 32)


def _index(nodes: DataFrame) -> DataFrame:
    """(key, side, fp): exact segments with side 2; one-wildcard variants with the masked bit as side.

    A key is the masked segment, its wildcard (32: none) and the number of the segment.  Fingerprints are
    few bytes, so a scan of them is few tasks; they are dealt out first, as each gives 66 rows.
    """
    entries = []
    for number in (0, 1):
        value = _segment(F.col("fp"), number)
        tag = lambda wildcard: F.shiftleft(wildcard.cast("long"), 33) + F.lit(number << 32)

        def variant(i: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), i)
            side = F.when(value.bitwiseAND(bit) == 0, 0).otherwise(1)
            return F.struct((tag(i) + value - F.when(side == 1, bit).otherwise(0)).alias("key"),
                            side.alias("side"))

        exact = F.struct((tag(F.lit(32)) + value).alias("key"), F.lit(2).alias("side"))
        entries += [F.transform(F.sequence(F.lit(0), F.lit(31)), variant), F.array(exact)]
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select("fp").repartition(tasks, "fp")
    return dealt.select("fp", F.explode(F.concat(*entries)).alias("e")).select("e.key", "e.side", "fp")


def _linked(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def _pairs(index: DataFrame, bits: int) -> DataFrame:
    left = index.select("key", "side", F.col("fp").alias("a"))
    right = index.select(F.col("key").alias("k"), F.col("side").alias("s"), F.col("fp").alias("b"))
    sides = ((F.col("side") == 2) & (F.col("a") < F.col("b"))) | ((F.col("side") == 0) & (F.col("s") == 1))
    met = left.where("side IN (0, 2)").join(right.where("s IN (1, 2)").hint("merge"), F.col("key") == F.col("k"))
    return met.where(sides & _linked(F.col("a"), F.col("b"), bits)).select("a", "b")


def _dense_links(index: DataFrame, bits: int) -> DataFrame:
    """Links of keys with many fingerprints, as stars.

    Under a wildcard key the segments differ by the one bit, or not at all; fingerprints whose other
    segments agree but for one masked bit differ by two bits at most.  Under an exact key the
    segments agree; other segments that have a common neighbour at one bit differ by two at most, and
    all that differ by two at most have one.  So whatever shares a key here is linked, and two linked
    fingerprints of the first key share one here.
    """
    number = F.shiftrightunsigned(F.col("key"), 32).bitwiseAND(F.lit(1))
    value = F.when(number == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    every = F.sequence(F.lit(0), F.lit(31))
    masked = F.transform(every, lambda i: F.struct(
        i.alias("w"), value.bitwiseAND(F.bitwise_not(bit(i))).alias("v")))
    same = F.array(F.struct(F.lit(32).alias("w"), value.alias("v")))
    hubs = F.concat(same, F.transform(every, lambda i: F.struct(
        F.lit(32).alias("w"), value.bitwiseXOR(bit(i)).alias("v"))))
    within = masked if bits == 1 else F.when(F.col("side") == 2, hubs).otherwise(masked)
    if bits == 1:  # an equal segment leaves one bit to the other; a masked one may not differ further
        within = F.when(F.col("side") == 2, masked).otherwise(same)
    rows = index.select("key", "fp", F.explode(within).alias("e")).select("key", "e.w", "e.v", "fp")
    least = rows.groupBy("key", "w", "v").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n"))
    return rows.join(least.where("n > 1").hint("merge"), ["key", "w", "v"]).where("fp <> b").select(
        F.col("fp").alias("a"), "b").distinct()


def links(scratch: Scratch, nodes: DataFrame, bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all that differ in ``bits`` bits or fewer:
    every such pair outside dense keys, and a star per neighbourhood within them."""
    if not 1 <= bits <= 2:
        raise ValueError("two segments with one wildcard find one or two differing bits")
    index = _index(nodes)
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = scratch.write("live", index.join(sizes.hint("merge"), "key"))
    found = _pairs(live.where(F.col("n") <= dense), bits).distinct()
    return found.unionByName(_dense_links(live.where(F.col("n") > dense), bits))


def _classes(scratch: Scratch, prints: DataFrame, bits: int, dense: int) -> DataFrame:
    """(fp, root) of every fingerprint of ``prints``; the root names the component."""
    nodes = scratch.write("nodes", prints.select("fp").distinct())
    edges = scratch.write("edges", links(scratch, nodes, bits, dense))
    roots = components(scratch, edges)
    return scratch.write("classes", nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = SHINGLE_WORDS,
                    bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """One row per document: (doc_id, fp, fingerprint, component_id)."""
    ship(spark)
    scratch = Scratch(spark, "simhash")
    prints = scratch.write("prints", docs.select("doc_id", fingerprints(F.col("text"), width).alias("fp")))
    nodes = scratch.write("nodes", prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = scratch.write("edges", links(scratch, nodes.select("fp"), bits, dense))
    roots = components(scratch, edges)
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.write("classes", named.join(names, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(spark: SparkSession, docs: DataFrame, width: int = SHINGLE_WORDS,
                    bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """The rows of one document of each component: of its smallest doc_id (null as the largest), and
    of the smallest digest among the texts of that doc_id.

    A document is a doc_id and a text.  Rows that repeat one stay together, as exact dedup is another
    stage; without a doc_id they are no document, and one row stays.
    """
    ship(spark)
    scratch = Scratch(spark, "simhash-rows")
    prints = scratch.write("prints", docs.select("doc_id", digest().alias("digest"),
                                                 fingerprints(F.col("text"), width).alias("fp")))
    classes = _classes(scratch, prints, bits, dense)
    return one_of_each(scratch, docs, prints.join(classes, "fp").select("doc_id", "digest", "root"))


def digest() -> Column:
    """Digest of a text; null without one."""
    return F.sha2("text", 256)


def one_of_each(scratch: Scratch, docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` of one document of each root of ``found`` (doc_id, digest, root)."""
    named = scratch.write("named", found.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    best = named.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    rest = named.join(best.where("n > 1").select("root", "best"), "root").where(order != F.col("best"))
    gone = scratch.write("gone", rest.select(F.col("doc_id").alias("id"), F.col("digest").alias("of")))

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id",
                           digest().alias("own"))
        same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("own").eqNullSafe(F.col("of"))
        return rows.join(gone, same, "left_anti")

    nameless = kept(docs.where("doc_id IS NULL")).dropDuplicates(["own"])
    return kept(docs.where("doc_id IS NOT NULL")).unionByName(nameless).select("row.*")
