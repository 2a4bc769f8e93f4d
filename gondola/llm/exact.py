"""Exact dedup of a batch against immutable snapshots screened by binary-fuse filters.

A snapshot is a folder written once: ``buckets`` holds one row per distinct text (digest, text, rows,
largest doc_id), ``filters`` one static filter per shard of digests.  A batch is first grouped by
itself; its distinct digests are then screened by the filters; only those that pass are joined with
the exact buckets, and the texts are compared byte by byte.

Size: digests are uniform, so shards of ``shard_keys`` digests are even, and shards multiply with the
snapshot; filters are never broadcast, they meet the digests of their shard.  Copies are collapsed
before every shuffle (the text is a grouping key), so a group with a third of all rows costs one row
per task.  The last join, of rows with their class, holds no text; adaptive execution splits its hot
keys.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays
(null doc_ids are smallest); of rows equal in doc_id and text, one stays; an empty table gives an
empty result.  Should two different texts share a digest, the byte check finds it and the run is
repeated with a longer digest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gondola.llm.common import Scratch, ship
from gondola.llm.fuse import Fuse, build

SHARD_KEYS = 200_000

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def sha512(text: Column) -> Column:
    return F.sha2(text, 512)


class DigestCollision(Exception):
    """Two different texts have one digest."""


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _classes(rows: DataFrame, digest: Digest) -> DataFrame:
    """One row per distinct text.  Equality of the grouping key is equality of bytes."""
    return (
        rows.select("doc_id", _text().alias("text")).withColumn("digest", digest(F.col("text")))
        .groupBy("digest", "text")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top_id"))
    )


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _key64(digests) -> np.ndarray:
    import hashlib

    return np.frombuffer(b"".join(
        hashlib.blake2b(d.encode(), digest_size=8).digest() for d in digests), np.uint64)


def _build_filter(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    fuse = build(_key64(rows["digest"]))
    return pd.DataFrame([{"shard": key[0], "seed": fuse.seed, "segment": fuse.segment,
                          "starts": fuse.starts, "slots": fuse.slots.tobytes()}])


def _screen(key: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(filters):
        return rows[["digest"]].iloc[:0]
    row = filters.iloc[0]
    fuse = Fuse(int(row["seed"]), int(row["segment"]), int(row["starts"]),
                np.frombuffer(row["slots"], np.uint16))
    return rows.loc[fuse.may_contain(_key64(rows["digest"])), ["digest"]]


class Snapshot:
    """An immutable set of published texts."""

    def __init__(self, buckets: DataFrame, filters: DataFrame, shards: int):
        self.buckets, self.filters, self.shards = buckets, filters, shards

    @staticmethod
    def publish(scratch: Scratch, rows: DataFrame, digest: Digest = sha256,
                shard_keys: int = SHARD_KEYS) -> Snapshot:
        buckets = scratch.write("buckets", _classes(rows, digest))
        shards = max(1, -(-buckets.count() // shard_keys))
        filters = buckets.select("digest", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(
            _build_filter, "shard int, seed long, segment long, starts long, slots binary")
        return Snapshot(buckets, scratch.write("filters", filters), shards)

    def screen(self, digests: DataFrame) -> DataFrame:
        """Digests that may be in the snapshot; the others are certainly new."""
        sharded = digests.select("digest", _shard(self.shards).alias("shard"))
        return sharded.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(
            _screen, "digest string")


def _no_collision(classes: DataFrame) -> None:
    if not classes.groupBy("digest").count().where("count > 1").isEmpty():
        raise DigestCollision


def _resolved(scratch: Scratch, batch: DataFrame, snapshot: Snapshot, digest: Digest) -> DataFrame:
    """(digest, keep_id, group_size) of every text of the batch and the snapshot."""
    new = scratch.write("batch", _classes(batch, digest))
    _no_collision(new)
    _no_collision(snapshot.buckets)
    maybe = scratch.write("maybe", snapshot.screen(new))
    hits = new.join(maybe, "digest", "left_semi").select(
        F.col("digest"), F.col("text").alias("new_text"), F.col("n").alias("new_n"),
        F.col("top_id").alias("new_top"))
    met = hits.join(snapshot.buckets, "digest").select(
        "digest", (F.col("new_text") == F.col("text")).alias("same"), "new_n", "new_top", "n", "top_id")
    met = scratch.write("met", met)
    if not met.where("NOT same").isEmpty():
        raise DigestCollision
    both = met.select("digest", F.greatest("top_id", "new_top").alias("keep_id"),
                      (F.col("n") + F.col("new_n")).alias("group_size"))
    alone = [
        side.join(met, "digest", "left_anti").select(
            "digest", F.col("top_id").alias("keep_id"), F.col("n").alias("group_size"))
        for side in (new.drop("text"), snapshot.buckets.drop("text"))
    ]
    return both.unionByName(alone[0]).unionByName(alone[1])


def dedup(spark: SparkSession, published: DataFrame, batch: DataFrame,
          digests: tuple[Digest, ...] = (sha256, sha512), shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of ``published`` and ``batch``:
    (doc_id, text_sha256, keep_id, group_size, kept)."""
    ship(spark)
    for digest in digests:
        scratch = Scratch(spark, "exact")
        try:
            snapshot = Snapshot.publish(scratch, published, digest, shard_keys)
            scratch.release()
            classes = _resolved(scratch, batch, snapshot, digest)
            break
        except DigestCollision:
            continue
    else:
        raise DigestCollision("no digest given tells all texts apart")
    rows = published.select("doc_id", "text").unionByName(batch.select("doc_id", "text"))
    rows = scratch.write("rows", rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", digest(_text()).alias("digest"),
        sha256(_text()).alias("text_sha256")))
    first = rows.groupBy("digest").agg(
        F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("keep_row"))
    classes = scratch.write("classes", classes.join(first, "digest"))
    return rows.join(classes, "digest").select(
        "doc_id", "text_sha256", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"))


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A table as a published part and an incoming batch, which together are the whole table."""
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    return docs.where(even), docs.where(~even)


def deduplicated(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    result = dedup(spark, *halves(docs), **options)
    scratch = Scratch(spark, "exact-rows")
    result = scratch.write("result", result)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id",
        sha256(_text()).alias("digest"))
    # Rows are told apart by doc_id and text; of those equal in both, one is taken.
    sets = result.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("of")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept"))
    sets = scratch.write("sets", sets)
    out = sets.where("NOT kept")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))
    stay = rows.join(out, same, "left_anti")
    twice = sets.where("kept AND rows > 1")
    if twice.isEmpty():
        return stay.select("row.*")
    one = rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "digest"])
    return stay.join(twice, same, "left_anti").unionByName(one).select("row.*")
