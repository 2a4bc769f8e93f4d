"""Repeated windows across documents: where does a run of ``size`` units also start in a document with
a smaller doc_id?  Shared by substring dedup over words and over bytes.

A document is a sequence of units (words or bytes); a window is ``size`` consecutive ones.  Every
window is filed under its anchor, the least hash among the ``gram``-unit grams within it.  Equal
windows have equal anchors, and consecutive windows mostly share one, so a document is a short list of
anchored stretches instead of a long list of windows:

1. ``first_texts``: equal texts are one text, held by the smallest doc_id that has it; the other documents
   with it lose all their windows.  What follows is about the windows of different texts.
   ``shared_anchors``: anchors that occur in at least two texts.  A task sends one row per anchor
   and batch; an anchor that repeats within the batch needs no answer.
2. ``stretches``: the units under shared anchors, cut out of the texts.
3. ``shards``: distinct stretches with the smallest doc_id that has them, dealt out by anchor, so that
   equal windows meet in one shard.  An anchor with very much under it (say the edge of a line that a
   third of all documents have, with another context in each) is in no shard: its contents are cut again by
   second anchors, equal pieces collapse, and pieces are dealt out by both anchors; equal windows have
   equal second anchors.  What is crowded under ``LEVELS`` such anchors is cut into windows, and the
   smallest doc_id of each is an aggregate over equal ones (``_holders``).
4. A shard's matcher gives, for every window of its stretches, the smallest doc_id that has it.  The
   matchers decide by the units themselves; hashes only bring windows together.
5. ``covered``: per document, the windows that a smaller doc_id has.

Sizes: no step pairs documents with each other, nothing but scalars reaches the driver, nothing is
broadcast.  Copies of a stretch are collapsed before every shuffle, and joins back to documents are
left to adaptive execution to split.  Every step ends in a table in the shared folder.

A null doc_id counts as the largest.  Documents equal in doc_id and text are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gondola.llm.common import Scratch, ship

LAST = (1 << 63) - 1
#: In place of spans: every window of the document.
WHOLE = -1
#: Times that contents under a crowded anchor are cut by further anchors before single windows are.
LEVELS = 2


@dataclass(frozen=True)
class Units:
    """How a text is cut into units, and joined again."""

    split: Callable[[bytes], tuple[object, np.ndarray]]  # the units, and a hash of each
    cut: Callable[[object, int, int], bytes]  # units from .. to as bytes
    size: int  # of a window
    gram: int  # of an anchor


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
        return x


def anchors(hashes: np.ndarray, size: int, gram: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First window of each stretch of one anchor, and the anchors (as signed numbers); another ``seed``
    chooses others."""
    windows = len(hashes) - size + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doubled, power = [hashes], [np.uint64(0x9E3779B97F4A7C15)]
    with np.errstate(over="ignore"):
        while 2 << len(doubled) - 1 <= gram:
            half, last = 1 << len(doubled) - 1, doubled[-1]
            doubled.append(last[:-half] * power[-1] + last[half:])
            power.append(power[-1] * power[-1])
        grams, have = doubled[-1], 1 << len(doubled) - 1
        for k in range(len(doubled) - 2, -1, -1):  # lengthened by the other powers of two in it
            if gram >> k & 1:
                rest = doubled[k][have:]
                grams = grams[:len(rest)] * power[k] + rest
                have += 1 << k
    least, span = _mixed(grams ^ np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))), 1
    width = size - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:windows], least[width - span:width - span + windows])
    starts = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    return starts, least[starts].view(np.int64)


def _documents(docs: DataFrame) -> DataFrame:
    """(key, print, text): the doc_id with null as the largest, and a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return docs.select(key.alias("key"), F.xxhash64(text).alias("print"), text.cast("binary").alias("text"))


def first_texts(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(print, same, lo, hi): each distinct text by its digest ``same``, with the smallest and largest doc_id that
    has it; and (key, print) of the documents whose text a smaller doc_id has.  No text is shuffled."""
    rows = scratch.write("digests", _documents(docs).select("key", "print", F.unhex(F.sha2("text", 256)).alias("same")))
    texts = scratch.write("texts", rows.groupBy("print", "same").agg(F.min("key").alias("lo"), F.max("key").alias("hi")))
    copies = rows.join(texts.where("lo < hi"), ["print", "same"]).where("key > lo").select("key", "print")
    return texts, copies.distinct()


def shared_anchors(scratch: Scratch, docs: DataFrame, texts: DataFrame, units: Units) -> DataFrame:
    """(key, print, anchors): the anchors of a text that another one has too, with the first document that has it."""
    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, prints, seen = batch["text"], batch["print"].to_numpy(), {}
            rows = [i for i, p in enumerate(prints.tolist())  # one of each text
                    if (j := seen.setdefault(p, i)) == i or not texts[i].equals(texts[j])]
            found = [np.unique(anchors(units.split(texts[i].as_py())[1], units.size, units.gram)[1])
                     for i in rows]
            sizes = [len(f) for f in found]
            if not sum(sizes):
                continue
            anchor, own = np.concatenate(found), np.repeat(np.arange(len(rows)), sizes)
            order = np.argsort(anchor, kind="stable")
            anchor, own = anchor[order], own[order]
            first = np.append(True, anchor[1:] != anchor[:-1])
            alone = first & np.append(anchor[1:] != anchor[:-1], True)
            # All rows of an anchor seen twice are known; only its first goes to meet other batches.
            route = np.where(first, anchor, _mixed((anchor + own).view(np.uint64)).view(np.int64))
            anchor[first] = 0  # it is the route then, and zeros cost next to nothing in a shuffle
            yield pa.RecordBatch.from_arrays(
                [pa.array(route), pa.array(anchor), pa.array(prints[rows][own]), pa.array(first), pa.array(~alone)],
                names=["route", "anchor", "print", "first", "known"])

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last anchor so far
        for batch in batches:
            rows = [batch[c].to_numpy(zero_copy_only=False) for c in range(5)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            open_ = rows[0] == rows[0][-1]
            held = [c[open_] for c in rows]
            yield _known([c[~open_] for c in rows])
        if held is not None:
            yield _known(held)

    def _known(rows: list[np.ndarray]) -> pa.RecordBatch:
        route, anchor, print_, first, known = rows
        anchor = np.where(first, route, anchor)
        places = np.flatnonzero(first)
        met = anchor[places]
        twice = np.zeros(len(met), bool)
        if len(met):
            order = np.argsort(met, kind="stable")
            ordered, texts_ = met[order], print_[places][order]
            change = np.append(True, ordered[1:] != ordered[:-1])
            starts = np.flatnonzero(change)
            several = np.minimum.reduceat(texts_, starts) < np.maximum.reduceat(texts_, starts)
            twice[order] = several[np.cumsum(change) - 1]
        out = known.copy()
        out[places] |= twice
        return pa.RecordBatch.from_arrays([pa.array(print_[out]), pa.array(anchor[out])], names=["print", "anchor"])

    rows = _documents(docs).select("print", "text").mapInArrow(
        first_rows, "route long, anchor long, print long, first boolean, known boolean")
    rows = rows.repartition("route").sortWithinPartitions("route").mapInArrow(meeting, "print long, anchor long")
    rows = rows.groupBy("print").agg(F.collect_list("anchor").alias("anchors"))
    # Different texts may have one hash by chance and count as one above: all of their anchors are looked at.
    first = texts.groupBy("print").agg(F.collect_set("lo").alias("keys"), F.count("*").alias("n"))
    rows = first.join(rows, "print", "left").where("n > 1 OR anchors IS NOT NULL").select(
        F.explode("keys").alias("key"), "print", F.when(F.col("n") == 1, F.col("anchors")).alias("anchors"))
    return scratch.write("shared", rows)


def stretches(scratch: Scratch, docs: DataFrame, shared: DataFrame, units: Units) -> DataFrame:
    """(anchor, content, key, print, at): units under shared anchors; ``at`` is the first window."""
    longest = 4 * units.size  # windows of a stretch; equal grams can follow each other for long

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, found_at, first_at, rows_of = [], [], [], []
            for i in range(batch.num_rows):
                parts, hashes = units.split(batch["text"][i].as_py())
                starts, found = anchors(hashes, units.size, units.gram)
                ends = np.append(starts[1:], len(hashes) - units.size + 1)
                if batch["anchors"][i].is_valid:
                    shared = np.sort(batch["anchors"][i].values.to_numpy())
                    wanted = shared[np.minimum(np.searchsorted(shared, found), len(shared) - 1)] == found
                    starts, ends, found = starts[wanted], ends[wanted], found[wanted]
                pieces = -(-(ends - starts) // longest)
                if len(pieces) and pieces.max() > 1:
                    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    starts = np.repeat(starts, pieces) + number * longest
                    ends = np.minimum(np.repeat(ends, pieces), starts + longest)
                    found = np.repeat(found, pieces)
                cut_, more = units.cut, units.size - 1
                contents += [cut_(parts, a, b + more) for a, b in zip(starts.tolist(), ends.tolist())]
                found_at.append(found)
                first_at.append(starts)
                rows_of.append(len(starts))
            if not contents:
                continue
            own = np.repeat(np.arange(batch.num_rows), rows_of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found_at)), pa.array(contents, pa.binary()),
                 pa.array(batch["key"].to_numpy()[own]), pa.array(batch["print"].to_numpy()[own]),
                 pa.array(np.concatenate(first_at).astype(np.int32))], schema=schema)

    schema = pa.schema([("anchor", pa.int64()), ("content", pa.binary()), ("key", pa.int64()),
                        ("print", pa.int64()), ("at", pa.int32())])
    rows = _documents(docs).join(shared, ["key", "print"]).mapInArrow(
        cut, "anchor long, content binary, key long, print long, at int")
    rows = rows.withColumn("content_print", F.xxhash64("content"))
    return scratch.write("stretches", rows)


def _pieces(units: Units, level: int):
    """Crowded contents cut again: by second anchors, or at the last ``level`` window by window."""
    schema = pa.schema([("of_anchor", pa.int64()), ("of_print", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()),
                        ("skip", pa.int32()), ("anchor", pa.int64()), ("content", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, skips, found_at, contents = [], [], [], []
            given = batch["anchor"].to_numpy()
            for i in range(batch.num_rows):
                parts, hashes = units.split(batch["content"][i].as_py())
                windows = len(hashes) - units.size + 1
                if level < LEVELS:
                    starts, found = anchors(hashes, units.size, units.gram, seed=level + 1)
                    found = _mixed(found.view(np.uint64) ^ given[i:i + 1].view(np.uint64)).view(np.int64)
                else:
                    starts, found = np.arange(windows), np.repeat(given[i], windows)
                ends = np.append(starts[1:], windows) + units.size - 1
                contents += [units.cut(parts, x, y) for x, y in zip(starts.tolist(), ends.tolist())]
                own.append(np.repeat(i, len(starts)))
                skips.append(starts)
                found_at.append(found)
            if contents:
                own = np.concatenate(own)
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(batch[c].to_numpy()[own]) for c in ("anchor", "content_print", "lo", "hi")),
                    pa.array(np.concatenate(skips).astype(np.int32)), pa.array(np.concatenate(found_at)),
                    pa.array(contents, pa.binary())], schema=schema)

    return cut, "of_anchor long, of_print long, lo long, hi long, skip int, anchor long, content binary"


def _holders(scratch: Scratch, contents: DataFrame, units: Units, matcher: Callable, shard_bytes: int,
             level: int = 0) -> DataFrame:
    """(anchor, content_print, spans, least) of the table ``contents``; see ``least_holders``."""
    if level > LEVELS:  # windows: a content is one, and so are its equals in the same group
        return contents.where("lo < hi").select(
            "anchor", "content_print", F.array(F.lit(1).cast("long")).alias("spans"), F.array("lo").alias("least"))
    # A table of its own: while it is small, Spark sees its size and leaves the contents where they are.
    sums = contents.groupBy("anchor").agg(F.sum(F.length("content")).alias("bytes"))
    heavy = scratch.write(f"heavy{level}", sums.where(F.col("bytes") > shard_bytes // 8).select(
        F.col("anchor").alias("of")))
    crowded = not heavy.isEmpty()
    light = contents
    if crowded:
        light = contents.join(heavy, F.col("anchor") == F.col("of"), "left_anti")
    total = light.agg(F.sum(F.length("content"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = light.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))

    def match(shard: pa.Table) -> pa.Table:
        anchor, print_, lo, hi = (shard[c].to_numpy() for c in ("anchor", "content_print", "lo", "hi"))
        found = matcher(shard["content"].to_pylist(), anchor, lo, hi)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        least, own = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
        # Runs of windows of one content with one holder.
        change = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (own[1:] != own[:-1])))
        number, lows, own = np.diff(change, append=len(least)), least[change], own[change]
        kept = lows < hi[own]
        spans = (change - (np.cumsum(sizes) - sizes)[own]) << 32 | number
        rows, counts = np.unique(own[kept], return_counts=True)
        ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        return pa.table({
            "anchor": anchor[rows], "content_print": print_[rows],
            "spans": pa.ListArray.from_arrays(ends, pa.array(spans[kept])),
            "least": pa.ListArray.from_arrays(ends, pa.array(lows[kept]))})

    found = dealt.groupBy("shard").applyInArrow(
        match, "anchor long, content_print long, spans array<bigint>, least array<bigint>")
    if not crowded:
        return found
    pieces = contents.join(heavy, F.col("anchor") == F.col("of"), "left_semi").mapInArrow(*_pieces(units, level))
    pieces = scratch.write(f"pieces{level}", pieces.withColumn("content_print", F.xxhash64("content")))
    inner = pieces.groupBy("anchor", "content_print", "content").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    inner = _holders(scratch, scratch.write(f"contents{level + 1}", inner), units, matcher, shard_bytes, level + 1)
    shift = F.shiftleft(F.col("skip").cast("long"), 32)
    back = pieces.drop("content").join(inner, ["anchor", "content_print"]).select(
        F.col("of_anchor").alias("anchor"), F.col("of_print").alias("content_print"),
        F.transform("spans", lambda x: x + shift).alias("spans"), "least")
    return found.unionByName(back)


def least_holders(scratch: Scratch, rows: DataFrame, units: Units, matcher: Callable, shard_bytes: int) -> DataFrame:
    """(anchor, content_print, spans, least): windows of a content (first << 32 | number) and the
    smallest doc_id that has them, where some document is to lose them."""
    contents = rows.groupBy("anchor", "content_print", "content").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"))
    contents = scratch.write("contents", contents)
    scratch.release()
    return scratch.write("least", _holders(scratch, contents, units, matcher, shard_bytes))


def covered(spark: SparkSession, docs: DataFrame, units: Units, matcher: Callable, shard_bytes: int) -> DataFrame:
    """(key, print, spans) of documents with windows that a smaller doc_id has: first << 32 | number, or
    ``WHOLE``."""
    ship(spark)
    scratch = Scratch(spark, "windows")
    texts, copies = first_texts(scratch, docs)
    shared = shared_anchors(scratch, docs, texts, units)
    scratch.release()
    rows = stretches(scratch, docs, shared, units)
    scratch.drop("shared")
    scratch.release()
    least = least_holders(scratch, rows, units, matcher, shard_bytes)
    scratch.release()
    own = F.zip_with("spans", "least", lambda s, low: F.when(low < F.col("key"), s + F.shiftleft(
        F.col("at").cast("long"), 32)))
    spans = rows.select("anchor", "content_print", "key", "print", "at").join(
        least, ["anchor", "content_print"]).select(
        "key", "print", F.filter(own, lambda s: s.isNotNull()).alias("spans")).where("size(spans) > 0")
    spans = spans.unionByName(copies.withColumn("spans", F.array(F.lit(WHOLE).cast("long"))))
    spans = spans.groupBy("key", "print").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    spans = scratch.write("covered", spans)
    scratch.release()
    levels = [f"{name}{k}" for name in ("heavy", "pieces", "contents") for k in range(LEVELS + 2)]
    for name in ("digests", "texts", "stretches", "contents", "least", *levels):
        scratch.drop(name)
    return spans


def roles(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contents that some document above their smallest holder may repeat, and contents that some
    document below their largest holder may have had: by the holders under their anchor.  A content alone
    under its anchor is neither: no other one has its windows, so their smallest holder is its own."""
    group = np.unique(anchors, return_inverse=True)[1]
    several = np.bincount(group)[group] > 1
    lowest, highest = np.full(group.max() + 1, LAST), np.full(group.max() + 1, -LAST - 1)
    np.minimum.at(lowest, group, lows)
    np.maximum.at(highest, group, highs)
    return several & (lows < highest[group]), several & (highs > lowest[group])


def mask(spans: np.ndarray | None, units: int, size: int) -> np.ndarray:
    """Which units the windows of the spans cover."""
    change = np.zeros(units + 1, np.int64)
    if spans is not None and len(spans) and spans.min() == WHOLE:
        return np.full(units, units >= size)
    if spans is not None and len(spans):
        first, number = spans >> 32, spans & 0xFFFFFFFF
        np.add.at(change, first, 1)
        np.add.at(change, first + number + size - 1, -1)
    return np.cumsum(change[:-1]) > 0


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of every document."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("own", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(
        "own_print", F.xxhash64("text"))
    return rows.join(spans, (F.col("own") == F.col("key")) & (F.col("own_print") == F.col("print")), "left").select(
        "doc_id", "text", "spans")
