"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1, drawn by hashing its code point.  An n-gram is
bound by permuting (rotating) the vectors of its letters by their place and multiplying them; a text
is bundled by adding the vectors of its n-grams, as often as they occur.  A language prototype bundles
the unit vectors of its training texts.  A text gets the language of the prototype with the largest
cosine, which is also the score.

Letters are lower-cased; a run of anything else is one boundary symbol, and the text stands between
two of them.  Whole texts are read.

Training reads a bounded sample of labelled rows: ``train_rows`` in expectation, chosen by a hash of
the doc_id (of the text without one).  The bound is shared among the languages: each gives the same
number of rows, or all it has if those are fewer, so that a rare language is learned beside common ones however
many rows they have.  All other work covers every row.  A task adds up the vectors of its texts, so what is
shuffled is one vector per task and language; prototypes (languages x dimensions) go to the tasks.
More than ``MAX_LANGUAGES`` labels are refused, which bounds them.

Defined results: ``und`` with score 0 for a text that is null or has no letters, or if nothing could
be learned; ties go to the language that sorts first; a null doc_id counts as an empty one; rows with
a null lang or text are not learned from; without any label, ``accepted`` goes by letters alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gondola.llm.common import ship

NGRAM = 3
DIMENSIONS = 1024
TRAIN_ROWS = 40_000
MAX_LANGUAGES = 4_096
UNKNOWN = "und"
SEED = 0x5EED
_GRAMS = 4_096  # distinct n-grams bound together
_UNITS = 1 << 20  # code points looked at together
_DRAWS = 1 << 40  # a share of a language is so fine that one of 10^12 rows gives some
_SCALE = float(1 << 30)  # prototypes are summed as whole numbers, so the order of tasks is no matter


def _hash(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def letter_vectors(letters: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Random vectors of code points, by hash: the same on every machine."""
    words = dimensions // 64
    base = _hash(letters.astype(np.uint64) + np.uint64(SEED << 32))
    drawn = _hash(base[:, None] + np.arange(words, dtype=np.uint64)[None, :])
    bits = np.unpackbits(drawn.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def gram_vectors(grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bind: the product of the letters' vectors, each rotated by its place in the n-gram."""
    vectors = letter_vectors(letters)
    out = None
    for place in range(grams.shape[1]):
        part = np.roll(vectors, place, axis=1)[grams[:, place]]
        out = part if out is None else out * part
    return out


def _symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points, everything else as 0, without repeated zeros."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint32)
    table = np.unique(points)
    letter = np.fromiter((chr(p).isalpha() for p in table.tolist()), bool, len(table))
    if not letter.any():
        return np.zeros(0, np.uint32)
    points = np.concatenate(([0], np.where(letter[np.searchsorted(table, points)], points, 0), [0]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return points[keep].astype(np.uint32)


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Vector of each text (texts x dimensions), and which texts have letters."""
    parts = [_symbols(t) for t in texts]
    known = np.array([len(p) > 0 for p in parts], bool)
    sizes = np.array([max(0, len(p) - NGRAM + 1) for p in parts], np.int64)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if not sizes.sum():
        return out, known
    letters, flat = np.unique(np.concatenate(parts), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    code = np.zeros(len(place), np.int64)
    for k in range(NGRAM):
        code = code * len(letters) + flat[place + k]
    grams, which = np.unique(code, return_inverse=True)
    for at in range(0, len(grams), _GRAMS):
        block = grams[at:at + _GRAMS]
        split = np.stack([block // len(letters) ** (NGRAM - 1 - k) % len(letters)
                          for k in range(NGRAM)], axis=1)
        inside = (which >= at) & (which < at + len(block))
        counts = np.bincount(owner[inside] * len(block) + which[inside] - at,
                             minlength=len(texts) * len(block))
        out += counts.reshape(len(texts), len(block)).astype(np.float32) @ gram_vectors(split, letters)
    return out, known


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of a bounded total length, one text at least, with their first place."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and (size + len(text or "") > _UNITS // 4 or len(held) >= 256):
            yield first, held
            first, held, size = i, [], 0
        held.append(text or "")
        size += len(text or "")
    if held:
        yield first, held


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


class Profiles:
    """Language prototypes: names in order, and their unit vectors."""

    def __init__(self, names: list[str], vectors: np.ndarray):
        self.names, self.vectors = names, vectors

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for first, group in _groups(texts):
            vectors, known = bundles(group)
            if not self.names:
                names += [UNKNOWN] * len(group)
                continue
            cosines = _unit(vectors) @ self.vectors.T
            best = cosines.argmax(axis=1)
            names += [self.names[b] if k else UNKNOWN for b, k in zip(best, known)]
            scores[first:first + len(group)] = np.where(
                known, np.clip(cosines[np.arange(len(group)), best], 0, 1), 0)
        return names, scores


def fold() -> Column:
    """crc32 of the doc_id as text, modulo 3."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def held_out() -> Column:
    return fold() == 1


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for rows in batches:
        labels = rows["lang"].tolist()
        for first, group in _groups(rows["text"].tolist()):
            vectors = np.round(_unit(bundles(group)[0]) * _SCALE).astype(np.int64)
            own = labels[first:first + len(group)]
            for lang in set(own):
                chosen = vectors[[x == lang for x in own]].sum(axis=0)
                totals[lang] = totals.get(lang, 0) + chosen
    for lang, vector in totals.items():
        yield pd.DataFrame({"lang": [lang], "vector": [vector]})


def quota(counts: dict[str, int], train_rows: int) -> int:
    """The most rows a language may give so that all together give ``train_rows`` at most; languages
    with fewer give all of theirs."""
    left, levels = train_rows, sorted(counts.values())
    for k, n in enumerate(levels):
        level = left // (len(levels) - k)
        if n > level:
            return max(1, level)
        left -= n
    return max(levels, default=0)


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Profiles:
    """Prototypes from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return Profiles([], np.zeros((0, DIMENSIONS)))
    most = quota(counts, train_rows)
    shares = spark.createDataFrame(
        [(lang, max(1, most * _DRAWS // n)) for lang, n in counts.items()], "of string, share long")
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(
        F.xxhash64(F.col("doc_id").cast("string")))
    sample = labelled.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(
        F.pmod(drawn, F.lit(_DRAWS)) < F.col("share"))
    sums = sample.select("lang", "text").mapInPandas(_sums, "lang string, vector array<bigint>")
    sums = sums.select("lang", F.posexplode("vector").alias("place", "value"))
    sums = sums.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    placed = F.sort_array(F.collect_list(F.struct("place", "value")))
    rows = sums.groupBy("lang").agg(placed["value"].alias("vector")).orderBy("lang")
    learned = rows.collect()  # an array per language, bounded above
    vectors = np.array([r["vector"] for r in learned], np.float64).reshape(-1, DIMENSIONS) / _SCALE
    return Profiles([r["lang"] for r in learned], _unit(vectors))


def predicted(text: Column, profiles: Profiles) -> Column:
    """Struct (lang_pred, score) of a text."""

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = profiles.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return of(text)


def identify(spark: SparkSession, docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score)."""
    profiles = learn(docs, train_rows)
    found = docs.select("doc_id", held_out().alias("held_out"),
                        predicted(F.col("text"), profiles).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def lettered(text: Column) -> Column:
    """Whether a text has a letter, which the prediction finds out by itself."""

    @F.pandas_udf("boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([any(c.isalpha() for c in t or "") for t in texts], dtype=bool)

    return of(text)


def accepted(spark: SparkSession, docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` in a known language.  Those without a letter are rejected, and no others:
    if nothing could be learned, every text with a letter stays."""
    profiles = learn(docs, train_rows)
    known = predicted(F.col("text"), profiles)["lang_pred"] != UNKNOWN if profiles.names else lettered(F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), known.alias("known"))
    return rows.where("known").select("row.*")
