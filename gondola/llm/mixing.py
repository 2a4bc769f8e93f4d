"""Mixing sources to target weights, by capped water-filling and seeded repetitions.

``water_fill`` gives each source its share of a word budget by weight, but never more than
``max_epochs`` times its size; what a clamped source cannot take is shared again by weight among the
rest, until no share is above its cap.  If the budget exceeds all caps together, every source is at
its cap.

``mix`` then takes words: every document ``floor(target / size of its source)`` times whole, and the
rest of the target from the documents in the order of a seeded hash, up to the point where the source
has taken its target; the document at that point is taken in part.  Each source therefore takes its
target to the word (rounded), and a rerun takes the same.

Size: documents are summed by (source, slot), where the slot is the leading hex digits of the hash,
so a source with a third of all rows is spread over all slots; slots grow in number with the documents, and
the order of the hash, hence the mix, is the same for any number.  Running sums go over slots first, then
over the rows of one slot.  No Python runs on the executors.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of its own;
equal doc_ids have equal hashes and are ordered by size, so equal rows are interchangeable; a null
doc_id hashes like an empty one, followed by the digest of the text if there is a text; an empty table gives an empty mix.  Columns of ``docs`` travel in a
struct, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gondola.llm.common import Scratch, word_count

SEED = "mix"
SLOT_ROWS = 4_000
MAX_SLOT_DIGITS = 5  # a million slots: the running sums over the slots of a source are one task


def slot_digits(rows: int) -> int:
    """Hex digits of a slot, so that a slot has ``SLOT_ROWS`` rows at most on average."""
    digits = 1
    while rows > SLOT_ROWS * 16 ** digits and digits < MAX_SLOT_DIGITS:
        digits += 1
    return digits


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to sources (source, source_size, weight).

    Each round clamps the sources whose share exceeds their cap; three scalars reach the driver per
    round.  The level only rises, so it ends after at most as many rounds as there are sources.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.col("weight").cast("double")
    clamped, level = -1, 0.0
    while True:
        over = (cap <= F.lit(level) * weight) if clamped >= 0 else F.lit(False)
        row = sources.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(over, 0.0).otherwise(weight)).alias("weight"),
            F.sum(F.when(over, 1).otherwise(0)).alias("n"),
        ).first()
        if row["n"] is None or not row["weight"]:
            return sources.withColumn("target", cap)
        if row["n"] == clamped:
            return sources.withColumn("target", F.least(cap, F.lit(level) * weight))
        clamped, level = row["n"], (budget - row["taken"]) / row["weight"]


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights by rank of the source name (code points, null last), repeating.  One row per source
    is ordered, not the documents."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(table, (rank % len(weights) + 1).cast("int")))


def _base(docs: DataFrame, size: Column | None, seed: str, digits: int) -> DataFrame:
    nameless = F.coalesce(F.md5("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.when(F.col("doc_id").isNull(), nameless).otherwise(
        F.col("doc_id").cast("string"))))
    measured = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source",
        (word_count(F.col("text")) if size is None else size).alias("size"), digest.alias("draw"))
    return measured.withColumn("slot", F.substring("draw", 1, digits))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1),
        budget_ratio: float = 1.5, max_epochs: float = 2.0, seed: str = SEED,
        size: Column | None = None) -> DataFrame:
    """Rows (row, doc_id, size, source, source_size, target, whole, extra, taken): ``row`` holds the
    columns of ``docs``; the mix takes the text ``whole`` times and ``extra`` words of it once more.
    """
    scratch = Scratch(spark, "mix")
    base = _base(docs, size, seed, slot_digits(docs.count()))
    slots = scratch.write("slots", base.groupBy("source", "slot").agg(F.sum("size").alias("slot_size")))
    sources = slots.groupBy("source").agg(F.sum("slot_size").alias("source_size"))
    sources = scratch.write("sources", cyclic_weights(sources, weights))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(sources, total * budget_ratio, max_epochs).withColumnRenamed("source", "of")

    earlier = Window.partitionBy("source").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ratio = F.col("target") / F.col("source_size")
    state = (
        slots.withColumn("before", F.sum("slot_size").over(earlier) - F.col("slot_size"))
        .join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0).cast("long"))
        .withColumn("cut", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
        .select(F.col("source").alias("of"), F.col("slot").alias("of_slot"), "before", "source_size",
                "target", "whole", "cut")
    )
    in_slot = Window.partitionBy("source", "slot").orderBy("draw", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("size").over(in_slot) - F.col("size")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("cut") - F.col("start")))
    return (
        base.join(state, F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("of_slot")))
        .withColumn("start", start)
        .withColumn("extra", extra)
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
        .select("row", "doc_id", "size", "source", "source_size", "target", "whole", "extra", "taken")
    )


def mixed_rows(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: each document as often as it is taken.  The one document per source that is
    taken in part gets its last copy if at least half of it is taken."""
    taken = mix(spark, docs, **options)
    copies = F.col("whole") + F.when(
        (F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)
    return (
        taken.withColumn("copies", copies.cast("int")).where("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("row.*")
    )
