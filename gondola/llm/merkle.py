"""Document fingerprints: a Merkle tree over sections and paragraphs.

Sections are separated by blank lines, paragraphs by line ends.  A paragraph's node is the digest of
its text, a section's the digest of its paragraphs' nodes, the root the digest of its sections' nodes
and of the blank lines between them.  Equal roots mean equal texts; where roots differ, the sections and then
the paragraphs whose nodes differ locate the edits (``edits``).

Likeness refines the paragraphs: a paragraph is cut into pieces of up to four words, and two trees
are as alike as the share of the larger one's distinct pieces that the other has (1 for equal roots).

``with_next`` sets every document beside the next one by descending doc_id without one global order:
ids are cut into ranges of a bounded number of rows on average; each range is ordered on its own, and
gets one extra row, the first of the range below (the first of all for the lowest).  Only that one
shuffle moves texts.  The table of ranges is broadcast; it has ``MAX_RANGES`` rows at most.

Only DataFrame functions run on the executors.  Defined results: a null text counts as empty; an empty
text has one empty section; rows equal in doc_id are ordered by text, null doc_ids come last; the next
of the last row is the first, so a single row follows itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_RANGES = 100_000
RANGE_ROWS = 2_000
BLANK = r"\n[\x20\x09-\x0D]*\n"
PIECE = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){1,4}"


def _digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def tree(text: Column) -> Column:
    """Array of sections, each with its node and the nodes of its paragraphs."""
    def section(part: Column) -> Column:
        paragraphs = F.transform(F.split(part, "\n", -1), lambda p: F.sha2(p, 256))
        return F.struct(_digest(paragraphs).alias("node"), paragraphs.alias("paragraphs"))

    return F.transform(F.split(text, BLANK, -1), section)


def root(text: Column) -> Column:
    """Root of the tree of a text."""
    nodes = F.transform(F.split(text, BLANK, -1), lambda s: _digest(
        F.transform(F.split(s, "\n", -1), lambda p: F.sha2(p, 256))))
    gaps = F.array_join(F.regexp_extract_all(text, F.lit(f"({BLANK})")), "|")
    return F.sha2(F.concat(F.array_join(nodes, ""), F.lit(":"), gaps), 256)


def pieces(text: Column) -> Column:
    """Distinct hashes of the pieces of a text."""
    found = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Share of the larger side's distinct pieces in common; 1 for equal roots, 0 if none has any."""
    common = F.size(F.array_intersect(a, b))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(equal, 1.0).when(most == 0, 0.0).otherwise(common / most).cast("double")


def edits(a: Column, b: Column) -> Column:
    """Places (section, paragraph) whose nodes differ between two trees, from 0.  Sections with equal
    nodes are not looked into; a section or paragraph that only one side has counts as different."""
    def within(s: Column) -> Column:
        left, right = F.get(a, s)["paragraphs"], F.get(b, s)["paragraphs"]
        last = F.greatest(F.coalesce(F.size(left), F.lit(0)), F.coalesce(F.size(right), F.lit(0))) - 1
        changed = F.filter(F.sequence(F.lit(0), last),
                           lambda p: ~F.get(left, p).eqNullSafe(F.get(right, p)))
        return F.transform(changed, lambda p: F.struct(s.alias("section"), p.alias("paragraph")))

    every = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    differing = F.filter(every, lambda s: ~F.get(a, s)["node"].eqNullSafe(F.get(b, s)["node"]))
    return F.flatten(F.transform(differing, within))


def with_next(rows: DataFrame, carried: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows of (doc_id, text, ...) with ``next_<column>`` of the next row by descending doc_id."""
    stats = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                     F.count(F.lit(1)).alias("n")).first()
    lo, hi = stats["lo"] or 0, stats["hi"] or 0
    ranges = max(1, min(MAX_RANGES, stats["n"] // range_rows))
    width = max(1, -(-(hi - lo + 1) // ranges))
    place = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(lo)) / F.lit(width)).cast("long")
    place = F.coalesce(place, F.lit(-1).cast("long"))  # null ids are a range below all others
    tops = rows.select("doc_id", place.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top"))
    above = F.lead("range").over(Window.orderBy("range"))
    least = F.min("range").over(Window.partitionBy())
    tops = tops.withColumn("gives_to", F.coalesce(above, least)).select(
        F.col("range").alias("of"), "top", "gives_to")
    targets = F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("extra")))
    extra = F.array(F.struct(F.col("gives_to").alias("at"), F.lit(True).alias("extra")))
    placed = rows.withColumn("range", place).join(F.broadcast(tops), F.col("range") == F.col("of"))
    placed = placed.withColumn("target", F.explode(F.when(
        F.col("doc_id").eqNullSafe(F.col("top")), F.concat(targets, extra)).otherwise(targets)))
    placed = placed.select(*rows.columns, "target.at", "target.extra")
    order = Window.partitionBy("at").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text")
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in carried]
    return placed.select("*", *following).where("NOT extra").drop("at", "extra")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint, pieces) of every document."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", root(F.col("text")).alias("fingerprint"),
                       pieces(F.col("text")).alias("pieces"))


def half_edited(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of every document and of its edited text: the last half of its code points
    replaced by the first as many of the next document."""
    rows = with_next(fingerprinted(docs), ["text", "fingerprint", "pieces"], range_rows)
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", chars.cast("long").alias("n_chars"), "fingerprint", "pieces",
                       "next_fingerprint", "next_pieces", edited.alias("edited"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"),
                       root(F.col("edited")).alias("edited_fingerprint"),
                       pieces(F.col("edited")).alias("edited_pieces"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("pieces"), F.col("edited_pieces"),
                 F.col("fingerprint") == F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("pieces"), F.col("next_pieces"),
                 F.col("fingerprint") == F.col("next_fingerprint")).alias("near_next"))
