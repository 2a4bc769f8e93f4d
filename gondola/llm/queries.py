"""Registered queries of the pipeline operators, and the SQL that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gondola.llm import (
    bpe, bytes_dedup, exact, langid, licenses, merkle, mixing, negatives, neighbours, pii, prefix_trie,
    simhash, substring,
)
from gondola.llm.common import Scratch, word_count
from gondola.llm.tiles import usable


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, with weights 5, 2, 1 by source and 150 % of all words."""
    docs = _documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    docs = Scratch(spark, "op1").write("sizes", docs)
    return mixing.mix(spark, docs, size=F.col("size")).select(
        "doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_value(5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE)
           [((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM docs GROUP BY source),
capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (SELECT sum(source_size) FROM sources) * 1.5::DOUBLE AS budget,
         row_number() OVER (ORDER BY source_size / weight, encode(source) NULLS LAST) AS k
  FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / sum(weight) OVER rest AS level
  FROM capped
  WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
best AS (SELECT level FROM levels WHERE cap > level * weight ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM best) * weight, cap)) AS target
  FROM capped),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole
  FROM targets),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.whole,
         round(s.target - s.whole * s.source_size)::BIGINT AS cut,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size ROWS UNBOUNDED PRECEDING)
           - d.size AS start
  FROM docs d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole * size + greatest(0, least(size, cut - start)))::BIGINT AS taken
FROM placed
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents: those with an even doc_id are published as a snapshot, all
    others arrive as a batch."""
    return exact.dedup(spark, *exact.halves(_documents(spark, sf_dir))).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of all documents and the component each belongs to."""
    return simhash.near_duplicates(spark, _documents(spark, sf_dir)).select(
        "doc_id", "fingerprint", "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    return langid.identify(spark, _documents(spark, sf_dir))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document keeps when windows of 13 words stay in the smallest doc_id only."""
    return substring.dedup(spark, _documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER ahead AS k
  FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
  QUALIFY count(*) OVER ahead = 13),
least AS (SELECT k, min(doc_id) AS lo FROM windows GROUP BY k),
hits AS (SELECT w.doc_id, w.i FROM windows w JOIN least l ON w.k = l.k WHERE l.lo < w.doc_id),
marked AS (
  SELECT w.doc_id, w.word, w.i, coalesce(bool_or(h.i IS NOT NULL) OVER (
           PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
  FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id AND w.i = h.i),
sums AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed,
         string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document keeps when strings of 50 bytes stay in the smallest doc_id only."""
    return bytes_dedup.dedup(spark, _documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    return merkle.half_edited(_documents(spark, sf_dir))


OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, t AS text, length(t) AS n_chars, length(t) // 2 AS half,
         coalesce(lead(t) OVER latest, first_value(t) OVER latest) AS next_text
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
  WINDOW latest AS (ORDER BY doc_id DESC NULLS LAST, t
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
texts AS (
  SELECT *, substring(text, 1, n_chars - half) || substring(next_text, 1, half) AS edited FROM docs),
versions AS (SELECT text AS t FROM texts UNION SELECT edited FROM texts),
trees AS (
  SELECT t, sha256(array_to_string(list_transform(
           regexp_split_to_array(t, '\n[\x20\x09-\x0D]*\n'), lambda s: sha256(array_to_string(
             list_transform(string_split(s, chr(10)), lambda p: sha256(p)), ''))), '')
           || ':' || array_to_string(regexp_extract_all(t, '\n[\x20\x09-\x0D]*\n'), '|')) AS root,
         list_distinct(regexp_extract_all(t, '(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,4}')) AS pieces
  FROM versions),
met AS (
  SELECT x.*, a.root AS fingerprint, e.root AS edited_fingerprint, n.root AS next_fingerprint,
         greatest(len(a.pieces), len(e.pieces)) AS most_edited, greatest(len(a.pieces), len(n.pieces)) AS most_next,
         len(list_intersect(a.pieces, e.pieces)) AS same_edited, len(list_intersect(a.pieces, n.pieces)) AS same_next
  FROM texts x JOIN trees a ON a.t = x.text JOIN trees e ON e.t = x.edited JOIN trees n ON n.t = x.next_text)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE WHEN most_edited = 0 THEN 0.0::DOUBLE
            ELSE same_edited::DOUBLE / most_edited END AS near_edited,
       CASE WHEN fingerprint = next_fingerprint THEN 1.0::DOUBLE WHEN most_next = 0 THEN 0.0::DOUBLE
            ELSE same_next::DOUBLE / most_next END AS near_next
FROM met
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.tokenized(spark, F.col("text"), path, public_tokenizers.PATTERN)
    return _documents(spark, sf_dir).select("doc_id", found.alias("found")).select("doc_id", "found.*")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document: declared in its text, or inherited from the nearest directory."""
    path = licenses.document_path(F.col("doc_id"), F.col("source"))
    return licenses.scan(spark, _documents(spark, sf_dir).select("doc_id", "text", path.alias("path")))


#: A fixed key, so that reruns agree; a user passes their own secret.
PII_KEY = "pseudonyms of the registered query"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms in the same format."""
    rows = pii.pseudonymized(_documents(spark, sf_dir), PII_KEY)
    return rows.select(F.col("row.doc_id").alias("doc_id"), F.size("found").cast("long").alias("found"),
                       "replaced", F.sha2("new_text", 256).alias("text_sha256"),
                       F.col("new_text").alias("text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each anchor and each of its five nearest rows of the same label."""
    divides = lambda n: F.col("vec_id") % n == 0
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(divides(7), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), label.alias("label"), negatives.quantized(F.col("embedding")).alias("vector"))
    return negatives.mine(spark, rows, anchor=F.col("id") % 50 == 0)


OP11_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id AND len(a.q) = len(b.q)),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id NULLS LAST) <= 5),
ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score,
         n.score AS negative_score, row_number() OVER (
           PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id NULLS LAST) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of conversations, each with its first turns taken from the one its fives begin with."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = F.col("conv_id")
    rebuilt = prefix_trie.grafted(prefix_trie.turns(rows), base=own - own % 5,
                                  heads=F.crc32(own.cast("string")) % 9, most=8)
    return prefix_trie.trie(spark, rebuilt)


OP12_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
conversation AS (
  SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS digests,
         list(strlen(text) ORDER BY turn NULLS FIRST, digest) AS sizes,
         -- crc32 of the decimal conv_id, bit by bit
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
             lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS head
  FROM turns GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id,
         list_concat(coalesce(list_slice(b.digests, 1, c.head), []), list_slice(c.digests, c.head + 1, len(c.digests))) AS digests,
         list_concat(coalesce(list_slice(b.sizes, 1, c.head), []), list_slice(c.sizes, c.head + 1, len(c.sizes))) AS sizes
  FROM conversation c LEFT JOIN conversation b ON b.conv_id = c.conv_id - c.conv_id % 5),
starts AS (SELECT *, unnest(range(0, len(digests) + 1)) AS depth FROM rebuilt),
keyed AS (
  SELECT *, array_to_string(list_slice(digests, 1, depth), '') AS k, coalesce(sizes[depth], 0) AS size FROM starts),
nodes AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(digests) = depth), '')) AS ends_sha256
  FROM keyed GROUP BY k, depth),
children AS (
  SELECT left(k, 32 * (depth - 1)) AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
under AS (
  SELECT left(n.k, 32 * d) AS k, sum(n.saved) AS saved_tokens, count(*) FILTER (c.k IS NULL) AS n_leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) n LEFT JOIN children c ON n.k = c.k GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs,
       coalesce(c.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN under u ON n.k = u.k LEFT JOIN children c ON n.k = c.k
LEFT JOIN nodes p ON n.depth > 0 AND p.k = left(n.k, 32 * (n.depth - 1))
"""


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.nearest(spark, rows, query=F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_substrings": op5_substrings,
    "op6_merkle": op6_merkle,
    "op7_suffix_array": op7_suffix_array,
    "op8_bpe": op8_bpe,
    "op9_licenses": op9_licenses,
    "op10_pii": op10_pii,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_neighbours": op13_neighbours,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op5_substrings": OP5_SQL,
    "op6_merkle": OP6_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
