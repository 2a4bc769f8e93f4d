"""Every operator, query and stage against plain versions: on the test tables and on awkward rows."""

import random
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import differences
from gondola.llm import (
    bpe, bytes_dedup, exact, langid, licenses, merkle, mixing, pii, simhash, substring,
    windows,
)
from gondola.llm.common import Scratch
from gondola.llm.components import components
from gondola.llm.queries import ORACLES, PII_KEY, QUERIES
from tests.llm import brute

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Names that the operators use inside.
CLASHING = ["row", "digest", "key", "print", "size", "fp", "draw", "slot", "found", "keep_id", "spans", "id"]


def _awkward():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioust") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(400)]
    texts = [None, "", "  \n\t ", "12 34 !!", passage, passage, f"start {passage} end", "a " * 3_000,
             "x" * 5_000, " ".join(word() for _ in range(20_000)), "É" * 40, "Ein\n\n \nZwei\nDrei\n\n"]
    for k in range(12):  # near copies
        edited = list(base)
        edited[rng.randrange(400)] = word()
        texts.append(" ".join(edited))
    texts += [" ".join([word(), passage[k:], word()]) for k in range(8)]
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["b", "a", "é", None, ""])) for k, t in
            enumerate(texts)]
    rows += [rows[4], rows[0], rows[12], (None, passage, None, None), (None, None, None, None), (-5, passage, "en", "a"),
             (3, "another text under a known doc_id", "en", "b")]
    return rows


AWKWARD = _awkward()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{c} string" for c in CLASHING)


def _table(spark, rows):
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), *["x"] * len(CLASHING)) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    return _table(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tiny():
    return duckdb.sql("SELECT doc_id, text, lang, source FROM '/root/testdata/sf0.001/documents.parquet' "
                      "ORDER BY doc_id").fetchall()


TEXTS = [(r[0], r[1]) for r in AWKWARD]


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def query(name, spark, sf_dir):
    return QUERIES[name](spark, sf_dir)


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(name, spark, sf_dir):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    assert differences(query(name, spark, sf_dir), duck, ORACLES[name]) == []


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# 1 Mixing

def test_mix_awkward(spark, awkward):
    found = mixing.mix(spark, awkward)
    expected = brute.mix([(r[0], r[1], r[3]) for r in AWKWARD])
    assert rows(found, "doc_id", "size", "source_size", F.round("target", 6), "taken") == Counter(
        (i, n, s, round(t, 6), k) for i, n, s, t, k, _, _ in expected)
    assert all(r["taken"] <= 2 * r["size"] for r in found.collect())
    again = mixing.mix(spark, _table(spark, AWKWARD[::-1]))
    assert rows(found, "doc_id", "size", "taken") == rows(again, "doc_id", "size", "taken")


def test_slots_grow_with_the_documents(spark, awkward, monkeypatch):
    """Any number of slots gives the same mix; rows without an id are spread by their texts."""
    assert [mixing.slot_digits(n) for n in (0, 60_000, 70_000, 2_000_000, 10 ** 12)] == [1, 1, 2, 3, 5]
    usual = rows(mixing.mix(spark, awkward), "doc_id", "size", "taken")
    monkeypatch.setattr(mixing, "SLOT_ROWS", 1)
    assert rows(mixing.mix(spark, awkward), "doc_id", "size", "taken") == usual
    nameless = spark.createDataFrame([(None, f"text {k}", "a") for k in range(500)],
                                     "doc_id long, text string, source string")
    slots = mixing._base(nameless, None, mixing.SEED, 2).groupBy("slot").count()
    assert slots.agg(F.max("count")).first()[0] < 20


def test_mix_reaches_targets(spark, sf_dir):
    taken = query("op1_mix_sources", spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in taken.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect():
        assert abs(r["n"] - r["t"]) <= 1


@pytest.mark.parametrize("sizes, weights, budget", [
    ([10, 10, 10], [1, 1, 1], 30.0), ([1, 100, 100], [8, 1, 1], 150.0), ([1, 2, 3], [1, 5, 9], 1e9),
    ([0, 5], [1, 1], 4.0), ([5, 1, 1, 1], [1, 50, 50, 50], 8.0)])
def test_water_filling(spark, sizes, weights, budget):
    table = spark.createDataFrame([(str(k), s, float(w)) for k, (s, w) in enumerate(zip(sizes, weights))],
                                  "source string, source_size long, weight double")
    found = {r["source"]: r["target"] for r in mixing.water_fill(table, budget, 2.0).collect()}
    expected = brute.fill({str(k): s for k, s in enumerate(sizes)},
                          {str(k): w for k, w in enumerate(weights)}, budget, 2.0)
    assert found == pytest.approx(expected)


# 2 Exact dedup

def test_exact_awkward(spark, awkward):
    published, batch = exact.halves(awkward)
    for options in ({}, {"shard_keys": 3}):
        found = exact.dedup(spark, published, batch, **options)
        assert rows(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == Counter(
            brute.exact(TEXTS))


def test_byte_check_finds_colliding_digests(spark, awkward):
    weak = lambda text: (F.length(text) % 5).cast("string")
    found = exact.dedup(spark, *exact.halves(awkward), digests=(weak, exact.sha256))
    assert rows(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == Counter(brute.exact(TEXTS))
    with pytest.raises(exact.DigestCollision):
        exact.dedup(spark, *exact.halves(awkward), digests=(weak,))


def test_exact_stage(spark, awkward):
    kept = exact.deduplicated(spark, awkward)
    assert kept.columns == awkward.columns
    best = {(i, d) for i, _, _, s, d in brute.exact(TEXTS) if s}
    assert Counter((r["doc_id"], brute.sha(r["text"] or "")) for r in kept.collect()) == Counter(best)


# 3 SimHash

def test_near_awkward(spark, awkward):
    expected = Counter(brute.near(TEXTS))
    for dense in (0, 3, 64):
        found = simhash.near_duplicates(spark, awkward, dense=dense)
        assert rows(found, "doc_id", "fingerprint", "component_id") == expected


def test_near_query(spark, sf_dir, tiny):
    found = query("op3_simhash", spark, sf_dir)
    assert rows(found, "doc_id", "fingerprint", "component_id") == Counter(brute.near([r[:2] for r in tiny]))


@pytest.mark.parametrize("bits", [1, 2])
def test_links_of_crowded_keys(spark, bits):
    rng = random.Random(bits)
    nodes = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(50):
            nodes.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    nodes = [n - (1 << 64) if n >> 63 else n for n in nodes]
    table = spark.createDataFrame([(n,) for n in nodes], "fp long")
    plain = lambda n: n & ((1 << 64) - 1)
    expected = brute.clusters(set(nodes), lambda a, b: (plain(a) ^ plain(b)).bit_count() <= bits)
    for dense in (0, 4, 10_000):
        scratch = Scratch(spark, "test")
        edges = scratch.write("edges", simhash.links(scratch, table, bits, dense))
        assert all((plain(r.a) ^ plain(r.b)).bit_count() <= bits for r in edges.collect())
        found = {r["node"]: r["root"] for r in components(scratch, edges).collect()}
        assert {n: found.get(n, n) for n in nodes} == expected


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 200), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(Scratch(spark, "test"), edges).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 200: 100}


def test_near_stage(spark, awkward):
    kept = simhash.representatives(spark, awkward)
    gone = {i for i, _, c in brute.near(TEXTS) if c is not None and c != i}
    assert kept.columns == awkward.columns
    assert rows(kept, "doc_id", "text") == Counter(t for t in TEXTS if t[0] not in gone)


def test_near_stage_drops_rows_and_not_ids(spark):
    base = [f"w{k}" for k in range(300)]
    a, b, c, d = (" ".join([f"{p}{w}" for w in base]) for p in "abcd")
    assert simhash.fingerprint(a) == simhash.fingerprint(a.upper())
    given = [(1, a), (None, a.upper()),  # a copy without an id, beside an unrelated one
             (None, b), (2, c), (3, c.upper()), (3, b + " " + a),  # two texts under one id
             (None, d), (None, d.upper()), (None, d)]  # a group without any id
    table = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    kept = rows(simhash.representatives(spark, table), "doc_id", "text")
    last = min([d, d.upper()], key=brute.sha)
    assert kept == Counter([(1, a), (None, b), (2, c), (3, b + " " + a), (None, last)])


# 4 Language

def test_language_query(spark):
    found = query("op4_language", spark, "/root/testdata/sf0.01").toPandas()
    truth = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert len(found) == len(truth)
    assert all(found.held_out == found.doc_id.map(brute.held_out))
    assert found.score.between(0, 1).all()
    held = found[found.held_out]
    assert (held.lang_pred == held.doc_id.map(truth)).mean() > 0.97


def test_language_awkward(spark, awkward):
    found = langid.identify(spark, awkward).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in TEXTS)
    letters = {(i, any(c.isalpha() for c in t or "")) for i, t in TEXTS}
    assert all(((r["doc_id"], r["lang_pred"] != "und") in letters) for r in found)
    profiles = langid.learn(awkward)
    again, _ = profiles.predict([t for _, t in TEXTS])
    assert Counter(again) == Counter(r["lang_pred"] for r in found)


def test_language_learns_from_its_fold_only(spark, awkward):
    changed = awkward.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    assert langid.learn(changed).names == langid.learn(awkward).names


def test_language_stage(spark, awkward):
    kept = langid.accepted(spark, awkward)
    assert kept.columns == awkward.columns
    assert rows(kept, "doc_id", "text") == Counter(
        t for t in TEXTS if any(c.isalpha() for c in t[1] or ""))


def test_rare_languages_are_learned(spark):
    """The sample is drawn by language; a table without labels loses no text."""
    rng = random.Random(3)
    say = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(12))
    given = [(k, say("abcdefgh"), "en") for k in range(6_000)] + [(k, say("rstuvwxyz"), "pl") for k in range(7_000, 7_030)]
    table = spark.createDataFrame(given, "doc_id long, text string, lang string").repartition(3)
    found = langid.identify(spark, table, train_rows=100).toPandas().set_index("doc_id").lang_pred
    assert all(found[k] == lang for k, _, lang in given)
    blank = table.where("lang = 'pl'").withColumn("lang", F.lit(None).cast("string"))
    assert langid.accepted(spark, blank.unionByName(spark.createDataFrame(
        [(1, "12 .", None), (2, None, None)], blank.schema))).count() == 30


@pytest.mark.parametrize("counts,rows,most", [([5, 5], 100, 5), ([1, 50, 50], 21, 10), ([30, 60_000], 400, 370),
                                              ([], 5, 0), ([9, 9, 9], 2, 1)])
def test_sample_by_language(counts, rows, most):
    assert langid.quota(dict(enumerate(counts)), rows) == most


def test_language_by_brute_force(spark, tiny):
    """Predictions from vectors bundled one n-gram at a time."""
    def bundle(text):
        run = re.sub(r"0+", "0", "0" + "".join(c if c.isalpha() else "0" for c in text.lower()) + "0")
        total = np.zeros(langid.DIMENSIONS)
        for gram, n in Counter(run[k:k + 3] for k in range(len(run) - 2)).items():
            points = np.array([0 if c == "0" else ord(c) for c in gram], np.uint32)
            a, b, c = (np.roll(v, k) for k, v in enumerate(langid.letter_vectors(points)))
            total += n * a * b * c
        return total / (np.linalg.norm(total) or 1)

    chosen = [r for r in tiny if r[1] and any(c.isalpha() for c in r[1]) and len(r[1]) < 3_000][:120]
    sums = {}
    for i, text, lang in ((r[0], r[1], r[2]) for r in chosen):
        if lang and not brute.held_out(i):
            sums[lang] = sums.get(lang, 0) + bundle(text)
    names = sorted(sums)
    unit = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    table = spark.createDataFrame([(r[0], r[1], r[2]) for r in chosen], "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark, table).collect()}
    for i, text in ((r[0], r[1]) for r in chosen):
        cosines = unit @ bundle(text)
        assert abs(found[i][1] - max(0, cosines.max())) < 1e-4
        assert cosines[names.index(found[i][0])] > cosines.max() - 1e-4


# 5 and 7 Substrings

def test_substrings_awkward(spark, awkward):
    for options in ({}, {"shard_bytes": 2_000}):  # small shards crowd anchors, down to single windows
        found = substring.dedup(spark, awkward, **options).withColumn("sha", F.sha2("kept_text", 256))
        assert rows(found, "doc_id", "n_words", "n_removed", "sha") == Counter(brute.substrings(TEXTS))


def test_byte_strings_awkward(spark, awkward):
    short = [(i, (t or "")[:9_000] if t else t) for i, t in TEXTS]
    table = awkward.withColumn("text", F.substring("text", 1, 9_000))
    for options in ({}, {"shard_bytes": 9_000}):
        found = bytes_dedup.dedup(spark, table, **options).withColumn("sha", F.sha2("kept", 256))
        assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == Counter(
            brute.byte_strings(short))


def test_crowded_anchors_are_cut_again(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = " ".join(word() for _ in range(14))
    given = [(k, " ".join([*(word() for _ in range(14)), line, *(word() for _ in range(14))])) for k in range(60)]
    given += [(None, line), (7, line + " " + line)]
    table = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    pieces = spark.sparkContext.accumulator(0)

    def matcher(contents, anchors, *rest):
        under = Counter()
        for anchor, content in zip(anchors.tolist(), contents):
            under[anchor] += len(content)
        assert max(under.values()) <= 100  # an eighth of a shard
        pieces.add(len(contents))
        return substring.match(contents, anchors, *rest)

    spans = windows.covered(spark, table, substring.UNITS, matcher, 800)
    found = windows.with_spans(table, spans).collect()
    expected = brute.removed(given, str.split, substring.WORDS)
    expected = Counter((i, " ".join(words), sum(gone)) for i, words, gone in expected)
    assert pieces.value > 60  # contexts of the line under further anchors, not all as single windows
    assert Counter((windows.LAST if r["doc_id"] is None else r["doc_id"], r["text"], int(windows.mask(
        None if r["spans"] is None else pd.Series(r["spans"]).to_numpy(), len(r["text"].split()),
        substring.WORDS).sum())) for r in found) == Counter(
            {(windows.LAST if i is None else i, t, n): c for (i, t, n), c in expected.items()})


def test_equal_texts_are_one_before_windows_are_compared(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    copied, short = text(60), text(5)
    given = [(k, copied) for k in range(20, 0, -1)] + [(30, short), (31, short), (None, copied), (40, text(40))]
    table = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    compared = spark.sparkContext.accumulator(0)

    def matcher(contents, *rest):
        compared.add(len(contents))
        return substring.match(contents, *rest)

    found = windows.with_spans(table, windows.covered(spark, table, substring.UNITS, matcher, 800)).collect()
    assert compared.value == 0  # copies of a text share nothing with another text
    gone = {r["doc_id"]: windows.mask(None if r["spans"] is None else np.array(r["spans"]), len(r["text"].split()),
                                      substring.WORDS).sum() for r in found}
    assert gone == {k: 0 if k in (1, 30, 31, 40) else 60 for k, _ in given}


def test_texts_with_one_hash_keep_their_windows(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    line, other = text(20), text(20)
    given = [(k, " ".join([text(3 + k % 2), (line, other)[k % 3 % 2], text(4)])) for k in range(12)]
    given += [(20, given[3][1]), (21, given[4][1])]
    documents = windows._documents
    monkeypatch.setattr(windows, "_documents", lambda docs: documents(docs).withColumn(
        "print", F.length("text").cast("long") % 2))
    table = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    spans = {}
    for r in windows.covered(spark, table, substring.UNITS, substring.match, 800).collect():
        spans.setdefault(r["key"], []).extend(r["spans"])
    expected = {i: gone for i, _, gone in brute.removed(given, str.split, substring.WORDS)}
    for i, t in given:
        assert windows.mask(np.array(spans.get(i, []), np.int64), len(t.split()), substring.WORDS).tolist() == list(
            expected[i])


def test_substring_queries(spark, sf_dir, tiny):
    pairs = [r[:2] for r in tiny]
    found = query("op5_substrings", spark, sf_dir)
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.substrings(pairs))
    found = query("op7_suffix_array", spark, sf_dir)
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(
        brute.byte_strings(pairs))


# 6 Merkle

def test_merkle_awkward(spark, awkward):
    small = AWKWARD[:9] + AWKWARD[10:]
    for range_rows in (1, 3, 2_000):
        found = merkle.half_edited(_table(spark, small), range_rows).collect()
        ordered = sorted(((r[0], r[1] or "") for r in small),
                         key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
        expected = Counter()
        for k, (i, text) in enumerate(ordered):
            after, half = ordered[(k + 1) % len(ordered)][1], len(text) // 2
            expected[(i, len(text), brute.sha(text[:len(text) - half] + after[:half]))] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == expected
        prints = {brute.sha(t): None for _, t in ordered}
        assert len({r["fingerprint"] for r in found}) == len(prints)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)


def test_edits_are_located(spark):
    a = "One\nTwo\n\nThree\nFour\n\nFive"
    b = "One\nTwo\n\nThree\nfour\n\nFive\nSix"
    table = spark.createDataFrame([(a, b), (a, a), ("", "")], "a string, b string")
    found = table.select(merkle.edits(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("e"),
                         (merkle.root(F.col("a")) == merkle.root(F.col("b"))).alias("same")).collect()
    assert [[tuple(x) for x in r["e"]] for r in found] == [[(1, 1), (2, 1)], [], []]
    assert [r["same"] for r in found] == [False, True, True]


# 8 BPE

def test_tokens(spark, awkward, sf_dir, tiny):
    ranks = bpe.read_ranks(PATH)
    usual = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def expected(pairs):
        out = Counter()
        for i, text in pairs:
            ids = usual.encode_ordinary(text or "")
            out[(i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text or ""))] += 1
        return out

    found = awkward.select("doc_id", bpe.tokenized(spark, F.col("text"), PATH, PATTERN).alias("t"))
    assert rows(found, "doc_id", "t.n_tokens", "t.ids_sha256", "t.decoded_sha256") == expected(TEXTS)
    found = query("op8_bpe", spark, sf_dir)
    assert rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(r[:2] for r in tiny)
    ids = awkward.select("text", bpe.token_ids(spark, F.col("text"), PATH, PATTERN).alias("ids"))
    back = ids.select("text", bpe.detokenized(spark, F.col("ids"), PATH).cast("string").alias("back"))
    assert all((r["text"] or "") == r["back"] for r in back.collect())


# 9 Licenses

def brute_licenses(given):
    """Own license of each (id, path, text), and the inherited one."""
    words = lambda text: re.findall("[a-z0-9]+", text.lower())
    cue = re.compile("licen[sc]|copyright|rights reserved|redistribut|public domain|permission|warrant|spdx", re.I)
    df = Counter(w for _, _, text in given for w in set(words(text or "")))
    weigh = lambda bag: {w: c * (1 + np.log((1 + len(given)) / (1 + df[w]))) for w, c in bag.items()}
    length = lambda v: sum(x * x for x in v.values()) ** 0.5
    cosine = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items()) / length(a) / length(b)
    models = [(name, weigh(Counter(words(text)))) for name, text in licenses.TEMPLATES]
    apart = [[set(m) - set(o) for other, o in models if other != name and cosine(m, o) >= 0.3 and set(m) - set(o)]
             for name, m in models]

    def runs(parts, most, joint):
        return {joint.join(parts[k:k + n]) for n in range(1, most + 1) for k in range(len(parts))}

    def best(text):
        lines = [x for x in text.split("\n") if re.search("[A-Za-z0-9]", x)]
        found = {text} | runs(lines, 4, "\n") | runs(re.split(r"\n(?:[^A-Za-z0-9\n]*\n)+", text), 5, "\n")
        top = None
        for bag in {" ".join(words(u)) for u in found if cue.search(u)} - {""}:
            unit = weigh(Counter(bag.split()))
            for (name, model), sets in zip(models, apart):
                if all(s & set(unit) for s in sets):
                    score = round(cosine(unit, model), 9)
                    rank = (name == "Proprietary", -score, name)
                    if score >= 0.7 and (top is None or rank < top):
                        top = rank
        return top and (-top[1], top[2])

    once = {text: best(text) for text in {t for _, _, t in given if t}}
    own = [once.get(text) for _, _, text in given]
    folders = {}
    for (_, path, _), best in zip(given, own):
        folder = path.rpartition("/")[0] if path else None
        if best and folder:
            if folder not in folders or (-best[0], best[1]) < (-folders[folder][0], folders[folder][1]):
                folders[folder] = best
    out = []
    for (i, path, _), best in zip(given, own):
        folder, source = (path or "").rpartition("/")[0], None
        while folder and source is None and not best:
            source = folder if folder in folders else None
            folder = folder.rpartition("/")[0]
        out.append((i, path, best and best[0], best and best[1], best[1] if best else source and folders[source][1], source))
    return out


LICENSE_COLUMNS = ("doc_id", "path", "own_score", "own_license", "license", "inherited_from")


def same_licenses(found, expected):
    key = lambda r: tuple((x is None, x) for x in (r[:2] + r[3:]))
    left, right = (sorted((tuple(r) for r in x), key=key) for x in (found, expected))
    assert [r[:2] + r[3:] for r in left] == [r[:2] + r[3:] for r in right]
    assert all(a[2] == b[2] or abs(a[2] - b[2]) < 1e-6 for a, b in zip(left, right))


def test_licenses(spark, sf_dir, tiny):
    found = query("op9_licenses", spark, sf_dir).select(*LICENSE_COLUMNS).collect()
    paths = {r["doc_id"]: r["path"] for r in found}
    same_licenses(found, brute_licenses([(r[0], paths[r[0]], r[1]) for r in tiny]))
    assert sum(r["own_license"] is not None for r in found) > 0


def test_licenses_awkward(spark):
    given = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x", "code"), (3, "a/b/x", None),
             (4, "z/x", ""), (5, None, "All rights reserved."), (6, "top", "nothing"), (1, "a/LICENSE",
             "Released under the MIT License."), (7, "a/b/c/y", "x\nAll  RIGHTS reserved!!\ny"),
             (8, "a/b/c/d/e", "the the the"), (None, "a/q", "Licensed under CC BY-NC 4.0."),
             (9, "w/x", "All rights reserved. " * 3_000), (10, "v/x", "// \n\n * \n*/\n\n")]
    table = spark.createDataFrame([(*g, "x") for g in given], "doc_id long, path string, text string, row string")
    same_licenses(licenses.scan(spark, table).select(*LICENSE_COLUMNS).collect(), brute_licenses(given))


def wrapped(text, width, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_headers_and_files(spark):
    """Headers as they stand in code, wrapped statements, whole texts and identifiers."""
    headers = dict((f"{name} {k}", text) for k, (name, text) in enumerate(licenses.HEADERS))
    pick = lambda start: next(t for n, t in headers.items() if n.startswith(start))
    prose = "The committee met again in spring and found that seven bridges need repair before winter."
    code = "import sys\n\n\ndef main(argv):\n    return len(argv)\n"
    address = "\n#\n# You should have received a copy of it along with this program; if not, write to its authors.\n\n"
    bsd3 = next(t for n, t in headers.items() if n.startswith("BSD-3"))
    holder = "Copyright (c) 2019, Some Holder\nAll rights reserved.\n\n"
    clauses = lambda t: re.sub(r" (?=[123]\. |THIS SOFTWARE)", "\n\n", t)
    given = {
        "gpl3-wrapped": (f"{prose}\nThis work is licensed under the GNU General Public License,\nversion 3.\n{prose}", "GPL-3.0"),
        "gpl2-wrapped": (f"{prose}\nThis work is licensed under the GNU General Public\nLicense, version 2.", "GPL-2.0"),
        "gpl-none": (f"{prose}\nThis work is licensed under the GNU General Public License.", None),
        "gpl2": ("# prog - does a thing\n#\n" + wrapped(pick("GPL-2.0"), 70, "# ") + address + code, "GPL-2.0"),
        "gpl3": ("/*\n * prog\n *\n" + wrapped(pick("GPL-3.0"), 70, " * ") + "\n */\n" + code, "GPL-3.0"),
        "lgpl": (wrapped(pick("LGPL-3.0"), 60, "// ") + "\n\n" + code, "LGPL-3.0"),
        "lgpl2": (wrapped(pick("LGPL-2.1"), 60, "// ") + "\n\n" + code, "LGPL-2.1"),
        "agpl": (wrapped(pick("AGPL-3.0"), 72) + "\n\n" + code, "AGPL-3.0"),
        "mit": ("MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped(
            [t for n, t in headers.items() if n.startswith("MIT")][1], 78), "MIT"),
        "bsd2": (holder + wrapped(pick("BSD-2"), 78), "BSD-2-Clause"),
        "bsd3": (holder + wrapped(bsd3, 78), "BSD-3-Clause"),
        "bsd3-code": ("\n".join("# " + x for x in (holder + clauses(bsd3)).split("\n")) + "\n\n" + code * 9, "BSD-3-Clause"),
        "bsd-none": ("Redistribution and use in source and binary forms are permitted.", None),
        "apache": (wrapped([t for n, t in headers.items() if n.startswith("Apache")][1], 70, "# ") + "\n" + code, "Apache-2.0"),
        "isc": (holder + wrapped([t for n, t in headers.items() if n.startswith("ISC")][1], 70), "ISC"),
        "rights": (f"{prose}\n\nAll rights reserved.\n", "Proprietary"),
        "prose": (f"{prose} Few rights were reserved by the public, and no licence was ever asked of the ferry.", None)}
    given |= {f"spdx-{n}": (f"// SPDX-License-Identifier: {n}\n{code}", n) for n, _ in licenses.STATEMENTS if n != "Proprietary"}
    rest = [(f"plain-{k}", f"{prose} This is line {k} of the report.\n{code}") for k in range(200)]
    table = spark.createDataFrame([(k, f"{k}/x", t) for k, (t, _) in given.items()] + [(k, f"{k}/x", t) for k, t in rest],
                                  "doc_id string, path string, text string")
    found = licenses.scan(spark, table).select(*LICENSE_COLUMNS).collect()
    assert {r["doc_id"]: r["own_license"] for r in found if r["doc_id"] in given} == {k: x for k, (_, x) in given.items()}
    assert all(r["own_license"] is None for r in found if r["doc_id"] not in given)
    same_licenses(found, brute_licenses([(k, f"{k}/x", t) for k, (t, _) in given.items()] + [
        (k, f"{k}/x", t) for k, t in rest]))


def test_every_template_declares_itself(spark):
    table = spark.createDataFrame([(k, f"{k}/x", text) for k, (name, text) in enumerate(licenses.TEMPLATES)],
                                  "doc_id long, path string, text string")
    assert {r["doc_id"]: r["own_license"] for r in licenses.scan(spark, table).collect()} == {
        k: name for k, (name, _) in enumerate(licenses.TEMPLATES)}


# 10 Personal data

def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def one(spark, values):
    table = spark.createDataFrame([(v,) for v in values], "v string")
    return [r["p"] for r in table.select(pii.pseudonym(F.col("v"), F.lit("key")).alias("p")).collect()]


def test_pseudonyms_are_valid_and_different(spark):
    rng = random.Random(4)
    cards = sorted({card(rng, n) for n in (13, 16, 19) for _ in range(60)})
    found = one(spark, cards)
    assert all(luhn(p) and len(p) == len(c) and p != c for p, c in zip(found, cards))
    assert len(set(found)) == len(cards)
    days = [str(d.date()) for d in pd.date_range("1999-12-01", periods=200)]
    found = one(spark, days)
    assert len(set(found)) == 200 and all(pd.Period(p, "D") for p in found)
    ips = [f"10.0.{k}.{k * 7 % 256}" for k in range(120)]
    found = one(spark, ips)
    assert len(set(found)) == 120 and all(0 <= int(o) < 256 for p in found for o in p.split("."))
    ssn = [f"{a:03d}-{b:02d}-0001" for a in (1, 665, 667, 899) for b in (1, 99)]
    found = one(spark, ssn)
    assert len(set(found)) == 8 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", p)
                                        for p in found)
    assert one(spark, ["4417744280351548", "666-10-1000", "2023-02-30", "31/02/2020", "000-12-1234"]) == [None] * 5


def test_network_permutes_every_pair(spark):
    table = spark.range(7 * 5).select((F.col("id") % 7).alias("a"), F.floor(F.col("id") / 7).alias("b"))
    out = table.select(pii.feistel(F.lit("k"), "t", F.col("a"), F.col("b"), F.lit(7), F.lit(5)).alias("o"))
    assert len({(r["o"]["a"], r["o"]["b"]) for r in out.collect()}) == 35


def test_texts_with_personal_data(spark):
    rng = random.Random(9)
    number = card(rng)
    texts = [f"pay {number} now", f"{number}!! {number} +1 (017) 555-7713.", None, "", "no data",
             "bad 4417744280351548 and 999.1.1.1", f"a.b@mail.example.com {number[:4]} {number[4:8]} "
             f"{number[8:12]} {number[12:]}", "x" * 50_000 + " 10.0.0.1"]
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, found string")
    found = {r["row"]["doc_id"]: r for r in pii.pseudonymized(table, "key").collect()}
    new = one(spark, [number])[0]
    assert found[0]["new_text"] == f"pay {new} now"
    assert found[1]["new_text"].startswith(f"{new}!! {new} +1 (") and found[1]["replaced"] == 3
    assert found[2]["new_text"] is None and found[2]["replaced"] == 0
    assert found[3]["new_text"] == "" and found[4]["new_text"] == "no data"
    assert found[5]["new_text"] == texts[5] and found[5]["replaced"] == 0
    assert found[6]["new_text"].endswith(" ".join(new[k:k + 4] for k in (0, 4, 8, 12)))
    assert "a.b@" not in found[6]["new_text"] and "@mail.example.com" in found[6]["new_text"]
    assert found[7]["replaced"] == 1 and len(found[7]["new_text"]) >= 50_000


def test_pii_query(spark, sf_dir, tiny):
    found = query("op10_pii", spark, sf_dir).collect()
    texts = dict(r[:2] for r in tiny)
    assert len(found) == len(texts)
    for r in found:
        for number in re.findall(r"(?<![0-9])[0-9]{13,19}(?![0-9])", texts[r["doc_id"]]):
            assert luhn(number) == (number not in r["text"])
        assert not re.search(r"\+1 \(\d{3}\) 555-", r["text"]) or r["replaced"]
        assert r["text_sha256"] == brute.sha(r["text"])
        if not r["found"]:
            assert r["text"] == texts[r["doc_id"]]
    assert PII_KEY


# Plans, empty tables, the pipeline

@pytest.mark.parametrize("name", ["op1_mix_sources", "op6_merkle", "op9_licenses", "op10_pii"])
def test_native_plans(name, spark, sf_dir):
    plan = query(name, spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"):
        assert operator not in plan


def test_empty_tables(spark, empty):
    assert mixing.mix(spark, empty).isEmpty() and mixing.mixed_rows(spark, empty).isEmpty()
    assert exact.dedup(spark, *exact.halves(empty)).isEmpty() and exact.deduplicated(spark, empty).isEmpty()
    assert simhash.near_duplicates(spark, empty).isEmpty() and simhash.representatives(spark, empty).isEmpty()
    assert langid.identify(spark, empty).isEmpty() and langid.accepted(spark, empty).isEmpty()
    assert substring.dedup(spark, empty).isEmpty() and bytes_dedup.dedup(spark, empty).isEmpty()
    assert merkle.half_edited(empty).isEmpty()
    assert empty.select(bpe.tokenized(spark, F.col("text"), PATH, PATTERN)).isEmpty()
    assert licenses.scan(spark, empty.withColumn("path", F.lit("a/b"))).isEmpty()
    assert pii.pseudonymized(empty, "key").isEmpty()


def test_stages_on_awkward_rows(spark, awkward, empty):
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = Scratch(spark, "test").write(name, stage(spark, docs, ""))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == awkward.columns


def test_pipeline(spark, sf_dir, tiny):
    left = [r for r in tiny if any(c.isalpha() for c in r[1] or "")]
    best = {i for i, _, _, kept, _ in brute.exact([r[:2] for r in left]) if kept}
    left = [r for r in left if r[0] in best]
    least = {i: c for i, _, c in brute.near([r[:2] for r in left])}
    left = [r for r in left if least[r[0]] == r[0]]
    usual = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    texts, expected = {r[0]: r[1] for r in left}, Counter()
    for i, n, _, _, _, whole, extra in brute.mix([(r[0], r[1], r[3]) for r in left]):
        ids = usual.encode_ordinary(texts[i])
        copies = whole + (extra > 0 and extra * 2 >= n)
        if copies:
            expected[(i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(texts[i]))] += copies
    found = corpus_pipeline.run(spark, sf_dir)
    assert rows(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_fingerprints_are_dealt_out_before_they_are_indexed(spark):
    """A few bytes of fingerprints are one scan task; 66 keys of each would all be held by it."""
    nodes = spark.range(0, 1000, 1, 1).select(F.col("id").alias("fp"))
    index = simhash._index(nodes)
    tasks = index.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r["count"] for r in tasks) == 66 * 1000


def test_the_index_of_fingerprints_is_never_broadcast(spark):
    """Spark sizes 66 keys, or the 33 hubs of a dense one, as the one row they are made of."""
    plans = []

    class Kept(Scratch):
        def write(self, name, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().write(name, df)

    nodes = spark.range(0, 300).select((F.col("id") * 3).alias("fp"))
    found = simhash.links(Kept(spark, "test"), nodes, 2, 8)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    assert sum(p.count("SortMergeJoin") for p in plans) == 3
    assert not any("Broadcast" in p for p in plans)
    assert found.count()
