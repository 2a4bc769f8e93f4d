"""The parts that the operators are made of, against plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from gondola.llm import bpe, bytes_dedup, fuse, langid, simhash, substring, windows
from gondola.llm.suffix import suffix_array
from tests.llm import brute


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1_000, 60_000])
def test_filter_has_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(0, 2**63, n, np.uint64), rng.integers(0, 2**63, 20_000, np.uint64)
    built = fuse.build(np.concatenate([keys, keys[:5]]))
    assert built.may_contain(keys).all()
    assert built.may_contain(others).mean() < 0.001


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 4),
       st.sampled_from([2, 5, 50]), st.sampled_from([1, 7, 10**6]))
def test_suffix_array(symbols, times, cap, memory):
    text = np.array(symbols * times, np.int32)
    order, lcp = suffix_array(text, 4, cap, memory)
    values = text.tolist()
    assert sorted(order.tolist()) == list(range(len(values)))
    heads = [values[i:i + cap] for i in order]
    assert heads == sorted(heads)
    for j in range(1, len(heads)):
        a, b, k = heads[j - 1], heads[j], 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        assert lcp[j] == k


def windows_with_least(contents, holders, size):
    least = {}
    for c, h in zip(contents, holders):
        for i in range(len(c) - size + 1):
            least[tuple(c[i:i + size])] = min(least.get(tuple(c[i:i + size]), windows.LAST), h)
    return [[least[tuple(c[i:i + size])] for i in range(len(c) - size + 1)] for c in contents]


def test_shard_matchers():
    rng = random.Random(5)
    for _ in range(30):
        words = [[rng.choice("abc") for _ in range(rng.randint(1, 40))] for _ in range(12)]
        words += [w[:20] for w in words[:4]] + [["a"] * 60, ["a"] * 45]
        holders = [rng.randint(0, 9) for _ in words]
        same = np.zeros(len(words), np.int64)  # all under one anchor
        highs = np.array(holders) + [rng.randint(0, 3) for _ in words]
        found = substring.match([" ".join(w).encode() for w in words], same, np.array(holders), highs)
        expected = windows_with_least(words, holders, substring.WORDS)
        for f, e, low, high in zip(found, expected, holders, highs):
            # What no holder loses may be any value that is not below one.
            assert [x for x in f.tolist() if x < high] == [x for x in e if x < high]
            assert [x < high for x in f.tolist()] == [x < high for x in e]
        data = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 130))) for _ in range(8)]
        data += [d[7:] for d in data[:4]] + [b"\x00" * 200, b"\xff" * 120]
        holders = [rng.randint(0, 9) for _ in data]
        same = np.zeros(len(data), np.int64)
        found = bytes_dedup.match(data, same, np.array(holders), np.array(holders))
        assert [f.tolist() for f in found] == windows_with_least(data, holders, bytes_dedup.LENGTH)


def test_contents_alone_under_their_anchor_are_not_compared(monkeypatch):
    rng, sorted_ = random.Random(8), []

    def counting(text, *rest):
        sorted_.append(len(text))
        return suffix_array(text, *rest)

    monkeypatch.setattr(bytes_dedup, "suffix_array", counting)
    data = [bytes(rng.choice(b"abc") for _ in range(80)) for _ in range(6)]
    data[4] = data[1][5:] + b"x"
    anchors, lows, highs = np.array([1, 2, 3, 4, 2, 4]), np.array([3, 5, 0, 7, 2, 7]), np.array([9, 5, 4, 7, 8, 7])
    found = bytes_dedup.match(data, anchors, lows, highs)
    assert [f.tolist() for f in found] == windows_with_least(data, lows.tolist(), bytes_dedup.LENGTH)
    assert sorted_ == [len(data[1]) + len(data[4]) + 2]
    # One alone is its own holder for all its windows, also where several documents have it.
    refers, asks = windows.roles(anchors, lows, highs)
    assert refers.tolist() == asks.tolist() == [False, True, False, False, True, False]


def test_tokenizer_keeps_between_tasks_only_what_came_up_again(monkeypatch):
    monkeypatch.setattr(bpe, "_PIECES", 20)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 40)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN)
    texts = [f"zqx zqy wvj{k} kfq{k % 30} " + "x" * 70 for k in range(300)]
    whole = [codec.encode(t) for t in texts]
    for found, ids in zip(codec.digests(texts), whole, strict=True):
        assert found == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(codec.decode(ids)).hexdigest())
        assert len(codec.once) <= 40 and len(codec.often) <= 40
    assert " zqx" in codec.often or "zqx" in codec.often
    codec.rest()
    assert not codec.once


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    for size, gram in ((13, 4), (50, 12), (7, 7), (5, 1), (9, 3)):
        shared = rng.integers(0, 2**63, size + 20, np.uint64)
        documents = [np.concatenate([rng.integers(0, 2**63, k, np.uint64), shared]) for k in (0, 5, 31)]
        found = []
        for k, hashes in zip((0, 5, 31), documents):
            starts, values = windows.anchors(hashes, size, gram)
            each = np.repeat(values, np.diff(np.append(starts, len(hashes) - size + 1)))
            found.append(each[k:].tolist())
        assert found[0] == found[1] == found[2]


def test_fingerprint():
    for text in (None, "", " \n", "One", "ONE two", "É a B c d " * 9, "x\x0bY\x0cz\x1cq w", "a " * 20_000):
        for width in (3, 5):
            assert simhash.fingerprint(text, width) == brute.fingerprint(text, width)


TOKENS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coders():
    ranks = bpe.read_ranks(TOKENS)
    own = bpe.Codec(ranks, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                  special_tokens={})


def test_tokens_match_the_usual_library(coders):
    own, usual = coders
    rng = random.Random(7)
    odd = [chr(i) for i in [*range(0x250), 0x2028, 0x3000, 0x200B, 0xFEFF, 0x660, 0x1F600, 0x4E2D, 0x301]]
    texts = ["", "a", "ab" * 5_000, " " * 3_000, "<|endoftext|>", "!?" * 2_000, "é" * 999]
    texts += ["".join(rng.choice(odd if rng.random() < 0.5 else "  \n\t'sabt12") for _ in range(60))
              for _ in range(1_500)]
    for text, found in zip(texts, own.digests(texts)):
        ids = usual.encode_ordinary(text)
        assert own.encode(text) == ids
        assert found == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text))
        assert own.decode(ids) == text.encode()


def test_bundling_by_hand():
    text = "Ab, ñ"
    symbols = [0, ord("a"), ord("b"), 0, ord("ñ"), 0]
    letters = np.array(sorted(set(symbols)), np.uint32)
    vector = {int(c): v for c, v in zip(letters, langid.letter_vectors(letters))}
    total = sum(vector[a] * np.roll(vector[b], 1) * np.roll(vector[c], 2)
                for a, b, c in zip(symbols, symbols[1:], symbols[2:]))
    found, known = langid.bundles([text, "12 34", ""])
    assert known.tolist() == [True, False, False]
    assert np.array_equal(found[0], total) and not found[1:].any()


def test_letter_vectors_are_nearly_orthogonal():
    vectors = langid.letter_vectors(np.arange(97, 123, dtype=np.uint32))
    cosines = vectors @ vectors.T / langid.DIMENSIONS - np.eye(26)
    assert abs(cosines).max() < 0.2


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
