"""Byte-level BPE encoding and decoding with a given rank file.

A text is split by the vocabulary's pattern; within a piece, the pair of neighbouring tokens with the
lowest rank is merged, the leftmost first, until no pair has a rank.  A segment tree over the byte
positions of the piece holds the rank of the pair that starts at each live token; its root is the
leftmost minimum, and a merge changes three leaves, each at logarithmic cost.  So a piece of any
length costs n log n.  The trees of short pieces are advanced together, as rows of one array.

Ranks are read once on the driver and broadcast; their size is that of the vocabulary file, which
does not grow with the data.  Pieces repeat, so each task keeps the results of short pieces in a
bounded cache.

Defined results: a null text counts as empty and has no tokens; other columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession, functions as F

from gondola.llm.common import ship

#: Pieces kept that came up in several blocks, and of those that came up in one so far; the latter go with their task.
CACHE_PIECES = 250_000
CACHED_LENGTH = 64
_PIECES = 100_000  # pieces looked up together
_ROWS = 4_096  # trees held together
_NONE = 1 << 62
_POSITION = (1 << 32) - 1

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rust_pattern(pattern: str) -> str:
    """The pattern with white space as the Unicode property, as the usual tokenizers read it."""
    inside = regex.sub(r"\[\^\\s", r"[^\\p{White_Space}", pattern)
    return inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def _ranges(chars: list[str]) -> str:
    """Inside of a character class of these characters of one byte."""
    return "".join(f"\\x{ord(c):02x}" for c in chars)


def latin_pattern(pattern: str) -> str:
    """The same pattern for texts of characters below U+0100, with its properties spelled out."""
    latin = [chr(i) for i in range(256)]
    sets = {
        r"\p{L}": _ranges([c for c in latin if unicodedata.category(c)[0] == "L"]),
        r"\p{N}": _ranges([c for c in latin if unicodedata.category(c)[0] == "N"]),
        r"\s": _ranges([c for c in latin if regex.match(r"\p{White_Space}", c)]),
    }
    out, inside, at = [], False, 0
    while at < len(pattern):
        token = next((k for k in sets if pattern.startswith(k, at)), None)
        if token:
            out.append(sets[token] if inside else f"[{sets[token]}]")
            at += len(token)
        elif pattern.startswith(r"\S", at) and not inside:
            out.append(f"[^{sets[chr(92) + 's']}]")
            at += 2
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    return "".join(out)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i:i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    ends = list(range(1, n + 1))  # of the live token that starts here
    before = list(range(-1, n - 1))  # start of the live token before this one

    while (best := tree[1]) != _NONE:
        at = best & _POSITION
        gone = ends[at]
        end = ends[at] = ends[gone]
        changes = [(size + gone, _NONE)]
        r = None
        if end < n:
            before[end] = at
            r = rank(piece[at:ends[end]])
        changes.append((size + at, _NONE if r is None else r << 32 | at))
        if at:
            left = before[at]
            r = rank(piece[left:end])
            changes.append((size + left, _NONE if r is None else r << 32 | left))
        for i, value in changes:
            if tree[i] == value:
                continue
            tree[i] = value
            while i > 1:  # up to the first node whose minimum stays
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
                if tree[i] == value:
                    break
                tree[i] = value
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:ends[at]]])
        at = ends[at]
    return ids


class Forest:
    """The segment trees of many short pieces at once: row by row the same steps as ``merge``."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf of the pair of tokens a and b at a position."""
        if not len(self.keys):
            return np.full(len(a), _NONE)
        key = a << 32 | b
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.ranks[found] << 32 | at, _NONE)

    def merge(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Ids of pieces of 2 to ``size`` bytes, a power of two."""
        m = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, m)
        text = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(m, size)
        places = np.arange(size)
        token = np.where(places < n[:, None], self.bytes[text], -1)
        ends = np.tile(places + 1, (m, 1))
        before = np.tile(places - 1, (m, 1))
        tree = np.full((m, 2 * size), _NONE)
        row, at = np.nonzero(places[1:] < n[:, None])
        tree[row, size + at] = self._leaf(token[row, at], token[row, at + 1], at)
        width = size
        while width > 1:
            width //= 2
            tree[:, width:2 * width] = np.minimum(tree[:, 2 * width:4 * width:2],
                                                  tree[:, 2 * width + 1:4 * width:2])

        def put(rows: np.ndarray, place: np.ndarray, value) -> None:
            place = place + size
            tree[rows, place] = value
            while place.size and place[0] > 1:
                place = place >> 1
                tree[rows, place] = np.minimum(tree[rows, 2 * place], tree[rows, 2 * place + 1])

        rows = np.arange(m)
        while True:
            best = tree[rows, 1]
            live = best != _NONE
            rows, best = rows[live], best[live]
            if not len(rows):
                break
            at = best & _POSITION
            gone = ends[rows, at]
            end = ends[rows, gone]
            token[rows, at], token[rows, gone], ends[rows, at] = best >> 32, -1, end
            put(rows, gone, _NONE)
            put(rows, at, _NONE)
            more = end < n[rows]
            r, p, e = rows[more], at[more], end[more]
            before[r, e] = p
            put(r, p, self._leaf(token[r, p], token[r, e], p))
            more = at > 0
            r, p = rows[more], at[more]
            left = before[r, p]
            put(r, left, self._leaf(token[r, left], token[r, p], left))
        return [[i for i in ids if i >= 0] for ids in token.tolist()]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.any_pieces = regex.compile(rust_pattern(pattern)).findall
        self.latin_pieces = re.compile(latin_pattern(pattern)).findall
        self.forest = Forest(ranks)
        # Most pieces never come up again: those seen in one block so far, and those seen in several.
        self.once: dict[str, tuple[int, str, bytes]] = {}
        self.often: dict[str, tuple[int, str, bytes]] = {}

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_pieces(text)
        return self.latin_pieces(text)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in merge(piece.encode(), self.ranks)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def _learn(self, pieces: list[str]) -> dict[str, tuple[int, str, bytes]]:
        """Results of pieces not seen before: short ones together by size, long ones one by one."""
        sizes: dict[int, list[str]] = {}
        found = {}
        for piece in pieces:
            data = piece.encode()
            if data in self.ranks or len(data) > CACHED_LENGTH:
                found[piece] = merge(data, self.ranks)
            else:
                sizes.setdefault(1 << (len(data) - 1).bit_length(), []).append(piece)
        for size, group in sizes.items():
            for at in range(0, len(group), _ROWS):
                part = group[at:at + _ROWS]
                found.update(zip(part, self.forest.merge([p.encode() for p in part], size)))
        return {p: (len(ids), " ".join(map(str, ids)), self.decode(ids)) for p, ids in found.items()}

    def digests(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Tokens, digest of the ids, digest of the decoded bytes of each text."""
        split, held = [], 0
        for text in texts:
            split.append(self.pieces(text) if text else [])
            held += len(split[-1])
            if held >= _PIECES:
                yield from self._digests(split)
                split, held = [], 0
        yield from self._digests(split)

    def _digests(self, split: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        found = {p: None for pieces in split for p in pieces}
        unseen = [p for p in found if p not in self.often and p not in self.once]
        again = [p for p in found if p in self.once]
        if len(self.often) + len(again) > CACHE_PIECES:
            self.often.clear()
            unseen = [p for p in found if p not in self.once]
        for piece in again:
            self.often[piece] = self.once.pop(piece)
        learned = self._learn(unseen)
        for piece in found:
            found[piece] = learned.get(piece) or self.often[piece]
        if len(self.once) + len(learned) > CACHE_PIECES:
            self.once.clear()
        self.once.update((p, r) for p, r in learned.items() if len(p) <= CACHED_LENGTH)
        for pieces in split:
            parts = [found[p] for p in pieces]
            ids = hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest()
            decoded = hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest()
            yield sum([p[0] for p in parts]), ids, decoded

    def rest(self) -> None:
        """Between tasks a worker only keeps the pieces that came up again."""
        self.once.clear()


#: The codec of this worker process: pieces seen by earlier tasks need no merging again.
_CODEC: list[tuple[tuple[str, str], Codec]] = []


def _codec(path: str, pattern: str, ranks: dict[bytes, int]) -> Codec:
    if not _CODEC or _CODEC[0][0] != (path, pattern) or _CODEC[0][1].ranks != ranks:
        _CODEC[:] = [((path, pattern), Codec(ranks, pattern))]
    return _CODEC[0][1]


def tokenized(spark: SparkSession, text: Column, path: str, pattern: str) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of a text."""
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf(RESULT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(path, pattern, shared.value)
        try:
            for texts in batches:
                yield pd.DataFrame(list(codec.digests(texts)),
                                   columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            codec.rest()

    return of(text)


def token_ids(spark: SparkSession, text: Column, path: str, pattern: str) -> Column:
    """Token ids of a text."""
    ship(spark)
    shared = spark.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(path, pattern, shared.value)
        for texts in batches:
            yield pd.Series([codec.encode(t) if t else [] for t in texts])

    return of(text)


def detokenized(spark: SparkSession, ids: Column, path: str) -> Column:
    """Bytes of token ids; of null ids, none."""
    ship(spark)
    shared = spark.sparkContext.broadcast({i: t for t, i in read_ranks(path).items()})

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = shared.value
        for rows in batches:
            yield pd.Series([b"".join([tokens[i] for i in r]) if r is not None else b"" for r in rows])

    return of(ids)
