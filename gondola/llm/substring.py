"""Substring dedup over words, with suffix automata of reference shards.

Every word covered by a window of 13 words that also starts in a document with a smaller doc_id is
removed; windows are judged on the input.  The words that can repeat are brought together by
``gondola.llm.windows``.  A shard's stretches are its reference: one suffix automaton holds them all,
each of its states with the smallest doc_id among the stretches that contain the state's strings.
The stretches of all documents are then streamed through it; where the matching statistic reaches the
window's length, the state of the window itself tells the smallest doc_id that has it.

The automata are not broadcast to all tasks: together they grow with the corpus.  Instead every
stretch meets the one automaton of its anchor's shard, which is bounded by ``shard_bytes``.

Defined results: a null or empty text has no words; copies keep their words in the document with the
smallest doc_id only; rows with one doc_id do not remove each other's words; a null doc_id counts as
the largest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from gondola.llm import windows

WORDS = 13
GRAM = 4
SHARD_BYTES = 600_000


class Automaton:
    """Suffix automaton of many sequences of numbers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]  # symbol -> state, per state
        self.length, self.link, self.least = [0], [-1], [windows.LAST]

    def _clone(self, p: int, symbol: int, q: int) -> int:
        """A copy of q for the shorter strings that p's extension stands for."""
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.next.append(self.next[q].copy())
        self.least.append(windows.LAST)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], holder: int) -> None:
        """Add a sequence that ``holder`` has."""
        following, length, link, least = self.next, self.length, self.link, self.least
        last = 0
        for symbol in sequence:
            q = following[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, symbol, q)
            else:
                state, p, q = len(length), last, None
                length.append(length[last] + 1)
                link.append(0)
                following.append({})
                least.append(windows.LAST)
                while p >= 0:
                    out = following[p]
                    q = out.get(symbol)
                    if q is not None:
                        break
                    out[symbol] = state
                    p = link[p]
                if q is not None:
                    link[state] = q if length[q] == length[p] + 1 else self._clone(p, symbol, q)
                last = state
            if holder < least[last]:
                least[last] = holder

    def close(self) -> None:
        """Give every state the smallest holder of the strings that end in its own."""
        link, least = self.link, self.least
        for state in np.argsort(-np.array(self.length), kind="stable").tolist()[:-1]:
            if least[state] < least[link[state]]:
                least[link[state]] = least[state]

    def holders(self, sequence: list[int], size: int) -> list[int]:
        """Smallest holder of each window of ``size`` symbols; LAST if it is not held."""
        following, length, link, least = self.next, self.length, self.link, self.least
        state = matched = 0
        out = []
        for symbol in sequence:
            q = following[state].get(symbol)
            while q is None and state:
                state = link[state]
                matched = length[state]
                q = following[state].get(symbol)
            if q is None:
                matched = 0
            else:
                state, matched = q, matched + 1
                if matched >= size:  # down to the state of the last ``size`` symbols
                    while length[link[state]] >= size:
                        state = link[state]
                        matched = length[state]
            out.append(least[state] if matched >= size else windows.LAST)
        return out[size - 1:]


def match(contents: list[bytes], anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> list[np.ndarray]:
    """For each content, the smallest holder of each of its windows: at most its own smallest one.

    Windows only recur under the same anchor.  A content is reference for documents above its smallest
    holder, and is streamed for those of its holders that have a smaller one below them.
    """
    numbers: dict[bytes, int] = {}
    sequences = [[numbers.setdefault(w, len(numbers)) for w in c.split(b" ")] for c in contents]
    refers, asks = windows.roles(anchors, lows, highs)
    automaton = Automaton()
    for sequence, low, used in zip(sequences, lows.tolist(), refers.tolist()):
        if used:
            automaton.add(sequence, low)
    automaton.close()
    return [np.minimum(np.array(automaton.holders(s, WORDS), np.int64), low) if asked
            else np.full(max(0, len(s) - WORDS + 1), low)
            for s, low, asked in zip(sequences, lows.tolist(), asks.tolist())]


def split(text: bytes) -> tuple[list[bytes], np.ndarray]:
    words = text.split()
    return words, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


UNITS = windows.Units(split, lambda words, a, b: b" ".join(words[a:b]), WORDS, GRAM)


def dedup(spark: SparkSession, docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_text): texts without the words they repeat; the kept
    words are joined by one space."""
    spans = windows.covered(spark, docs, UNITS, match, shard_bytes)

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def removed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            rows = []
            for text, own in zip(texts, found):
                words = text.encode().split()
                gone = windows.mask(own, len(words), WORDS)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((len(words), int(gone.sum()), kept.decode()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])

    rows = windows.with_spans(docs, spans).withColumn("new", removed("text", "spans"))
    return rows.select("doc_id", "text", "new.*")
