"""Static binary-fuse filters: three slots per key, in three neighbouring segments.

A filter is built once for a fixed set of 64-bit keys and never says no to one of them; to another
key it says yes with probability 2^-16.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

U = np.uint64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys ^ U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> U(shift))) * U(factor)
        return h ^ (h >> U(33))


@dataclass
class Fuse:
    seed: int
    segment: int  # slots of a segment, a power of two
    starts: int  # segments in which a key's first slot may lie
    slots: np.ndarray  # fingerprints, uint16

    def positions(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three slots of each key, and its fingerprint."""
        h, g = _mixed(keys, self.seed), _mixed(keys, self.seed + 1_000_003)
        first = ((h >> U(32)) * U(self.starts)) >> U(32)
        low = U(self.segment - 1)
        at = np.stack([
            first * U(self.segment) + (h & low),
            (first + U(1)) * U(self.segment) + (g & low),
            (first + U(2)) * U(self.segment) + ((g >> U(24)) & low),
        ]).astype(np.int64)
        return at, ((g >> U(48)) & U(0xFFFF)).astype(np.uint16)

    def may_contain(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(len(keys), bool)
        at, print_ = self.positions(keys)
        return (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]]) == print_


def build(keys: np.ndarray) -> Fuse:
    """Peel the keys slot by slot, all slots with one key left at once, and fill in reverse."""
    keys = np.unique(np.asarray(keys, U))
    n = len(keys)
    if not n:
        return Fuse(0, 1, 1, np.zeros(0, np.uint16))
    segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 4)))
    starts = max(1, math.ceil(n * factor / segment) - 2)
    for seed in range(200):
        if seed and seed % 20 == 0:
            starts += max(1, starts // 10)
        fuse = Fuse(seed, segment, starts, np.zeros((starts + 2) * segment, np.uint16))
        at, prints = fuse.positions(keys)
        count = np.bincount(at.ravel(), minlength=len(fuse.slots))
        mask = np.zeros(len(fuse.slots), np.int64)  # xor of the numbers of the keys left in a slot
        for row in at:
            np.bitwise_xor.at(mask, row, np.arange(n))
        rounds, ready, left = [], np.flatnonzero(count == 1), n
        while len(ready):
            found, one = np.unique(mask[ready], return_index=True)
            rounds.append((found, ready[one]))
            left -= len(found)
            for row in at:
                np.subtract.at(count, row[found], 1)
                np.bitwise_xor.at(mask, row[found], found)
            near = np.unique(at[:, found])
            ready = near[count[near] == 1]
        if left == 0:
            for found, slot in reversed(rounds):
                a, b, c = fuse.slots[at[0][found]], fuse.slots[at[1][found]], fuse.slots[at[2][found]]
                fuse.slots[slot] = prints[found] ^ a ^ b ^ c ^ fuse.slots[slot]
            return fuse
    raise RuntimeError("no seed peels these keys")
