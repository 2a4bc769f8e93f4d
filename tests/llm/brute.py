"""Plain versions of the operators, one row after another, to hold the Spark jobs against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def exact(rows):
    """(doc_id, keep_id, group_size, kept, sha) of rows (doc_id, text), as a sorted list."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        stays = [False] * len(ids)
        stays[ids.index(keep)] = True
        out += [(i, keep, len(ids), s, sha(text)) for i, s in zip(ids, stays)]
    return out


def fingerprint(text, width=3):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + width]).encode(), 42)
              for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def clusters(nodes, linked):
    """Smallest node reachable of each node."""
    nodes, root = sorted(nodes), {}
    for start in nodes:
        if start in root:
            continue
        root[start], todo = start, [start]
        while todo:
            a = todo.pop()
            for b in nodes:
                if b not in root and linked(a, b):
                    root[b] = start
                    todo.append(b)
    return root


def near(rows, width=3, bits=2):
    """(doc_id, fingerprint, component_id) of rows (doc_id, text)."""
    prints = [fingerprint(t, width) for _, t in rows]
    root = clusters(set(prints), lambda a, b: (a ^ b).bit_count() <= bits)
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            least[root[p]] = min(least.get(root[p], LAST), doc_id)
    return [(i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints)]


def removed(rows, split, size):
    """Units and a mask of what windows of ``size`` units with a smaller holder cover, row by row."""
    seen = {}
    for doc_id, text in rows:
        units, doc_id = split(text or ""), LAST if doc_id is None else doc_id
        for i in range(len(units) - size + 1):
            w = tuple(units[i:i + size])
            seen[w] = min(seen.get(w, LAST), doc_id)
    for doc_id, text in rows:
        units, own = split(text or ""), LAST if doc_id is None else doc_id
        gone = [False] * len(units)
        for i in range(len(units) - size + 1):
            if seen[tuple(units[i:i + size])] < own:
                gone[i:i + size] = [True] * size
        yield doc_id, units, gone


def substrings(rows, size=13):
    return [(i, len(u), sum(g), sha(" ".join(w for w, x in zip(u, g) if not x)))
            for i, u, g in removed(rows, lambda t: WORD.findall(t), size)]


def byte_strings(rows, size=50):
    return [(i, len(u), sum(g), sum(a and not b for a, b in zip(g, [False, *g])),
             sha(bytes(w for w, x in zip(u, g) if not x)))
            for i, u, g in removed(rows, lambda t: t.encode(), size)]


def fill(sizes, weights, budget, epochs):
    """Targets of sources by raising the level until the budget is spent."""
    capped = set()
    while True:
        rest = [s for s in sizes if s not in capped]
        spent = sum(sizes[s] * epochs for s in capped)
        if not rest:
            return {s: sizes[s] * epochs for s in sizes}
        level = (budget - spent) / sum(weights[s] for s in rest)
        over = {s for s in rest if sizes[s] * epochs <= level * weights[s]}
        if not over:
            return {s: sizes[s] * epochs if s in capped else level * weights[s] for s in sizes}
        capped |= over


def mix(rows, weights=(5.0, 2.0, 1.0), ratio=1.5, epochs=2.0):
    """(doc_id, size, source_size, target, taken, extra) of rows (doc_id, text, source)."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    nameless = lambda t: "" if t is None else md5(t)
    sized = [(i, len(WORD.findall(t or "")), s, md5(f"mix:{nameless(t) if i is None else i}")) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, n, s, _ in sized:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    share = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    targets = fill(sizes, share, ratio * sum(sizes.values()), epochs)
    out = []
    for s in names:
        whole = math.floor(targets[s] / sizes[s]) if sizes[s] else 0
        left = math.floor(targets[s] - whole * sizes[s] + 0.5)
        for i, n, _, _ in sorted((x for x in sized if x[2] == s), key=lambda x: (x[3], x[1])):
            extra = max(0, min(n, left))
            left -= n
            out.append((i, n, sizes[s], targets[s], whole * n + extra, whole, extra))
    return out


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 == 1
