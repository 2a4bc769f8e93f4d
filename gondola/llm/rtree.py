"""A sort-tile-recursive R-tree over the rows of one tile, searched best box first by inner product."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np

LEAF_ROWS = 128
FANOUT = 32
#: Sums of products of whole numbers below this are exact in double precision.
EXACT = float(1 << 53)


def str_order(vectors: np.ndarray, labels: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in the order of their leaves: by label, then tiled by the three widest coordinates."""
    axes = np.argsort(-vectors.var(axis=0), kind="stable")[:3]
    runs = [r for label in np.unique(labels) for r in [np.flatnonzero(labels == label)]]
    for depth, axis in enumerate(axes):
        cut = []
        for run in runs:
            leaves = -(-len(run) // leaf)
            parts = max(1, round(leaves ** (1 / (len(axes) - depth))))
            size = -(-leaves // parts) * leaf
            run = run[np.argsort(vectors[run, axis], kind="stable")]
            cut += [run[k:k + size] for k in range(0, len(run), size)]
        runs = cut
    return np.concatenate(runs)


class RTree:
    """Boxes of the rows: ``levels[0]`` the leaves, each further level ``FANOUT`` boxes of the one below.

    A box has the least and greatest value of every coordinate and of the label.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = str_order(vectors, labels, leaf)
        self.ids, self.labels, self.vectors, self.leaf = ids[order], labels[order], vectors[order], leaf
        self.largest = float(np.abs(vectors).max())
        boxes = (self.vectors, self.vectors, self.labels, self.labels)
        self.levels, step = [], leaf
        while True:
            starts = np.arange(0, len(boxes[0]), step)
            boxes = (np.minimum.reduceat(boxes[0], starts), np.maximum.reduceat(boxes[1], starts),
                     np.minimum.reduceat(boxes[2], starts), np.maximum.reduceat(boxes[3], starts))
            self.levels.append(boxes)
            step = FANOUT
            if len(starts) == 1:
                break

    def exact(self, queries: np.ndarray) -> bool:
        """Whether double precision holds all inner products with whole numbers."""
        return self.largest * float(np.abs(queries).max()) * queries.shape[1] < EXACT

    def scores(self, rows: slice, queries: np.ndarray) -> np.ndarray:
        """Exact inner products, a row for each vector; beyond double precision as Python's integers."""
        if self.exact(queries):
            return self.vectors[rows] @ queries.T
        whole = [[int(x) for x in q] for q in queries]
        return np.array([[sum(int(a) * b for a, b in zip(v, q)) for q in whole] for v in self.vectors[rows]], dtype=object)

    def best_first(self, queries: np.ndarray, admits: Callable, least: Callable[[], np.ndarray]
                   ) -> Iterator[tuple[slice, np.ndarray]]:
        """Leaves as slices of rows with the numbers of the queries that have to see them; the leaf with the
        greatest possible inner product with any query first.

        ``admits(least possible, greatest possible, least label, greatest label)`` tells for which queries a
        box can matter; a query leaves boxes strictly below its ``least()``, as it is by then.  Queries of one
        block share the queue, so that a leaf is scored for all of them at once.
        """
        up, down = np.maximum(queries, 0.0).T, np.minimum(queries, 0.0).T
        slack = 1e-12 * self.largest * np.abs(queries).sum(axis=1)  # for sums that are not exact
        bounds = [(low @ up + high @ down - slack, high @ up + low @ down + slack) for low, high, _, _ in self.levels]
        queue = [(-np.inf, len(self.levels) - 1, 0)]
        while queue:
            bound, level, box = heapq.heappop(queue)
            floors = least()
            if -bound < floors.min():
                return  # the queue is in order: all others are below as well
            fewest, most = (x[box] for x in bounds[level])
            _, _, small, large = self.levels[level]
            active = np.flatnonzero(admits(fewest, most, small[box], large[box]) & (most >= floors).astype(bool))
            if not len(active):
                continue
            if level == 0:
                yield slice(box * self.leaf, (box + 1) * self.leaf), active
                continue
            most = bounds[level - 1][1]
            for k in range(box * FANOUT, min((box + 1) * FANOUT, len(most))):
                heapq.heappush(queue, (-float(most[k][active].max()), level - 1, k))
