"""Connected components of a graph given by its edges, by hooking to neighbours and halving paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gondola.llm.common import Scratch

MAX_ROUNDS = 200


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node reachable.

    Each round gives a node the smallest root among its own, its neighbours' and its root's root.
    Rounds grow with the logarithm of the longest path in common cases.  Every round is a table in
    the shared folder; only the number of changed rows reaches the driver.  Minima are taken before
    the shuffle, and a node with very many neighbours is a skewed join key, which adaptive execution
    splits.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(
        F.col("a").alias("node"), "root")
    state = scratch.write("roots-0", state)
    if state.isEmpty():
        return state
    both = scratch.write("both", both)
    for number in range(1, MAX_ROUNDS):
        near = both.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        up = state.select(F.col("node").alias("of"), F.col("root").alias("next"))
        hooked = state.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        halved = hooked.join(up, F.col("root") == F.col("of")).select(
            "node", F.least("root", "next").alias("root"), "was")
        new = scratch.write(f"roots-{number}", halved)
        changed = not new.where("root <> was").isEmpty()
        state = new.select("node", "root")
        if number > 1:
            scratch.drop(f"roots-{number - 2}")
        if not changed:
            return state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
