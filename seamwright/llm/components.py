"""Connected components by hooking and pointer jumping, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of (node, parent) with parent <= node; every parent is a node itself or a root."""
    now = materialize(parents.select("node", F.col("parent").alias("root")).where("root <> node"), "roots")
    while True:
        # two jumps, and a look whether there is a third, in one pass
        up = [now.select(F.col("node").alias(f"n{k}"), F.col("root").alias(f"r{k}")) for k in range(3)]
        hop = now.join(up[0], F.expr("root = n0"), "left").join(up[1], F.expr("r0 = n1"), "left")
        end = hop.select("node", F.coalesce("r1", "r0", "root").alias("root"))
        nxt = materialize(end.join(up[2], F.expr("root = n2"), "left").select("node", "root", F.col("r2").isNotNull().alias("more")), "roots")
        discard(now)
        more = not nxt.where("more").isEmpty()
        now = nxt.drop("more")
        now._scratch_path = nxt._scratch_path
        if not more:
            return now


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for the nodes of edges (a, b) other than it.

    Each round every node takes its smallest neighbour as parent, chains of parents are shortened to their
    root, and edges are contracted; a hub with many neighbours is only a minimum to be aggregated.
    """
    now = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    found: DataFrame | None = None
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        top = roots(least)
        if found is None:
            found = top
        else:
            step = top.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            old = found.join(step, found["root"] == step["mid"], "left").select("node", F.coalesce("top", "root").alias("root"))
            found = materialize(old.unionByName(top.select("node", "root")), "labels")
        ta, tb = (top.select(F.col("node").alias(f"n{s}"), F.col("root").alias(f"r{s}")) for s in "ab")
        moved = now.join(ta, now["a"] == ta["na"], "left").join(tb, now["b"] == tb["nb"], "left")
        moved = moved.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct()
        nxt = materialize(moved, "edges")
        discard(now)
        now = nxt
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
