"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ROWS_PER_TASK, Scratch, few

#: Edges up to which minima are joined back without being written: no hub is too much for a task then.
PLAIN_EDGES = 100 * ROWS_PER_TASK


def _settled(edges: DataFrame) -> bool:
    """Whether every u hangs on one v, and no v on another: stars, of which each is a component."""
    ups = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    chained = ups.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
    return ups.where("n > 1").select("u").unionByName(chained).isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node it reaches.

    ``edges``: columns a, b (long). Null ends and loops are ignored; repeated
    edges count once; no edges give an empty table. Beyond PLAIN_EDGES a step's
    minima are written out before they are joined back, so both join sides are
    plain shuffles and Spark can split a hub's partition.
    """
    n = edges.count()

    def kept(df: DataFrame, what: str, rows: int) -> DataFrame:
        return scratch.save(df, what, rows) if n > PLAIN_EDGES else few(df, rows)

    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = scratch.save(oriented, f"{name}-0", n)
    for step in count(1):
        if _settled(current):
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{name}-{step}-large", 2 * n)
        # every neighbour above u hangs on u's minimum; u is below v there
        large = few(both.where("v > u").join(low, "u"), 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"{name}-{step}-edges", n)
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}-small", n)
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = few(large.join(low, "u"), 2 * n).select(F.explode(ends).alias("e"))
        current = scratch.save(small.select("e.*").where("u <> v").distinct(), f"{name}-{step}", n)
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-large", f"{name}-{step}-edges", f"{name}-{step}-small")


def merged_components(found: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components (node, root) with further edges (a, b) taken in. Only edges between components are worked on, each component as its root."""
    root = lambda side: found.select(F.col("node").alias(side), F.col("root").alias(f"{side}r"))
    apart = edges.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = apart.select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b")).where("a <> b").distinct()
    apart = scratch.save(apart, f"{name}-apart")
    if apart.isEmpty():
        return found
    joined = connected_components(apart, scratch, name)
    moved = found.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    # a root has no row of its own in found, so none comes twice
    both = moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(joined)
    both = scratch.save(both, f"{name}-merged")
    scratch.drop(f"{name}-apart")
    return both
