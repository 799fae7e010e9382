"""Connected components by alternating large-star and small-star rounds, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``a`` is above ``b`` in each row that it gets."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    lower = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b of any ordered type. Returns node, root (the least node that it reaches) for each node with an edge.

    Loops and repeated rows are allowed; rows with a null are ignored; no edges give no rows. Each round
    ends in a written table; minima are aggregated before the shuffle, and a node with very many
    neighbours is only ever the key of a join, which adaptive execution splits.
    """
    now = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        after = stash(_small_star(_large_star(now)), "edges")
        new = _state(after)
        drop(now)
        now, done, state = after, new == state, new
        if done:
            break
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
    out._stash_path = now._stash_path
    return out
