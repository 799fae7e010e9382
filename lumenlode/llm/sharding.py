"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stash
from .tables import literal_table

#: Places on the ring, and parts that each arc of it is cut into so that no key's rows meet in one task.
PLACES, PARTS = 1 << 16, 256


def _ring(spark, shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise."""
    nodes = spark.range(shards * virtual).select(
        F.pmod(F.xxhash64(F.lit("node"), (F.col("id") / virtual).cast("int"), F.col("id") % virtual), F.lit(PLACES)).cast("int").alias("place"),
        (F.col("id") / virtual).cast("int").alias("shard"),
    )
    return sorted(map(tuple, nodes.collect()))  # shards * virtual rows


def flow(ring: list[tuple[int, int]], counts: dict[int, int], capacity: list[int]) -> list[dict]:
    """Which ranks of each arc go to which shard.

    Each arc's keys first go to the shard of the virtual node that ends it; what a full shard cannot take
    continues clockwise to the next shard with room.
    """
    free, slot, out, over = list(capacity), [0] * len(capacity), [], []

    def put(arc: int, at: int, shard: int, n: int) -> None:
        if n:
            out.append({"arc": arc, "from_rank": at, "to_rank": at + n, "shard": shard, "from_slot": slot[shard]})
            free[shard] -= n
            slot[shard] += n

    for arc, (_, shard) in enumerate(ring):
        n = min(counts.get(arc, 0), free[shard])
        put(arc, 0, shard, n)
        if n < counts.get(arc, 0):
            over.append((arc, n))
    for arc, at in over:
        step = arc
        while at < counts[arc]:
            step = (step + 1) % len(ring)
            n = min(counts[arc] - at, free[ring[step][1]])
            put(arc, at, ring[step][1], n)
            at += n
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """With no slack, sizes that differ by one at most and sum to ``rows``."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def shard(
    df: DataFrame,
    shards: int,
    key: Column,
    order: list[Column],
    virtual: int = 64,
    slack: float = 0.0,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Place each row of ``df`` on the ring by ``key`` (equal keys start at one place) and deal it to a shard.

    Returns per row: the columns of ``carry``, shard (int), slot (long, gapless from 0 in each shard).
    No shard gets more than (1 + slack) times the mean, rounded up; with no slack counts differ by one at
    most. A null key is a key like any other. ``order`` breaks ties among rows of one key; rows equal in
    all of it are interchangeable. An empty table gives no rows. A key of any number of rows is cut into
    PARTS parts by ``order``, ranked apart; only counts per arc (shards * virtual) reach the driver.
    """
    spark, carry = df.sparkSession, carry or {}
    ring = _ring(spark, shards, virtual)
    places = [p for p, _ in ring]
    arc_of = ",".join(str(bisect_left(places, p) % len(ring)) for p in range(PLACES))
    lookup = F.split(F.lit(arc_of), ",").cast("array<int>")
    rows = df.select(
        F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("carry"),
        F.pmod(F.xxhash64(F.lit("key"), key), F.lit(PLACES)).cast("int").alias("place"),
        F.xxhash64(F.lit("order"), *order).alias("o"),
    )
    rows = stash(
        rows.select("carry", "place", "o", F.element_at(lookup, F.col("place") + 1).alias("arc"), F.pmod("o", F.lit(PARTS)).cast("int").alias("part")),
        "ring",
    )
    parts = rows.groupBy("arc", "part").agg(F.count("*").alias("n"))
    parts = parts.select("arc", "part", (F.sum("n").over(Window.partitionBy("arc").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    splits = flow(ring, counts, capacities(sum(counts.values()), shards, slack))
    splits = literal_table(spark, splits, "arc int, from_rank bigint, to_rank bigint, shard int, from_slot bigint")
    ranked = rows.withColumn(
        "nth", F.row_number().over(Window.partitionBy("arc", "part").orderBy("place", "o", "carry")).cast("long") - 1
    )
    # parts has shards * virtual * PARTS rows at most, splits one for each arc and for each time that a shard fills up
    ranked = ranked.join(F.broadcast(parts), ["arc", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(splits), "arc").where("rank >= from_rank and rank < to_rank")
    return placed.select(
        *[F.col(f"carry.{k}").alias(k) for k in carry],
        "shard",
        (F.col("from_slot") + F.col("rank") - F.col("from_rank")).alias("slot"),
    )
