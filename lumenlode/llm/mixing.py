"""Mixing sources to target weights: exact block quotas split among shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stash
from .tables import literal_table

#: Documents in a block, about, blocks in a group of blocks, and units that are drawn from at most (the generator takes a billion).
BLOCK, GROUP, UNITS = 256, 4096, 500_000_000


def targets(sizes: dict, weights: dict, most: float = 3.0) -> dict:
    """Each source's share by weight of the total size, at most ``most`` times its own; the excess reshared by weight."""
    total, capped, out = sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        by_weight = sum(weights[s] for s in open_)
        out = {s: most * sizes[s] if s in capped else rest * weights[s] / by_weight for s in sizes}
        above = {s for s in open_ if out[s] > most * sizes[s]}
        if not above:
            return out
        capped |= above


def split(counts: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """``counts`` blocks of each source dealt to ``shards``: rows are shards, whose sums differ by one at most.

    Recursively: the left half of the shards draws its blocks without replacement (a multivariate
    hypergeometric draw over the sources), the right half gets the others.
    """
    out = np.zeros((shards, len(counts)), np.int64)

    def descend(have: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle, n = (first + last) // 2, int(have.sum())
        left = rng.multivariate_hypergeometric(have, n * (middle - first) // (last - first), method="marginals")
        descend(left, first, middle)
        descend(have - left, middle, last)

    descend(np.array(counts, np.int64), 0, shards)
    return out


def mix(
    df: DataFrame,
    weight_of,
    shards: int = 16,
    most: int = 3,
    seed: int = 20260805,
    source: str = "source",
    text: str = "text",
    order: list[Column] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Draw documents so that each source's words come near its target, and deal them to shards.

    Returns one row per row of ``df``: row (struct of ``keep``, all columns by default), size (words),
    source_size, target, copies (0 to ``most``) and placements, an array of copy, shard and order (of a
    local shuffle) with one element per copy. ``weight_of``: from the list of sources in code-point
    order, null last, to their weights. A null source is a source, a null text has size 0; a source of no
    words has target 0 and is not drawn; rows alike in all columns that ``order`` names are drawn apart
    only if they fall to the same side; an empty table gives no rows. Reruns agree: draws depend on the
    seed, on ``order`` (by default the text) and on counts.

    Documents fall into blocks of about BLOCK (more beyond UNITS of them) by a hash. Whole passes over a source take every block;
    of the rest of its target a prefix of its blocks (in hash order) is taken, and of the block where the
    target falls the documents that still fit, longest first. Blocks taken, per pass, are units; the tree fixes how many units
    of each source a shard gets, and shards draw disjoint ranges of a permutation of the units. Sources
    (the configuration of a mix) are listed on the driver, documents and blocks never.
    """
    spark = df.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    order = order or [F.xxhash64(text)]
    rows = stash(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row"),
            F.col(source).alias("source"),
            size.alias("size"),
            F.xxhash64(F.lit(seed), *order).alias("u"),
        ),
        "sized",
    )
    found = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    names = sorted(found, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    if not names:
        return rows.select("row", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"), _no_placements().alias("placements"))
    sizes = {s: int(found[s]["size"]) for s in names}
    target = targets(sizes, dict(zip(names, weight_of(names), strict=True)), most) if sum(sizes.values()) else dict.fromkeys(names, 0.0)
    passes = {s: min(most, int(target[s] // sizes[s])) if sizes[s] else 0 for s in names}
    rest = {s: 0.0 if passes[s] == most else max(0.0, target[s] - passes[s] * sizes[s]) for s in names}
    block = max(BLOCK, -(-most * sum(r["n"] for r in found.values()) // UNITS))  # larger for very many documents, so that draws stay exact
    blocks = {s: max(1, -(-found[s]["n"] // block)) for s in names}

    known = literal_table(
        spark,
        [{"k": k, "source": s, "source_size": sizes[s], "target": target[s], "passes": passes[s], "rest": rest[s], "blocks": blocks[s]} for k, s in enumerate(names)],
        "k int, source string, source_size bigint, target double, passes int, rest double, blocks bigint",
    )
    rows = rows.join(F.broadcast(known), rows["source"].eqNullSafe(known["source"])).drop("source")
    rows = rows.withColumn("block", F.pmod("u", "blocks"))

    # words before each block of its source, in two steps so that no task sees all blocks of a source
    of_block = rows.groupBy("k", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    of_block = of_block.withColumn("group", F.floor(F.col("block") / GROUP))
    groups = of_block.groupBy("k", "group").agg(F.sum("words").alias("words"))
    groups = groups.select("k", "group", (F.sum("words").over(Window.partitionBy("k").orderBy("group")) - F.col("words")).alias("start"))
    inside = F.sum("words").over(Window.partitionBy("k", "group").orderBy("block")) - F.col("words")
    before = of_block.withColumn("inside", inside).join(groups, ["k", "group"]).withColumn("before", F.col("start") + F.col("inside"))
    cuts = {r["k"]: r for r in before.where("before <= rest and rest < before + words").collect()}  # one block per source at most
    cut = {k: cuts[k]["block"] if k in cuts else -1 for k in range(len(names))}
    edge = literal_table(spark, [{"k": k, "cut": cut[k]} for k in cut], "k int, cut bigint")
    edge = rows.join(F.broadcast(edge), "k").where("block = cut").groupBy("k", "u").agg(F.sum("size").alias("words"))
    left = {k: rest[s] - (cuts[k]["before"] if k in cuts else 0) for k, s in enumerate(names)}
    chosen: dict[int, list[int]] = {k: [] for k in cut}
    for r in sorted(edge.collect(), key=lambda r: (-r["words"], r["u"])):  # about BLOCK rows per source; rows alike are one
        if r["words"] <= left[r["k"]]:
            left[r["k"]] -= r["words"]
            chosen[r["k"]].append(r["u"])

    units = [passes[s] * blocks[s] + cut[k] + 1 for k, s in enumerate(names)]
    rng = np.random.default_rng(seed)
    quotas = split(units, shards, rng)
    ends = np.cumsum(quotas, axis=0)
    steps = []
    for n in units:
        a = int(rng.integers(1, max(2, min(n, 1 << 20))))
        while n and gcd(a, n) > 1:
            a += 1
        steps.append((a, int(rng.integers(0, max(1, min(n, 1 << 40))))))
    plan = literal_table(
        spark,
        [{"k": k, "cut": cut[k], "chosen": chosen[k], "units": units[k], "a": steps[k][0], "b": steps[k][1], "ends": ends[:, k].tolist()} for k in cut],
        "k int, cut bigint, chosen array<bigint>, units bigint, a bigint, b bigint, ends array<bigint>",
    )
    rows = rows.join(F.broadcast(plan), "k")
    rows = rows.withColumn("extra", (F.col("block") < F.col("cut")) | F.array_contains("chosen", F.col("u")))
    rows = rows.withColumn("copies", F.col("passes") + F.col("extra").cast("int"))

    def placed(copy: Column) -> Column:
        """Shards draw consecutive ranges of a permutation of their source's units."""
        at = F.pmod((copy * F.col("blocks") + F.col("block")) * F.col("a") + F.col("b"), F.greatest("units", F.lit(1)))
        return F.struct(
            copy.cast("int").alias("copy"),
            F.size(F.filter("ends", lambda e: e <= at)).cast("int").alias("shard"),
            F.xxhash64(F.lit(seed), copy, "u").alias("order"),
        )

    steps_of = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select("row", "size", "source_size", "target", "copies", F.transform(steps_of, placed).alias("placements"))


def _no_placements() -> Column:
    return F.array().cast("array<struct<copy:int,shard:int,order:bigint>>")


def mixed(rows: DataFrame) -> DataFrame:
    """The drawn documents themselves, a row per copy, in shards and shuffled inside each; columns may be named like anything."""
    drawn = rows.select("row", F.explode("placements").alias("placement"))
    return drawn.sortWithinPartitions("placement.shard", "placement.order").select("row.*")
