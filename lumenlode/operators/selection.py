"""Ordered selections: samples by quota, evidence, windows of candidates, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import running_total


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (DISTINCT ON)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def distinct_on_columns(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """As ``keep_latest`` for one order column, by a max of structs, which is aggregated before the shuffle."""
    best = F.max(F.struct(order.alias("_o"), *[F.col(c) for c in columns])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in columns])


def stratified_sample(df: DataFrame, stratum: str, limit: int, order: list[Column]) -> DataFrame:
    """``limit`` rows with the strata in proportion: each gets its share rounded down, and those that fall shortest one more.

    A share rounded down leaves fewer rows over than there are strata, so one more each is enough; a table
    of no more than ``limit`` rows is taken whole. Equal shortfalls go to the smaller stratum.
    """
    counts = df.groupBy(stratum).agg(F.count("*").alias("_c"))
    whole = F.sum("_c").over(Window.partitionBy())  # a row per stratum (year)
    quota = F.least(F.col("_c"), F.floor(F.lit(limit) * F.col("_c") / whole))
    shares = counts.withColumn("_t", whole).withColumn("_q", quota)
    over = F.least(F.lit(limit), F.col("_t")) - F.sum("_q").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.col("_q") - F.col("_c"), stratum))
    shares = shares.withColumn("_q", F.col("_q") + F.when(place <= over, 1).otherwise(0)).select(stratum, "_q")
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= limit).join(F.broadcast(shares), stratum).where("_n <= _q").drop("_n", "_q")


def share_gate(df: DataFrame, value: str, share: float) -> DataFrame:
    """Rows whose value is at least the one at index int(share * n) of all, in ascending order.

    Equal values are counted first, and their counts are summed up by ranges: no task sees the whole column.
    """
    counts = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("all")))  # one row
    placed = running_total(counts, "v", [F.col("v")], "n", "before").crossJoin(total)
    at = F.least(F.col("all") - 1, F.floor(F.col("all") * share))
    gate = placed.where((F.col("before") <= at) & (at < F.col("before") + F.col("n"))).select(F.col("v").alias("_gate"))
    return df.crossJoin(F.broadcast(gate)).where(F.col(value) >= F.col("_gate")).drop("_gate")


def evidence(df: DataFrame, group: str, klass: str, order: list[Column], most: int = 20, per_class: int = 10) -> DataFrame:
    """Per group ``most`` rows in order, at most ``per_class`` of a class unless the list would stay short."""
    in_class = F.row_number().over(Window.partitionBy(group, klass).orderBy(*order))
    capped = df.withColumn("_over", (in_class > per_class).cast("int"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_over", *order))
    return capped.withColumn("place", place.cast("long")).where(F.col("place") <= most).drop("_over")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, or null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def exclusion_log(df: DataFrame, reason: str, key: str, examples: int = 5) -> DataFrame:
    """How many rows each rule excluded, with a few examples in order; only the examples are sorted."""
    out = df.where(F.col(reason).isNotNull())
    n = F.row_number().over(Window.partitionBy(reason).orderBy(key))
    few = out.select(reason, key).withColumn("_n", n).where(F.col("_n") <= examples)  # a limit that Spark applies before the shuffle
    few = few.groupBy(reason).agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("examples"))
    return out.groupBy(reason).agg(F.count("*").alias("excluded")).join(few, reason)


def head_screen(ranked: DataFrame, verdict: str, top: int, batch: int, mature: str | None = None) -> DataFrame:
    """Candidates are read in batches by rank until ``top`` are kept; the kept ones of the batches read.

    A null verdict is a check that failed, and keeps the row. With ``mature``, if all batches hold fewer
    than ``top``, rows that only the maturity check took out fill the places left, by rank.
    """
    held = F.coalesce(F.col(verdict), F.lit(True))
    b = ranked.withColumn("batch", F.floor((F.col("rank") - 1) / batch).cast("long"))
    kept = b.groupBy("batch").agg(F.sum(held.cast("int")).alias("k"))
    before = F.sum("k").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    read = kept.withColumn("before", F.coalesce(before, F.lit(0)))  # a row per batch
    out = b.join(F.broadcast(read.where(F.col("before") < top).select("batch")), "batch").where(held)
    if mature is None:
        return out
    short = kept.agg((F.lit(top) - F.sum("k")).alias("_short"))
    spare = b.where(~held & F.col(mature)).orderBy("rank").limit(top)
    spare = spare.withColumn("_n", F.row_number().over(Window.orderBy("rank"))).crossJoin(F.broadcast(short)).where("_n <= _short").drop("_n", "_short")
    return out.unionByName(spare)


def tiers(df: DataFrame, approved: str, votes: str) -> Column:
    return F.when(F.col(approved) & (F.col(votes) >= 3), 0).when(F.col(approved), 1).when(F.col(votes) >= 2, 2).otherwise(3)


def jury(df: DataFrame, score: str, votes: str, penalty: float = 15.0) -> DataFrame:
    """Three of three votes pass, none drops, the rest lose ``penalty``."""
    held = F.when(F.col(votes) >= 3, F.col(score)).otherwise(F.col(score) - penalty)
    return df.where(F.col(votes) > 0).withColumn(score, held)


def rerank_bonus(rank: Column, depth: Column, most: float = 10.0) -> Column:
    return most * (1 - rank / depth)


def tier_scores(df: DataFrame, tier: str, score: str, least: float = 0.01) -> DataFrame:
    """Scores that agree with the tiers: a tier whose best is not below the tier before is shifted down as a whole, to 0.01 below that one's last.

    Four tiers at most, so their ends are folded on one row.
    """
    ends = df.groupBy(tier).agg(F.max(score).alias("top"), F.min(score).alias("low"))
    listed = ends.agg(F.array_sort(F.collect_list(F.struct(F.col(tier).cast("int").alias("tier"), "top", "low"))).alias("t"))  # a row per tier
    start = F.struct(F.lit(None).cast("double").alias("floor"), F.array().cast("array<struct<tier:int,shift:double>>").alias("out"))

    def step(s, x):
        shift = F.when(s["floor"].isNotNull() & (x["top"] >= s["floor"]), x["top"] - (s["floor"] - least)).otherwise(0.0)
        low = F.greatest(F.lit(0.0), x["low"] - shift)
        floor = F.when(s["floor"].isNull(), low).otherwise(F.least(s["floor"], low))
        return F.struct(floor.alias("floor"), F.concat(s["out"], F.array(F.struct(x["tier"].alias("tier"), shift.alias("shift")))).alias("out"))

    shifts = listed.select(F.explode(F.aggregate("t", start, step)["out"]).alias("x")).select(F.col("x.tier").alias("_tier"), F.col("x.shift").alias("_shift"))
    moved = F.when(F.col("_shift") > 0, F.greatest(F.lit(0.0), F.col(score) - F.col("_shift"))).otherwise(F.col(score))
    return df.join(F.broadcast(shifts), F.col(tier).cast("int") == F.col("_tier")).withColumn(score, moved).drop("_tier", "_shift")


def rerank(df: DataFrame, order: str, removed: str, approved: str, score: str, depth: int = 120) -> DataFrame:
    """A judge's order over the head: rows that it removes go unless approved before; the ordered ones gain up to ten points."""
    n = F.count(order).over(Window.partitionBy())  # the head: ``depth`` rows at most are ordered
    head = df.where(F.col("rank") <= depth).withColumn("_n", n)
    head = head.where(~F.coalesce(F.col(removed), F.lit(False)) | F.coalesce(F.col(approved), F.lit(False)))
    head = head.withColumn(score, F.col(score) + F.when(F.col(order).isNull(), 0.0).otherwise(rerank_bonus(F.col(order), F.col("_n")))).drop("_n")
    return head.unionByName(df.where(F.col("rank") > depth))


def mature_titles(df: DataFrame, verdicts: DataFrame, title: str = "title") -> DataFrame:
    """Rows whose title no probe calls mainstream. ``verdicts``: title, verdict."""
    gone = verdicts.where(F.col("verdict") == "MAINSTREAM").select(F.lower(F.trim(F.col(title))).alias("_t")).distinct()
    return df.withColumn("_t", F.lower(F.trim(F.col(title)))).join(gone, "_t", "left_anti").drop("_t")


def probe_budget(df: DataFrame, limit: int = 150) -> DataFrame:
    """The terms whose outside signals are asked for."""
    return df.orderBy(F.desc("df"), F.desc("termhood"), F.asc("term")).limit(limit)


def popular(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The keys with most rows: the baseline that a forecast is held against."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(limit)


def budget_split(df: DataFrame, source: str, order: list[Column], budget: int) -> DataFrame:
    """An equal share per source, leftovers to the sources with more, taken in turn (round robin)."""
    n = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    few = df.withColumn("_n", n).where(F.col("_n") <= budget)  # applied before the shuffle
    turn = F.row_number().over(Window.orderBy("_n", source))
    return few.withColumn("turn", turn.cast("long")).where(F.col("turn") <= budget).drop("_n")


def interleaved(df: DataFrame, group: str, order: list[Column], budget: int) -> DataFrame:
    """Queries of several groups in turn, one of each group at a time."""
    return budget_split(df, group, order, budget)
