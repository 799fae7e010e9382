"""Six indicators into one score, its total order, and how stable that order is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp01
from ..functions.ordering import ranked_by

# Default weights.
WEIGHTS = {"novelty": 0.20, "growth": 0.30, "diffusion": 0.15, "weakness": 0.15, "coherence": 0.10, "impact": 0.10}


def renormalised(weights: dict[str, float], measured: list[str]) -> dict[str, float]:
    total = sum(weights[k] for k in measured)
    return {k: weights[k] / total for k in measured}


def geometric(weights: dict[str, float]) -> Column:
    """100 times the weighted geometric mean; exactly 0 if an indicator is."""
    zero = F.least(*[F.col(k) for k in weights]) <= 0
    return F.when(zero, 0.0).otherwise(100 * F.exp(sum((w * F.log(k) for k, w in weights.items()), F.lit(0.0))))


def arithmetic(weights: dict[str, float]) -> Column:
    """The weighted mean; 0 if an indicator is."""
    zero = F.least(*[F.col(k) for k in weights]) <= 0
    return F.when(zero, 0.0).otherwise(100 * sum((w * F.col(k) for k, w in weights.items()), F.lit(0.0)))


def minimum(weights: dict[str, float]) -> Column:
    return 100 * F.least(*[F.col(k) for k in weights])


def shortfall(weights: dict[str, float], floor: float = 1e-9) -> Column:
    """Each indicator's share of what the score lacks to 100: -w ln(x) over their sum; all 0 where nothing is lacking."""
    raw = {k: -w * F.log(F.greatest(F.col(k), F.lit(floor))) for k, w in weights.items()}
    total = sum(raw.values(), F.lit(0.0))
    return F.array(*[F.struct(F.lit(k).alias("indicator"), F.when(total > 0, clamp01(x / total)).otherwise(0.0).alias("share")) for k, x in raw.items()])


def total_order() -> list[Column]:
    """By score, burst weight, novelty (each rounded, descending) and key."""
    return [F.desc(F.round("score", 6)), F.desc(F.round("burst_weight", 6)), F.desc(F.round("novelty", 6)), F.asc("topic")]


def top(t: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` by the total order, ranked: a top-k, not a sort of everything."""
    few = t.orderBy(*total_order()).limit(n)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*total_order())).cast("long"))


def ranked(t: DataFrame) -> DataFrame:
    """Every topic with its rank in the total order, found by ranges of the score."""
    return ranked_by(t.withColumn("_score", F.round("score", 6)), "_score", total_order(), descending=True).drop("_score")


def scenarios(weights: dict[str, float], up: float = 1.5, down: float = 0.5) -> list[dict[str, float]]:
    """The weights, equal ones, and each weight raised and lowered in turn; every set sums to 1."""
    out = [weights, dict.fromkeys(weights, 1 / len(weights))]
    for k in weights:
        for f in (up, down):
            raised = weights | {k: weights[k] * f}
            out.append({x: w / sum(raised.values()) for x, w in raised.items()})
    return out


def stability(t: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Best and worst place of each topic under all scenarios.

    Places are counted, not sorted for: per scenario the topics of each score, then the scores above it in
    ranges, then the place among equals by key.
    """
    sets = scenarios(weights)
    each = F.array(*[F.struct(F.lit(i).alias("scenario"), F.round(geometric(w), 6).alias("s")) for i, w in enumerate(sets)])
    long = t.select("topic", F.explode(each).alias("e")).select("topic", "e.*")
    long = long.withColumn("range", F.when(F.col("s") <= 0, -1).otherwise(F.floor(F.col("s") * 4)))  # 400 ranges of the scale
    sizes = long.groupBy("scenario", "range").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("scenario").orderBy(F.desc("range"))) - F.col("n")
    sizes = sizes.select("scenario", "range", above.alias("above"))  # at most 401 rows for each scenario
    inside = F.row_number().over(Window.partitionBy("scenario", "range").orderBy(F.desc("s"), "topic"))
    placed = long.withColumn("inside", inside).join(F.broadcast(sizes), ["scenario", "range"]).withColumn("place", F.col("above") + F.col("inside"))
    return placed.groupBy("topic").agg(F.min("place").cast("long").alias("best"), F.max("place").cast("long").alias("worst"))
