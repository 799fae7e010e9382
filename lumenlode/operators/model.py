"""Model scores, their measures, rules of the classifier, backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp01, sigmoid, signed_log1p

TRANSFORMS = {"identity": lambda x: x, "log1p": F.log1p, "signed_log1p": signed_log1p}


def linear(features: list[tuple[str, float, str, float, float]], bias: float, link: str = "sigmoid") -> Column:
    """bias + sum of weight * (T(x) - centre) / scale, a missing feature adding nothing; name, weight, T, centre, scale."""
    x = F.lit(bias)
    for name, weight, transform, centre, scale in features:
        x = x + F.coalesce(weight * (TRANSFORMS[transform](F.col(name).cast("double")) - centre) / scale, F.lit(0.0))
    return 100 * sigmoid(x) if link == "sigmoid" else x


def contributions(features: list[tuple[str, float, str, float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("feature"), (w * (TRANSFORMS[t](F.col(n).cast("double")) - c) / s).alias("contribution")) for n, w, t, c, s in features])


def blended(methodology: Column, model: Column, papers: Column, hosts: Column) -> Column:
    """Half of each, up to 18 for papers found and up to 8 for supporting hosts."""
    return 0.5 * methodology + 0.5 * model + F.least(6.0 * papers, F.lit(18.0)) + F.least(3 * F.log2(1.0 + hosts), F.lit(8.0))


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    c = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")
    m = df.agg(c(truth & predicted).alias("tp"), c(truth & ~predicted).alias("fn"), c(~truth & predicted).alias("fp"), c(~truth & ~predicted).alias("tn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fn, fp, tn = (F.col(k) for k in ("tp", "fn", "fp", "tn"))
    m = m.withColumns({"precision": over(tp, tp + fp), "recall": over(tp, tp + fn), "accuracy": over(tp + tn, tp + fn + fp + tn)})
    return m.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the curve from counts per distinct score: ties count half."""
    per = df.groupBy(score).agg(F.sum(truth).alias("p"), F.sum(1 - F.col(truth)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = per.withColumn("u", F.col("p") * (below + F.col("n") / 2))
    return s.agg((F.sum("u") / (F.sum("p") * F.sum("n"))).alias("auc"))


def classify(t: DataFrame) -> DataFrame:
    """First rule that matches, on works_recent, first_year, growth, kinds, works, span, current_year, and, where a phrase was asked for, wiki_years and wiki_size."""
    old = F.col("current_year") - F.col("first_year") > 6
    slow = F.col("growth") < 0.20 / F.log(F.lit(3.0))
    known = (F.col("wiki_years") >= 5) & (F.col("wiki_size") >= 30_000) if {"wiki_years", "wiki_size"} <= set(t.columns) else F.lit(False)
    verdict = (
        F.when(F.col("works_recent") >= 3000, "MAINSTREAM").when(F.coalesce(known, F.lit(False)), "MAINSTREAM").when(old & slow, "MAINSTREAM").when(F.col("kinds") < 2, "INSUFFICIENT").otherwise("WEAK_SIGNAL")
    )
    sure = 0.45 * F.log1p(F.col("kinds")) / F.log1p(F.lit(4.0)) + 0.30 * F.log1p("works") / F.log1p(F.lit(50.0)) + 0.25 * F.col("span") / 4
    return t.withColumn("verdict", verdict).withColumn("certainty", clamp01(sure))


def backtest(series: DataFrame, cutoff: int, hit: float = 1.5) -> DataFrame:
    """Each topic frozen at the cutoff against what came: before, after, lift over the corpus' growth, hit, doubling.

    doubling: years until as many documents had come as there were (null if they never did). ``series``:
    topic, period, df, n (the corpus), a row per period.
    """
    past = F.col("period") <= cutoff
    total = lambda c, w: F.sum(F.when(w, F.col(c)).otherwise(0))
    later = F.sum(F.when(~past, F.col("df")).otherwise(0)).over(Window.partitionBy("topic").orderBy("period"))
    t = series.withColumn("later", later).withColumn("had", F.sum(F.when(past, F.col("df")).otherwise(0)).over(Window.partitionBy("topic")))
    doubled = F.min(F.when(~past & (F.col("had") > 0) & (F.col("later") >= F.col("had")), F.col("period") - cutoff))
    t = t.groupBy("topic").agg(total("df", past).alias("before"), total("df", ~past).alias("after"), total("n", past).alias("na"), total("n", ~past).alias("nb"), doubled.cast("long").alias("doubling"))
    lift = F.when((F.col("before") > 0) & (F.col("nb") > 0), (F.col("after") / F.col("before")) / (F.col("nb") / F.col("na"))).otherwise(0.0)
    return t.select("topic", "before", "after", lift.alias("lift"), (lift >= hit).alias("hit"), "doubling")


def backtest_summary(outcomes: DataFrame) -> DataFrame:
    """One row: topics, hit_rate, median lift, and the median years to doubling of those that doubled."""
    return outcomes.agg(
        F.count("*").alias("topics"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.expr("percentile(lift, 0.5)").alias("median_lift"), F.expr("percentile(doubling, 0.5)").alias("median_lead")
    )


def held_out(df: DataFrame, key: str, group: str | None, share: float, seed: int = 20260920) -> DataFrame:
    """``df`` with test: a share of the rows, or of the groups whole, by hash: reruns agree."""
    return df.withColumn("test", F.pmod(F.xxhash64(F.lit(seed), F.col(group or key)), F.lit(10_000)) < int(share * 10_000))


def train(df: DataFrame, features: dict[str, str], label: str, test: str = "test", regularisation: float = 1.0) -> dict:
    """A logistic model of the rows not held out, as an artifact that ``linear`` applies.

    ``features``: names and transforms. Centre and scale are of the training rows' known values; a missing
    value counts as the centre, a feature without spread has weight 0. Classes weigh the same. The area
    under the curve is of the held-out rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = {n: TRANSFORMS[t](F.col(n).cast("double")) for n, t in features.items()}
    rows = df.where(~F.col(test) & F.col(label).isNotNull())
    figures = rows.agg(
        *[F.avg(c).alias(f"m_{n}") for n, c in x.items()], *[F.stddev_pop(c).alias(f"s_{n}") for n, c in x.items()],
        F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("p"),
    ).first()
    n, p = figures["n"], figures["p"] or 0
    if not 0 < p < n:
        raise ValueError("training needs rows of both classes")
    usable = [f for f in x if (figures[f"s_{f}"] or 0.0) > 1e-12]
    if not usable:
        raise ValueError("no feature varies")
    table = [(f, 0.0, features[f], figures[f"m_{f}"], figures[f"s_{f}"]) if f in usable else (f, 0.0, "identity", 0.0, 1.0) for f in x]
    scaled = F.array(*[F.coalesce((x[f] - figures[f"m_{f}"]) / figures[f"s_{f}"], F.lit(0.0)) for f in usable])
    weight = F.when(F.col(label).cast("int") == 1, n / (2 * p)).otherwise(n / (2 * (n - p)))
    ready = rows.select(array_to_vector(scaled).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
    fitted = LogisticRegression(weightCol="weight", regParam=1 / (regularisation * n), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10).fit(ready)
    weights = dict(zip(usable, fitted.coefficients.toArray().tolist(), strict=True))
    table = [(f, weights.get(f, 0.0), t, c, s) for f, _, t, c, s in table]
    scored = df.where(F.col(test) & F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), linear(table, float(fitted.intercept)).alias("score"))
    return {"bias": float(fitted.intercept), "features": table, "rows": n, "positives": p, "auc": auc(scored, "y", "score").first()["auc"]}


def proposals(names: DataFrame, known: DataFrame, generic: DataFrame, pages: DataFrame, activity: DataFrame) -> DataFrame:
    """What becomes of proposed names: name, outcome (a code, or 'accepted') and pages.

    In order: a known topic; a generic name; without a page of the corpus and without measured activity; with
    activity but no work to show. ``pages``: name, url found in the corpus; ``activity``: name, works, mentions, shown.
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    one = names.select(F.trim("name").alias("name"), key("name").alias("k")).where("name <> ''").groupBy("k").agg(F.min("name").alias("name"))
    mark = lambda df, c: df.select(key("name").alias("k")).distinct().withColumn(c, F.lit(True))
    j = one.join(mark(known, "known"), "k", "left").join(mark(generic, "generic"), "k", "left")
    j = j.join(pages.groupBy(key("name").alias("k")).agg(F.countDistinct("url").alias("pages")), "k", "left")
    j = j.join(activity.groupBy(key("name").alias("k")).agg(F.max((F.col("works") > 0) | (F.col("mentions") > 0)).alias("active"), F.max(F.col("shown") > 0).alias("shown")), "k", "left")
    outcome = (
        F.when(F.col("known"), "proposed_already_known")
        .when(F.col("generic"), "proposed_generic_name")
        .when(F.coalesce("pages", F.lit(0)) > 0, "accepted")
        .when(~F.coalesce("active", F.lit(False)), "proposed_no_evidence")
        .when(~F.coalesce("shown", F.lit(False)), "proposed_no_sources")
        .otherwise("accepted")
    )
    return j.select("name", outcome.alias("outcome"), F.coalesce("pages", F.lit(0)).cast("long").alias("pages"))
