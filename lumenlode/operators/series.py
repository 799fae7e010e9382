"""Yearly series of topics and what is read off them. Mentions: topic, doc, period, org, source_class, venue, tf."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp01, log_share, safe_div


def term_period_stats(m: DataFrame) -> DataFrame:
    """df and tf of each topic and period."""
    return m.groupBy("topic", "period").agg(F.countDistinct("doc").alias("df"), F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("tf"))


def period_class_stats(m: DataFrame) -> DataFrame:
    return m.groupBy("topic", "period", "source_class").agg(
        F.countDistinct("doc").alias("df"), F.countDistinct("org").alias("orgs"), F.countDistinct("venue").alias("venues"), F.sum("tf").cast("long").alias("tf")
    )


def corpus_per_period(m: DataFrame) -> DataFrame:
    return m.groupBy("period").agg(F.countDistinct("doc").alias("n"))


#: What a topic is counted by: the columns that make a thing distinct inside a topic.
KINDS = {"period": ["period", "doc"], "doc": ["doc"], "org": ["org"], "venue": ["venue"], "class": ["source_class", "doc"]}


#: What is measured of a document: the name among a profile's entries of each column of the mentions.
MEASURES = {"citations": "c", "patent": "p", "corporate": "i"}


def profile(m: DataFrame, kinds: tuple[str, ...] = tuple(KINDS), measures: tuple[str, ...] = tuple(MEASURES), shared: bool = True) -> DataFrame:
    """One row per topic with what its indicators need, from one pass over the mentions.

    Only columns of the mentions that ``kinds`` and ``measures`` need are moved; what rests on others is zero or empty.

    The mentions are shuffled once, as they are, by topic; then each is laid out by every set of columns and
    grouped and counted where it lies, and only the few counts of a topic are moved again, as one column, so that
    all who read a profile share them (if ``shared``; one that is read once need not be). A topic's mentions meet in one task, which groups them with spilling.
    Columns: topic; series (period, df, tf); documents, doc_firsts and org_firsts (period, n: things first seen
    then), orgs, venues, classes (documents per class), citations, patent_share and corporate_share per document.
    """
    named = ["period", "doc", "org", "venue", "source_class"]
    types = dict(m.dtypes)
    null = lambda t: F.lit(None).cast(t)

    def entry(kind: str) -> F.Column:
        things = [(F.col(c) if c in KINDS[kind] else null(types[c])).alias(c) for c in named]
        first = F.col("period") if kind in ("doc", "org") else null(types["period"])
        tf = F.col("tf") if kind == "period" else null(types["tf"])
        held = [(F.col(c).cast("double") if kind == "doc" and c in types and c in measures else null("double")).alias(x) for c, x in MEASURES.items()]
        return F.struct(F.lit(kind).alias("kind"), *things, first.alias("first"), tf.alias("tf"), *held)

    # many small parts, so that groups fit a task's memory; their number is given as adaptive execution would join them
    dealt = m.repartition(4 * int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), "topic")
    each = dealt.select("topic", F.explode(F.array(*[entry(k) for k in kinds])).alias("e")).select("topic", "e.*")
    each = each.where("not (kind = 'org' and org is null) and not (kind = 'venue' and venue is null)")
    g = each.groupBy("topic", "kind", *named).agg(F.min("first").alias("first"), F.sum("tf").alias("tf"), *[F.max(c).alias(c) for c in "cpi"])
    at = F.when(F.col("kind") == "period", F.col("period")).when(F.col("kind").isin("doc", "org"), F.col("first"))
    counts = g.groupBy("topic", "kind", at.alias("at"), F.when(F.col("kind") == "class", F.col("source_class")).alias("class")).agg(
        F.count("*").alias("n"), F.sum("tf").alias("tf"), F.sum("c").alias("c"), F.count("c").alias("cited"), F.sum("p").alias("p"), F.sum("i").alias("i")
    )
    every = counts.groupBy("topic").agg(F.collect_list(F.struct("kind", "at", "class", "n", "tf", "c", "cited", "p", "i")).alias("x"))  # a few rows per period and class
    every = every.repartition("topic") if shared else every
    of_kind = lambda k: F.filter("x", lambda r: r["kind"] == k)
    total = lambda k, f: F.aggregate(of_kind(k), F.lit(0.0), lambda s, r: s + F.coalesce(r[f].cast("double"), F.lit(0.0)))
    firsts = lambda k: F.array_sort(F.transform(of_kind(k), lambda r: F.struct(r["at"].alias("period"), r["n"].alias("n"))))
    docs = total("doc", "n")
    return every.select(
        "topic",
        F.array_sort(F.transform(of_kind("period"), lambda r: F.struct(r["at"].alias("period"), r["n"].alias("df"), F.coalesce(r["tf"], F.lit(0)).cast("long").alias("tf")))).alias("series"),
        docs.cast("long").alias("documents"),
        firsts("doc").alias("doc_firsts"),
        firsts("org").alias("org_firsts"),
        total("org", "n").cast("long").alias("orgs"),
        total("venue", "n").cast("long").alias("venues"),
        F.transform(of_kind("class"), lambda r: r["n"]).alias("classes"),
        safe_div(total("doc", "c"), total("doc", "cited")).alias("citations"),
        safe_div(total("doc", "p"), docs).alias("patent_share"),
        safe_div(total("doc", "i"), docs).alias("corporate_share"),
        (total("doc", "cited") > 0).alias("cited"),
    )


def span(m: DataFrame) -> DataFrame:
    """One row: the corpus' first period a, its periods, and documents by period as a map (periods are years)."""
    c = corpus_per_period(m)
    return c.agg(F.min("period").alias("a"), F.max("period").alias("b"), F.map_from_entries(F.collect_list(F.struct("period", "n"))).alias("by_period"))


def filled(profiles: DataFrame, corpus: DataFrame) -> DataFrame:
    """A row for each topic and each period of the corpus' span, zero where there is none: df, tf, n, idx (from 1), length."""
    j = profiles.select("topic", F.map_from_entries(F.transform("series", lambda r: F.struct(r["period"], r))).alias("own")).crossJoin(F.broadcast(corpus))  # one row
    row = lambda p: F.struct(
        p.alias("period"), (p - F.col("a") + 1).cast("long").alias("idx"), (F.col("b") - F.col("a") + 1).cast("long").alias("length"),
        F.coalesce(F.try_element_at("own", p)["df"], F.lit(0)).cast("long").alias("df"), F.coalesce(F.try_element_at("own", p)["tf"], F.lit(0)).cast("long").alias("tf"),
        F.coalesce(F.try_element_at("by_period", p), F.lit(0)).cast("long").alias("n"),
    )
    return j.select("topic", F.explode(F.transform(F.sequence("a", "b"), row)).alias("r")).select("topic", "r.*")


def topic_series(m: DataFrame) -> DataFrame:
    """See ``filled``; of all topics of the mentions."""
    return filled(profile(m, ("period",)), span(m))


def growth(series: DataFrame, g_max: float = 3.0, last_share: float = 1.0) -> DataFrame:
    """Slope of ln(df + 1) over periods with documents, the last one annualised; half-window slopes; growth in 0..1.

    Slopes have nine decimals: a flat series has slope 0, not the noise of its sums.
    """
    df = F.when(F.col("idx") == F.col("length"), F.col("df") / max(last_share, 0.05)).otherwise(F.col("df"))
    s = series.withColumn("y", F.when(df > 0, F.log(df + 1.0))).withColumn("x", F.when(df > 0, F.col("idx").cast("double")))
    half = F.floor(F.col("length") / 2)

    def slope(where) -> F.Column:
        x, y = F.when(where, F.col("x")), F.when(where, F.col("y"))
        varied = F.coalesce(F.var_pop(x), F.lit(0.0)) > 0
        return F.when(varied, F.round(F.coalesce(F.regr_slope(y, x), F.lit(0.0)), 9)).otherwise(0.0)

    always, early, late = F.lit(True), F.col("idx") <= half, F.col("idx") > F.col("length") - half
    out = s.groupBy("topic").agg(
        slope(always).alias("slope"),
        F.when(F.coalesce(F.var_pop("y"), F.lit(0.0)) > 1e-12, F.coalesce(F.regr_r2("y", "x"), F.lit(0.0))).otherwise(0.0).alias("r2"),
        F.count("x").alias("points"),
        slope(early).alias("early"),
        slope(late).alias("recent"),
    )
    value = clamp01(F.greatest(F.col("slope"), F.lit(0.0)) / F.log(F.lit(g_max)))
    return out.withColumn("acceleration", F.col("recent") - F.col("early")).withColumn("growth", value)


def visibility_and_diffusion(series: DataFrame, decay: float = 0.05) -> DataFrame:
    """DoV and DoD: share of tf and of df, later periods weighing more."""
    weight = 1 - decay * (F.col("length") - F.col("idx"))
    return series.select(
        "topic", "period", (safe_div(F.col("tf"), F.col("n")) * weight).alias("dov"), (safe_div(F.col("df"), F.col("n")) * weight).alias("dod")
    )


def mean_increase_rate(series: DataFrame, value: str = "df") -> DataFrame:
    before = F.lag(value).over(Window.partitionBy("topic").orderBy("idx"))
    s = series.withColumn("before", before).where("before > 0")
    return s.groupBy("topic").agg(F.avg(F.col(value) / F.col("before") - 1).alias("rate"))


def burst(series: DataFrame, scale: float = 2.0, floor_documents: float = 1.0) -> DataFrame:
    """Periods whose rate is ``scale`` times the mean rate of the first half or more: weight, start, number."""
    s = series.withColumn("rate", safe_div(F.col("df"), F.col("n")))
    half = F.greatest(F.lit(1), F.floor(F.col("length") / 2))
    base = s.groupBy("topic").agg(
        (F.sum(F.when(F.col("idx") <= half, F.col("rate")).otherwise(0.0)) / F.max(half)).alias("mean"),
        F.avg(F.when(F.col("n") > 0, F.col("n"))).alias("per_period"),
    )
    base = base.select("topic", F.greatest("mean", safe_div(F.lit(floor_documents), F.col("per_period"))).alias("base"))
    hot = s.join(base, "topic").withColumn("hot", (F.col("base") > 0) & (F.col("rate") >= scale * F.col("base")))
    return hot.groupBy("topic").agg(
        F.max("base").alias("base"),
        F.sum(F.when(F.col("hot"), F.col("rate") / F.col("base") - scale).otherwise(0.0)).alias("weight"),
        F.min(F.when(F.col("hot"), F.col("period"))).alias("start"),
        F.count(F.when(F.col("hot"), 1)).alias("periods"),
    )


def _all_topics(df: DataFrame) -> DataFrame:
    """``df``, planned like a side of a join by topic (which leaves out nulls), so that what both read is shuffled once."""
    return df.where("topic is not null").union(df.where("topic is null"))


def corpus_stats(m: DataFrame, series: DataFrame, recent: int = 2) -> DataFrame:
    """One row: recent_max, q25, q60, q90 of topics' documents, classes."""
    volume = series.groupBy("topic").agg(
        F.sum("df").alias("v"), F.sum(F.when(F.col("idx") > F.col("length") - recent, F.col("df")).otherwise(0)).alias("r")
    )
    q = [F.expr(f"percentile(v, {x})").alias(k) for k, x in (("q25", 0.25), ("q60", 0.6), ("q90", 0.9))]
    return _all_topics(volume).agg(F.max("r").alias("recent_max"), *q).crossJoin(m.agg(F.countDistinct("source_class").alias("classes")))


def first_credible(p: DataFrame, documents: int = 2, parties: int = 2) -> F.Column:
    """Of a profile the first period by which the topic has so many documents of so many organisations, or null."""
    by = lambda c, at: F.aggregate(F.filter(c, lambda r: r["period"] <= at), F.lit(0).cast("long"), lambda s, r: s + r["n"])
    reached = F.filter(F.transform("doc_firsts", lambda r: r["period"]), lambda at: (by("doc_firsts", at) >= documents) & (by("org_firsts", at) >= parties))
    late = F.filter(F.transform("org_firsts", lambda r: r["period"]), lambda at: (by("doc_firsts", at) >= documents) & (by("org_firsts", at) >= parties))
    return F.least(F.array_min(reached), F.array_min(late))


def first_credible_year(m: DataFrame, documents: int = 2, parties: int = 2) -> DataFrame:
    """Topics that reach them, with the first period by which a topic has so many documents of so many organisations."""
    p = profile(m, ("doc", "org"))
    return p.select("topic", first_credible(p, documents, parties).alias("first_year")).where("first_year is not null")


def novelty_of(first_year: F.Column, current_year: int, tau: float = 3.0) -> F.Column:
    """1 in the year of the first credible evidence, then decaying; 0 without such a year."""
    return F.when(first_year.isNull(), 0.0).otherwise(F.exp(-F.greatest(F.lit(0), F.lit(current_year) - first_year) / tau))


def novelty(m: DataFrame, current_year: int, tau: float = 3.0) -> DataFrame:
    p = profile(m, ("doc", "org"))
    return p.select("topic", first_credible(p).alias("first_year")).select("topic", "first_year", novelty_of(F.col("first_year"), current_year, tau).alias("novelty"))


def weakness(series: DataFrame, recent: int = 2, floor: int = 5) -> DataFrame:
    """1 where nothing recent, 0 for the topic with most recent documents."""
    r = series.groupBy("topic").agg(F.sum(F.when(F.col("idx") > F.col("length") - recent, F.col("df")).otherwise(0)).alias("recent"))
    most = F.greatest(F.max("recent"), F.lit(floor)).alias("most")
    return r.crossJoin(F.broadcast(_all_topics(r).agg(most))).select("topic", "recent", clamp01(1 - F.log1p("recent") / F.log1p("most")).alias("weakness"))


def diffusion_of(active: F.Column, weights=(0.40, 0.35, 0.25), orgs: int = 50, venues: int = 25) -> tuple[F.Column, F.Column]:
    """Of a profile the evenness over source classes (``active``: how many the corpus has), and the diffusion."""
    n = F.aggregate("classes", F.lit(0.0), lambda s, x: s + x)
    entropy = F.aggregate("classes", F.lit(0.0), lambda s, x: s - (x / n) * F.log(x / n))
    even = clamp01(safe_div(entropy, F.log(active.cast("double"))))
    return even, clamp01(weights[0] * even + weights[1] * log_share(F.col("orgs"), orgs) + weights[2] * log_share(F.col("venues"), venues))


def diffusion(m: DataFrame) -> DataFrame:
    """Entropy over source classes, breadth of organisations and of venues."""
    active = F.broadcast(m.agg(F.countDistinct("source_class").alias("k")))
    even, value = diffusion_of(F.col("k"))
    return profile(m, ("org", "venue", "class")).crossJoin(active).select("topic", "orgs", "venues", even.alias("evenness"), value.alias("diffusion"))  # one row


def impact_of(weights=(0.45, 0.30, 0.25)) -> tuple[F.Column, F.Column]:
    """Of a profile the impact, and whether anything of it is measured."""
    value = weights[0] * log_share(F.col("citations"), 10) + weights[1] * clamp01(F.col("patent_share") / 0.30) + weights[2] * clamp01(F.col("corporate_share") / 0.50)
    return value, F.col("cited") | (F.col("patent_share") > 0) | (F.col("corporate_share") > 0)


def impact(m: DataFrame) -> DataFrame:
    """Citations a year per document, share of patents and of corporate organisations; each part held in 0..1 first."""
    value, measured = impact_of()
    return profile(m, ("doc",)).select("topic", "patent_share", value.alias("impact"), measured.alias("measured"))


def per_year(citations: F.Column, year: F.Column, current_year: int) -> F.Column:
    """Citations a year since publication, the year itself counting as one."""
    return citations / F.greatest(F.lit(1), F.lit(current_year) - year)


def confidence(series: DataFrame, fit: DataFrame, classes: DataFrame, threshold: float = 0.40) -> DataFrame:
    """Evidence, diversity of classes, adjusted fit and span, weighted; ``classes``: topic, class_count, documents."""
    span = series.groupBy("topic").agg(F.count(F.when(F.col("df") > 0, 1)).alias("with_data"), F.max("length").alias("length"))
    j = span.join(fit.select("topic", "r2"), "topic").join(classes, "topic")
    n = F.col("with_data")
    adjusted = F.when(n <= 2, 0.0).otherwise(clamp01(1 - (1 - clamp01(F.col("r2"))) * (n - 1) / F.greatest(n - 2, F.lit(1))))
    of_span = clamp01(n / F.greatest(F.lit(1), F.least("length", F.lit(5))))
    value = 0.35 * log_share(F.col("documents"), 20) + 0.25 * clamp01(F.col("class_count") / 3) + 0.20 * adjusted + 0.20 * of_span
    return j.select("topic", clamp01(value).alias("confidence"), (value < threshold).alias("low_evidence"))


def lifecycle(t: DataFrame) -> DataFrame:
    """First rule that matches, on slope, volume, patent_share, bursting, q25 and q60."""
    s, v = F.col("slope"), F.col("volume")
    stage = (
        F.when((s <= 0.2) | ((F.col("patent_share") > 0.4) & (v >= F.col("q60"))), "MATURING")
        .when((s > 0.5) & (F.col("bursting") | (v >= F.col("q60"))), "ACCELERATING")
        .when((F.col("q25") <= v) & (v < F.col("q60")), "EMERGING")
        .when((v < F.col("q25")) & (s > 0), "EMBRYONIC")
        .otherwise("EMERGING")
    )
    return t.withColumn("stage", stage)
