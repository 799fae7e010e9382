"""Views of a finished report and reads of stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_report(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """The newest report of each direction whose request was completed. ``reports``: report, request, created; ``requests``: request, direction, status."""
    done = reports.join(requests.where("status = 'COMPLETED'").select("request", "direction"), "request")
    best = F.max(F.struct("created", "report")).alias("b")
    return done.groupBy("direction").agg(best).select("direction", F.col("b.report").alias("report"), F.col("b.created").alias("created"))


def latest_titles(trends: DataFrame, reports: DataFrame) -> DataFrame:
    """Each topic's title in the newest report that has it. ``trends``: report, topic, title."""
    best = F.max(F.struct("created", "report", "title")).alias("b")
    return trends.join(reports.select("report", "created"), "report").groupBy("topic").agg(best).select("topic", F.col("b.title").alias("title"))


def search_topics(trends: DataFrame, reports: DataFrame, requests: DataFrame, needles: list[str], columns: list[str], viewer=None, keep: int = 5) -> DataFrame:
    """Topics that have every needle in one of the columns, over the reports that a viewer may see: topic, directions, best_rank, title, seen (newest first, ``keep`` at most).

    LIKE's own signs in a needle are plain characters here. ``requests``: request, direction, owner, public.
    """
    r = reports.join(requests.where(F.col("public") | (F.col("owner") == F.lit(viewer))).select("request", "direction"), "request").select("report", "direction", "created")
    t = trends.join(r, "report")
    for n in needles:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.col(c).cast("string")), F.lit(n.lower()))
        t = t.where(hit)
    order = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("created"), "report"))
    few = t.withColumn("n", order).where(F.col("n") <= keep).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("report").cast("string").alias("r")))), lambda x: x["r"]), "|").alias("seen"))
    by = t.groupBy("topic").agg(F.countDistinct("direction").alias("directions"), F.min("rank").cast("long").alias("best_rank"), F.max_by("title", F.struct("created", F.col("report"))).alias("title"))
    return by.join(few, "topic")


def partial_coverage(partial: Column, unavailable: Column) -> Column:
    """Whether some sources did not answer in full."""
    return F.coalesce(partial, F.lit(False)) | (F.size(F.coalesce(unavailable, F.array().cast("array<string>"))) > 0)


def comparable(delta: DataFrame, before: str | None, after: str | None) -> DataFrame:
    """A delta between reports, empty if they were made by different methodologies."""
    return delta if before == after and before is not None else delta.where(F.lit(False))


def cached_request(requests: DataFrame, params: str, since) -> DataFrame:
    """Per set of parameters the request whose result is still good: the newest completed one since then, else the newest that is still running."""
    fresh = requests.where((F.col("status") == "COMPLETED") & (F.col("finished") >= F.lit(since).cast("timestamp")) | ~F.col("status").isin("COMPLETED", "FAILED", "CANCELLED"))
    best = F.max(F.struct((F.col("status") == "COMPLETED").alias("done"), "submitted", "request")).alias("b")
    return fresh.groupBy(params).agg(best).select(params, F.col("b.request").alias("request"), F.col("b.done").alias("hit"))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """DELETE … USING: the rows that no row of ``gone`` matches."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def year_series(timeline: DataFrame, current_year: int) -> DataFrame:
    """Years of a timeline by quarters ("2024-Q1") or years: topic, year, documents, partial."""
    t = timeline.withColumn("year", F.substring("period", 1, 4).try_cast("int")).where("year is not null")
    return t.groupBy("topic", "year").agg(F.sum("documents").cast("long").alias("documents")).withColumn("partial", F.col("year") >= current_year)


def last_year_growth(years: DataFrame) -> DataFrame:
    """How many times the documents of the year before the last full year has; topics with two full years, the first not empty."""
    full = years.where("not partial")
    n = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("year")))
    two = full.withColumn("n", n).where("n <= 2").groupBy("topic").agg(F.max(F.when(F.col("n") == 1, F.col("documents"))).alias("last"), F.max(F.when(F.col("n") == 2, F.col("documents"))).alias("before"))
    return two.where("before > 0").select("topic", (F.col("last") / F.col("before")).alias("factor"))


def stability_verdict(best: Column, worst: Column, top: int) -> Column:
    return F.when(best.isNull() | worst.isNull(), None).when(best == worst, "immovable").when(worst <= top, "holds").otherwise("slips")


def reliability(confidence: Column, low_evidence: Column, verdict: Column, direction_share: Column, low_credibility: Column, noise: Column, floor: float = 0.5, least: float = 0.4) -> Column:
    """low with little evidence, check if anything speaks against the topic, else ok; what was not measured says nothing."""
    low = F.coalesce(low_evidence, F.lit(False)) | (confidence < least)
    flagged = F.coalesce(verdict == "slips", F.lit(False)) | F.coalesce(direction_share < floor, F.lit(False)) | F.coalesce(low_credibility, F.lit(False)) | F.coalesce(noise, F.lit(False))
    return F.when(low, "low").when(flagged, "check").otherwise("ok")


def key_predictors(indicators: DataFrame, most: int = 3) -> DataFrame:
    """A topic's strongest indicators with a weight and a value: topic, name, value, place. Rows: topic, position, name, value, weight."""
    good = indicators.where("weight > 0 and value > 0")
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("value"), "position"))
    return good.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("topic", "name", "value", "place")


def earlier_mentions(timeline: DataFrame, first_credible: DataFrame) -> DataFrame:
    """Topics mentioned before their first credible year: topic, since, gap. Rows: topic, period, documents; topic, first_year."""
    since = timeline.where("documents > 0").withColumn("y", F.substring(F.col("period").cast("string"), 1, 4).try_cast("int"))
    j = since.groupBy("topic").agg(F.min("y").alias("since")).join(first_credible.select("topic", "first_year"), "topic")
    return j.select("topic", F.col("since").cast("long").alias("since"), (F.col("first_year") - F.col("since")).cast("long").alias("gap")).where("gap > 0")
