"""Reads of finished reports. Rows: direction, version, topic, rank, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import keep_latest


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each topic of either report: entered, left or stayed, with the changes of rank and score."""
    b = before.select("topic", F.col("rank").alias("old_rank"), F.col("score").alias("old_score"))
    j = after.select("topic", "rank", "score").join(b, "topic", "full")
    status = F.when(F.col("old_rank").isNull(), "entered").when(F.col("rank").isNull(), "left").otherwise("stayed")
    return j.select("topic", status.alias("status"), (F.col("old_rank") - F.col("rank")).alias("rank_change"), (F.col("score") - F.col("old_score")).alias("score_change"))


def overlap(reports: DataFrame, least: int = 2) -> DataFrame:
    """Topics of several directions with their best rank."""
    out = reports.groupBy("topic").agg(F.countDistinct("direction").alias("directions"), F.min("rank").cast("long").alias("best_rank"))
    return out.where(F.col("directions") >= least)


def portrait(reports: DataFrame, stage: str, stages: list[str]) -> DataFrame:
    """Topics per stage of each direction, zero for stages without any, and the lower median score."""
    spine = reports.select("direction").distinct().select("direction", F.explode(F.array(*map(F.lit, stages))).alias("stage"))
    got = reports.groupBy("direction", F.col(stage).alias("stage")).agg(F.count("*").alias("topics"), F.sort_array(F.collect_list("score")).alias("s"))
    middle = F.expr("element_at(s, cast((size(s) - 1) div 2 as int) + 1)")
    return spine.join(got, ["direction", "stage"], "left").select("direction", "stage", F.coalesce("topics", F.lit(0)).cast("long").alias("topics"), F.when(F.col("topics") > 0, middle).alias("median_score"))


def search(titles: DataFrame, needles: list[str], columns: list[str]):
    """Rows in which every needle occurs in one of the columns, whatever the case."""
    for n in needles:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.col(c)), F.lit(n.lower()))
        titles = titles.where(hit)
    return titles


def carried_feedback(feedback: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    return keep_latest(feedback, keys, [F.desc(at), F.desc(tie)])


def hidden(feedback: DataFrame, report: DataFrame, verdict: str = "NOISE") -> DataFrame:
    """Keys last called noise that are not in the report."""
    return feedback.where(F.col("verdict") == verdict).select("topic").distinct().join(report.select("topic"), "topic", "left_anti")


def radar_digest(reports: DataFrame, headline: int = 3) -> DataFrame:
    """Per direction: newest version, topics that entered since the one before, first titles."""
    newest = F.max("version").over(Window.partitionBy("direction"))
    r = reports.withColumn("newest", newest)
    now = r.where("version = newest")
    old = r.where("version = newest - 1").select("direction", "topic")
    entered = now.join(old, ["direction", "topic"], "left_anti").groupBy("direction").agg(F.count("*").alias("entered"))
    n = F.row_number().over(Window.partitionBy("direction").orderBy("rank", "topic"))
    top = now.withColumn("n", n).where(F.col("n") <= headline)
    top = top.groupBy("direction", F.col("newest").alias("version")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "topic"))), lambda x: x["topic"]), "|").alias("headline"))
    return top.join(entered, "direction", "left").select("direction", "version", "headline", F.coalesce("entered", F.lit(0)).cast("long").alias("entered"))


def next_version(reports: DataFrame) -> DataFrame:
    return reports.groupBy("direction").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("long").alias("version"))
