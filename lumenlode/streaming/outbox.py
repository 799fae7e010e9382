"""Messages that wait to be sent: claims in batches, backoff, and the dead-letter table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def backoff_seconds(attempts: Column, first: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """How long to wait after so many failed attempts."""
    return F.least(F.lit(most), first * F.pow(F.lit(factor), F.greatest(attempts - 1, F.lit(0))))


def claim(messages: DataFrame, now, limit: int, most_attempts: int = 10) -> DataFrame:
    """The next messages to send: unpublished, due, not given up; oldest first, then by id. A top-k."""
    due = messages.where(F.col("published").isNull() & (F.col("due") <= F.lit(now).cast("timestamp")) & (F.col("attempts") < most_attempts))
    return due.orderBy("created", "id").limit(limit)


def lag(messages: DataFrame) -> DataFrame:
    """One row: when the oldest unpublished message was made, and how many wait."""
    return messages.where("published is null").agg(F.min("created").alias("oldest"), F.count("*").alias("waiting"))


def outcomes(messages: DataFrame, results: DataFrame, now, most_attempts: int = 10) -> DataFrame:
    """The messages after an attempt (results: id, ok): published, due again later, or dead."""
    at = F.lit(now).cast("timestamp")
    j = messages.join(results, "id", "left")
    tried = F.col("attempts") + F.col("ok").isNotNull().cast("int")
    later = F.timestamp_seconds(F.unix_micros(at) / 1e6 + backoff_seconds(tried))
    state = (
        F.when(F.col("published").isNotNull() | F.coalesce("ok", F.lit(False)), "published").when(tried >= most_attempts, "dead").otherwise("waiting")
    )
    return j.select(
        "id", "created", F.when(F.coalesce("ok", F.lit(False)), at).otherwise(F.col("published")).alias("published"),
        F.when(F.col("ok") == F.lit(False), later).otherwise(F.col("due")).alias("due"), tried.alias("attempts"), state.alias("state"),
    )


def split_bad(rows: DataFrame, parsed: str, raw: str) -> tuple[DataFrame, DataFrame]:
    """Records that could be parsed, and the others for the dead-letter table."""
    return rows.where(F.col(parsed).isNotNull()), rows.where(F.col(parsed).isNull()).select(raw)


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    """Envelopes to a Kafka topic, keyed by correlation; needs Spark's Kafka package on the class path."""
    value = F.to_json(F.struct(*[F.col(c) for c in messages.columns]))
    messages.select(F.col("correlationId").alias("key"), value.alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
