"""Event streams: file and Kafka sources, idempotency, windows, rate limits, the request state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENVELOPE = "messageId string, type string, schemaVersion int, occurredAt timestamp, source string, correlationId string, causationId string, traceparent string, payload string"


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Envelopes of a topic; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), ENVELOPE).alias("e")).select("e.*")


def once(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each message once, remembered for ``delay`` of event time."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, at: str, keys: list[str], width: str, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per window; later than ``delay`` is dropped (on a batch nothing is)."""
    e = events.withWatermark(at, delay) if events.isStreaming else events
    out = e.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "events", "total")


def sliding(events: DataFrame, at: str, keys: list[str], width: str, step: str, delay: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(at, delay) if events.isStreaming else events
    return e.groupBy(F.window(at, width, step).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *keys, "events")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(at, delay) if events.isStreaming else events
    out = e.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("events"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def quota_estimate(events: DataFrame, at: str, key: str, width_s: int) -> DataFrame:
    """At the end of each bucket's first half: its count so far plus the part of the bucket before still inside."""
    t = events.select(key, F.unix_timestamp(at).alias("s")).withColumn("bucket", F.floor(F.col("s") / width_s).cast("long"))
    n = t.groupBy(key, "bucket").agg(F.sum(F.when(F.col("s") % width_s < width_s / 2, 1).otherwise(0)).cast("long").alias("sofar"), F.count("*").alias("n"))
    before = n.select(key, (F.col("bucket") + 1).alias("bucket"), F.col("n").alias("before"))
    return n.join(before, [key, "bucket"], "left").select(key, "bucket", (F.coalesce("before", F.lit(0)) * 0.5 + F.col("sofar")).alias("estimate"))


def token_bucket(events: DataFrame, key: str, at: str, per_second: float, capacity: float) -> DataFrame:
    """Whether each event finds a token, folded over a key's events in order of time."""
    kind = dict(events.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([at, "event_id"])
        tokens, last, out = capacity, None, []
        for t in rows[at].astype("int64").to_numpy() / 1e9 if str(rows[at].dtype).startswith("datetime64[ns") else rows[at].astype("datetime64[us]").astype("int64").to_numpy() / 1e6:
            tokens = min(capacity, tokens + (0 if last is None else (t - last) * per_second))
            last = t
            out.append(tokens >= 1)
            tokens -= tokens >= 1
        return pd.DataFrame({"event_id": rows["event_id"], key: rows[key], "allowed": out})

    return events.select("event_id", key, at).groupBy(key).applyInPandas(run, f"event_id bigint, {key} {kind[key]}, allowed boolean")


# The states of a research request and what may follow each.
STATES = {
    "PENDING": ["COLLECTING", "FAILED", "CANCELLED"],
    "COLLECTING": ["ANALYZING", "FAILED", "CANCELLED"],
    "ANALYZING": ["ASSEMBLING", "FAILED", "CANCELLED"],
    "ASSEMBLING": ["COMPLETED", "FAILED", "CANCELLED"],
}


def saga(events: DataFrame, key: str, to: str, at: str, delay: str = "1 hour", deadline_ms: int = 3_600_000) -> DataFrame:
    """Each request's state after its events; moves that the table does not allow are ignored, the overdue fail."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (now,) = state.get
            state.remove()
            if now in STATES:
                yield pd.DataFrame({key: [k[0]], "state": ["FAILED"]})
            return
        now = state.get[0] if state.exists else "PENDING"
        for rows in batches:
            for move in rows.sort_values(at)[to]:
                if move in STATES.get(now, []):
                    now = move
        state.update((now,))
        if now in STATES:
            state.setTimeoutDuration(deadline_ms)
        yield pd.DataFrame({key: [k[0]], "state": [now]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string", "state string", "update", "ProcessingTimeTimeout")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Everything that is there now, into an in-memory table (tests)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def overdue(requests: DataFrame, now) -> DataFrame:
    return requests.where(F.col("status").isin(list(STATES)) & (F.col("deadline") < now))


def latest_state(events: DataFrame, key: str, at: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc("event_id")))
    return events.withColumn("_n", n).where("_n = 1").drop("_n")
