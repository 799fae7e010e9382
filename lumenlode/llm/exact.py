"""Exact duplicates by progressive refinement: length, then a hash of the head, then a hash of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, stash


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    head: int = 64,
    carry: dict[str, Column] | None = None,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """Of rows with equal text the one with the largest id stays.

    Returns one row per row of ``df``: the id column, keep_id, group_size, kept, and the columns of
    ``carry`` (expressions over ``df``, evaluated in the same scan). A null text counts as empty. A null
    id is below every other; of repeated rows with the largest id exactly one is kept. An empty table
    gives no rows; other columns are ignored, whatever their names.

    Only lengths are compared first; a hash of the first ``head`` characters is taken of lengths that
    occur twice, and the whole text is hashed only where length and head both occur twice. The keys that
    survive are broadcast up to ``broadcast_rows`` of them (24 bytes each); beyond that each scanned row
    is hashed before it is shuffled, so that a text never moves.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(F.octet_length(t).alias("n"), F.xxhash64(F.substring(t, 1, head)).alias("h"))
    lengths = base.groupBy("n").count().where("count > 1").select("n")
    heads = base.join(lengths, "n", "left_semi")  # a length and a hash move, not the text
    suspects = stash(heads.groupBy("n", "h").count().where("count > 1").select("n", "h", F.lit(True).alias("s")), "heads")

    carry = carry or {}
    rows = df.select(
        F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("at")).alias("row"),
        F.octet_length(t).alias("n"),
        F.xxhash64(F.substring(t, 1, head)).alias("h"),
        t.alias("t"),
        F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("carry"),
    )
    if suspects.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(suspects), ["n", "h"], "left").select(
            "row", "carry", F.when(F.col("s"), F.sha2("t", 256)).alias("full")
        )
    else:
        rows = (
            rows.select("row", "carry", "n", "h", F.sha2("t", 256).alias("full"))
            .join(suspects, ["n", "h"], "left")
            .select("row", "carry", F.when(F.col("s"), F.col("full")).alias("full"))
        )
    rows = stash(rows, "rows")
    drop(suspects)

    groups = rows.where("full is not null").groupBy("full").agg(F.max("row").alias("keep"), F.count("*").alias("size"))
    extra = [F.col(f"carry.{k}").alias(k) for k in carry]
    single = rows.where("full is null").select(
        F.col("row.id").alias(id_col), F.col("row.id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), *extra,
    )
    shared = rows.where("full is not null").join(groups, "full").select(
        F.col("row.id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep")).alias("kept"), *extra,
    )
    return single.union(shared)
