"""Small tables known on the driver, as plans that need no Python on executors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """``rows`` as a DataFrame; ``schema``: the fields of a struct in DDL."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(parsed))
