"""Each query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from lumenlode.plans import more  # noqa: F401  (adds its queries)
from lumenlode.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    ours = plans.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(plans.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


#: What queries without SQL are held against: see test_units and test_more for their operators.
PROPERTIES = {
    "average_linkage_clusters": lambda rows: all(r.cluster <= r.vec_id for r in rows) and len(rows) == len({r.vec_id for r in rows}),
    "distinct_concepts": lambda rows: len(rows) == len({(r.p_brand, r.p_name) for r in rows}),
    "token_bucket": lambda rows: {r.allowed for r in rows} == {True, False},
    "synonym_merge": lambda rows: {(r.direction, r.canonical) for r in rows} <= {(r.direction, r.term) for r in rows},
    "topic_build": lambda rows: all((r.topic is None) == (r.role == "head") and (r.role != "label" or r.topic == r.term) for r in rows),
    "narration": lambda rows: all(30 <= len(r.sentence) <= 400 and r.mark in r.sentence.lower() and r.place <= 2 for r in rows),
    "model_training": lambda rows: all(0 <= r.auc <= 1 and r.scale > 0 for r in rows),
    "tfidf_space": lambda rows: all(-1.000001 <= r.similarity <= 1.000001 for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_hold_their_properties(spark, name):
    rows = plans.QUERIES[name](spark, SF).collect()
    assert rows and PROPERTIES[name](rows)
