"""Functions and operators against values worked out by hand, and properties of the scores."""

import itertools
import math
from datetime import date, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlode.functions import numeric as N
from lumenlode.functions import text as T
from lumenlode.operators import scoring, selection, series, vectors
from lumenlode.sources import documents as D
from lumenlode.streaming import events as streams


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_text_functions(spark):
    r = one(
        spark,
        key=T.dedup_key(F.lit(" 10.1/A "), F.lit(None).cast("string"), F.lit("x"), F.lit(""), F.lit(2020)),
        same=T.dedup_key(F.lit("10.1/a"), F.lit("9"), F.lit("y"), F.lit("z"), F.lit(1)),
        url=T.canonical_url(F.lit("HTTPS://www.Example.org/A/#x")),
        org=T.canonical_organization(F.lit("The Foo & Bar Co., Ltd.")),
        author=T.normalize_author(F.lit("Smith, John")),
        plain=T.normalize_author(F.lit("John Smith")),
        lang=T.detect_language(F.lit("der Hund und die Katze sind nicht im Haus")),
        english=T.detect_language(F.lit("a short description with die and den in it")),
        russian=T.detect_language(F.lit("Нейронные сети и машинное обучение")),
        none=T.detect_language(F.lit(None).cast("string")),
        year=T.is_year_like(F.lit("1999")),
        label=T.label_matches(F.lit("solid state battery"), F.lit("state")),
    )
    assert r.key == r.same and r.url == "example.org/a" and r.org == "the foo and bar"
    assert r.author == r.plain == "smith j"
    assert (r.lang, r.none, r.english, r.russian, r.year, r.label) == ("de", None, "en", "ru", True, True)


def test_numeric_guards(spark):
    r = one(
        spark,
        inf=N.clamp01(F.lit(float("inf"))),
        nan=N.clamp01(F.lit(float("nan"))),
        null=N.clamp01(F.lit(None).cast("double")),
        zero=N.safe_div(F.lit(1.0), F.lit(0.0)),
        cos=N.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))),
    )
    assert list(r) == [0.0] * 5


def test_series_has_zeros_and_growth_is_a_slope(spark):
    rows = [("a", f"d{y}{i}", y, f"o{i}", "P", "v", 1) for y, n in ((2018, 1), (2020, 3), (2021, 7)) for i in range(n)] + [("b", "x", 2018, "o", "N", "v", 2)]
    m = spark.createDataFrame(rows, "topic string, doc string, period int, org string, source_class string, venue string, tf int")
    s = series.topic_series(m)
    assert [r.df for r in s.where("topic = 'a'").orderBy("idx").collect()] == [1, 0, 3, 7]
    fit = {r.topic: r for r in series.growth(s).collect()}
    x, y = [1, 3, 4], [math.log(2), math.log(4), math.log(8)]
    assert fit["a"].slope == pytest.approx(np.polyfit(x, y, 1)[0]) and fit["b"].slope == 0
    assert {r.topic: r.first_year for r in series.first_credible_year(m).collect()} == {"a": 2020}
    hot = series.burst(s).where("topic = 'a'").first()
    assert hot.weight >= 0


six = st.lists(st.floats(0, 1), min_size=6, max_size=6)
weights = st.lists(st.floats(0.01, 1), min_size=6, max_size=6)


@settings(max_examples=15, deadline=None)
@given(values=st.lists(six, min_size=1, max_size=5), w=weights)
def test_aggregators_stay_on_scale(spark, values, w):
    names = list(scoring.WEIGHTS)
    w = {k: x / sum(w) for k, x in zip(names, w)}
    t = spark.createDataFrame(values, names)
    for v, r in zip(values, t.select(scoring.geometric(w).alias("g"), scoring.arithmetic(w).alias("a"), scoring.minimum(w).alias("m")).collect()):
        assert -1e-9 <= r.m <= 100 + 1e-6 and (min(v) <= 0 or r.m <= r.g + 1e-6 <= r.a + 2e-6 <= 100 + 3e-6)
        if min(v) <= 0:
            assert r.g == r.a == r.m == 0


def test_stratified_sample_keeps_proportions(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") < 700, 1).when(F.col("id") < 990, 2).otherwise(3))
    got = {r.y: r["count"] for r in selection.stratified_sample(df, "y", 101, [F.asc("id")]).groupBy("y").count().collect()}
    assert got == {1: 71, 2: 29, 3: 1}  # 70.7, 29.29 and 1.01: the shortest by most gets the one left
    assert selection.stratified_sample(df, "y", 2000, [F.asc("id")]).count() == 1000


def test_average_linkage_joins_the_nearest_first():
    v = np.array([[1, 0], [1, 0.01], [0, 1], [0.01, 1], [-1, -1]])
    assert vectors.average_linkage(v, 0.1) == [0, 0, 2, 2, 4]
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, 4))
    assert len(set(vectors.average_linkage(x, 2.1))) == 1


def test_svd_is_orthonormal_and_repeats():
    texts = [" ".join(w) for w in itertools.permutations(["red", "green", "blue", "cyan"], 3)]
    a, b = vectors.tfidf_svd(texts, 3), vectors.tfidf_svd(texts, 3)
    assert np.array_equal(a, b) and np.allclose(np.linalg.norm(a, axis=1), 1)


def test_jsonl_comments_and_envelopes(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('// a comment\n{"documentId": "1", "title": "T", "publishedOn": "2020-01-02", "authors": [{"fullName": "A B", "organizationName": "O"}]}\n\n{"payload": {"documentId": "2", "title": "U", "publishedOn": "2021-05-06"}}\n')
    d = D.derived(D.read_jsonl(spark, str(path))).orderBy("documentId").collect()
    assert [(r.documentId, r.year, r.text, r.organizations) for r in d] == [("1", 2020, "T", ["O"]), ("2", 2021, "U", [])]


def test_connectors(spark):
    page = spark.createDataFrame([('{"items": [{"full_name": "a/b", "description": "x", "created_at": "2020-01-02T03:04:05Z", "html_url": "u"}]}',)], "body string")
    r = D.normalize_json(page, "github").first()
    assert (r.externalId, r.publishedOn, r.sourceClass) == ("a/b", date(2020, 1, 2), "CODE_REPOSITORY")
    feed = spark.createDataFrame([("<feed><entry><id>1</id><title>A</title><summary>S</summary><published>2020-02-03T00:00:00Z</published></entry></feed>",)], "body string")
    r = D.normalize_feed(feed, "arxiv", "PREPRINT").first()
    assert (r.externalId, r.title, r.abstractText, r.publishedOn) == ("1", "A", "S", date(2020, 2, 3))
    m = spark.sql("SELECT map('b', array(1), 'a', array(0, 2)) AS m").select(D.inverted_abstract(F.col("m")).alias("t")).first().t
    assert m == "a b a"


def test_exports_are_safe_and_snapshots_are_written_once(spark, tmp_path):
    r = spark.createDataFrame([(1, "=cmd", 1.0)], "rank int, topic string, score double")
    D.export_csv(r, str(tmp_path / "csv"))
    assert "'=cmd" in (tmp_path / "csv").glob("*.csv").__next__().read_text()
    docs = spark.createDataFrame([("1", date(2020, 1, 1))], "documentId string, publishedOn date")
    D.write_snapshot(docs, str(tmp_path / "s"), "x")
    with pytest.raises(Exception, match="exist"):
        D.write_snapshot(docs, str(tmp_path / "s"), "x")


def test_streams(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 0, 0), 1.0), ("a", datetime(2024, 1, 1, 0, 0), 1.0), ("b", datetime(2024, 1, 1, 0, 20), 2.0)]
    spark.createDataFrame(rows, "id string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.read_files(spark, str(tmp_path / "in"), "id string, ts timestamp, value double")
    got = streams.run_to_table(streams.once(s, "id", "ts"), "seen", str(tmp_path / "c1")).collect()
    assert sorted(r.id for r in got) == ["a", "b"]
    w = streams.run_to_table(streams.tumbling(s, "ts", [], "10 minutes"), "wins", str(tmp_path / "c2"), "complete").collect()
    assert sorted((r.start.minute, r.events) for r in w) == [(0, 2), (20, 1)]


def test_token_bucket(spark):
    rows = [(i, 1, datetime(2024, 1, 1, 0, 0, i)) for i in range(4)] + [(9, 1, datetime(2024, 1, 1, 0, 1))]
    e = spark.createDataFrame(rows, "event_id long, user long, ts timestamp")
    got = {r.event_id: r.allowed for r in streams.token_bucket(e, "user", "ts", 0.1, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 9: True}
