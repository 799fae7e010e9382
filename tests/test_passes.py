"""Queries whose shuffles are dealt with in parts."""

from lumenlode.functions import store
from lumenlode.operators import terms
from lumenlode.plans import queries as plans

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    assert rows(a) == rows(b)


def shuffled(monkeypatch):
    """The rows of each table that ``in_passes`` gets to see, by pass."""
    seen, stash = [], store.stash

    def noted(df, label):
        out = stash(df, label)
        seen.append((label, out.count()))
        return out

    monkeypatch.setattr(store, "stash", noted)
    return seen


def test_indicators_are_the_same_in_passes_and_leave_no_mentions_to_shuffle(spark, monkeypatch):
    m = plans.mentions(spark, SF)
    seen = shuffled(monkeypatch)
    several = plans._indicators(m, 3)
    parts = [n for label, n in seen if label == "profiles"]
    assert len(parts) == 3 and sum(parts) == m.select("topic").distinct().count() and max(parts) < sum(parts)
    assert "lineitem" not in several._jdf.queryExecution().toString()  # what is returned reads what was written
    same(several, plans._indicators(m, 1))


def test_token_statistics_are_the_same_in_passes(spark):
    s = terms.sentences(spark.read.parquet(f"{SF}/documents.parquet"))
    same(terms.token_statistics(s, 3), terms.token_statistics(s))


def test_tokens_are_numbered_where_documents_repeat_and_sentences_are_missing(spark):
    rows = [(7, 0, ["A", "b"]), (7, 0, ["A", "b"]), (7, 3, ["b", "b"]), (9, 1, ["A"]), (2, 5, ["c"])]
    got = {r.token: r for r in terms.token_statistics(spark.createDataFrame(rows, "doc long, nth int, w array<string>")).collect()}
    # sentences in order: 2/5 is 0, 7/0 twice 1 and 2, 7/3 is 3, 9/1 is 4
    assert {t: (r.freq, r.sentences, r.middle) for t, r in got.items()} == {"a": (3, 3, 2.0), "b": (4, 3, 2.0), "c": (1, 1, 0.0)}
    assert (got["b"].lefts, got["b"].rights, got["a"].lefts, got["a"].rights, got["a"].upper, got["a"].capitalised) == (3, 2, 1, 2, 0, 3)


def test_rows_of_tokens_are_shuffled_once_for_their_middles(spark):
    s = terms.sentences(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = s.selectExpr("explode(w) as token", "0 as range", "doc", "nth").where("doc is not null")
    df = terms._middles(rows)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("REPARTITION_BY_COL") <= 2


def test_candidates_are_the_same_in_passes_and_shuffled_without_documents(spark, monkeypatch):
    rows = [(1, "Bill of Materials for the red pump. GPU red pump, red pump red."), (1, "Bill of materials. Red pump."), (2, "GPU red pump red pump. of pump"), (None, "GPU blue."), (None, "blue gpu"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, stash = [], terms.stash
    monkeypatch.setattr(terms, "stash", lambda df, label: seen.append(df._jdf.queryExecution().executedPlan().toString()) or stash(df, label))
    several = terms.candidates_in_passes(docs, 3)
    once = terms.candidates(terms.postings(terms.ngrams(docs)))
    same(several, once)
    got = {r.term: (r.df, r.tf, r.upper) for r in several.collect()}
    assert got["red pump"] == (2, 6, 0) and got["gpu"] == (3, 4, 3) and "bill of materials" not in got and "blue" not in got
    assert len(seen) == 3 and all(p.count("Exchange hashpartitioning(term") == p.count("Exchange") == 1 for p in seen)


def test_terms_of_a_large_corpus_have_the_same_values(spark, monkeypatch):
    small = {name: plans.QUERIES[name](spark, SF).toPandas() for name in ("c_value", "termhood")}
    monkeypatch.setattr(plans, "LETTERS", 0)
    for name, want in small.items():
        got = plans.QUERIES[name](spark, SF)
        assert not got._jdf.queryExecution().toString().count("documents.parquet")  # what is returned reads what was written
        same(got, spark.createDataFrame(want))


def test_c_values_are_the_same_in_passes(spark):
    docs = spark.createDataFrame([(i, "red green blue cyan. red green red. blue.") for i in range(3)], "doc_id long, text string")
    cand = terms.candidates(terms.postings(terms.ngrams(docs)))
    same(terms.c_value(cand, 3), terms.c_value(cand))
