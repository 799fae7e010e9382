"""Operators without SQL, against values worked out by hand, brute force or other implementations."""

import itertools
import math
import random
import re
import uuid
import zipfile
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlode.functions import ordering, stem
from lumenlode.functions import text as T
from lumenlode.operators import corpus, evidence, model, names, selection, series, terms, topics, vectors, views
from lumenlode.sources import documents, signals
from lumenlode.streaming import events, outbox


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_tokens_and_sentences(spark):
    text = "Dr. Smith met J. R. Doe at 5 p.m. They use GPT-4, 5G and x-ray tools! См. рис. 3… It’s BERT-base."
    r = one(spark, s=T.sentences(F.lit(text)), w=T.words(F.lit("GPT-4 uses 3.5 T cells, x-ray 5G 日本 naïve it’s")))
    assert r.s == ["Dr. Smith met J. R. Doe at 5 p.m.", "They use GPT-4, 5G and x-ray tools!", "См. рис. 3…", "It’s BERT-base."]
    assert r.w == ["gpt-4", "uses", "3.5", "cells", "x-ray", "5g", "naïve", "it's"]


def test_bridged_terms_are_kept_and_cut_at_function_words(spark):
    d = spark.createDataFrame([(1, "A software bill of materials for the Internet of Things. Of course 3 nodes.")], "doc_id long, text string")
    got = {r.term for r in terms.ngrams(d).collect()}
    assert {"software bill of materials", "bill of materials", "internet of things", "course", "nodes"} <= got
    assert not any(t.startswith("of ") or t.endswith(" of") or " for " in t or "things course" in t for t in got)


def test_stems(spark):
    words = ["batteries", "networks", "processing", "glass", "used", "classes", "speed", "embedded", "bus", "stopping", "calling", "status", "boxes"]
    want = ["battery", "network", "process", "glass", "used", "class", "speed", "embed", "bus", "stop", "call", "status", "box"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate([*words, "обучение", "вычислений", "нейронные", "сетями", "скорость"])], "i int, w string")
    got = [r.s for r in df.orderBy("i").select(stem.stem(F.col("w")).alias("s")).collect()]
    assert got == [*want, "обучен", "вычислен", "нейрон", "сет", "скорост"]


def test_acronyms(spark):
    texts = ["We study large language models (LLMs) and the internet of things (IoT).", "Large language models (LLMs) grow.", "work on software bill of materials (SBOM)", "sodium-ion battery (SIB)", "produced in (Germany)"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.acronym: (r.long_form, r.support) for r in names.acronyms(d).collect()}
    assert got == {"llms": ("large language models", 2), "iot": ("internet of things", 1), "sbom": ("software bill of materials", 1), "sib": ("sodium-ion battery", 1)}
    t = spark.createDataFrame([("iot",), ("things iot",), ("internet of things iot",), ("secure iot",), ("edge",)], "term string")
    assert {r.term: r.key for r in names.folded(t, names.acronyms(d)).collect()} == {"iot": "internet of things", "secure iot": "secure iot", "edge": "edge"}
    assert one(spark, x=names.expanded_label(F.lit("IOT"), F.lit("internet of things")), y=names.expanded_label(F.lit("Edge"), F.lit("a b"))) == ("internet of things (IOT)", "Edge")


def test_names():
    assert names.siblings("mobile edge computing", "mobile cloud computing") and not names.siblings("mobile computing", "mobile cloud computing")
    assert not names.siblings("sdn network", "software defin network") and not names.siblings("edge", "edge computing")
    near = lambda a, b: names.near_duplicate(names.concept(a), names.concept(b))
    assert near("vision-language-action models", "Vision Language Action (VLA)") and near("tokenised deposits", "tokenized deposit") and near("VLA", "vision language action")
    assert not near("fog computing", "quantum annealing")


def test_matching_names_with_texts(spark):
    r = one(
        spark,
        phrase=names.name_supported(F.lit("neuromorphic chip"), F.lit("New neuromorphic chips are here")),
        words=names.name_supported(F.lit("battery factory"), F.lit("A factory for new batteries")),
        no=names.name_supported(F.lit("fog computing"), F.lit("edge computing")),
        named=names.on_topic(F.lit("On-device use of large language models"), F.lit("On-Device LLM")),
        off=names.on_topic(F.lit("A deal between two companies"), F.lit("On-Device LLM")),
        unknown=names.on_topic(F.lit("深度学习模型"), F.lit("LLM")),
        outside=names.external_phrase(F.lit("speculative decoding (SD)")),
    )
    assert tuple(r) == (True, True, False, True, False, None, "speculative decoding")


def test_lexicon(spark):
    lines = spark.createDataFrame([("# comment",), ("quantum computing = quantum algorithm | ~quant-ph",), ("no entry",), ("edge computing = fog",)], "value string")
    entries = names.lexicon(lines)
    assert {r.key: (r.labels, r.searched) for r in entries.collect()}["quantum comput"] == (["quant-ph", "quantum algorithm"], ["quantum algorithm"])
    q = spark.createDataFrame([(1, "news on quantum computing"), (2, "quantum computers")], "query int, text string")
    assert {r.query: r.labels for r in names.expand(q, entries).collect()} == {1: ["quant-ph", "quantum algorithm"]}
    assert [r.surface for r in names.suggest(q.where("query = 2"), entries).collect()] == ["quantum computing"]
    with pytest.raises(Exception, match="too long"):
        names.lexicon(spark.createDataFrame([("a1 b2 c3 d4 e5 = x",)], "value string")).collect()


def test_ranks_and_medians_equal_sorting(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([0.0, 1.0, rng.random()]), rng.randrange(20), rng.randrange(30_000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, x double, k int, v long")
    want = {r[0]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r.i: r["rank"] for r in ordering.ranked_by(df, "x", [F.desc("x"), F.asc("i")], descending=True).collect()} == want
    total, before = 0, {}
    for i, x, k, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        before[i] = total
        total += k
    assert {r.i: r.s for r in ordering.running_total(df, "x", [F.col("x"), F.col("i")], "k", "s").collect()} == before
    for width in (16, 4096):
        got = {r.k: r["median"] for r in ordering.middle(df, "k", "v", width).collect()}
        assert got == {k: np.median([r[3] for r in rows if r[2] == k]) for k in {r[2] for r in rows}}


def plain_linkage(v, threshold):
    """Average linkage as it is defined: again and again the two clusters with the least mean distance."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[i] for i in range(len(v))]
    while len(groups) > 1:
        best = min((round(float(np.mean([d[a, b] for a in x for b in y])), 9), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2))
        if best[0] > threshold:
            break
        _, i, j = best
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("threshold", [0.1, 0.4, 0.8, 1.0])
def test_average_linkage_equals_its_definition(threshold):
    v = np.random.default_rng(int(threshold * 10)).standard_normal((40, 3))
    labels = vectors.average_linkage(v, threshold)
    assert {frozenset(np.flatnonzero(np.array(labels) == k).tolist()) for k in set(labels)} == plain_linkage(v, threshold)
    assert all(k <= i for i, k in enumerate(labels)) and vectors.average_linkage(np.zeros((0, 3)), 0.5) == []


def test_lsa_places_queries_beside_their_texts():
    texts = ["edge computing at the network edge", "cloud computing in data centres", "solid state battery cells", "battery cathode materials"]
    space = vectors.Lsa(texts, 3)
    assert np.allclose(np.linalg.norm(space.vectors, axis=1), 1) and np.allclose(space.embed(texts), space.vectors, atol=1e-6)
    near = space.embed(["battery materials"]) @ space.vectors.T
    assert near[0].argmax() == 3 and vectors.Lsa([], 4).vectors.shape == (0, 0)


def terms_table(spark, rows):
    return spark.createDataFrame([("d", t, len(t.split()), h, tf, [float(x) for x in v], docs) for t, h, tf, v, docs in rows], "direction string, term string, size int, termhood double, tf long, vector array<double>, docs array<long>")


def test_synonyms_do_not_join_nested_names_or_siblings(spark):
    v = [1, 0]
    rows = [("language model", 0.6, 5, v, [1]), ("large language model", 0.9, 5, v, [1]), ("llm", 0.5, 5, v, [2]), ("edge computing", 0.5, 5, v, [3]), ("fog computing", 0.4, 5, v, [3]), ("battery", 0.4, 5, [0, 1], [4])]
    got = {r.term: r.canonical for r in topics.synonyms(terms_table(spark, rows)).collect()}
    assert got["language model"] != got["large language model"] and got["edge computing"] != got["fog computing"] and got["battery"] == "battery"
    assert len(set(got.values())) < len(got)  # "llm" joins one of them


def test_topics_drop_heads_and_keep_technologies_apart(spark):
    wide = list(range(100))
    rows = [
        ("computing", 0.9, 200, [1, 0.01], wide),
        ("fog computing", 0.8, 20, [1, 0.02], wide[:10]),
        ("mobile edge computing", 0.7, 20, [1, 0.03], wide[20:32]),
        ("edge computing", 0.6, 14, [1, 0.03], wide[20:32]),
        ("solid state battery", 0.5, 9, [0, 1], [200, 201]),
    ]
    got = {r.term: (r.topic, r.role) for r in topics.topics(terms_table(spark, rows), documents=300).collect()}
    assert got["computing"] == (None, "head")
    assert got["fog computing"] == ("fog computing", "label")
    assert got["edge computing"][0] == got["mobile edge computing"][0] == "mobile edge computing"  # the full form names it
    assert got["solid state battery"] == ("solid state battery", "label")


def test_novelty_is_nothing_without_a_credible_year(spark):
    rows = [("a", "d1", 2018, "o1"), ("a", "d2", 2020, "o2"), ("b", "d3", 2019, "o1"), ("b", "d4", 2020, "o1"), ("c", "d5", 2021, None)]
    m = spark.createDataFrame([(*r, "P", "v", 1) for r in rows], "topic string, doc string, period int, org string, source_class string, venue string, tf int")
    got = {r.topic: (r.first_year, r.novelty) for r in series.novelty(m, 2021).collect()}
    assert got["a"] == (2020, pytest.approx(math.exp(-1 / 3))) and got["b"] == (None, 0.0) and got["c"] == (None, 0.0)


def test_training_equals_newtons_method(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(1, 1, (400, 2))
    y = (np.log1p(x[:, 0]) - 0.5 * np.log1p(x[:, 1]) + rng.normal(0, 0.7, 400) > 0.6).astype(int)
    rows = [(i, float(a), float(b) if i % 9 else None, 5.0, int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = model.held_out(spark.createDataFrame(rows, "id int, a double, b double, flat double, y int"), "id", None, 0.25)
    made = model.train(df, {"a": "log1p", "b": "log1p", "flat": "identity"}, "y")
    part = [r for r in df.collect() if not r.test]
    raw = np.array([[np.log1p(r.a), np.nan if r.b is None else np.log1p(r.b)] for r in part])
    z = np.nan_to_num((raw - np.nanmean(raw, axis=0)) / np.nanstd(raw, axis=0))
    t = np.array([r.y for r in part])
    w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum())))
    design, beta = np.c_[np.ones(len(t)), z], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        penalty = np.diag([0.0, 1.0, 1.0])
        beta -= np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]) + penalty, design.T @ (w * (p - t)) + penalty @ beta)
    weights = {f[0]: f[1] for f in made["features"]}
    assert made["bias"] == pytest.approx(beta[0], abs=1e-3) and [weights["a"], weights["b"]] == pytest.approx(beta[1:].tolist(), abs=1e-3)
    assert weights["flat"] == 0 and made["auc"] > 0.7


def test_blended_scores_and_contributions(spark):
    f = [("x", 2.0, "log1p", 0.0, 1.0), ("gone", 3.0, "identity", 0.0, 1.0)]
    r = one(
        spark,
        b=model.blended(F.lit(40.0), F.lit(60.0), F.lit(2), F.lit(3)),
        most=model.blended(F.lit(100.0), F.lit(100.0), F.lit(9), F.lit(999)),
        c=F.transform(F.array(F.lit(1)), lambda _: F.lit(0)),
        bonus=selection.rerank_bonus(F.lit(1), F.lit(4)),
    )
    assert r.b == pytest.approx(0.5 * 40 + 0.5 * 60 + 12 + 6) and r.most == 126 and r.bonus == 7.5
    x = spark.createDataFrame([(math.e - 1, None)], "x double, gone double").select(model.contributions(f).alias("c"), model.linear(f, 0.0, "identity").alias("s")).first()
    assert [tuple(p) for p in x.c] == [("x", pytest.approx(2.0)), ("gone", None)] and x.s == pytest.approx(2.0)


def test_head_screen_refills_from_mature_rows(spark):
    rows = [(i, i % 3 == 0 if i != 4 else None, i in (2, 5)) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "rank int, ok boolean, mature boolean")
    assert sorted(r["rank"] for r in selection.head_screen(df, "ok", 5, 3, "mature").collect()) == [2, 3, 4, 6, 9]
    assert sorted(r["rank"] for r in selection.head_screen(df, "ok", 2, 3).collect()) == [3, 4, 6]


def test_narration_quotes_the_strongest_sentences(spark):
    text = "However this is hard to say about anything. Edge nodes suffer from very high power draw in the field. Edge nodes are nice and small and cheap. The new edge node reduces power by orders of magnitude."
    d = spark.createDataFrame([("t", 1, text, "PREPRINT", 10)], "topic string, doc long, text string, class string, citations int")
    s = spark.createDataFrame([("t", ["edge", "node"])], "topic string, stems array<string>")
    got = {r.kind: (r.sentence, r.mark) for r in evidence.narration(d, s).collect()}
    assert got["problem"] == ("Edge nodes suffer from very high power draw in the field.", "suffer from")
    assert got["benefit"][1] == "orders of magnitude"


def test_message_ids_are_uuids_of_their_parts(spark):
    got = one(spark, x=signals.message_id(F.lit("run"), F.lit("7"), F.lit("é"))).x
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "run|7|é"))


def test_answers_of_sources(spark):
    body = F.lit('{"meta": {"count": 9}, "group_by": [{"key": "2020", "count": 3}, {"key": "2022", "count": 1}, {"key": "1999", "count": 5}]}')
    r = one(spark, g=signals.year_groups(body, [2020, 2021, 2022]), none=signals.year_groups(F.lit("{}"), [2020]), total=signals.total_results(F.lit("<feed><opensearch:totalResults>12</opensearch:totalResults></feed>")))
    assert (r.g.by_year, r.g.total, r.g.all_time, r.g.recent_two, r.g.recent_two_year_share) == ({"2020": 3, "2021": 0, "2022": 1}, 4, 9, 1, 0.25)
    assert (r.none.total, r.none.recent_two_year_share, r.total) == (0, None, 12)
    missing = one(spark, a=signals.article(F.lit('{"query": {"pages": [{"title": "X", "missing": true}]}}'), F.lit("2024-03-05").cast("date")), w=signals.pageview_window(F.lit("2024-01-15").cast("date")))
    assert (missing.a.exists, missing.a.size_bytes) == (False, None) and tuple(missing.w) == (date(2023, 1, 1), date(2023, 12, 31))
    with pytest.raises(Exception, match="totalResults"):
        one(spark, x=signals.total_results(F.lit("<feed/>")))


def test_cache_of_answers(spark, tmp_path):
    rows = [("a", "works", 1, datetime(2024, 1, 1), "old"), ("a", "works", 1, datetime(2024, 2, 1), "new"), ("b", "works", 0, datetime(2024, 1, 1), "x")]
    signals.remember(spark.createDataFrame(rows, "term string, source string, version int, fetched timestamp, body string"), str(tmp_path / "c"))
    cache = signals.recalled(spark, str(tmp_path / "c"))
    assert {(r.term, r.body) for r in cache.collect()} == {("a", "new"), ("b", "x")}
    assert [r.term for r in signals.missing(spark.createDataFrame([("a",), ("b",)], "term string"), cache, "works", 1).collect()] == ["b"]


def test_feeds_have_dates_and_entities(spark):
    feed = "<rss><item><guid>1</guid><title>A &amp; B &lt;i&gt;</title><description><![CDATA[x]]></description><pubDate>Tue, 3 Feb 2020 10:00:00 GMT</pubDate><link>http://a</link></item></rss>"
    r = documents.normalize_feed(spark.createDataFrame([(feed,)], "body string"), "rss", "NEWS").first()
    assert (r.title, r.publishedOn, r.url, r.abstractText) == ("A & B <i>", date(2020, 2, 3), "http://a", "x")
    page = '{"results": [{"id": "W1", "display_name": "T", "abstract_inverted_index": {"two": [1], "one": [0]}, "publication_date": "2021-05-06"}]}'
    r = documents.normalize_json(spark.createDataFrame([(page,)], "body string"), "openalex").first()
    assert (r.abstractText, r.publishedOn) == ("one two", date(2021, 5, 6))
    dates = ["2020-01-02T03:04:05Z", "20240131T000000Z", "31/12/2020", "12/31/2020", "Sat, 01 Feb 2020", "soon", None]
    got = [r.d for r in spark.createDataFrame(list(enumerate(dates)), "i int, x string").orderBy("i").select(documents.parsed_date(F.col("x")).alias("d")).collect()]
    assert got == [date(2020, 1, 2), date(2024, 1, 31), None, date(2020, 12, 31), date(2020, 2, 1), None, None]


def test_new_documents_keep_the_first_of_a_page(spark):
    rows = [("s", "1", "k1", 3), ("s", "1", "k2", 1), ("s", "2", "k2", 2), ("s", "3", "k9", 4), ("s", "4", "old", 5), ("s", None, "k7", 6)]
    page = spark.createDataFrame(rows, "sourceId string, externalId string, dedupKey string, nth int")
    stored = spark.createDataFrame([("s", "3", "z"), ("s", "8", "old")], "sourceId string, externalId string, dedupKey string")
    assert sorted((r.externalId or "", r.nth) for r in documents.new_documents(page, stored).collect()) == [("", 6), ("1", 1)]
    assert tuple(documents.batch_counts(page, stored).first()) == (6, 2, 4)


def test_mentions_have_a_last_word(spark, tmp_path):
    kind = "term_id long, document_id long, published_on date, ingested_at int, occurrences int, citation_count int"
    batch = lambda *rows: spark.createDataFrame([(t, d, date(2020, 1, 1), at, n, c) for t, d, at, n, c in rows], kind)
    documents.write_mentions(batch((1, 1, 1, 5, 0), (1, 2, 1, 7, 0)), str(tmp_path / "m"))
    documents.write_mentions(batch((1, 1, 2, 6, 3)), str(tmp_path / "m"))
    got = documents.read_mentions(spark, str(tmp_path / "m"))
    assert sorted((r.document_id, r.occurrences) for r in got.collect()) == [(1, 6), (2, 7)]


def test_reports_snapshots_and_web_pages(spark, tmp_path):
    r = spark.createDataFrame([(2, "b", 1.0, "EMERGING", [("T", "http://x")]), (1, "a", 2.0, "MATURING", [])], "rank int, topic string, score double, stage string, evidence array<struct<title:string,url:string>>")
    documents.save_report(r, str(tmp_path / "r"), "7")
    assert [x.topic for x in documents.load_report(spark, str(tmp_path / "r"), "7").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="exist"):
        documents.save_report(r, str(tmp_path / "r"), "7")
    text = documents.brief(r, "Report").first().markdown
    assert text.startswith("# Report\n\n## 1. a\nScore 2.00, maturing") and "- [T](http://x)" in text
    (tmp_path / "w.json").write_text('{"url": "http://www.a.org/x/", "text": "1", "date": "2020-01-02"}\n{"url": "http://a.org/x#y", "text": "2"}\n')
    pages = documents.read_web_corpus(spark, str(tmp_path / "w.json")).collect()
    assert [(p.canonical, p.text, p.day) for p in pages] == [("a.org/x", "1", date(2020, 1, 2))]


def test_workbooks(spark, tmp_path):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>term</t></si><si><t>la</t><t>bel</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    got = documents.read_xlsx(spark, str(tmp_path / "*.xlsx")).orderBy("row").collect()
    assert [r.cells for r in got] == [["term", None, "label"], ["x", "5"]]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: otherbot\nUser-agent: LumenBot\nDisallow: /*.pdf\nCrawl-delay: 2"
    rules = documents.robots_rules(spark.createDataFrame([("a.org", body)], "host string, body string"))
    urls = spark.createDataFrame([("http://a.org/private/x",), ("http://a.org/private/open/x",), ("http://a.org/y.pdf",), ("http://b.org/private",)], "url string")
    ask = lambda agent: [r.allowed for r in documents.allowed(urls, rules, agent).orderBy("url").collect()]
    assert ask("AnyBot/1.0 (+x)") == [True, False, True, True] and ask("LumenBot/2") == [True, True, False, True]
    assert {r.agent: r.delay for r in rules.where("delay is not null").collect()} == {"otherbot": 2.0, "lumenbot": 2.0}


def test_corpus_terms_and_windows(spark):
    assert documents.upstream_terms("квантовые вычисления", ["quantum computing"]) == ["quantum computing"]
    assert documents.upstream_terms("quantum", ["x"]) == ["quantum"] and documents.upstream_terms("*", ["x"]) == ["*"]
    assert corpus.phrase_stems(['solid state battery', '"a" OR Cells of the sun']) == [["solid", "state", "batter"], ["cells", "sun"]]
    r = one(
        spark, short=corpus.has_phrase(F.lit("Solid-state? no: solid state batteries!"), [["solid", "state", "batter"]]),
        long=corpus.has_phrase(F.lit("edge nodes run models offline"), [["edge", "nodes", "run", "large", "models"]]), gap=corpus.has_phrase(F.lit("edge xx nodes yy run zz large"), [["edge", "nodes", "run", "large"]]),
        word=corpus.matches_phrase(F.lit("Tokenisation of deposits"), "tokenization"), no=corpus.matches_phrase(F.lit("token ring"), "tokenization"),
        accepts=documents.accepts(F.lit("NEWS"), []), elapsed=corpus.elapsed_share(F.lit("2024-12-31").cast("date"), F.lit("2024-01-02").cast("date")),
    )
    assert tuple(r) == (True, True, False, True, False, True, 0.05)


def test_outbox_waits_longer_each_time_and_gives_up(spark):
    r = one(spark, w=F.array(*[outbox.backoff_seconds(F.lit(n)) for n in (1, 2, 3, 7, 20)]))
    assert r.w == [1.0, 2.0, 4.0, 60.0, 60.0]
    at = datetime(2024, 1, 1)
    m = spark.createDataFrame([(1, at, None, at, 0), (2, at, None, at, 9), (3, at, at, at, 1), (4, at, None, at, 0)], "id long, created timestamp, published timestamp, due timestamp, attempts int")
    done = spark.createDataFrame([(1, False), (2, False), (4, True)], "id long, ok boolean")
    got = {x.id: (x.state, x.attempts, x.due) for x in outbox.outcomes(m, done, "2024-01-01 01:00:00").collect()}
    assert got[1] == ("waiting", 1, datetime(2024, 1, 1, 1, 0, 1)) and got[2][:2] == ("dead", 10) and got[3][0] == got[4][0] == "published"
    good, bad = outbox.split_bad(spark.createDataFrame([("a", 1), ("b", None)], "raw string, parsed int"), "parsed", "raw")
    assert good.count() == 1 and [x.raw for x in bad.collect()] == ["b"]


def test_requests_move_as_the_table_allows(spark, tmp_path):
    moves = [("a", "COLLECTING", 1), ("a", "COMPLETED", 2), ("a", "ANALYZING", 3), ("b", "FAILED", 1), ("b", "COLLECTING", 2)]
    rows = [(k, to, datetime(2024, 1, 1, 0, at)) for k, to, at in moves]
    spark.createDataFrame(rows, "id string, to string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = events.read_files(spark, str(tmp_path / "in"), "id string, to string, at timestamp")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers would keep the stream alive
    got = events.run_to_table(events.saga(s, "id", "to", "at"), "sagas", str(tmp_path / "c"), "update").collect()
    assert {r.id: r.state for r in got} == {"a": "ANALYZING", "b": "FAILED"}
    q = spark.createDataFrame([(1, "COLLECTING", datetime(2024, 1, 1)), (2, "COMPLETED", datetime(2024, 1, 1)), (3, "PENDING", datetime(2025, 1, 1))], "id int, status string, deadline timestamp")
    assert [r.id for r in events.overdue(q, F.lit("2024-06-01").cast("timestamp")).collect()] == [1]


def test_views(spark):
    d = spark.createDataFrame([("t", 1)], "topic string, rank int")
    assert views.comparable(d, "v1", "v2").count() == 0 and views.comparable(d, "v1", "v1").count() == 1
    r = one(spark, a=views.stability_verdict(F.lit(2), F.lit(9), 8), b=views.stability_verdict(F.lit(2), F.lit(2), 8), c=views.stability_verdict(F.lit(None).cast("int"), F.lit(2), 8))
    assert tuple(r) == ("slips", "immovable", None)


def test_vectors_come_from_a_named_provider_only(monkeypatch):
    monkeypatch.delenv("EMBEDDING_PROVIDER", raising=False)
    assert signals.embedding() is None


def test_average_linkage_of_a_large_group(spark):
    """More than 5000 rows in one label, in groups of three around 1800 directions and with vectors of zeros."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1800, 32))
    v = np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape), 2 * base, np.zeros((3, 32))])
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v.tolist())], "label int, key long, v array<double>")
    got = {r.key: r.cluster for r in vectors.clusters(df, "label", "key", "v", 0.2).collect()}
    assert got == {i: i % 1800 if i < 5400 else i for i in range(len(v))}
    with pytest.raises(Exception, match="5000 allowed"):
        vectors.clusters(df, "label", "key", "v", 0.2, most=5000).collect()


def test_indicators_shuffle_the_mentions_once(spark):
    """Joins by topic, the greatest recent count and quantiles all read one profile, and a profile deals the mentions out once."""
    from lumenlode.plans import queries as plans

    for name in ("emergence_ranking", "lifecycle"):
        d = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        d.collect()
        plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        large = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x and "Exchange" in x]
        assert 1 <= len([x for x in large if "ReusedExchange" not in x]) <= 2, name  # the second has the mentions of no topic: none


def test_stages_move_only_what_they_read(spark):
    """Of the mentions lifecycle deals out topic, document, period, frequency and patents: no organisation, place, class or citations."""
    from lumenlode.plans import queries as plans

    plan = plans.lifecycle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    dealt, found = [plan], set()
    while dealt:
        p = dealt.pop()
        if p.getClass().getSimpleName() == "RepartitionByExpression" and "doc#" in p.output().mkString(","):
            found.add(re.sub(r"#\d+L?", "", p.output().mkString(",")))
        dealt += [p.children().apply(i) for i in range(p.children().size())]
    assert found == {"topic,doc,period,tf,patent"}


def test_profiles_keep_mentions_without_topic_or_place(spark):
    rows = [(None, 1, 2000, 7, "A", 1, 2), (5, 1, 2000, None, "A", None, 3), (5, 1, 2001, 7, "B", 1, 1), (5, None, 2001, 8, "B", 1, None)]
    m = spark.createDataFrame(rows, "topic long, doc long, period int, org long, source_class string, venue long, tf int")
    got = {r.topic: r for r in series.profile(m).collect()}
    assert {k: (r.documents, r.orgs, r.venues, sorted(r.classes)) for k, r in got.items()} == {None: (1, 1, 1, [1]), 5: (2, 2, 1, [1, 2])}
    assert [tuple(x) for x in got[5].doc_firsts] == [(2000, 1), (2001, 1)] and [tuple(x) for x in got[5].series] == [(2000, 1, 3), (2001, 2, 1)]
    top = series.weakness(series.filled(series.profile(m), series.span(m)), floor=0)
    assert {r.topic: r.recent for r in top.collect()} == {None: 1, 5: 3}


def test_c_values_count_the_postings_once(spark):
    docs = spark.createDataFrame([(i, "red green blue cyan. red green. blue.") for i in range(3)], "doc_id long, text string")
    d = terms.c_value(terms.candidates(terms.postings(terms.ngrams(docs))))
    got = {r.term: (r.containers, round(r.c_value, 6)) for r in d.collect()}
    assert got["red green"] == (2, 3.0) and got["red green blue cyan"] == (0, 6.0) and got["blue"][0] == 5
    plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    by_doc = [x for x in plan.splitlines() if "Exchange hashpartitioning(term" in x and ", doc#" in x]
    assert len([x for x in by_doc if "ReusedExchange" not in x]) == 1
