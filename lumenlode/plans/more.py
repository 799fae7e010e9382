"""More queries over the driver's tables, and the same in SQL: corpora, names, topics, evidence, views, answers of sources, messages.

As in ``queries``, columns of the tables stand in for what the operators take.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem_english
from ..operators import corpus, evidence, model, names, scoring, selection, terms, topics, vectors, views
from ..sources import documents, signals
from ..streaming import outbox
from .queries import _MEASURED, _PARTS, _TOKENS, _W, QUERIES, SQL, _normal_sql, _tokens_sql, indicators, query, rounded, table

_BEFORE = set(QUERIES)


def _stem_sql(x: str) -> str:
    """``stem_english`` of a lower-case word."""
    one = (
        f"CASE WHEN regexp_matches({x}, 'sses$') THEN regexp_replace({x}, 'es$', '') WHEN regexp_matches({x}, '^..+ies$') THEN regexp_replace({x}, 'ies$', 'y') "
        f"WHEN regexp_matches({x}, '^.{{2,}}(ch|sh|x|z|s)es$') THEN regexp_replace({x}, 'es$', '') WHEN regexp_matches({x}, 's$') AND NOT regexp_matches({x}, '(ss|us|is|os)$') THEN regexp_replace({x}, 's$', '') ELSE {x} END"
    )
    twice = "|".join(c + c for c in "bcdfghjkmnpqrtvwx")
    cut = lambda e: f"regexp_replace(y, '{e}$', '')"
    plain = lambda e: f"CASE WHEN regexp_matches({cut(e)}, '({twice})$') THEN left({cut(e)}, length({cut(e)}) - 1) ELSE {cut(e)} END"
    fits = lambda e: f"regexp_matches(y, '^.{{4,}}{e}$') AND regexp_matches({cut(e)}, '[aeiouy]')"
    rest = f"CASE WHEN {fits('ing')} THEN {plain('ing')} WHEN {fits('ed')} THEN {plain('ed')} ELSE y END"
    return f"CASE WHEN length({x}) <= 3 THEN {x} ELSE list_transform([{one}], lambda y: {rest})[1] END"


@query(f"{_TOKENS} SELECT doc AS doc_id, count(*) AS sentences, sum(len(w))::BIGINT AS tokens FROM tk GROUP BY doc")
def sentences(spark, sf):
    s = terms.sentences(table(spark, sf, "documents"))
    return s.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("sentences"), F.sum(F.size("w")).cast("long").alias("tokens"))


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM documents)
    SELECT w AS word, {_stem_sql('w')} AS stem FROM t""")
def english_stems(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", stem_english(F.col("word")).alias("stem"))


@query("SELECT o_orderpriority AS corpus, min(o_orderdate)::DATE::VARCHAR AS first, max(o_orderdate)::DATE::VARCHAR AS last, count(*) AS documents FROM orders GROUP BY 1")
def corpus_window(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("d"))
    return o.groupBy(F.col("o_orderpriority").alias("corpus")).agg(F.min("d").cast("string").alias("first"), F.max("d").cast("string").alias("last"), F.count("*").alias("documents"))


def _snapshot(spark, sf):
    """Orders frozen by priority, in the order of their price."""
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("snapshot_id"), F.col("o_orderkey").alias("documentId"), F.struct(F.col("o_totalprice"), F.col("o_orderkey")).alias("ordinal"))


@query("SELECT o_orderkey AS \"documentId\", o_orderstatus AS status FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
def snapshot_page(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("documentId"), F.col("o_orderstatus").alias("status"))
    return corpus.snapshot_page(_snapshot(spark, sf), docs, "2-HIGH", 50, 25).select("documentId", "status")


@query("SELECT l_orderkey AS \"documentId\", count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '3-MEDIUM') GROUP BY 1")
def load_snapshot(spark, sf):
    docs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("documentId"))
    return corpus.load_snapshot(_snapshot(spark, sf), docs, "3-MEDIUM").groupBy("documentId").agg(F.count("*").alias("lines"))


@query("SELECT o_orderkey AS \"documentId\", coalesce(string_agg(l_partkey || ':' || l_returnflag, ' ' ORDER BY l_linenumber, l_partkey, l_returnflag), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_documents(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("documentId"))
    children = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("documentId"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))
    whole = corpus.nested(docs, children, "parts", ["part", "flag"])
    return whole.select("documentId", F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["part"].cast("string"), p["flag"])), " ").alias("parts"))


@query("SELECT p_partkey, CASE WHEN trim(e) <> '' THEN e ELSE p_name END AS title FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN '  ' WHEN 1 THEN p_type END AS e FROM part)")
def translated_titles(spark, sf):
    english = F.when(F.col("p_size") % 3 == 0, "  ").when(F.col("p_size") % 3 == 1, F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", corpus.translated(F.col("p_name"), english).alias("title"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1996-06-30' AND o_orderstatus IN ('F', 'P')")
def select_corpus(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("d"))
    return corpus.select_corpus(o, "1995-03-01", "1996-06-30", ["F", "P"], "d", "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderpriority AS snapshot, greatest(min(o_orderdate)::DATE, make_date(year(max(o_orderdate)) - 2, 1, 1))::VARCHAR AS first,
    round(least(1.0, greatest(0.05, (date_diff('day', make_date(year(max(o_orderdate)), 1, 1), max(o_orderdate)::DATE) + 1) / (date_diff('day', make_date(year(max(o_orderdate)), 1, 1), make_date(year(max(o_orderdate)), 12, 31)) + 1))), 6) AS elapsed
    FROM orders GROUP BY 1""")
def analysis_window(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("snapshot")).agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return rounded(o.select("snapshot", corpus.analysis_window(F.col("a"), F.col("b"), 3).cast("string").alias("first"), corpus.elapsed_share(F.col("b"), F.lit("2030-01-01").cast("date")).alias("elapsed")))


_PHRASES = ["that", "was that", "licensed under", "not"]
_HAY = f"""' ' || array_to_string(list_transform(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}-]*'),
    lambda x: length(x) >= 2 AND x NOT IN ({', '.join(f"'{w}'" for w in corpus.SEARCH_STOP)})), lambda x: left(x, 6)), ' ') || ' '"""


def _phrase_sql(p: list[str]) -> str:
    has = lambda x: f"contains(h, ' {x} ')"
    if len(p) <= 3:
        return has(" ".join(p))
    each = list(dict.fromkeys(p))
    return f"(({' + '.join(has(s) + '::INT' for s in each)}) >= {len(each) - 1} AND ({' OR '.join(has(f'{a} {b}') for a, b in zip(p, p[1:]))}))"


@query(f"""WITH d AS (SELECT doc_id, source, {_HAY} AS h FROM documents), k AS (SELECT *, source = 'src1' OR {' OR '.join(map(_phrase_sql, corpus.phrase_stems(_PHRASES)))} AS keep FROM d)
    SELECT doc_id FROM k WHERE keep OR (SELECT avg(keep::INT) FROM k) < 0.15""")
def relevant_documents(spark, sf):
    d = table(spark, sf, "documents")
    return corpus.relevant_documents(d, _PHRASES[0], _PHRASES[1:], "text", "source", ("src1",)).select("doc_id")


@query("""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), 'ё', 'е'), '(\\p{L}{2})is(ations|ation|ed|es|e|ing)([^\\p{L}\\p{N}]|$)', '\\1iz\\2\\3', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS h FROM documents)
    SELECT doc_id FROM d WHERE regexp_matches(h, ' free(?:s|es)? licen[\\p{L}\\p{N}]{0,6} ') OR regexp_matches(h, ' rights(?:s|es)? ') OR regexp_matches(h, ' righ[\\p{L}\\p{N}]{0,6} reserv[\\p{L}\\p{N}]{0,6} ')""")
def phrase_matches(spark, sf):
    text = F.col("text")
    hit = corpus.matches_phrase(text, "rights reserved") | corpus.matches_phrase(text, "free license")
    return table(spark, sf, "documents").where(hit).select("doc_id")


@query("""WITH u AS (SELECT l_partkey AS key, 0 AS part, l_orderkey * 10 + l_linenumber AS nth FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 1, l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_returnflag = 'A')
    SELECT key, arg_min(part, (part, nth))::BIGINT AS part, arg_min(nth, (part, nth)) AS nth FROM u GROUP BY key""")
def union_first_seen(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nth"), "l_returnflag")
    return rounded(corpus.union_first_seen([line.where(F.col("l_returnflag") == f).select("key", "nth") for f in ("R", "A")], "key").select("key", "part", "nth"))


@query("""WITH w AS (SELECT p_partkey AS term, p_size < 40 AS a, p_size < 30 AND p_retailprice > 950 AS b, p_size < 20 AND p_retailprice > 1000 AS c FROM part)
    SELECT term, CASE WHEN a AND b AND c THEN 'ranked' WHEN a AND b THEN 'clustered' WHEN a THEN 'admitted' END AS last, CASE WHEN NOT a THEN 'admitted' WHEN NOT b THEN 'clustered' WHEN NOT c THEN 'ranked' END AS lost FROM w""")
def stage_trace(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("term"), "p_size", "p_retailprice")
    steps = [("admitted", p.where("p_size < 40")), ("clustered", p.where("p_size < 30 and p_retailprice > 950")), ("ranked", p.where("p_size < 20 and p_retailprice > 1000"))]
    return corpus.trace(p, steps)


_SUBJECTS = "SELECT p_partkey AS doc, p_type AS label, p_brand AS code, (p_size % 4) / 3.0 AS score FROM part"
_TARGETS = ["promo", "economy"]


def _label_sql(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}]{{2,}}'), lambda w: {_stem_sql('w')}), ' ')"


@query(f"""WITH s AS ({_SUBJECTS}), l AS (SELECT doc, ' ' || {_label_sql('label')} || ' ' AS l FROM s WHERE score > 0)
    SELECT doc, ({' + '.join(f"contains(l, ' {t} ')::INT" for t in _TARGETS)}) / {len(_TARGETS)}.0 AS relevance FROM l""")
def subject_relevance(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.col("p_type").alias("label"), F.lit(None).cast("string").alias("code"), ((F.col("p_size") % 4) / 3.0).alias("score"))
    return rounded(topics.subject_relevance(p, _TARGETS))


@query(f"""WITH s AS ({_SUBJECTS}), l AS (SELECT doc, ' ' || {_label_sql('label')} || ' ' AS l FROM s WHERE score > 0)
    SELECT p_partkey AS doc, p_name FROM part WHERE p_partkey IN (SELECT doc FROM l WHERE {' OR '.join(f"contains(l, ' {t} ')" for t in _TARGETS)})""")
def documents_in_direction(spark, sf):
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), "p_name")
    return topics.documents_in_direction(docs, subject_relevance(spark, sf))


def _classified(spark, sf):
    """Orders as documents: finished ones are in the direction, pending ones are not, open ones are not classified."""
    o = table(spark, sf, "orders")
    return o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderstatus") == "F").cast("double").alias("relevance"))


_RELEVANCE = """rel AS (SELECT o_orderkey AS doc, (o_orderstatus = 'F')::INT AS x FROM orders WHERE o_orderstatus <> 'O'),
    topical AS (SELECT l_suppkey AS topic, coalesce(avg(x), 0) AS relevance FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) LEFT JOIN rel ON doc = l_orderkey GROUP BY 1)"""


def _topical(spark, sf):
    posts = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("topic"), F.col("l_orderkey").alias("doc"))
    none = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return topics.topic_relevance(posts, _classified(spark, sf), none, [1.0] * 64)


@query(f"WITH {_RELEVANCE} SELECT topic, round(relevance, 6) AS relevance FROM topical")
def topic_relevance(spark, sf):
    return rounded(_topical(spark, sf))


@query(f"""WITH {_RELEVANCE}, base AS (SELECT avg((o_orderstatus = 'F')::INT) AS p FROM orders), cut AS (SELECT least(0.5, (2 * p / (1 - p)) / (1 + 2 * p / (1 - p))) AS cut FROM base),
    r AS (SELECT topic, relevance, relevance >= cut AS inside, row_number() OVER (PARTITION BY relevance >= cut ORDER BY relevance DESC, topic) AS n FROM topical, cut)
    SELECT topic, round(relevance, 6) AS relevance FROM r WHERE inside OR n <= 60 - (SELECT count(*) FROM r WHERE inside)""")
def relevant_topics(spark, sf):
    base = F.broadcast(table(spark, sf, "orders").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("p")))  # one row
    t = _topical(spark, sf).crossJoin(base)
    return rounded(topics.relevant(t, topics.direction_cut(F.col("p"))).select("topic", "relevance"))


@query("""WITH p AS (SELECT o_custkey AS base, avg((o_orderstatus = 'F')::INT) AS p FROM orders GROUP BY 1)
    SELECT base, round(CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 0.5 ELSE least(0.5, (2 * p / (1 - p)) / (1 + 2 * p / (1 - p))) END, 6) AS cut FROM p""")
def direction_cut(spark, sf):
    p = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("base")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("p"))
    return rounded(p.select("base", topics.direction_cut(F.col("p")).alias("cut")))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    own AS (SELECT label, i, x FROM e WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
    docs AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
    u AS (SELECT label, i, 0.5 * own.x / sqrt(sum(own.x * own.x) OVER (PARTITION BY label)) + 0.5 * docs.x / sqrt(sum(docs.x * docs.x) OVER (PARTITION BY label)) AS x FROM own JOIN docs USING (label, i))
    SELECT label::VARCHAR AS term, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM u""")
def term_vectors(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("term", F.col("label").cast("string"))
    surfaces = e.groupBy("term").agg(F.min_by("embedding", "vec_id").alias("vector"))
    v = topics.term_vectors(surfaces, e.select("term", F.col("vec_id").alias("doc")), e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector")))
    return rounded(v.select("term", F.posexplode("vector").alias("i", "x")))


_BUDGET = 100


@query(f"""WITH t AS (SELECT p_partkey::VARCHAR AS term, 1 + p_size % 3 AS size, p_retailprice AS hood FROM part), r AS (SELECT *, row_number() OVER (ORDER BY hood DESC, term) AS n FROM t),
    strong AS (SELECT term FROM r WHERE n <= {_BUDGET // 2}),
    g AS (SELECT l_partkey::VARCHAR AS term, count(DISTINCT l_suppkey) AS groups, count(DISTINCT l_suppkey) FILTER (l_shipdate > TIMESTAMP '2000-01-01') AS fresh FROM lineitem GROUP BY 1),
    f AS (SELECT term FROM t JOIN g USING (term) WHERE size > 1 AND groups >= 2 AND term NOT IN (SELECT term FROM strong) ORDER BY fresh DESC, groups DESC, term LIMIT {_BUDGET - _BUDGET // 2}),
    b AS (SELECT term, 'termhood' AS part FROM strong UNION ALL SELECT term, 'fresh' FROM f)
    SELECT * FROM b UNION ALL SELECT term, 'rest' FROM (SELECT term, row_number() OVER (ORDER BY hood DESC, term) AS n FROM t WHERE term NOT IN (SELECT term FROM b)) WHERE n <= {_BUDGET} - (SELECT count(*) FROM b)""")
def clustering_budget(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("term"), (1 + F.col("p_size") % 3).alias("size"), F.col("p_retailprice").alias("termhood"))
    posts = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("term"), F.col("l_suppkey").alias("team"), (F.col("l_shipdate") > F.lit("2000-01-01").cast("timestamp")).alias("recent"))
    return topics.clustering_budget(t, posts, _BUDGET)


def _terms_of_parts(spark, sf):
    """Part names as terms with the vectors of the same number, in directions by label; their orders as documents."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("p_partkey"), F.col("label").alias("direction"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    docs = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_orderkey").alias("docs"), F.sum("l_linenumber").alias("tf"))
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("term"), F.size(F.split("p_name", " ")).alias("size"), (F.col("p_retailprice") / 2000).alias("termhood"))
    return e.join(p, "p_partkey").join(docs, "p_partkey").drop("p_partkey").dropDuplicates(["direction", "term"])


@query()
def synonym_merge(spark, sf):
    return topics.synonyms(_terms_of_parts(spark, sf), likeness=0.7)


@query()
def topic_build(spark, sf):
    return topics.topics(_terms_of_parts(spark, sf), distance=0.6, documents=table(spark, sf, "orders").count())


@query("""WITH c AS (SELECT l_partkey AS term, l_partkey % 7 AS canonical FROM (SELECT DISTINCT l_partkey FROM lineitem))
    SELECT canonical::VARCHAR AS term, l_orderkey AS doc, sum(l_linenumber)::BIGINT AS tf FROM lineitem JOIN c ON term = l_partkey GROUP BY ALL""")
def merged_postings(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("term"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("tf"))
    return topics.merged_postings(line, line.select("term", (F.col("term") % 7).cast("string").alias("canonical")).distinct())


@query("""SELECT lower(p_name) AS topic, 'corpus' AS origin FROM part WHERE p_size % 2 = 0 UNION ALL
    SELECT p_name, 'proposed' FROM part WHERE p_size % 3 = 0 AND lower(trim(p_name)) NOT IN (SELECT lower(p_name) FROM part WHERE p_size % 2 = 0)""")
def topics_with_proposals(spark, sf):
    p = table(spark, sf, "part")
    return topics.with_proposals(p.where("p_size % 2 = 0").select(F.lower("p_name").alias("topic")), p.where("p_size % 3 = 0").select(F.col("p_name").alias("topic")))


@query("""WITH v AS (SELECT l_suppkey AS term, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b, count(*) FILTER (l_returnflag = 'R') AS c, count(*) FILTER (l_linestatus = 'F') AS d FROM lineitem GROUP BY 1),
    mem AS (SELECT s_nationkey AS topic, term, unnest([a, b, c, d])::DOUBLE AS x, unnest([1, 2, 3, 4]) AS i FROM supplier JOIN v ON s_suppkey = term),
    cen AS (SELECT topic, i, avg(x) AS c FROM mem GROUP BY ALL),
    cs AS (SELECT topic, term, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cos FROM mem JOIN cen USING (topic, i) GROUP BY ALL),
    near AS (SELECT topic, avg(cos) AS c_emb, count(*) AS members FROM cs GROUP BY topic),
    one AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS t FROM lineitem), df AS (SELECT t, count(*) AS df FROM one GROUP BY t),
    pf AS (SELECT x.t AS a, y.t AS b, count(*) AS pair_df FROM one x JOIN one y ON x.k = y.k AND x.t < y.t GROUP BY ALL),
    m AS (SELECT DISTINCT topic, term FROM mem),
    cp AS (SELECT x.topic, x.term AS a, y.term AS b, coalesce(pair_df, 0) AS pair_df FROM m x JOIN m y ON x.topic = y.topic AND x.term < y.term LEFT JOIN pf ON pf.a = x.term AND pf.b = y.term),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY pair_df DESC, a, b) AS n FROM cp) WHERE n <= 10),
    val AS (SELECT topic, CASE WHEN pair_df = 0 THEN -1 ELSE greatest(-1.0, least(1.0, ln((pair_df / n) / ((da / n) * (db / n))) / -ln(pair_df / n))) END AS npmi FROM (
        SELECT best.topic, pair_df, x.df::DOUBLE AS da, y.df::DOUBLE AS db, (SELECT count(DISTINCT k) FROM one)::DOUBLE AS n FROM best JOIN df x ON x.t = a JOIN df y ON y.t = b)),
    mean AS (SELECT topic, avg(npmi) AS npmi FROM val GROUP BY topic)
    SELECT topic::BIGINT AS topic, members, round(c_emb, 6) AS c_emb, round(npmi, 6) AS npmi, round(0.6 * c_emb + 0.4 * CASE WHEN npmi IS NULL THEN 0.5 ELSE (npmi + 1) / 2 END, 6) AS coherence FROM near LEFT JOIN mean USING (topic)""")
def topic_coherence(spark, sf):
    line = table(spark, sf, "lineitem")
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1)).cast("double")
    v = line.groupBy(F.col("l_suppkey").alias("term")).agg(F.array(n("l_returnflag", "A"), n("l_returnflag", "N"), n("l_returnflag", "R"), n("l_linestatus", "F")).alias("vector"))
    members = v.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("term"), F.col("s_nationkey").alias("topic")), "term")
    return rounded(topics.coherence(members, line.select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("term"))))


@query(f"""{_PARTS}, p AS (SELECT topic, {', '.join(f'{-_W[k]!r} * ln(greatest({k}, 1e-9)) AS r_{k}' for k in _MEASURED)} FROM parts)
    SELECT topic, {', '.join(f"round(CASE WHEN {' + '.join(f'r_{x}' for x in _MEASURED)} > 0 THEN r_{k} / ({' + '.join(f'r_{x}' for x in _MEASURED)}) ELSE 0 END, 6) AS {k}" for k in _MEASURED)} FROM p""")
def shortfall_shares(spark, sf):
    t = indicators(spark, sf).withColumn("s", scoring.shortfall(_W))
    return rounded(t.select("topic", *[F.element_at("s", i + 1)["share"].alias(k) for i, k in enumerate(_W)]))


@query("""WITH d AS (SELECT l_suppkey AS topic, l_orderkey * 10 + l_linenumber AS doc, CASE l_returnflag WHEN 'N' THEN 'PATENT' ELSE 'NEWS' END AS class, l_discount > 0.05 AS corporate, l_quantity::INT AS citations, 'org' || l_partkey AS org FROM lineitem)
    SELECT topic, arg_min(doc, k) AS doc, arg_min(org, k) AS org, ['PATENT', 'CORPORATE_PUBLICATION', 'ACADEMIC_GROUP'][arg_min(tier, k) + 1] AS basis FROM (
        SELECT *, (tier, -citations, doc) AS k FROM (SELECT *, CASE WHEN class = 'PATENT' AND corporate THEN 0 WHEN corporate THEN 1 ELSE 2 END AS tier FROM d)) GROUP BY topic""")
def case_example(spark, sf):
    line = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("topic"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"), F.when(F.col("l_returnflag") == "N", "PATENT").otherwise("NEWS").alias("class"),
        (F.col("l_discount") > 0.05).alias("corporate"), F.col("l_quantity").cast("int").alias("citations"), F.concat(F.lit("org"), F.col("l_partkey")).alias("org"),
    )
    return evidence.case_example(line, "topic")


@query()
def narration(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), "text", F.lit("PREPRINT").alias("class"), F.col("n_chars").alias("citations"))
    stems = d.select("topic").distinct().withColumn("stems", F.array(*[F.lit(x) for x in ("the", "of", "and", "software")]))
    return evidence.narration(d, stems, problems={"licensed under": 1.0, "that the": 0.8, "is not": 0.7}, benefits={"released under": 0.9, "with the": 0.8, "of the": 0.7})  # phrases of the tables' invented prose


_HOSTS = {"press": ["wire.example.org"], "media": ["example.org"], "social": ["example.com"]}


@query("""WITH p AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS h, contains(lower(substr(html, 1, 400)), 'sponsored') AS promo,
        ['STANDARD', 'PREPRINT', 'CODE_REPOSITORY', 'NEWS'][page_id % 4 + 1] AS class, page_id % 3 = 0 AS owned FROM pages)
    SELECT level, independent, count(*) AS pages FROM (SELECT CASE WHEN regexp_matches(h, '(^|[.])wire[.]example[.]org$') THEN 'LOW' WHEN regexp_matches(h, '(^|[.])example[.]org$') THEN CASE WHEN promo THEN 'LOW' ELSE 'MEDIUM' END
            WHEN regexp_matches(h, '(^|[.])example[.]com$') THEN 'LOW' WHEN regexp_matches(h, '(^|[.])example[.]net$') THEN 'HIGH'
            WHEN class = 'STANDARD' THEN 'HIGH' WHEN class = 'PREPRINT' THEN 'MEDIUM' WHEN class = 'CODE_REPOSITORY' AND owned THEN 'MEDIUM' ELSE 'LOW' END AS level,
        CASE WHEN regexp_matches(h, '(^|[.])wire[.]example[.]org$') THEN false WHEN regexp_matches(h, '(^|[.])example[.]org$') THEN NOT promo WHEN regexp_matches(h, '(^|[.])example[.]com$') THEN false
            WHEN regexp_matches(h, '(^|[.])example[.]net$') THEN true WHEN class IN ('STANDARD', 'PREPRINT') THEN true WHEN class = 'CODE_REPOSITORY' THEN owned ELSE NOT promo END AS independent FROM p) GROUP BY ALL""")
def source_credibility(spark, sf):
    klass = F.element_at(F.array(*map(F.lit, ("STANDARD", "PREPRINT", "CODE_REPOSITORY", "NEWS"))), (F.col("page_id") % 4 + 1).cast("int"))
    v = evidence.credibility(T.host(F.col("url")), klass, F.substring("html", 1, 400), _HOSTS, [".example.net"], ["sponsored"], F.col("page_id") % 3 == 0)
    return table(spark, sf, "pages").select(v.alias("v")).groupBy("v.level", "v.independent").agg(F.count("*").alias("pages"))


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_retailprice DESC, p_name, p_partkey LIMIT 150")
def probe_budget(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.col("p_size").alias("df"), F.col("p_retailprice").alias("termhood"), F.struct("p_name", "p_partkey").alias("term"))
    return rounded(selection.probe_budget(p).select("p_partkey", "p_name", "p_size"))


@query("SELECT l_suppkey AS key, count(*) AS n FROM lineitem WHERE year(l_shipdate) <= 1998 GROUP BY 1 ORDER BY n DESC, key LIMIT 15")
def popular_baseline(spark, sf):
    return selection.popular(table(spark, sf, "lineitem").where(F.year("l_shipdate") <= 1998).select(F.col("l_suppkey").alias("key")), "key", 15)


@query("SELECT event_type, count(*) AS asked, max(ts) AS last_asked FROM events GROUP BY 1 ORDER BY asked DESC, last_asked DESC, event_type LIMIT 20")
def most_asked(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("asked"), F.max("ts").alias("last_asked")).orderBy(F.desc("asked"), F.desc("last_asked"), "event_type").limit(20)


@query("""WITH a AS (SELECT p_partkey, p_retailprice AS score, CASE WHEN p_size % 2 = 0 AND p_size % 4 = 3 THEN 0 WHEN p_size % 2 = 0 THEN 1 WHEN p_size % 4 >= 2 THEN 2 ELSE 3 END AS tier FROM part),
    e AS (SELECT tier, max(score) AS top, min(score) AS low, row_number() OVER (ORDER BY tier) AS n FROM a GROUP BY tier),
    s1 AS (SELECT n, tier, 0.0::DOUBLE AS shift, low AS floor FROM e WHERE n = 1),
    s2 AS (SELECT e.n, e.tier, CASE WHEN top >= floor THEN top - (floor - 0.01) ELSE 0 END AS shift, least(floor, greatest(0, low - CASE WHEN top >= floor THEN top - (floor - 0.01) ELSE 0 END)) AS floor FROM e, s1 WHERE e.n = 2),
    s3 AS (SELECT e.n, e.tier, CASE WHEN top >= floor THEN top - (floor - 0.01) ELSE 0 END AS shift, least(floor, greatest(0, low - CASE WHEN top >= floor THEN top - (floor - 0.01) ELSE 0 END)) AS floor FROM e, s2 WHERE e.n = 3),
    s AS (SELECT tier, shift FROM s1 UNION ALL SELECT tier, shift FROM s2 UNION ALL SELECT tier, shift FROM s3)
    SELECT p_partkey, tier::BIGINT AS tier, round(CASE WHEN shift > 0 THEN greatest(0, score - shift) ELSE score END, 6) AS score FROM a JOIN s USING (tier)""")
def tier_scores(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("score"), (F.col("p_size") % 2 == 0).alias("ok"), (F.col("p_size") % 4).alias("votes"))
    return rounded(selection.tier_scores(p.withColumn("tier", selection.tiers(p, "ok", "votes")), "tier", "score").select("p_partkey", "tier", "score"))


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, p_retailprice AS score, CASE WHEN p_size % 5 <> 0 THEN p_size END AS o, p_size % 7 = 0 AS gone, p_size % 14 = 0 AS ok FROM part),
    h AS (SELECT *, (SELECT count(o) FROM r WHERE rank <= 120) AS n FROM r WHERE rank <= 120)
    SELECT p_partkey, round(score + CASE WHEN o IS NULL THEN 0 ELSE 10 * (1 - o / n) END, 6) AS score FROM h WHERE NOT gone OR ok UNION ALL SELECT p_partkey, round(score, 6) FROM r WHERE rank > 120""")
def reranked(spark, sf):
    from .queries import _ranked_parts

    r = _ranked_parts(spark, sf).select("p_partkey", "rank", F.col("p_retailprice").alias("score"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("o"), (F.col("p_size") % 7 == 0).alias("gone"), (F.col("p_size") % 14 == 0).alias("ok"))
    return rounded(selection.rerank(r, "o", "gone", "ok", "score").select("p_partkey", "score"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(trim(p_name)) NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_size > 45)")
def external_maturity(spark, sf):
    p = table(spark, sf, "part")
    verdicts = p.select(F.col("p_name").alias("title"), F.when(F.col("p_size") > 45, "MAINSTREAM").otherwise("WEAK_SIGNAL").alias("verdict"))
    return selection.mature_titles(p.select("p_partkey", "p_name", F.col("p_name").alias("title")), verdicts).select("p_partkey", "p_name")


_STORED = """reports AS (SELECT o_orderkey AS report, o_custkey AS request, o_orderdate AS created FROM orders),
    requests AS (SELECT c_custkey AS request, c_mktsegment AS direction, CASE WHEN c_custkey % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, c_nationkey AS owner, c_custkey % 2 = 0 AS public FROM customer)"""


def _stored(spark, sf):
    reports = table(spark, sf, "orders").select(F.col("o_orderkey").alias("report"), F.col("o_custkey").alias("request"), F.col("o_orderdate").alias("created"))
    requests = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request"), F.col("c_mktsegment").alias("direction"), F.when(F.col("c_custkey") % 5 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
        F.col("c_nationkey").alias("owner"), (F.col("c_custkey") % 2 == 0).alias("public"),
    )
    return reports, requests


@query(f"WITH {_STORED} SELECT DISTINCT ON (direction) direction, report FROM reports JOIN requests USING (request) WHERE status = 'COMPLETED' ORDER BY direction, created DESC, report DESC")
def latest_report(spark, sf):
    return views.latest_report(*_stored(spark, sf)).select("direction", "report")


def _trends(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_suppkey").alias("topic"), F.concat(F.lit("part "), F.col("l_partkey")).alias("title"), F.col("l_linenumber").alias("rank"))


@query("SELECT DISTINCT ON (l_suppkey) l_suppkey AS topic, 'part ' || l_partkey AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey ORDER BY l_suppkey, o_orderdate DESC, o_orderkey DESC, 'part ' || l_partkey DESC")
def latest_titles(spark, sf):
    return views.latest_titles(_trends(spark, sf), _stored(spark, sf)[0])


@query(f"""WITH {_STORED}, t AS (SELECT l_suppkey AS topic, 'part ' || l_partkey AS title, l_linenumber AS rank, report, created, direction FROM lineitem JOIN reports ON l_orderkey = report JOIN requests USING (request)
        WHERE (public OR owner = 3) AND contains('part ' || l_partkey, '1') AND contains('part ' || l_partkey, '5')),
    o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY created DESC, report, title DESC, rank) AS n FROM t)
    SELECT topic, count(DISTINCT direction) AS directions, min(rank)::BIGINT AS best_rank FROM o GROUP BY topic""")
def stored_topic_search(spark, sf):
    reports, requests = _stored(spark, sf)
    return views.search_topics(_trends(spark, sf), reports, requests, ["1", "5"], ["title"], viewer=3).select("topic", "directions", "best_rank")


@query(f"WITH {_STORED} SELECT direction, count(*) AS versions, max(report) AS newest FROM reports JOIN requests USING (request) GROUP BY direction")
def reports_of_directions(spark, sf):
    reports, requests = _stored(spark, sf)
    return reports.join(requests, "request").groupBy("direction").agg(F.count("*").alias("versions"), F.max("report").alias("newest"))


@query("""SELECT o_custkey AS params, arg_max(o_orderkey, (o_orderstatus = 'F', o_orderdate, o_orderkey)) AS request, max(o_orderstatus = 'F') AS hit FROM orders
    WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01' OR o_orderstatus = 'O' GROUP BY 1""")
def cached_request(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "ANALYZING").otherwise("FAILED")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("params"), F.col("o_orderkey").alias("request"), status.alias("status"), F.col("o_orderdate").alias("finished"), F.col("o_orderdate").alias("submitted"))
    return views.cached_request(o, "params", "1997-01-01").select("params", "request", "hit")


@query("SELECT o_orderpriority AS priority, count(*) AS reports FROM orders WHERE (o_orderstatus = 'P' OR o_shippriority_list > 0) GROUP BY 1".replace("o_shippriority_list > 0", "o_custkey % 3 = 0"))
def partial_coverage(spark, sf):
    gone = F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("arxiv"))).otherwise(F.array().cast("array<string>"))
    o = table(spark, sf, "orders").where(views.partial_coverage(F.col("o_orderstatus") == "P", gone))
    return o.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("reports"))


@query("SELECT user_id, event_type, count(*) AS kept FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 99) GROUP BY ALL")
def delete_using(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "value")
    return views.without(e, e.where("value > 99"), ["user_id", "event_type"]).groupBy("user_id", "event_type").agg(F.count("*").alias("kept"))


_TIMELINE = "t AS (SELECT l_suppkey AS topic, year(l_shipdate) AS y, count(*) AS documents FROM lineitem GROUP BY ALL)"


def _timeline(spark, sf):
    period = F.concat(F.year("l_shipdate").cast("string"), F.lit("-Q"), F.quarter("l_shipdate").cast("string"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("topic"), period.alias("period")).agg(F.count("*").alias("documents"))


@query(f"WITH {_TIMELINE} SELECT topic, y AS year, documents, y >= 2000 AS partial FROM t")
def year_series(spark, sf):
    return rounded(views.year_series(_timeline(spark, sf), 2000))


@query(f"WITH {_TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY y DESC) AS n FROM t WHERE y < 2000) SELECT a.topic, round(a.documents / b.documents, 6) AS factor FROM r a JOIN r b ON a.topic = b.topic AND a.n = 1 AND b.n = 2")
def last_year_growth(spark, sf):
    return rounded(views.last_year_growth(views.year_series(_timeline(spark, sf), 2000)))


@query(f"""WITH {_TIMELINE}, f AS (SELECT s_suppkey AS topic, 1995 + s_suppkey % 4 AS first_year FROM supplier)
    SELECT topic, since, gap FROM (SELECT topic, min(y) AS since, any_value(first_year) - min(y) AS gap FROM t JOIN f USING (topic) GROUP BY topic) WHERE gap > 0""")
def earlier_mentions(spark, sf):
    first = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("topic"), (1995 + F.col("s_suppkey") % 4).alias("first_year"))
    return views.earlier_mentions(_timeline(spark, sf), first)


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size END AS best, p_size + p_partkey % 3 AS worst, p_retailprice / 2000 AS conf, p_size % 9 = 0 AS low, (p_partkey % 10) / 10 AS share, p_size % 11 = 0 AS noise FROM part),
    v AS (SELECT *, CASE WHEN best IS NULL THEN NULL WHEN best = worst THEN 'immovable' WHEN worst <= 25 THEN 'holds' ELSE 'slips' END AS verdict FROM p)
    SELECT p_partkey, verdict, CASE WHEN low OR conf < 0.4 THEN 'low' WHEN coalesce(verdict = 'slips', false) OR share < 0.5 OR noise THEN 'check' ELSE 'ok' END AS level FROM v""")
def reliability(spark, sf):
    size = F.col("p_size")
    verdict = views.stability_verdict(F.when(size % 6 == 0, None).otherwise(size), size + F.col("p_partkey") % 3, 25)
    level = views.reliability(F.col("p_retailprice") / 2000, size % 9 == 0, F.col("verdict"), (F.col("p_partkey") % 10) / 10, F.lit(False), size % 11 == 0)
    return table(spark, sf, "part").withColumn("verdict", verdict).select("p_partkey", "verdict", level.alias("level"))


@query(f"""{_PARTS}, l AS ({' UNION ALL '.join(f"SELECT topic, {i} AS position, '{k}' AS name, round({k}, 6) AS value FROM parts" for i, k in enumerate(_MEASURED))})
    SELECT topic, name, value, place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY value DESC, position) AS place FROM l WHERE value > 0) WHERE place <= 3""")
def key_predictors(spark, sf):
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("name"), (F.round(k, 6) + 0.0).alias("value"), F.lit(_W[k]).alias("weight")) for i, k in enumerate(_MEASURED)]))
    return views.key_predictors(indicators(spark, sf).select("topic", each.alias("i")).select("topic", "i.*"))


_YEARS = [1994, 1995, 1996, 1997, 1998]


def _grouped_answers(spark, sf):
    """A landed answer for each customer: orders by year, and by status."""
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    body = lambda key: o.groupBy("o_custkey", F.col(key).cast("string").alias("key")).agg(F.count("*").alias("count"))
    total = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("g"))
    group = lambda key: body(key).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("key", F.col("key").alias("key_display_name"), "count"))).alias("group_by"))
    meta = F.struct(F.struct(F.col("n").alias("count"), F.col("g").alias("groups_count")).alias("meta"), "group_by")
    pack = lambda key: group(key).join(total, "o_custkey").select("o_custkey", "n", F.to_json(F.struct(meta["meta"].alias("meta"), F.col("group_by"))).alias("body"))
    return pack("y"), pack("o_orderstatus")


@query(f"""WITH c AS (SELECT o_custkey, year(o_orderdate) AS y FROM orders), n AS (SELECT o_custkey, count(*) FILTER (y IN ({', '.join(map(str, _YEARS))})) AS total, count(*) AS all_time, count(*) FILTER (y IN (1997, 1998)) AS recent,
        {', '.join(f'count(*) FILTER (y = {y}) AS y{y}' for y in _YEARS)} FROM c GROUP BY 1)
    SELECT o_custkey, total, all_time, recent, {', '.join(f'y{y}' for y in _YEARS)}, round(CASE WHEN total > 0 THEN recent / total END, 6) AS share FROM n""")
def year_groups(spark, sf):
    g = _grouped_answers(spark, sf)[0].select("o_custkey", signals.year_groups(F.col("body"), _YEARS).alias("g"))
    by = [F.element_at("g.by_year", F.lit(str(y))).alias(f"y{y}") for y in _YEARS]
    return rounded(g.select("o_custkey", "g.total", "g.all_time", F.col("g.recent_two").alias("recent"), F.col("g.recent_two_year_share").alias("share"), *by))


@query("""WITH g AS (SELECT o_custkey, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_custkey, count(*) AS groups, count(*) >= 200 AS truncated, arg_min(k, (-n, k)) AS top, round(max(n) / sum(n), 6) AS share FROM g GROUP BY 1""")
def group_concentration(spark, sf):
    a = _grouped_answers(spark, sf)[1].select("o_custkey", signals.group_count(F.col("body")).alias("g"), signals.concentration(F.col("body"), F.col("n")).alias("c"))
    return rounded(a.select("o_custkey", "g.groups", "g.truncated", "c.top", "c.share"))


@query("SELECT user_id, count(*) FILTER (year(ts) = 2023) AS y2023, count(*) FILTER (year(ts) = 2024) AS y2024 FROM events GROUP BY 1")
def hits_by_year(spark, sf):
    hits = table(spark, sf, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.unix_timestamp("ts").alias("created_at_i"))).alias("hits"))).alias("body"))
    by = signals.hits_by_year(F.col("body"), [2023, 2024])
    return hits.select("user_id", F.element_at(by, F.lit("2023")).alias("y2023"), F.element_at(by, F.lit("2024")).alias("y2024"))


@query("SELECT o_custkey, sum(floor(o_totalprice))::BIGINT AS stars, count(*) FILTER (year(o_orderdate) = 1997) AS y1997 FROM orders GROUP BY 1")
def repository_pages(spark, sf):
    item = F.struct(F.floor("o_totalprice").alias("stargazers_count"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("body"))
    r = signals.repositories(F.col("body"), _YEARS)
    return o.select("o_custkey", r["stars"].alias("stars"), F.element_at(r["by_year"], F.lit("1997")).alias("y1997"))


@query("""SELECT page_id, page_id % 5 <> 0 AS "exists", CASE WHEN page_id % 5 <> 0 THEN length(html) END AS size_bytes, CASE WHEN page_id % 5 <> 0 THEN 19000 - page_id END AS age_days,
    '2021-01-01' AS first, '2021-12-31' AS last, (page_id % 7 + page_id % 3)::BIGINT AS views FROM pages""")
def wiki_articles(spark, sf):
    page = F.struct(F.col("url").alias("title"), (F.col("page_id") % 5 == 0).alias("missing"), F.length("html").alias("length"), F.array(F.struct(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("page_id").cast("int")), "yyyy-MM-dd'T'00:00:00'Z'").alias("timestamp"))).alias("revisions"))
    body = F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query")))
    views_ = F.to_json(F.struct(F.array(F.struct((F.col("page_id") % 7).alias("views")), F.struct((F.col("page_id") % 3).alias("views"))).alias("items")))
    today = F.date_add(F.lit("1970-01-01").cast("date"), 19000)
    a, w = signals.article(body, today), signals.pageview_window(today)
    return table(spark, sf, "pages").select("page_id", a["exists"].alias("exists"), a["size_bytes"].alias("size_bytes"), a["age_days"].cast("long").alias("age_days"), w["first"].cast("string").alias("first"), w["last"].cast("string").alias("last"), signals.pageviews(views_)["views"].alias("views"))


@query("""WITH a AS (SELECT o_custkey AS term, 'works' AS source, max(o_totalprice) AS peak, count(*) FILTER (year(o_orderdate) = 1997) AS y FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
    SELECT term, 'works.peak' AS feature, round(peak, 6) AS value FROM a UNION ALL SELECT term, 'works.works_last_year', y FROM a""")
def source_features(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("term")).agg(F.max("o_totalprice").alias("peak"), F.count(F.when(F.year("o_orderdate") == 1997, 1)).alias("y"), F.count(F.when(F.year("o_orderdate") == 1996, 1)).alias("x"))
    answers = o.select("term", F.lit("works").alias("source"), F.lit(True).alias("ok"), F.create_map(F.lit("peak"), F.col("peak")).alias("data"), F.create_map(F.lit("works_by_year"), F.create_map(F.lit("1996"), F.col("x"), F.lit("1997"), F.col("y"))).alias("series"))
    return rounded(signals.features(answers))


@query("SELECT DISTINCT o_custkey AS term FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def unasked_terms(spark, sf):
    cache = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("term"), F.lit("works").alias("source"), F.lit(1).alias("version"))
    return signals.missing(table(spark, sf, "orders").select(F.col("o_custkey").alias("term")), cache, "works", 1)


def _messages(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created"), F.when(F.col("event_type") == "click", F.col("ts")).alias("published"), F.col("ts").alias("due"), (F.col("event_id") % 12).cast("int").alias("attempts")
    )


@query("SELECT event_id AS id FROM events WHERE event_type <> 'click' AND ts <= TIMESTAMP '2024-01-15' AND event_id % 12 < 10 ORDER BY ts, event_id LIMIT 50")
def outbox_claim(spark, sf):
    return outbox.claim(_messages(spark, sf), "2024-01-15", 50).select("id")


@query("SELECT min(ts) AS oldest, count(*) AS waiting FROM events WHERE event_type <> 'click'")
def outbox_lag(spark, sf):
    return outbox.lag(_messages(spark, sf))


@query("""WITH m AS (SELECT event_id AS id, event_type = 'click' AS sent, event_id % 12 AS a, CASE WHEN event_id % 2 = 0 THEN event_id % 4 = 0 END AS ok FROM events)
    SELECT state, attempts, count(*) AS messages FROM (SELECT CASE WHEN sent OR coalesce(ok, false) THEN 'published' WHEN a + (ok IS NOT NULL)::INT >= 10 THEN 'dead' ELSE 'waiting' END AS state, (a + (ok IS NOT NULL)::INT)::BIGINT AS attempts FROM m) GROUP BY ALL""")
def outbox_outcomes(spark, sf):
    results = table(spark, sf, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("event_id") % 4 == 0).alias("ok"))
    out = outbox.outcomes(_messages(spark, sf), results, "2024-02-01")
    return out.groupBy("state", F.col("attempts").cast("long").alias("attempts")).agg(F.count("*").alias("messages"))


@query()
def model_training(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    d = model.held_out(d.withColumn("words", F.size(F.split("text", " "))), "doc_id", None, 0.25)
    made = model.train(d, {"n_chars": "log1p", "words": "log1p"}, "quality")
    rows = [(n, float(w), t, float(c), float(s)) for n, w, t, c, s in made["features"]]
    return spark.createDataFrame(rows, "feature string, weight double, transform string, centre double, scale double").withColumns({"bias": F.lit(made["bias"]), "auc": F.lit(made["auc"])})


@query("""WITH n AS (SELECT lower(trim(p_name)) AS k, min(trim(p_name)) AS name FROM part GROUP BY 1),
    k AS (SELECT DISTINCT lower(trim(p_name)) AS k FROM part WHERE p_size % 5 = 0), g AS (SELECT DISTINCT lower(trim(p_name)) AS k FROM part WHERE p_brand = 'Brand#11'),
    u AS (SELECT lower(trim(p_name)) AS k, count(DISTINCT url) AS pages FROM part JOIN pages ON page_id = p_partkey GROUP BY 1),
    a AS (SELECT lower(trim(p_name)) AS k, max(l_quantity > 45) AS active, max(l_discount > 0.08) AS shown FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
    SELECT name, CASE WHEN k.k IS NOT NULL THEN 'proposed_already_known' WHEN g.k IS NOT NULL THEN 'proposed_generic_name' WHEN coalesce(pages, 0) > 0 THEN 'accepted' WHEN NOT coalesce(active, false) THEN 'proposed_no_evidence'
        WHEN NOT coalesce(shown, false) THEN 'proposed_no_sources' ELSE 'accepted' END AS outcome, coalesce(pages, 0) AS pages
    FROM n LEFT JOIN k ON k.k = n.k LEFT JOIN g ON g.k = n.k LEFT JOIN u ON u.k = n.k LEFT JOIN a ON a.k = n.k""")
def proposals(spark, sf):
    p = table(spark, sf, "part")
    name = p.select(F.col("p_name").alias("name"), "p_partkey", "p_size", "p_brand")
    pages = name.join(table(spark, sf, "pages").select(F.col("page_id").alias("p_partkey"), "url"), "p_partkey")
    line = name.join(table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")
    activity = line.select("name", (F.col("l_quantity") > 45).cast("int").alias("works"), F.lit(0).alias("mentions"), (F.col("l_discount") > 0.08).cast("int").alias("shown"))
    return model.proposals(name, name.where("p_size % 5 = 0"), name.where("p_brand = 'Brand#11'"), pages, activity)


@query("""WITH f AS (SELECT regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS k, p_name AS name, p_brand || '/' || p_size AS url, p_partkey AS nth FROM part), u AS (SELECT k, url, min(nth) AS nth FROM f GROUP BY ALL)
    SELECT arg_min(f.name, f.nth) AS name, any_value(found) AS found FROM f JOIN (SELECT k, count(*) AS found FROM u GROUP BY k) USING (k) GROUP BY k ORDER BY found DESC, name LIMIT 40""")
def panel_merge(spark, sf):
    f = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("url"), F.col("p_partkey").alias("nth"))
    return names.merged_findings(f, 40).select("name", "found")


@query(f"""WITH s AS (SELECT p_name || ' no ' || p_partkey AS name, p_size AS evidence, CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 7 = 0 THEN false END AS approved, list_distinct(list_transform({_tokens_sql("p_name || ' no ' || p_partkey || ' ' || p_type")}, lambda x: left({_normal_sql('x')}, 6))) AS bag, p_partkey FROM part),
    q AS (SELECT n_nationkey AS query, list_distinct(list_transform({_tokens_sql("'medium ring'")}, lambda x: left(x, 6))) AS w FROM nation),
    h AS (SELECT query, name, approved, evidence, len(list_intersect(w, bag)) AS hits, len(w) // 2 + 1 AS need FROM q, s WHERE approved IS NULL OR approved)
    SELECT query, name, hits, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, coalesce(approved, false) DESC, evidence DESC, name) AS place FROM (SELECT DISTINCT query, name, approved, evidence, hits FROM h WHERE hits >= need)) WHERE place <= 5""")
def corpus_signals(spark, sf):
    s = table(spark, sf, "part").select(F.concat_ws(" no ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.lit("none").alias("direction"), F.col("p_type").alias("description"), F.col("p_size").alias("evidence"), F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 7 == 0, False).alias("approved")).distinct()
    q = table(spark, sf, "nation").select(F.col("n_nationkey").alias("query"), F.lit("medium ring").alias("text"))
    return rounded(names.signals_for(s, q, 5))


@query("""SELECT l_suppkey AS term, year(l_shipdate) AS period, count(DISTINCT l_orderkey) AS df, sum(tf)::BIGINT AS tf FROM (
        SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber AS tf, min(l_linestatus = 'O') OVER (PARTITION BY l_suppkey, year(l_shipdate), l_orderkey) AS fresh, l_linestatus FROM lineitem) WHERE fresh OR l_linestatus = 'F' GROUP BY ALL""")
def incremental_sums(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("term"), F.year("l_shipdate").alias("period"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("tf"), "l_linestatus")
    old, new = line.where("l_linestatus = 'F'"), line.where("l_linestatus = 'O'")
    stored = old.groupBy("term", "period").agg(F.countDistinct("doc").alias("df"), F.sum("tf").alias("tf"))
    return rounded(documents.added_stats(stored, old.select("term", "period", "doc").distinct(), new))


@query("""WITH s AS (SELECT l_suppkey AS t, l_orderkey AS d, arg_max(l_quantity, l_partkey * 10 + l_linenumber) AS q, arg_max(l_partkey, l_partkey * 10 + l_linenumber) AS p FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
    b AS (SELECT l_suppkey AS t, l_orderkey AS d, arg_max(l_quantity, l_partkey * 10 + l_linenumber) AS q, arg_max(l_partkey, l_partkey * 10 + l_linenumber) AS p FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
    SELECT coalesce(s.t, b.t) AS term_id, coalesce(s.d, b.d) AS document_id, round(coalesce(b.q, s.q), 6) AS occurrences, coalesce(s.p, b.p) AS part FROM s FULL JOIN b ON s.t = b.t AND s.d = b.d""")
def upserted_facts(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("term_id"), F.col("l_orderkey").alias("document_id"), F.col("l_quantity").alias("occurrences"), F.col("l_partkey").alias("part"), F.lit(0).alias("citation_count"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ingested_at"), "l_linestatus")
    rest = F.max_by(F.struct("occurrences", "part", "citation_count", "ingested_at"), "ingested_at").alias("f")
    stored = line.where("l_linestatus = 'F'").groupBy("term_id", "document_id").agg(rest).select("term_id", "document_id", "f.*")
    return rounded(documents.upserted(stored, line.where("l_linestatus = 'O'").drop("l_linestatus")).select("term_id", "document_id", "occurrences", "part"))


@query("SELECT o_orderpriority AS \"sourceId\", greatest(max(o_orderdate)::DATE, DATE '1998-07-02')::VARCHAR AS since FROM orders GROUP BY 1")
def incremental_window(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("sourceId")).agg(F.max("o_orderdate").cast("date").alias("watermark"))
    return documents.incremental_window(c, "1998-08-01").select("sourceId", F.col("since").cast("string").alias("since"))


_SUFFIXES = ["Inc", "Labs", "University", "Co.", "", "GmbH", "Institute of Technology Inc"]


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN true WHEN c_custkey % 13 = 0 THEN false ELSE [true, true, false, true, false, true, false][c_custkey % 7 + 1] END AS corporate,
    'customer#' || split_part(c_name, '#', 2) AS team FROM customer""")
def corporate_organizations(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("c_custkey") % 7 + 1).cast("int"))
    kind = F.when(F.col("c_custkey") % 11 == 0, "COMPANY").when(F.col("c_custkey") % 13 == 0, "UNIVERSITY")
    team = F.array_join(T.author_team(F.array("c_name")), ";")
    return table(spark, sf, "customer").select("c_custkey", T.is_corporate(F.concat_ws(" ", "c_name", suffix), kind).alias("corporate"), team.alias("team"))


def _content_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in ["a", "an", "the", "of", "for", "and", "in", "on", "with", "to", "as", "by", "via", "based"])
    one = "CASE WHEN regexp_matches(w, '^..+ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '^...+s$') AND NOT w LIKE '%ss' THEN regexp_replace(w, 's$', '') ELSE w END"
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: w NOT IN ({stop})), lambda w: {one}))"


@query(f"""WITH p AS (SELECT p_partkey, {_content_sql('p_name')} AS a, {_content_sql("p_name || ' of ' || p_type")} AS b, {_content_sql('p_type')} AS c, regexp_replace(p_name || ' (' || upper(left(p_type, 3)) || ')', '\\s*\\([0-9]?[A-Z][A-Z0-9]{{1,5}}s?\\)\\s*$', '') AS phrase FROM part)
    SELECT p_partkey, phrase, len(a) > 0 AND len(b) > 0 AND (list_has_all(b, a) OR len(list_intersect(a, b)) >= 2) AS inside, len(a) > 0 AND len(c) > 0 AND (list_has_all(c, a) OR (len(list_intersect(a, c)) >= 2 AND len(list_intersect(a, c)) >= len(list_distinct(list_concat(a, c))) * 2 / 3 - 1e-9)) AS alike FROM p""")
def lexical_matches(spark, sf):
    long = F.concat_ws(" ", "p_name", F.lit("of"), "p_type")
    return table(spark, sf, "part").select(
        "p_partkey", names.external_phrase(F.concat(F.col("p_name"), F.lit(" ("), F.upper(F.substring("p_type", 1, 3)), F.lit(")"))).alias("phrase"),
        names.lexical_match(F.col("p_name"), long).alias("inside"), names.lexical_match(F.col("p_name"), F.col("p_type")).alias("alike"),
    )


@query(f"""WITH e AS (SELECT DISTINCT p_type AS surface, {_label_sql('p_type')} AS key FROM part), k AS (SELECT DISTINCT ON (key) key, surface FROM e ORDER BY key, surface),
    q AS (SELECT p_partkey AS query, list_distinct(list_transform(regexp_extract_all(lower(p_type || ' ' || p_name), '[\\p{{L}}]{{2,}}'), lambda w: {_stem_sql('w')})) AS w FROM part),
    s AS (SELECT query, surface, round(len(list_intersect(w, list_distinct(string_split(key, ' ')))) / len(list_distinct(list_concat(w, string_split(key, ' ')))), 6) AS jaccard FROM q, k)
    SELECT query, surface, jaccard, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY jaccard DESC, surface) AS place FROM s WHERE jaccard > 0) WHERE place <= 3""")
def lexicon_suggestions(spark, sf):
    lines = table(spark, sf, "part").select(F.concat(F.col("p_type"), F.lit(" = label")).alias("value")).distinct()
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("query"), F.concat_ws(" ", "p_type", "p_name").alias("text"))
    return rounded(names.suggest(q, names.lexicon(lines)))


@query()
def tfidf_space(spark, sf):
    """Documents in the space of a sample, as a budgeted corpus: the benchmark's texts, and how near each is to the first."""
    rows = table(spark, sf, "benchmark").orderBy("item_id").limit(1500).collect()  # the budget of an analysis
    space = vectors.Lsa([r["text"] or "" for r in rows], 64)
    near = space.vectors @ space.vectors[0] if len(rows) else []
    return spark.createDataFrame([(int(r["item_id"]), round(float(x), 6)) for r, x in zip(rows, near)], "item_id long, similarity double")


NAMES = [n for n in QUERIES if n not in _BEFORE]
assert set(SQL) <= set(QUERIES)
