"""Queries over the driver's tables, one for each operator, and the same in SQL.

Parts stand in for topics, orders for documents, ship years for periods, suppliers for organisations,
their nations for venues and return flags for source classes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import store
from ..functions import text as T
from ..functions.numeric import cosine, out
from ..operators import evidence, model, reports, scoring, selection, series, terms, vectors
from ..streaming import events as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(out(F.col(c)) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    line, supplier = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    return line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).select(
        F.col("l_partkey").alias("topic"),
        F.col("l_orderkey").alias("doc"),
        F.year("l_shipdate").alias("period"),
        F.col("l_suppkey").alias("org"),
        F.col("l_returnflag").alias("source_class"),
        F.col("s_nationkey").alias("venue"),
        F.col("l_linenumber").alias("tf"),
        series.per_year(F.col("l_quantity"), F.year("l_shipdate"), 2001).alias("citations"),
        (F.col("l_linestatus") == "F").cast("double").alias("patent"),
        (F.col("l_discount") > 0.05).cast("double").alias("corporate"),
    )


M = """WITH m AS (
    SELECT l_partkey AS topic, l_orderkey AS doc, year(l_shipdate) AS period, l_suppkey AS org, l_returnflag AS source_class,
           s_nationkey AS venue, l_linenumber AS tf, l_quantity / greatest(1, 2001 - year(l_shipdate)) AS citations,
           (l_linestatus = 'F')::INT::DOUBLE AS patent, (l_discount > 0.05)::INT::DOUBLE AS corporate
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""
STATS = "stats AS (SELECT topic, period, count(DISTINCT doc) AS df, sum(tf)::BIGINT AS tf FROM m GROUP BY ALL)"
SERIES = f"""{M}, {STATS},
corpus AS (SELECT period, count(DISTINCT doc) AS n FROM m GROUP BY ALL),
ends AS (SELECT min(period) AS a, max(period) AS b FROM corpus),
spine AS (SELECT p AS period, p - a + 1 AS idx, b - a + 1 AS length FROM (SELECT a, b, unnest(range(a, b + 1)) AS p FROM ends)),
s AS (
    SELECT t.topic, spine.period, idx, length, coalesce(df, 0) AS df, coalesce(tf, 0) AS tf, coalesce(n, 0) AS n
    FROM (SELECT DISTINCT topic FROM m) t CROSS JOIN spine LEFT JOIN stats ON t.topic = stats.topic AND spine.period = stats.period
    LEFT JOIN corpus ON spine.period = corpus.period
)"""
CLAMP = "least(1.0, greatest(0.0, {}))"
FIT = f"""{SERIES}, xy AS (SELECT *, CASE WHEN df > 0 THEN ln(df + 1.0) END AS y, CASE WHEN df > 0 THEN idx::DOUBLE END AS x, floor(length / 2) AS half FROM s),
fit AS (
    SELECT topic,
        CASE WHEN var_pop(x) > 0 THEN round(regr_slope(y, x), 9) ELSE 0 END AS slope,
        CASE WHEN var_pop(y) > 1e-12 THEN regr_r2(y, x) ELSE 0 END AS r2,
        count(x) AS points,
        CASE WHEN var_pop(x) FILTER (idx <= half) > 0 THEN round(regr_slope(y, x) FILTER (idx <= half), 9) ELSE 0 END AS early,
        CASE WHEN var_pop(x) FILTER (idx > length - half) > 0 THEN round(regr_slope(y, x) FILTER (idx > length - half), 9) ELSE 0 END AS recent
    FROM xy GROUP BY topic
)"""
BURST = """rates AS (SELECT *, CASE WHEN n > 0 THEN df / n ELSE 0 END AS rate, greatest(1, floor(length / 2)) AS half FROM s),
base AS (
    SELECT topic, greatest(sum(CASE WHEN idx <= half THEN rate ELSE 0 END) / max(half), 1.0 / avg(n) FILTER (n > 0)) AS base FROM rates GROUP BY topic
),
bursts AS (
    SELECT topic, max(base) AS base, coalesce(sum(rate / base - 2) FILTER (rate >= 2 * base), 0) AS weight,
           min(period) FILTER (rate >= 2 * base) AS start, count(*) FILTER (rate >= 2 * base) AS periods
    FROM rates JOIN base USING (topic) GROUP BY topic
)"""
NOVELTY = """firsts AS (
    SELECT topic, min(period) AS first_year FROM (
        SELECT topic, period, sum(d) OVER w AS d, sum(o) OVER w AS o FROM (
            SELECT topic, period, sum(d) AS d, sum(o) AS o FROM (
                SELECT topic, min(period) AS period, 1 AS d, 0 AS o FROM m GROUP BY topic, doc
                UNION ALL SELECT topic, min(period), 0, 1 FROM m GROUP BY topic, org)
            GROUP BY topic, period)
        WINDOW w AS (PARTITION BY topic ORDER BY period))
    WHERE d >= 2 AND o >= 2 GROUP BY topic
),
novel AS (
    SELECT t.topic, first_year, CASE WHEN first_year IS NULL THEN 0.0 ELSE exp(-greatest(0, 2001 - first_year) / 3.0) END AS novelty
    FROM (SELECT DISTINCT topic FROM m) t LEFT JOIN firsts USING (topic)
)"""
WEAK = """recents AS (SELECT topic, sum(CASE WHEN idx > length - 2 THEN df ELSE 0 END)::BIGINT AS recent FROM s GROUP BY topic),
weak AS (
    SELECT topic, recent, least(1.0, greatest(0.0, 1 - ln(1 + recent) / ln(1 + (SELECT greatest(5, max(recent)) FROM recents)))) AS weakness FROM recents
)"""
DIFF = """classes AS (SELECT topic, source_class, count(DISTINCT doc) AS c FROM m GROUP BY ALL),
shares AS (SELECT topic, c / sum(c) OVER (PARTITION BY topic) AS p FROM classes),
entropy AS (SELECT topic, sum(-p * ln(p)) AS h FROM shares GROUP BY topic),
breadth AS (SELECT topic, count(DISTINCT org) AS orgs, count(DISTINCT venue) AS venues FROM m GROUP BY topic),
even AS (
    SELECT topic, orgs, venues, least(1.0, greatest(0.0, h / ln(k))) AS evenness
    FROM breadth JOIN entropy USING (topic) CROSS JOIN (SELECT count(DISTINCT source_class) AS k FROM m)
),
diff AS (
    SELECT *, least(1.0, greatest(0.0, 0.40 * evenness + 0.35 * least(1.0, ln(1 + orgs) / ln(51)) + 0.25 * least(1.0, ln(1 + venues) / ln(26)))) AS diffusion
    FROM even
)"""
IMPACT = """per_doc AS (SELECT topic, doc, max(citations) AS c, max(patent) AS p, max(corporate) AS i FROM m GROUP BY ALL),
imp AS (
    SELECT topic, avg(p) AS patent_share, count(c) > 0 OR avg(p) > 0 OR avg(i) > 0 AS measured,
           0.45 * least(1.0, ln(1 + avg(c)) / ln(11)) + 0.30 * least(1.0, avg(p) / 0.30) + 0.25 * least(1.0, avg(i) / 0.50) AS impact
    FROM per_doc GROUP BY topic
)"""
VOLUME = """volumes AS (SELECT topic, sum(df)::BIGINT AS v, sum(CASE WHEN idx > length - 2 THEN df ELSE 0 END)::BIGINT AS r FROM s GROUP BY topic),
corpus_stats AS (
    SELECT max(r) AS recent_max, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.6) AS q60, quantile_cont(v, 0.9) AS q90,
           (SELECT count(DISTINCT source_class) FROM m) AS classes FROM volumes
)"""


@query("SELECT p_brand AS topic, year(l_shipdate) AS period, count(DISTINCT l_orderkey) AS df, sum(l_linenumber)::BIGINT AS tf FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def term_period_stats(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic"))
    line = table(spark, sf, "lineitem").select("l_partkey", F.col("l_orderkey").alias("doc"), F.year("l_shipdate").alias("period"), F.col("l_linenumber").alias("tf"))
    return rounded(series.term_period_stats(line.join(part, "l_partkey")))


@query(f"{M} SELECT topic, period, source_class, count(DISTINCT doc) AS df, count(DISTINCT org) AS orgs, count(DISTINCT venue) AS venues, sum(tf)::BIGINT AS tf FROM m GROUP BY ALL")
def period_class_stats(spark, sf):
    return rounded(series.period_class_stats(mentions(spark, sf)))


@query(f"{M} SELECT period, count(DISTINCT doc) AS n FROM m GROUP BY ALL")
def corpus_per_period(spark, sf):
    return rounded(series.corpus_per_period(mentions(spark, sf)))


def _series(spark, sf):
    return series.topic_series(mentions(spark, sf))


@query(f"{SERIES} SELECT topic, period, idx, length, df, tf, n FROM s")
def topic_series(spark, sf):
    return rounded(_series(spark, sf))


@query(f"{FIT} SELECT topic, round(slope, 6) + 0.0 AS slope, round(r2, 6) AS r2, points, round(early, 6) + 0.0 AS early, round(recent, 6) + 0.0 AS recent, round(recent - early, 6) + 0.0 AS acceleration, round(least(1.0, greatest(0.0, slope / ln(3))), 6) AS growth FROM fit")
def growth_fit(spark, sf):
    return rounded(series.growth(_series(spark, sf)))


@query(f"{SERIES} SELECT topic, period, round(CASE WHEN n > 0 THEN tf / n ELSE 0 END * (1 - 0.05 * (length - idx)), 6) AS dov, round(CASE WHEN n > 0 THEN df / n ELSE 0 END * (1 - 0.05 * (length - idx)), 6) AS dod FROM s")
def visibility_and_diffusion(spark, sf):
    return rounded(series.visibility_and_diffusion(_series(spark, sf)))


@query(f"{SERIES} SELECT topic, round(avg(df / b - 1), 6) AS rate FROM (SELECT topic, df, lag(df) OVER (PARTITION BY topic ORDER BY idx) AS b FROM s) WHERE b > 0 GROUP BY topic")
def mean_increase_rate(spark, sf):
    return rounded(series.mean_increase_rate(_series(spark, sf)))


@query(f"{SERIES}, {BURST} SELECT topic, round(base, 6) AS base, round(weight, 6) AS weight, start, periods FROM bursts")
def burst_detection(spark, sf):
    return rounded(series.burst(_series(spark, sf)))


@query(f"{SERIES}, {VOLUME} SELECT recent_max, round(q25, 6) AS q25, round(q60, 6) AS q60, round(q90, 6) AS q90, classes FROM corpus_stats")
def corpus_stats(spark, sf):
    m = mentions(spark, sf)
    return rounded(series.corpus_stats(m, series.topic_series(m)))


@query(f"{M}, {NOVELTY} SELECT topic, first_year, round(novelty, 6) AS novelty FROM novel")
def novelty(spark, sf):
    return rounded(series.novelty(mentions(spark, sf), 2001))


@query(f"{SERIES}, {WEAK} SELECT topic, recent, round(weakness, 6) AS weakness FROM weak")
def weakness(spark, sf):
    return rounded(series.weakness(_series(spark, sf)))


@query(f"{M}, {DIFF} SELECT topic, orgs, venues, round(evenness, 6) AS evenness, round(diffusion, 6) AS diffusion FROM diff")
def diffusion(spark, sf):
    return rounded(series.diffusion(mentions(spark, sf)))


@query(f"{M}, {IMPACT} SELECT topic, round(patent_share, 6) AS patent_share, round(impact, 6) AS impact, measured FROM imp")
def impact(spark, sf):
    return rounded(series.impact(mentions(spark, sf)))


CONF = """held AS (SELECT topic, count(*) FILTER (df > 0) AS n, max(length) AS length FROM s GROUP BY topic),
topic_classes AS (SELECT topic, count(DISTINCT source_class) AS k, count(DISTINCT doc) AS d FROM m GROUP BY topic),
conf AS (
    SELECT topic, 0.35 * least(1.0, ln(1 + d) / ln(21)) + 0.25 * least(1.0, k / 3)
        + 0.20 * CASE WHEN n <= 2 THEN 0 ELSE least(1.0, greatest(0.0, 1 - (1 - r2) * (n - 1) / (n - 2))) END
        + 0.20 * least(1.0, n / least(length, 5)) AS confidence
    FROM held JOIN fit USING (topic) JOIN topic_classes USING (topic)
)"""


def _classes(m):
    return m.groupBy("topic").agg(F.countDistinct("source_class").alias("class_count"), F.countDistinct("doc").alias("documents"))


@query(f"{FIT}, {CONF} SELECT topic, round(confidence, 6) AS confidence, confidence < 0.4 AS low_evidence FROM conf")
def confidence(spark, sf):
    m = mentions(spark, sf)
    s = series.topic_series(m)
    return rounded(series.confidence(s, series.growth(s), _classes(m)))


STAGE = """staged AS (
    SELECT topic, v, CASE WHEN slope <= 0.2 OR (patent_share > 0.4 AND v >= q60) THEN 'MATURING'
        WHEN slope > 0.5 AND (weight > 0 OR v >= q60) THEN 'ACCELERATING'
        WHEN q25 <= v AND v < q60 THEN 'EMERGING' WHEN v < q25 AND slope > 0 THEN 'EMBRYONIC' ELSE 'EMERGING' END AS stage
    FROM fit JOIN imp USING (topic) JOIN bursts USING (topic) JOIN volumes USING (topic) CROSS JOIN corpus_stats
)"""


def _staged(m):
    p = series.profile(m, ("period", "doc"), ("patent",))
    s = series.filled(p, series.span(m))
    volume = s.groupBy("topic").agg(F.sum("df").alias("volume"))
    q = F.broadcast(series.corpus_stats(m, s).select("q25", "q60"))  # one row
    t = series.growth(s).join(p.select("topic", "patent_share"), "topic").join(series.burst(s), "topic").join(volume, "topic").crossJoin(q)
    return series.lifecycle(t.withColumn("bursting", F.col("weight") > 0))


@query(f"{FIT}, {BURST}, {IMPACT}, {VOLUME}, {STAGE} SELECT topic, v AS volume, stage FROM staged")
def lifecycle(spark, sf):
    return _staged(mentions(spark, sf)).select("topic", "volume", "stage")


_MEASURED = ["novelty", "growth", "diffusion", "weakness", "impact"]
_W = scoring.renormalised(scoring.WEIGHTS, _MEASURED)
_PARTS = f"""{FIT}, {BURST}, {NOVELTY}, {WEAK}, {DIFF}, {IMPACT},
parts AS (
    SELECT topic, novelty, least(1.0, greatest(0.0, slope / ln(3))) AS growth, diffusion, weakness, impact, weight AS burst_weight
    FROM novel JOIN fit USING (topic) JOIN diff USING (topic) JOIN weak USING (topic) JOIN imp USING (topic) JOIN bursts USING (topic)
)"""
_ZERO = f"least({', '.join(_MEASURED)}) <= 0"


def _geo_sql(w: dict[str, float]) -> str:
    return f"CASE WHEN {_ZERO} THEN 0 ELSE 100 * exp({' + '.join(f'{w[k]!r} * ln(CASE WHEN {k} > 0 THEN {k} ELSE 1 END)' for k in _MEASURED)}) END"


#: Mentions whose shuffle may lie on the disks at a time.
MENTIONS = 12_000_000


def _indicators(m: DataFrame, passes: int) -> DataFrame:
    """Five indicators and the burst weight of each topic, from one profile of the mentions.

    With several passes profiles are made of a part of the topics at a time, and each step is written, so that
    what it shuffled leaves the disks before the next.
    """
    classes, corpus, parts = m.agg(F.countDistinct("source_class").alias("k")), series.span(m), []  # one row each
    if passes > 1:
        classes, corpus = store.stash(classes, "classes"), store.stash(corpus, "corpus")
        store.release(m.sparkSession)

    def own(some: DataFrame, shared: bool) -> DataFrame:
        p = series.profile(some, shared=shared)
        return p.crossJoin(F.broadcast(classes)).select(
            "topic", "series", series.novelty_of(series.first_credible(p), 2001).alias("novelty"), series.diffusion_of(F.col("k"))[1].alias("diffusion"), series.impact_of()[0].alias("impact")
        )

    if passes > 1:
        parts = store.in_passes(m, "topic", passes, lambda some: own(some, False), "profiles")
        p = store.together(parts).repartition("topic")
    else:
        p = own(m, True)
    s = series.filled(p, corpus)
    t = p.drop("series").join(series.growth(s).select("topic", "growth"), "topic").join(series.weakness(s).select("topic", "weakness"), "topic")
    t = t.join(series.burst(s).select("topic", F.col("weight").alias("burst_weight")), "topic")
    if passes > 1:
        t = store.stash(t, "indicators")
        store.drop(classes, corpus, *parts)
        store.release(m.sparkSession)
    return t


def indicators(spark, sf):
    return _indicators(mentions(spark, sf), -(-table(spark, sf, "lineitem").count() // MENTIONS))


@query(f"""{_PARTS} SELECT topic, round({_geo_sql(_W)}, 6) AS geometric,
    round(CASE WHEN {_ZERO} THEN 0 ELSE 100 * ({' + '.join(f'{_W[k]!r} * {k}' for k in _MEASURED)}) END, 6) AS arithmetic,
    round(100 * least({', '.join(_MEASURED)}), 6) AS minimum FROM parts""")
def aggregators(spark, sf):
    t = indicators(spark, sf)
    return rounded(t.select("topic", scoring.geometric(_W).alias("geometric"), scoring.arithmetic(_W).alias("arithmetic"), scoring.minimum(_W).alias("minimum")))


@query(f"""{_PARTS} SELECT * FROM (
    SELECT row_number() OVER (ORDER BY round(score, 6) DESC, round(burst_weight, 6) DESC, round(novelty, 6) DESC, topic) AS rank, topic, round(score, 6) AS score,
           round(novelty, 6) AS novelty, round(growth, 6) AS growth, round(diffusion, 6) AS diffusion, round(weakness, 6) AS weakness, round(impact, 6) AS impact
    FROM (SELECT *, {_geo_sql(_W)} AS score FROM parts)) WHERE rank <= 15""")
def emergence_ranking(spark, sf):
    t = indicators(spark, sf).withColumn("score", scoring.geometric(_W))
    return rounded(scoring.top(t).select("rank", "topic", "score", *_MEASURED))


@query(f"""{_PARTS}, placed AS ({' UNION ALL '.join(f'SELECT topic, row_number() OVER (ORDER BY round({_geo_sql(w)}, 6) DESC, topic) AS place FROM parts' for w in scoring.scenarios(_W))})
    SELECT topic, min(place) AS best, max(place) AS worst FROM placed GROUP BY topic""")
def rank_stability(spark, sf):
    return scoring.stability(indicators(spark, sf), _W)


@query("""WITH one AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem), df AS (SELECT i, count(*) AS df FROM one GROUP BY i),
    pairs AS (SELECT a.i AS a, b.i AS b, count(*) AS pair_df FROM one a JOIN one b ON a.k = b.k AND a.i < b.i GROUP BY ALL HAVING count(*) >= 3),
    p AS (SELECT a, b, pair_df, x.df AS da, y.df AS db, (SELECT count(DISTINCT k) FROM one)::DOUBLE AS n FROM pairs JOIN df x ON a = x.i JOIN df y ON b = y.i)
    SELECT a, b, pair_df, round(ln((pair_df / n) / ((da / n) * (db / n))) / -ln(pair_df / n), 6) AS npmi FROM p""")
def npmi(spark, sf):
    return rounded(terms.npmi(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", 3))


def _quoted(x: str) -> str:
    return x.replace("'", "''")


_TOKEN = _quoted(T.TOKEN)
_BLANK = "[ \\t\\n\\x0B\\f\\r\\x{a0}]+"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_BRIDGE = ", ".join(f"'{w}'" for w in T.BRIDGING_WORDS)


def _sentences_sql(text: str) -> str:
    """The sentences of a text: abbreviations and initials are protected first, twice as they may follow each other."""
    known = "|".join(_quoted(re.escape(x)) for x in T.ABBREVIATIONS)
    out = text
    for pattern in (f"(^|[^\\p{{L}}\\p{{N}}])((?i:{known}))\\.{_BLANK}", f"(^|[^\\p{{L}}])(\\p{{Lu}})\\.{_BLANK}"):
        for _ in range(2):
            out = f"regexp_replace({out}, '{pattern}', '\\1\\2.' || chr(2), 'g')"
    cut = f"string_split(regexp_replace({out}, '([.!?…]){_BLANK}', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: trim(replace(x, chr(2), ' '))), lambda x: x <> '')"


def _tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '{_TOKEN}'), lambda x: NOT regexp_matches(x, '{T.UNSEGMENTED}'))"


def _normal_sql(x: str) -> str:
    return f"replace(lower({x}), '’', chr(39))"


_TOKENS = f"""WITH sent AS (
    SELECT doc_id AS doc, unnest(p) AS s, unnest(range(0, len(p))) AS nth FROM (SELECT doc_id, {_sentences_sql("coalesce(text, '')")} AS p FROM documents)),
tk AS (SELECT doc, nth, w, list_transform(w, lambda x: {_normal_sql('x')}) AS n FROM (SELECT doc, nth, {_tokens_sql('s')} AS w FROM sent) WHERE len(w) > 0)"""
_STATS = f"""{_TOKENS},
placed AS (SELECT row_number() OVER (ORDER BY doc, nth) - 1 AS sid, w, n FROM tk),
each AS (SELECT sid, unnest(w) AS x, unnest(n) AS token FROM placed),
ins AS (
    SELECT token, sid, count(*) AS f, sum((regexp_matches(x, '\\p{{L}}.*\\p{{L}}') AND NOT regexp_matches(x, '\\p{{Ll}}|\\p{{Lo}}'))::INT) AS u, sum(regexp_matches(x, '^\\p{{Lu}}')::INT) AS c
    FROM each GROUP BY ALL),
pairs AS (SELECT DISTINCT unnest(list_prepend('', n)) AS l, unnest(list_append(n, '')) AS r FROM placed),
lefts AS (SELECT r AS token, count(*) AS lefts FROM pairs WHERE r <> '' GROUP BY r),
rights AS (SELECT l AS token, count(*) AS rights FROM pairs WHERE l <> '' GROUP BY l),
stats AS (
    SELECT token, sum(f)::BIGINT AS freq, sum(u)::BIGINT AS upper, sum(c)::BIGINT AS capitalised, count(*) AS sentences, median(sid) AS middle, any_value(lefts) AS lefts, any_value(rights) AS rights
    FROM ins JOIN lefts USING (token) JOIN rights USING (token) GROUP BY token)"""
_GRAMS = f"""joined AS (
    SELECT doc, string_split(array_to_string(list_transform(w, lambda x: CASE WHEN ({_normal_sql('x')} IN ({_STOP}) AND {_normal_sql('x')} NOT IN ({_BRIDGE})) OR regexp_full_match({_normal_sql('x')}, '[0-9][0-9.,]*') THEN chr(1) ELSE x END), ' '), chr(1)) AS p FROM tk),
runs AS (SELECT doc, string_split(run, ' ') AS r FROM (SELECT doc, unnest(list_transform(p, lambda x: regexp_replace(trim(x), '^(?i:(?:{'|'.join(T.BRIDGING_WORDS)})(?: |$))+', ''))) AS run FROM joined) WHERE run <> ''),
lower_runs AS (SELECT doc, r, list_transform(r, lambda x: {_normal_sql('x')}) AS n FROM runs),
grams AS (
    SELECT doc, array_to_string(n[i:i + size - 1], ' ') AS term, size, size = 1 AND regexp_matches(r[i], '\\p{{L}}.*\\p{{L}}') AND NOT regexp_matches(r[i], '\\p{{Ll}}|\\p{{Lo}}') AS upper
    FROM (SELECT doc, r, n, unnest(range(1, len(n) + 1)) AS i FROM lower_runs), (SELECT unnest([1, 2, 3, 4]) AS size)
    WHERE i + size - 1 <= len(n) AND n[i] NOT IN ({_BRIDGE}) AND n[i + size - 1] NOT IN ({_BRIDGE})),
posts AS (SELECT term, size, doc, count(*) AS tf, sum(upper::INT) AS upper FROM grams GROUP BY ALL),
cand AS (SELECT term, size, count(*) AS df, sum(tf)::BIGINT AS tf, sum(upper)::BIGINT AS upper FROM posts GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"{_STATS} SELECT token, freq, upper, capitalised, sentences, round(middle, 6) AS middle, lefts, rights FROM stats")
def token_statistics(spark, sf):
    return rounded(terms.token_statistics(terms.sentences(table(spark, sf, "documents"))))


#: Parts that the terms of a larger corpus are counted in.
TERM_PASSES = 6


def _candidates(spark, sf):
    docs = table(spark, sf, "documents")
    if _passes(docs) > 1:
        return terms.candidates_in_passes(docs, TERM_PASSES)
    return terms.candidates(terms.postings(terms.ngrams(docs)))


@query(f"{_TOKENS}, {_GRAMS} SELECT term, size, df, tf, upper FROM cand")
def candidate_terms(spark, sf):
    return rounded(_candidates(spark, sf))


_GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC_WORDS)


@query(f"""{_TOKENS}, {_GRAMS}, ruled AS (SELECT *, split_part(term, ' ', 1) AS a, split_part(term, ' ', size) AS z FROM cand)
    SELECT rule, count(*) AS terms FROM (SELECT CASE WHEN trim(term) = '' THEN 'empty' WHEN length(term) < 3 THEN 'too_short' WHEN length(term) > 60 THEN 'too_long'
        WHEN regexp_full_match(term, '[0-9 ]+') THEN 'numeric_only' WHEN NOT regexp_matches(term, '\\p{{L}}') THEN 'no_alphabetic'
        WHEN size = 1 AND term IN ({_GENERIC}) THEN 'generic_term' WHEN a IN ({_STOP}) OR z IN ({_STOP}) THEN 'generic_boundary'
        WHEN size > 1 AND z IN ({_GENERIC}) THEN 'process_noun' WHEN regexp_matches(z, '^[a-z]{{3,}}(ing|ed)$') AND size > 1 THEN 'participle_tail' ELSE 'kept' END AS rule FROM ruled) GROUP BY rule""")
def term_filter(spark, sf):
    rule = F.coalesce(terms.rejects(F.col("term"), F.col("size")), F.lit("kept")).alias("rule")
    return _candidates(spark, sf).select(rule).groupBy("rule").agg(F.count("*").alias("terms"))


_CVALUE = """inside AS (
    SELECT DISTINCT array_to_string(string_split(term, ' ')[i:i + n - 1], ' ') AS part, term AS outside, tf
    FROM cand, (SELECT unnest([1, 2, 3, 4]) AS i), (SELECT unnest([1, 2, 3]) AS n) WHERE size > 1 AND n < size AND i + n - 1 <= size
),
nested AS (SELECT part AS term, avg(tf) AS f, count(*) AS containers FROM inside GROUP BY part),
cv AS (
    SELECT term, size, df, tf, coalesce(containers, 0) AS containers,
           CASE WHEN size = 1 THEN log2(1.1) ELSE log2(size) END * (tf - coalesce(f, 0)) AS c_value
    FROM cand LEFT JOIN nested USING (term)
)"""


def _values(spark, sf):
    cand, passes = _candidates(spark, sf), _passes(table(spark, sf, "documents"))
    return terms.c_value(cand, passes)


@query(f"{_TOKENS}, {_GRAMS}, {_CVALUE} SELECT term, size, df, tf, containers, round(c_value, 6) AS c_value FROM cv")
def c_value(spark, sf):
    return rounded(_values(spark, sf))


_YAKE = """totals AS (SELECT avg(freq) AS mean, stddev_pop(freq) AS std, max(freq) AS most, (SELECT count(*) FROM tk) AS n FROM stats),
yake AS (
    SELECT token, freq, 1 + (lefts / freq + rights / freq) * freq / most AS rel,
           rel * ln(ln(3 + middle)) / (greatest(upper, capitalised) / (1 + ln(freq)) + freq / (mean + std) / rel + sentences / greatest(n, 1) / rel) AS yake
    FROM stats, totals
)"""


#: Parts that the tokens of a corpus of so many letters are shuffled in; those of a smaller one are shuffled at once.
PASSES, LETTERS = 3, 60_000_000


def _passes(docs: DataFrame) -> int:
    return PASSES if (docs.agg(F.sum(F.length("text"))).first()[0] or 0) > LETTERS else 1


def _word_scores(docs: DataFrame, passes: int) -> DataFrame:
    s = terms.sentences(docs)
    if passes > 1:
        s = store.stash(s, "sentences")
    n = s.agg(F.count("*").alias("n"))
    if passes > 1:
        n = store.stash(n, "n")
    return terms.yake(terms.token_statistics(s, passes, owned=passes > 1), n)


@query(f"{_STATS}, {_YAKE} SELECT token, freq, round(yake, 6) AS yake FROM yake")
def yake(spark, sf):
    docs = table(spark, sf, "documents")
    return rounded(_word_scores(docs, _passes(docs)))


@query(f"""{_STATS}, {_GRAMS}, {_CVALUE}, {_YAKE},
    parts AS (SELECT term, tf, unnest(string_split(term, ' ')) AS token FROM cv),
    ty AS (SELECT term, product(coalesce(yake, 1)) / (any_value(tf) * (1 + sum(coalesce(yake, 1)))) AS y FROM parts LEFT JOIN yake USING (token) GROUP BY term)
    SELECT term, size, df, tf, round(least(1.0, greatest(0.0, 0.6 * least(1.0, ln(1 + greatest(c_value, 0)) / ln(1 + (SELECT max(greatest(c_value, 0)) FROM cv))) + 0.4 * CASE WHEN y >= 0 THEN 1 / (1 + y) ELSE 0 END)), 6) AS termhood
    FROM cv JOIN ty USING (term)""")
def termhood(spark, sf):
    docs = table(spark, sf, "documents")
    values = _values(spark, sf)
    if _passes(docs) == 1:
        values = store.stash(values, "cvalues")  # read three times
    store.release(spark)
    return rounded(terms.termhood(values, _word_scores(docs, _passes(docs))))


@query(f"""WITH d AS (
        SELECT doc_id AS doc, list_concat(list_concat(t, t), list_concat(t, b)) AS s FROM (
            SELECT doc_id, list_transform({_tokens_sql("split_part(coalesce(text, ''), chr(10), 1)")}, lambda x: left({_normal_sql('x')}, 6)) AS t,
                   list_transform({_tokens_sql("coalesce(text, '')")}, lambda x: left({_normal_sql('x')}, 6)) AS b FROM documents)),
    q AS (SELECT DISTINCT query, unnest(w) AS s FROM (SELECT item_id AS query, list_transform({_tokens_sql("coalesce(text, '')")}, lambda x: left({_normal_sql('x')}, 6)) AS w FROM benchmark)),
    qs AS (SELECT * FROM q WHERE s NOT IN ({_STOP})),
    need AS (SELECT query, CASE WHEN count(*) <= 3 THEN count(*) ELSE count(*) - 1 END AS need FROM qs GROUP BY query),
    lens AS (SELECT doc, len(s) AS len FROM d WHERE len(s) > 0), corpus AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
    tf AS (SELECT doc, s, count(*) AS tf FROM (SELECT doc, unnest(s) AS s FROM d) WHERE s IN (SELECT s FROM qs) GROUP BY ALL),
    df AS (SELECT s, count(*) AS df FROM tf GROUP BY s),
    scored AS (
        SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.75 + 0.75 * len / mean))) AS score, count(*) AS hits
        FROM tf JOIN df USING (s) JOIN qs USING (s) JOIN lens USING (doc) CROSS JOIN corpus GROUP BY ALL)
    SELECT query, doc, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rank FROM scored JOIN need USING (query) WHERE hits >= need) WHERE rank <= 5""")
def bm25(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), "text")
    return rounded(terms.bm25(docs, table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")))


@query("""SELECT doc_id, sha256(concat_ws('|', trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}]+', ' ', 'g')), coalesce(source, ''), coalesce(n_chars::VARCHAR, ''))) AS dedup_key FROM documents""")
def dedup_key(spark, sf):
    none = F.lit(None).cast("string")
    return table(spark, sf, "documents").select("doc_id", T.dedup_key(none, none, F.col("text"), F.col("source"), F.col("n_chars")).alias("dedup_key"))


def _letters_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


_VOTES = {k: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in v) + ")))" for k, v in T.LANGUAGE_WORDS.items()}
_OTHERS = ", ".join(k for k in T.LANGUAGE_WORDS if k != "en")


@query(f"""WITH d AS (SELECT lang, coalesce(text, '') AS t FROM documents),
    w AS (SELECT lang, {_letters_sql('[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]')} AS han, {_letters_sql('[\\x{3040}-\\x{30ff}]')} AS kana, {_letters_sql('[\\x{ac00}-\\x{d7af}\\x{1100}-\\x{11ff}]')} AS hangul,
        {_letters_sql('[\\x{0400}-\\x{04ff}]')} AS cyrillic, {_letters_sql('[A-Za-z\\x{c0}-\\x{24f}]')} AS latin,
        regexp_extract_all(lower(regexp_replace(t, 'https?://[^ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '[a-z\\x{{df}}-\\x{{ff}}]+') AS w FROM d),
    v AS (SELECT *, han + kana + hangul + cyrillic + latin AS n, {', '.join(f'{x} AS {k}' for k, x in _VOTES.items())} FROM w),
    m AS (SELECT *, greatest({_OTHERS}) AS most FROM v)
    SELECT lang, CASE WHEN n < 20 THEN NULL WHEN kana >= 0.05 * n THEN 'ja' WHEN hangul >= 0.2 * n THEN 'ko' WHEN han >= 0.2 * n THEN 'zh' WHEN cyrillic >= 0.3 * n THEN 'ru' WHEN latin < 0.5 * n THEN NULL
        {' '.join(f"WHEN {k} = most AND most >= 3 AND most >= 2 * en + 1 THEN '{k}'" for k in T.LANGUAGE_WORDS if k != 'en')} ELSE 'en' END AS detected, count(*) AS docs FROM m GROUP BY ALL""")
def detect_language(spark, sf):
    return table(spark, sf, "documents").select("lang", T.detect_language(F.col("text")).alias("detected")).groupBy("lang", "detected").agg(F.count("*").alias("docs"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '#.*$', ''), '^https?://', ''), '^www[.]', ''), '/+$', '') AS canonical,
    regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS host FROM pages""")
def canonical_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"), T.host(F.col("url")).alias("host"))


@query("""SELECT level, count(*) AS pages FROM (SELECT CASE WHEN regexp_matches(h, '(^|[.])example[.]org$') THEN 'HIGH' WHEN regexp_matches(h, '^m[.]') THEN 'LOW'
    WHEN contains(lower(html), 'class="ad"') THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM (SELECT html, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS h FROM pages)) GROUP BY level""")
def credibility(spark, sf):
    h = T.host(F.col("url"))
    rules = [("HIGH", h.rlike("(^|[.])example[.]org$")), ("LOW", h.rlike("^m[.]")), ("MEDIUM", F.contains(F.lower("html"), F.lit('class="ad"')))]
    level = F.coalesce(selection.first_reason(rules), F.lit("HIGH")).alias("level")
    return table(spark, sf, "pages").select(level).groupBy("level").agg(F.count("*").alias("pages"))


@query("""SELECT c_custkey, trim(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(c_name || ' & Co. Ltd'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')),
    '( (ag|co|company|corp|corporation|gmbh|inc|limited|llc|ltd|plc|sa))+$', ''), '^((ag|co|company|corp|corporation|gmbh|inc|limited|llc|ltd|plc|sa) )+', '')) AS canonical FROM customer""")
def canonical_organization(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.canonical_organization(F.concat("c_name", F.lit(" & Co. Ltd"))).alias("canonical"))


_QUOTA = 1500


@query(f"""WITH RECURSIVE y AS (SELECT year(o_orderdate) AS y, count(*) AS n, (SELECT count(*) FROM orders) AS total FROM orders GROUP BY 1),
    q AS (SELECT y, n, ({_QUOTA} * n) // total AS quota FROM y),
    f AS (SELECT y, quota + CASE WHEN row_number() OVER (ORDER BY quota - n, y) <= {_QUOTA} - sum(quota) OVER () THEN 1 ELSE 0 END AS quota FROM q)
    SELECT o_orderkey, o_year FROM (SELECT o_orderkey, year(o_orderdate) AS o_year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
    JOIN f ON o_year = f.y WHERE r <= quota""")
def stratified_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("o_year"))
    return rounded(selection.stratified_sample(o, "o_year", _QUOTA, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_year"))


_CLASSES = {"A": "JOURNAL_ARTICLE", "N": "PATENT", "R": "NEWS"}


@query(f"""WITH l AS (
        SELECT l_suppkey AS topic, l_orderkey * 10 + l_linenumber AS doc, CASE l_returnflag {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _CLASSES.items())} END AS class, l_shipdate::DATE AS date,
               l_discount * 10 AS relevance, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity::INT END AS citations FROM lineitem),
    m AS (SELECT *, max(coalesce(citations, 0)) OVER (PARTITION BY topic) AS most FROM l),
    s AS (SELECT *, round(0.4 * least(1.0, relevance) + 0.3 * least(1.0, greatest(0.0, date_diff('day', DATE '1992-01-01', date) / date_diff('day', DATE '1992-01-01', DATE '2001-12-31')))
        + 0.3 * CASE WHEN citations IS NOT NULL AND most > 0 THEN ln(1 + citations) / ln(1 + most) ELSE CASE class WHEN 'JOURNAL_ARTICLE' THEN 0.9 WHEN 'PATENT' THEN 0.75 WHEN 'NEWS' THEN 0.3 ELSE 0.5 END END, 6) AS score FROM m),
    c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY topic, class ORDER BY score DESC, date DESC, doc) > 10 THEN 1 ELSE 0 END AS over_ FROM s)
    SELECT topic, doc, class, score, place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY over_, score DESC, date DESC, doc) AS place FROM c) WHERE place <= 20""")
def evidence_selection(spark, sf):
    klass = F.coalesce(*[F.when(F.col("l_returnflag") == k, v) for k, v in _CLASSES.items()])
    line = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("topic"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"), klass.alias("class"), F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_discount") * 10).alias("relevance"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity").cast("int")).alias("citations"),
    )
    s = evidence.scored(line, "topic", "1992-01-01", "2001-12-31")
    return rounded(selection.evidence(s, "topic", "class", [F.desc("score"), F.desc("date"), F.asc("doc")]).select("topic", "doc", "class", "score", "place"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def keep_latest(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    order = F.struct("o_orderdate", "o_orderkey")
    return selection.distinct_on_columns(o, ["o_custkey"], order, ["o_orderkey", "o_orderstatus"])


@query("SELECT p_partkey FROM part WHERE p_retailprice >= (SELECT list_sort(list(p_retailprice))[least(count(*), floor(count(*) * 0.9)::BIGINT + 1)] FROM part)")
def unigram_gate(spark, sf):
    return selection.share_gate(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 0.9).select("p_partkey")


_REASON = "CASE WHEN o_orderstatus = 'F' THEN 'mature' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'stale' WHEN o_totalprice < 50000 THEN 'low_confidence' END"


@query(f"""WITH r AS (SELECT o_orderkey, {_REASON} AS reason FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY o_orderkey) AS k FROM r WHERE reason IS NOT NULL)
    SELECT reason, count(*) AS excluded, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) FILTER (k <= 5) AS examples FROM n GROUP BY reason""")
def exclusion_log(spark, sf):
    rules = [("mature", F.col("o_orderstatus") == "F"), ("stale", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")), ("low_confidence", F.col("o_totalprice") < 50000)]
    o = table(spark, sf, "orders").withColumn("reason", selection.first_reason(rules))
    return selection.exclusion_log(o, "reason", "o_orderkey")


_RANKED = "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part"


def _ranked_parts(spark, sf):
    order = Window.orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").withColumn("rank", F.row_number().over(order).cast("long"))


@query(f"""WITH b AS (SELECT *, (rank - 1) // 40 AS batch, p_size % 3 = 0 AS ok FROM ({_RANKED})), k AS (SELECT batch, sum(ok::INT) AS k FROM b GROUP BY batch),
    r AS (SELECT batch, coalesce(sum(k) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
    SELECT p_partkey, rank, batch FROM b JOIN r USING (batch) WHERE ok AND before < 30""")
def head_screen(spark, sf):
    r = _ranked_parts(spark, sf).withColumn("ok", F.col("p_size") % 3 == 0)
    return selection.head_screen(r, "ok", 30, 40).select("p_partkey", "rank", "batch")


@query("""WITH v AS (SELECT p_partkey, p_retailprice AS score, p_size % 4 AS votes, p_size % 2 = 0 AS approved FROM part)
    SELECT p_partkey, round(CASE WHEN votes >= 3 THEN score ELSE score - 15 END, 6) AS score,
           (CASE WHEN approved AND votes >= 3 THEN 0 WHEN approved THEN 1 WHEN votes >= 2 THEN 2 ELSE 3 END)::BIGINT AS tier FROM v WHERE votes > 0""")
def jury_tiers(spark, sf):
    v = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("score"), (F.col("p_size") % 4).alias("votes"), (F.col("p_size") % 2 == 0).alias("approved"))
    return rounded(selection.jury(v, "score", "votes").select("p_partkey", "score", selection.tiers(v, "approved", "votes").alias("tier")))


@query("""SELECT p_partkey, p_brand, turn FROM (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY n, p_brand) AS turn
    FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)) WHERE turn <= 150""")
def budget_split(spark, sf):
    return selection.budget_split(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", [F.asc("p_partkey")], 150)


_REPORTS = """WITH agg AS (SELECT o_orderpriority AS direction, year(o_orderdate) - 1994 AS version, l_suppkey AS topic, round(sum(l_extendedprice), 2) AS score
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
reports AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction, version ORDER BY score DESC, topic) AS rank FROM agg) WHERE rank <= 20)"""


def report_rows(spark, sf):
    """The twenty suppliers with most revenue per order priority (direction) and year (version)."""
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    agg = o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(
        F.col("o_orderpriority").alias("direction"), (F.year("o_orderdate") - 1994).cast("long").alias("version"), F.col("l_suppkey").alias("topic")
    ).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    n = F.row_number().over(Window.partitionBy("direction", "version").orderBy(F.desc("score"), "topic"))
    return agg.withColumn("rank", n.cast("long")).where("rank <= 20")


@query(f"""{_REPORTS}, a AS (SELECT * FROM reports WHERE direction = '1-URGENT' AND version = 4), b AS (SELECT * FROM reports WHERE direction = '1-URGENT' AND version = 5)
    SELECT coalesce(a.topic, b.topic) AS topic, CASE WHEN a.topic IS NULL THEN 'entered' WHEN b.topic IS NULL THEN 'left' ELSE 'stayed' END AS status,
           a.rank - b.rank AS rank_change, round(b.score - a.score, 2) AS score_change FROM a FULL JOIN b ON a.topic = b.topic""")
def report_delta(spark, sf):
    r = report_rows(spark, sf).where("direction = '1-URGENT'")
    return reports.delta(r.where("version = 4"), r.where("version = 5")).withColumn("score_change", F.round("score_change", 2))


@query(f"{_REPORTS} SELECT topic, count(DISTINCT direction) AS directions, min(rank) AS best_rank FROM reports WHERE version = 5 GROUP BY topic HAVING count(DISTINCT direction) >= 2")
def direction_overlap(spark, sf):
    return reports.overlap(report_rows(spark, sf).where("version = 5"))


@query(f"""{_REPORTS}, st AS (SELECT *, CASE WHEN rank <= 3 THEN 'ACCELERATING' WHEN rank <= 15 THEN 'EMERGING' ELSE 'EMBRYONIC' END AS stage FROM reports WHERE version = 5),
    sp AS (SELECT direction, unnest(['ACCELERATING', 'EMERGING', 'EMBRYONIC', 'MATURING']) AS stage FROM (SELECT DISTINCT direction FROM st)),
    g AS (SELECT direction, stage, count(*) AS topics, list_sort(list(score)) AS l FROM st GROUP BY ALL)
    SELECT direction, stage, coalesce(topics, 0) AS topics, l[(len(l) - 1) // 2 + 1] AS median_score FROM sp LEFT JOIN g USING (direction, stage)""")
def direction_portrait(spark, sf):
    r = report_rows(spark, sf).where("version = 5").withColumn("stage", F.when(F.col("rank") <= 3, "ACCELERATING").when(F.col("rank") <= 15, "EMERGING").otherwise("EMBRYONIC"))
    return reports.portrait(r, "stage", ["ACCELERATING", "EMERGING", "EMBRYONIC", "MATURING"])


@query(f"""{_REPORTS}, p AS (SELECT *, max(version) OVER (PARTITION BY direction) AS newest FROM reports),
    e AS (SELECT direction, count(*) AS entered FROM p WHERE version = newest AND NOT EXISTS (SELECT 1 FROM p q WHERE q.direction = p.direction AND q.version = p.newest - 1 AND q.topic = p.topic) GROUP BY direction),
    h AS (SELECT direction, version, string_agg(topic::VARCHAR, '|' ORDER BY rank) AS headline FROM p WHERE version = newest AND rank <= 3 GROUP BY ALL)
    SELECT direction, version, headline, coalesce(entered, 0) AS entered FROM h LEFT JOIN e USING (direction)""")
def radar_digest(spark, sf):
    return reports.radar_digest(report_rows(spark, sf).withColumn("topic", F.col("topic").cast("string")))


@query(f"{_REPORTS} SELECT direction, max(version) + 1 AS version FROM reports GROUP BY direction")
def next_version(spark, sf):
    return reports.next_version(report_rows(spark, sf))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE (contains(lower(p_name), 'blue') OR contains(lower(p_type), 'blue') OR contains(lower(p_brand), 'blue')) AND (contains(lower(p_name), 'econ') OR contains(lower(p_type), 'econ') OR contains(lower(p_brand), 'econ'))")
def topic_search(spark, sf):
    return reports.search(table(spark, sf, "part"), ["Blue", "Econ"], ["p_name", "p_type", "p_brand"]).select("p_partkey", "p_name", "p_type")


_FEEDBACK = "SELECT DISTINCT ON (user_id) user_id, CASE WHEN event_type = 'error' THEN 'NOISE' ELSE 'USEFUL' END AS verdict, event_id FROM events ORDER BY user_id, ts DESC, event_id DESC"


@query(_FEEDBACK)
def carried_feedback(spark, sf):
    f = table(spark, sf, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "NOISE").otherwise("USEFUL").alias("verdict"))
    return reports.carried_feedback(f, ["user_id"], "ts", "event_id").select("user_id", "verdict", "event_id")


@query(f"WITH f AS ({_FEEDBACK}) SELECT DISTINCT user_id AS topic FROM f WHERE verdict = 'NOISE' AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def hidden_topics(spark, sf):
    shown = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("topic"))
    return reports.hidden(carried_feedback(spark, sf).withColumnRenamed("user_id", "topic"), shown)


@query("SELECT event_type, count(*) AS asked, max(ts) AS last_asked, arg_max(user_id, (ts, event_id)) AS last_user FROM events GROUP BY event_type")
def unrecognised_directions(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("asked"), F.max("ts").alias("last_asked"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last_user"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def request_history_page(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20)


@query("SELECT source, sha256(string_agg(id, chr(10) ORDER BY id)) AS content_hash, count(*) AS documents FROM (SELECT DISTINCT source, doc_id::VARCHAR AS id FROM documents) GROUP BY source")
def snapshot_hash(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("id"))
    return d.groupBy("source").agg(T.content_hash(F.col("id")).alias("content_hash"), F.countDistinct("id").alias("documents"))


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)
    SELECT label::BIGINT AS label, i, round(avg(x), 6) AS x FROM e GROUP BY ALL""")
def centroid(spark, sf):
    c = vectors.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return rounded(c.select("label", F.posexplode("centroid").alias("i", "x")))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY ALL),
    s AS (SELECT vec_id, label, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cos FROM e JOIN c USING (label, i) GROUP BY ALL)
    SELECT label::BIGINT AS label, round(avg(cos), 6) AS cohesion, count(*) AS members FROM s GROUP BY label""")
def coherence(spark, sf):
    return rounded(vectors.cohesion(table(spark, sf, "embeddings"), "label", "embedding"))


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE label % 2 = 0 END AS inside, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
    c AS (SELECT inside, i, avg(x) AS c FROM e WHERE inside IS NOT NULL GROUP BY ALL),
    s AS (SELECT vec_id, c.inside, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cos FROM e JOIN c USING (i) WHERE e.inside IS NULL GROUP BY ALL)
    SELECT a.vec_id, a.cos >= b.cos AS given FROM s a JOIN s b USING (vec_id) WHERE a.inside AND NOT b.inside""")
def label_transfer(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("inside", F.when(F.col("vec_id") % 5 != 0, F.col("label") % 2 == 0))
    return vectors.transfer_labels(e, "embedding", "inside").select("vec_id", "given")


@query()
def average_linkage_clusters(spark, sf):
    return vectors.clusters(table(spark, sf, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.35)


@query()
def distinct_concepts(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return vectors.greedy_distinct(p, "p_brand", "p_partkey", "p_name")


_FEATURES = [("l_quantity", 0.8, "log1p", 3.0, 0.7), ("l_discount", -0.5, "identity", 0.05, 0.03), ("l_tax", 0.3, "signed_log1p", 0.04, 0.02)]


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(100 / (1 + exp(-(-0.2 + 0.8 * (ln(1 + l_quantity) - 3.0) / 0.7 - 0.5 * (l_discount - 0.05) / 0.03
    + 0.3 * (sign(l_tax) * ln(1 + abs(l_tax)) - 0.04) / 0.02))), 6) AS score FROM lineitem""")
def model_score(spark, sf):
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", model.linear(_FEATURES, -0.2).alias("score")))


_JUDGED = "SELECT quality = 1 AS truth, n_chars >= 500 AS predicted, quality, n_chars FROM labels JOIN documents USING (doc_id)"


def _judged(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")


@query(f"""WITH c AS (SELECT count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (truth AND NOT predicted) AS fn, count(*) FILTER (NOT truth AND predicted) AS fp,
    count(*) FILTER (NOT truth AND NOT predicted) AS tn FROM ({_JUDGED}))
    SELECT tp, fn, fp, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + tn) / (tp + fn + fp + tn), 6) AS accuracy,
           round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def classification_metrics(spark, sf):
    return rounded(model.confusion(_judged(spark, sf), F.col("quality") == 1, F.col("n_chars") >= 500))


@query(f"""WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM ({_JUDGED}))
    SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc FROM r""")
def roc_auc(spark, sf):
    return rounded(model.auc(_judged(spark, sf), "quality", "n_chars"))


@query(f"""{FIT}, {NOVELTY}, {VOLUME}, k AS (SELECT topic, count(DISTINCT source_class) AS kinds, count(DISTINCT doc) AS works, max(period) - min(period) + 1 AS span FROM m GROUP BY topic)
    SELECT topic, CASE WHEN r >= 3000 THEN 'MAINSTREAM' WHEN 2001 - first_year > 4 AND least(1.0, greatest(0.0, slope / ln(3))) < 0.2 / ln(3) AND 2001 - first_year > 6 THEN 'MAINSTREAM'
        WHEN kinds < 2 THEN 'INSUFFICIENT' ELSE 'WEAK_SIGNAL' END AS verdict,
        round(least(1.0, 0.45 * ln(1 + kinds) / ln(5) + 0.30 * ln(1 + works) / ln(51) + 0.25 * span / 4), 6) AS certainty
    FROM fit JOIN novel USING (topic) JOIN volumes USING (topic) JOIN k USING (topic)""")
def signal_classifier(spark, sf):
    m = mentions(spark, sf)
    s = series.topic_series(m)
    k = m.groupBy("topic").agg(F.countDistinct("source_class").alias("kinds"), F.countDistinct("doc").alias("works"), (F.max("period") - F.min("period") + 1).alias("span"))
    t = series.growth(s).select("topic", "growth").join(series.novelty(m, 2001), "topic").join(series.weakness(s).select("topic", F.col("recent").alias("works_recent")), "topic").join(k, "topic")
    return rounded(model.classify(t.withColumn("current_year", F.lit(2001))).select("topic", "verdict", "certainty"))


_BACKTEST = f"""{SERIES}, t AS (SELECT topic, sum(df) FILTER (period <= 1998) AS a, sum(df) FILTER (period > 1998) AS b, sum(n) FILTER (period <= 1998) AS na, sum(n) FILTER (period > 1998) AS nb FROM s GROUP BY topic),
    c AS (SELECT topic, period, sum(df) FILTER (period > 1998) OVER (PARTITION BY topic ORDER BY period) AS later FROM s),
    g AS (SELECT topic, min(period) - 1998 AS doubling FROM c JOIN t USING (topic) WHERE period > 1998 AND a > 0 AND later >= a GROUP BY topic),
    o AS (SELECT topic, a::BIGINT AS before, b::BIGINT AS after, CASE WHEN a > 0 AND nb > 0 THEN (b / a) / (nb / na) ELSE 0 END AS lift, doubling FROM t LEFT JOIN g USING (topic))"""


@query(f"{_BACKTEST} SELECT topic, before, after, round(lift, 6) AS lift, lift >= 1.5 AS hit, doubling FROM o")
def backtest(spark, sf):
    return rounded(model.backtest(_series(spark, sf), 1998))


@query(f"{_BACKTEST} SELECT count(*) AS topics, round(avg((lift >= 1.5)::INT), 6) AS hit_rate, round(median(lift), 6) AS median_lift, round(median(doubling), 6) AS median_lead FROM o")
def backtest_summary(spark, sf):
    return rounded(model.backtest_summary(model.backtest(_series(spark, sf), 1998)))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf):
    return rounded(streams.tumbling(table(spark, sf, "events"), "ts", ["event_type"], "1 hour"))


@query("SELECT b - INTERVAL 30 MINUTE * o AS start, event_type, count(*) AS events FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS b, event_type FROM events), (SELECT unnest([0, 1]) AS o) GROUP BY ALL")
def sliding_window(spark, sf):
    return streams.sliding(table(spark, sf, "events"), "ts", ["event_type"], "1 hour", "30 minutes")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, k""")
def session_window(spark, sf):
    return streams.sessions(table(spark, sf, "events"), "ts", ["user_id"], "6 hours")


@query("""WITH t AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events), n AS (SELECT user_id, s // 86400 AS bucket, count(*) FILTER (s % 86400 < 43200) AS sofar, count(*) AS n FROM t GROUP BY ALL)
    SELECT n.user_id, n.bucket, coalesce(p.n, 0) * 0.5::DOUBLE + n.sofar AS estimate FROM n LEFT JOIN n p ON n.user_id = p.user_id AND n.bucket = p.bucket + 1""")
def quota_estimate(spark, sf):
    return streams.quota_estimate(table(spark, sf, "events"), "ts", "user_id", 86400)


@query()
def token_bucket(spark, sf):
    return streams.token_bucket(table(spark, sf, "events"), "user_id", "ts", 1 / 36000, 3)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_state(spark, sf):
    return streams.latest_state(table(spark, sf, "events"), "user_id", "ts").select("user_id", "event_type", "event_id")


@query("SELECT o_custkey, count(*) AS orders FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY o_custkey")
def already_known(spark, sf):
    known = table(spark, sf, "events").select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf, "orders").join(known, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), q AS (SELECT vec_id AS query, i, x FROM e WHERE vec_id % 100 = 0),
    s AS (SELECT query, vec_id, round(sum(e.x * q.x) / (sqrt(sum(e.x * e.x)) * sqrt(sum(q.x * q.x))), 6) AS similarity FROM e JOIN q USING (i) GROUP BY ALL)
    SELECT query, vec_id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS place FROM s) WHERE place <= 60""")
def topic_relevance_top(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return vectors.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "v", 60)
