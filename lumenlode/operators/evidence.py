"""What supports a topic: evidence and its credibility, the case example, quoted problems and benefits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import clamp01, safe_div
from ..functions.stem import stem_english

# Authority of a document without citations, by source class; any other class has 0.5.
AUTHORITY = {"JOURNAL_ARTICLE": 0.90, "STANDARD": 0.85, "PATENT": 0.75, "ANALYST_REPORT": 0.60, "PREPRINT": 0.55, "CODE_REPOSITORY": 0.45, "NEWS": 0.30}
# Phrases that announce a problem, and a benefit, with their weights.
PROBLEMS = {
    "remains challenging": 1.0, "remain challenging": 1.0, "is limited by": 1.0, "are limited by": 1.0, "suffers from": 1.0, "suffer from": 1.0, "open problem": 1.0, "bottleneck": 0.9,
    "is still an open": 0.9, "remains an open": 0.9, "fails to": 0.85, "fail to": 0.85, "do not scale": 0.85, "does not scale": 0.85, "computationally expensive": 0.85, "prohibitively": 0.85,
    "difficult to": 0.8, "hard to": 0.8, "lack of": 0.8, "lacks": 0.75, "limitation": 0.75, "drawback": 0.75, "challenge": 0.7, "however": 0.6, "nevertheless": 0.6,
    "остается проблемой": 1.0, "остаются проблемой": 1.0, "узкое место": 1.0, "не позволяет": 0.9, "не позволяют": 0.9, "ограничен": 0.85, "ограничивает": 0.85,
    "недостатком": 0.8, "недостаток": 0.8, "сложность": 0.7, "проблема": 0.7, "однако": 0.6, "тем не менее": 0.6,
}
BENEFITS = {
    "outperforms": 1.0, "outperform": 1.0, "state-of-the-art": 0.95, "state of the art": 0.95, "speedup": 0.95, "speed-up": 0.95, "achieves": 0.9, "achieve": 0.9, "we show": 0.9, "we demonstrate": 0.9,
    "we propose": 0.8, "enables": 0.9, "enable": 0.9, "reduces": 0.9, "reduce": 0.85, "improves": 0.9, "improve": 0.85, "increases": 0.85, "without sacrificing": 0.9, "orders of magnitude": 0.95,
    "significantly": 0.7, "превосходит": 1.0, "позволяет": 0.9, "позволяют": 0.9, "сокращает": 0.9, "снижает": 0.9, "повышает": 0.9, "ускоряет": 0.9, "обеспечивает": 0.85, "демонстрирует": 0.8, "предлагается": 0.7,
}
# Words that make a sentence the continuation of another.
OPENERS = ["however", "moreover", "furthermore", "therefore", "thus", "hence", "nevertheless", "nonetheless", "instead", "conversely", "meanwhile", "besides", "additionally", "consequently", "accordingly", "otherwise"]


def prior(klass: Column) -> Column:
    out = F.lit(0.5)
    for k, v in AUTHORITY.items():
        out = F.when(klass == k, v).otherwise(out)
    return out


def evidence_score(relevance: Column, date: Column, first: Column, last: Column, citations: Column, most_citations: Column, klass: Column) -> Column:
    """0.4 relevance, 0.3 recency (1 on the window's last day), 0.3 authority (citations, logarithmic by the topic's largest, or the class' own), six decimals."""
    days = F.datediff(last, first)
    recency = F.when(days <= 0, 1.0).otherwise(clamp01(F.datediff(date, first) / days))
    cited = clamp01(safe_div(F.log1p(citations.cast("double")), F.log1p(most_citations.cast("double"))))
    authority = F.when(citations.isNotNull() & (most_citations > 0), cited).otherwise(prior(klass))
    return F.round(0.4 * clamp01(relevance) + 0.3 * recency + 0.3 * authority, 6)


def scored(df: DataFrame, topic: str, first, last) -> DataFrame:
    """Rows topic, doc, class, date, relevance, citations with their evidence score; the largest citation count is the topic's."""
    most = F.max(F.coalesce("citations", F.lit(0))).over(Window.partitionBy(topic))
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    rows = df.withColumn("_most", most)
    return rows.withColumn("score", evidence_score(F.col("relevance"), F.col("date"), lo, hi, F.col("citations"), F.col("_most"), F.col("class"))).drop("_most")


def case_example(df: DataFrame, topic: str) -> DataFrame:
    """Each topic's example: a corporate patent, else the most cited corporate document, else the most cited of another organisation; ties by document.

    Rows: topic, doc, class, org, corporate, citations.
    """
    tier = F.when((F.col("class") == "PATENT") & F.col("corporate"), 0).when(F.col("corporate"), 1).otherwise(2)
    best = F.min(F.struct(tier.alias("tier"), (-F.coalesce("citations", F.lit(0))).alias("c"), F.col("doc"), F.col("org"))).alias("b")
    basis = F.element_at(F.array(F.lit("PATENT"), F.lit("CORPORATE_PUBLICATION"), F.lit("ACADEMIC_GROUP")), F.col("b.tier") + 1)
    return df.where("org is not null and org <> ''").groupBy(topic).agg(best).select(topic, F.col("b.doc").alias("doc"), F.col("b.org").alias("org"), basis.alias("basis"))


def _strongest(lowered: Column, marks: dict[str, float]) -> Column:
    """weight and mark of the strongest phrase in a sentence, of equals the first in order; null without one."""
    found = F.array(*[F.when(F.contains(lowered, F.lit(m)), F.struct(F.lit(-w).alias("w"), F.lit(m).alias("mark"))) for m, w in marks.items()])
    return F.array_min(F.array_compact(found))


def narration(docs: DataFrame, topics: DataFrame, most: int = 2, least_coverage: float = 0.0, problems: dict[str, float] = PROBLEMS, benefits: dict[str, float] = BENEFITS) -> DataFrame:
    """Sentences that tell a topic's problem and benefit: topic, kind, place, doc, sentence, mark, score.

    ``docs``: topic, doc, text, class, citations; ``topics``: topic, stems. A sentence of 30 to 400 characters
    that does not begin as a continuation counts with weight * (.25 + .75 coverage) * (.25 + .75 authority);
    repeated sentences count once. A topic's documents are its selected evidence.
    """
    s = docs.select("topic", "doc", "class", "citations", F.explode(F.array_distinct(T.sentences(F.col("text")))).alias("s"))
    s = s.where((F.length("s") >= 30) & (F.length("s") <= 400))
    first = F.lower(F.regexp_extract("s", r"[\p{L}\p{N}_-]+", 0))
    s = s.where((first != "") & ~first.isin(OPENERS)).join(topics.select("topic", F.array_distinct("stems").alias("stems")), "topic")
    hits = F.size(F.array_intersect("stems", F.transform(T.words(F.col("s")), stem_english)))
    s = s.withColumn("coverage", clamp01(safe_div(hits, F.size("stems")))).where(F.col("coverage") >= least_coverage)
    authority = clamp01(0.5 * prior(F.col("class")) + 0.5 * F.log1p(F.coalesce("citations", F.lit(0)).cast("double")) / F.log1p(F.lit(200.0)))
    low = F.lower("s")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _strongest(low, m).alias("m")) for k, m in (("problem", problems), ("benefit", benefits))])
    each = s.select("topic", "doc", "s", "coverage", authority.alias("authority"), F.explode(kinds).alias("k")).where("k.m is not null")
    score = F.round(-F.col("k.m.w") * (0.25 + 0.75 * F.col("coverage")) * (0.25 + 0.75 * F.col("authority")), 9)
    each = each.select("topic", F.col("k.kind").alias("kind"), "doc", F.col("s").alias("sentence"), F.col("k.m.mark").alias("mark"), score.alias("score"))
    once = each.groupBy("topic", "kind", "sentence").agg(F.max(F.struct("score", (-F.col("doc")).alias("d"), "mark")).alias("b"))
    rows = once.select("topic", "kind", "sentence", F.col("b.score").alias("score"), (-F.col("b.d")).alias("doc"), F.col("b.mark").alias("mark"))
    place = F.row_number().over(Window.partitionBy("topic", "kind").orderBy(F.desc("score"), "doc", "sentence"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def credibility(host: Column, klass: Column, title: Column, hosts: dict[str, list[str]], official: list[str], promo: list[str], owned: Column | None = None) -> Column:
    """level and independence of a source; the first rule that holds. ``hosts``: lists 'press', 'media' and 'social'; ``official``: domain suffixes; ``promo``: marks in titles.

    Press services and social platforms are low and not independent; professional media medium, low if the
    title is promotion; official domains high; then the class decides.
    """
    promotion = F.exists(F.array(*map(F.lit, promo)), lambda m: F.contains(F.lower(F.coalesce(title, F.lit(""))), m)) if promo else F.lit(False)
    on = lambda k: T.on_host(host, hosts[k]) if hosts.get(k) else F.lit(False)
    verdict = lambda level, alone: F.struct(F.lit(level).alias("level"), F.lit(alone).alias("independent"))
    owned = F.lit(False) if owned is None else owned
    return (
        F.when(on("press"), verdict("LOW", False))
        .when(on("media") & promotion, verdict("LOW", False))
        .when(on("media"), verdict("MEDIUM", True))
        .when(on("social"), verdict("LOW", False))
        .when(T.on_host(host, [s.lstrip(".") for s in official]) if official else F.lit(False), verdict("HIGH", True))
        .when(klass.isin("STANDARD", "PATENT", "JOURNAL_ARTICLE"), verdict("HIGH", True))
        .when(klass.isin("PREPRINT", "ANALYST_REPORT"), verdict("MEDIUM", True))
        .when((klass == "CODE_REPOSITORY") & owned, verdict("MEDIUM", True))
        .when(klass == "CODE_REPOSITORY", verdict("LOW", False))
        .when(promotion, verdict("LOW", False))
        .otherwise(verdict("LOW", True))
    )
