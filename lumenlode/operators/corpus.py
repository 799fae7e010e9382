"""The corpus of an analysis: snapshots and their pages, windows, relevance to a query, traces of lost terms."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ordering import ranked_by

# Words that a search phrase leaves out.
SEARCH_STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "its", "of", "on", "or", "the", "to", "with", "via", "using", "based", "и", "в", "во", "не", "на", "с", "со", "по", "к", "из", "за", "от", "до", "для", "как", "или", "о", "об", "при", "у"]


def window(docs: DataFrame, date: str = "publishedOn") -> DataFrame:
    """One row: the first and last date of a corpus, and its documents."""
    return docs.agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("documents"))


def analysis_window(snapshot_from: Column, snapshot_to: Column, years: int) -> Column:
    """The day an analysis starts: the snapshot's first, or the first of January that leaves ``years`` years."""
    return F.greatest(snapshot_from, F.make_date(F.year(snapshot_to) - (years - 1), F.lit(1), F.lit(1)))


def elapsed_share(window_to: Column, today: Column) -> Column:
    """How much of the window's last year is over, 0.05 at least."""
    end, year = F.least(window_to, today), F.year(window_to)
    start, last = F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))
    share = (F.datediff(end, start) + 1) / (F.datediff(last, start) + 1)
    return F.when(end >= last, 1.0).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), share)))


def select_corpus(docs: DataFrame, first, last, classes: list[str] | None = None, date: str = "publishedOn", klass: str = "sourceClass") -> DataFrame:
    """Documents of the window and, if given, of the source classes."""
    out = docs.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return out.where(F.col(klass).isin(classes)) if classes else out


def load_snapshot(snapshot: DataFrame, docs: DataFrame, snapshot_id, key: str = "documentId") -> DataFrame:
    """The documents of a frozen corpus."""
    ids = snapshot.where(F.col("snapshot_id") == snapshot_id).select(key)
    return docs.join(ids, key, "left_semi")


def snapshot_page(snapshot: DataFrame, docs: DataFrame, snapshot_id, offset: int, limit: int, key: str = "documentId") -> DataFrame:
    """A page of a snapshot's documents in its order (``ordinal``): a top-k of the snapshot, then a join."""
    page = snapshot.where(F.col("snapshot_id") == snapshot_id).orderBy("ordinal").offset(offset).limit(limit).select(key, "ordinal")
    return docs.join(F.broadcast(page), key)  # ``limit`` rows


def nested(docs: DataFrame, children: DataFrame, name: str, fields: list[str], key: str = "documentId", place: str = "ordinal") -> DataFrame:
    """``docs`` with their children (authors, topics) as an array of structs in the order of ``place``; empty without any."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(place, *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    own = children.groupBy(key).agg(rows.alias(name))  # a document's own authors or subjects
    j = docs.join(own, key, "left")
    return j.withColumn(name, F.coalesce(name, F.array().cast(j.schema[name].dataType)))


def translated(original: Column, english: Column) -> Column:
    """The English translation where there is one."""
    return F.when(F.trim(english) != "", english).otherwise(original)


def _stems(text: Column) -> Column:
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}-]*"), F.lit(0))
    return F.transform(F.filter(w, lambda x: (F.length(x) >= 2) & ~x.isin(SEARCH_STOP)), lambda x: T.stem_prefix(x))


def phrase_stems(phrases: list[str]) -> list[list[str]]:
    """The stems of search phrases; quotes and OR separate variants."""
    out: list[list[str]] = []
    for phrase in phrases:
        for variant in re.split(r'"|\bOR\b', phrase):
            words = [w for w in re.findall(r"[^\W_][\w-]*", variant.lower()) if len(w) >= 2 and w not in SEARCH_STOP]
            if words and (s := [w[:6] for w in words]) not in out:
                out.append(s)
    return out


def has_phrase(text: Column, phrases: list[list[str]]) -> Column:
    """Whether a text has one of the phrases: up to three stems in a row; of longer ones all stems but one, two of them in a row."""
    hay = F.concat(F.lit(" "), F.array_join(_stems(text), " "), F.lit(" "))
    has = lambda x: F.contains(hay, F.lit(f" {x} "))
    out = F.lit(False)
    for p in phrases:
        if len(p) <= 3:
            hit = has(" ".join(p))
        else:
            each = list(dict.fromkeys(p))
            present = sum((has(s).cast("int") for s in each), F.lit(0))
            hit = (present >= len(each) - 1) & reduce(lambda a, b: a | b, (has(f"{a} {b}") for a, b in zip(p, p[1:])))
        out = out | hit
    return out


def relevant_documents(docs: DataFrame, query: str, expansion: list[str], text: str = "text", source: str = "sourceId", exempt: tuple[str, ...] = ("deepresearch", "webcorpus"), least_share: float = 0.15) -> DataFrame:
    """Documents that have the query or one of its expansions as a phrase; all of them if expansions are fewer than three or less than ``least_share`` would stay."""
    if len(expansion) < 3:
        return docs
    keep = F.col(source).isin(*exempt) | has_phrase(F.col(text), phrase_stems([query, *expansion]))
    marked = docs.withColumn("_keep", F.coalesce(keep, F.lit(True)))
    share = F.broadcast(marked.agg(F.avg(F.col("_keep").cast("int")).alias("_share")))  # one row
    return marked.crossJoin(share).where(F.col("_keep") | (F.col("_share") < least_share)).drop("_keep", "_share")


def matches_phrase(text: Column, phrase: str) -> Column:
    """Stem-tolerant containment: words of five letters or more by their stem and at most four letters longer, short ones with s or es; British -is- as -iz-."""
    clean = lambda x: F.regexp_replace(F.translate(F.lower(x), "ё", "е"), r"(\p{L}{2})is(ations|ation|ed|es|e|ing)(?![\p{L}\p{N}])", "$1iz$2")
    words = re.findall(r"[^\W_]+", re.sub(r"(\w{2})is(ations|ation|ed|es|e|ing)\b", r"\1iz\2", phrase.lower().replace("ё", "е")))
    if not words:
        return F.lit(False)

    def form(w: str) -> str:
        if len(w) < 5:
            return f"{w}(?:s|es)?"
        stem = w[: max(4, len(w) - 2)]
        return rf"{stem}[\p{{L}}\p{{N}}]{{0,{len(w) + 4 - len(stem)}}}"

    hay = F.concat(F.lit(" "), F.trim(F.regexp_replace(clean(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return hay.rlike(" " + " ".join(map(form, words)) + " ")


def union_first_seen(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several results in the order of the parts, each key once, where it was seen first. Rows need ``nth``, their place in a part."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    whole = reduce(DataFrame.unionByName, tagged)
    first = whole.groupBy(key).agg(F.min(F.struct("_part", "nth", *[c for c in parts[0].columns if c not in (key, "nth")])).alias("f"))
    rest = [F.col(f"f.{c}").alias(c) for c in parts[0].columns if c != key]
    return first.select(key, F.col("f._part").alias("part"), *rest)


def trace(watched: DataFrame, stages: list[tuple[str, DataFrame]], key: str = "term") -> DataFrame:
    """Where watched terms were lost: term, last (the stage that still had it, null if none), lost (the stage after, null if it came through)."""
    j = watched.select(key).distinct()
    for i, (_, rows) in enumerate(stages):
        j = j.join(rows.select(key).distinct().withColumn(f"_{i}", F.lit(True)), key, "left")
    last, lost = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, _) in reversed(list(enumerate(stages))):
        lost = F.when(F.col(f"_{i}").isNull(), name).otherwise(lost)
    seen = F.lit(True)
    for i, (name, _) in enumerate(stages):
        seen = seen & F.col(f"_{i}").isNotNull()
        last = F.when(seen, name).otherwise(last)
    return j.select(key, last.alias("last"), lost.alias("lost"))


def relevance_sample(docs: DataFrame, relevance: str, limit: int) -> DataFrame:
    """The most relevant ``limit`` documents, by a rank that no task sorts alone."""
    return ranked_by(docs, relevance, [F.desc(relevance), F.asc("documentId")], descending=True).where(F.col("rank") <= limit)
