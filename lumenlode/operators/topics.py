"""From terms to topics: term vectors, the clustering budget, synonyms, topics and their relevance to a direction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import clamp01, cosine, norm
from ..functions.stem import stem_english
from . import names
from .terms import cooccurrence, npmi_of
from .vectors import average_linkage, centroids

#: A name of several words in so many documents can be a topic; a share of a word's documents that decides.
NAMED, SHARE = 5, 0.5


def unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def term_vectors(surfaces: DataFrame, posts: DataFrame, docs: DataFrame) -> DataFrame:
    """Half the term's own vector, half the mean of its documents', both of unit length, the sum too: term, vector.

    ``surfaces``: term, vector; ``posts``: term, doc; ``docs``: doc, vector. A term without documents has its own only.
    """
    of_docs = centroids(posts.select("term", "doc").distinct().join(docs.select("doc", "vector"), "doc"), "term", "vector")
    own = F.transform("vector", lambda x: x.cast("double"))
    j = surfaces.select("term", own.alias("v")).join(of_docs, "term", "left")
    none = F.transform("v", lambda x: F.lit(0.0))
    mixed = F.zip_with(unit(F.col("v")), unit(F.coalesce("centroid", none)), lambda a, b: 0.5 * a + 0.5 * b)
    return j.select("term", mixed.alias("m")).select("term", unit(F.col("m")).alias("vector"))


def clustering_budget(terms: DataFrame, posts: DataFrame, limit: int = 5000, fresh_share: float = 0.5, teams: int = 2) -> DataFrame:
    """The terms that are clustered, with part: 'termhood', 'fresh' or 'rest'.

    The first part by termhood; then names of several words that most independent teams used lately (then:
    ever), of ``teams`` teams at least; places left go by termhood again. ``terms``: term, size, termhood;
    ``posts``: term, team, recent (rows without a team are ignored).
    """
    head = limit - round(limit * fresh_share)
    by_termhood = Window.orderBy(F.desc("termhood"), "term")
    first = terms.orderBy(F.desc("termhood"), "term").limit(limit).withColumn("_n", F.row_number().over(by_termhood))  # ``limit`` rows
    strong = first.where(F.col("_n") <= head).select("term", F.lit("termhood").alias("part"))
    of_term = posts.where("team is not null").groupBy("term").agg(F.countDistinct("team").alias("groups"), F.countDistinct(F.when(F.col("recent"), F.col("team"))).alias("fresh"))
    pool = terms.where("size > 1").join(strong, "term", "left_anti").join(of_term.where(F.col("groups") >= teams), "term")
    fresh = pool.orderBy(F.desc("fresh"), F.desc("groups"), "term").limit(limit - head).select("term", F.lit("fresh").alias("part"))
    both = strong.union(fresh)
    spare = terms.join(both, "term", "left_anti").orderBy(F.desc("termhood"), "term").limit(limit)
    n = both.agg((F.lit(limit) - F.count("*")).alias("_left"))
    spare = spare.withColumn("_n", F.row_number().over(by_termhood)).crossJoin(F.broadcast(n)).where("_n <= _left")  # one row
    return both.union(spare.select("term", F.lit("rest").alias("part")))


def admitted(terms: DataFrame, gate: DataFrame) -> DataFrame:
    """Terms of several words, and the single ones in ``gate``."""
    return terms.where("size > 1").unionByName(terms.where("size = 1").join(gate.select("term"), "term", "left_semi"))


def apart(group: list[int], terms: list[str]) -> list[list[int]]:
    """A group of like terms cut so that no part holds a term inside another, or two kinds of one thing."""
    parts: list[list[int]] = []
    for i in sorted(group, key=lambda i: terms[i]):
        clash = lambda j, t=terms[i]: names.within(t, terms[j]) or names.within(terms[j], t) or names.siblings(t, terms[j])
        home = next((p for p in parts if not any(map(clash, p))), None)
        if home is None:
            parts.append(home := [])
        home.append(i)
    return parts


def _grouped(labels: list[int]) -> list[list[int]]:
    found: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        found.setdefault(k, []).append(i)
    return list(found.values())


def synonyms(df: DataFrame, group: str = "direction", likeness: float = 0.90, most: int = 5000) -> DataFrame:
    """Each term's canonical form: clusters at a cosine of ``likeness`` or more, cut by ``apart``; the highest termhood, then most words, then the order of letters, names them.

    Rows: the group, term, size, termhood, vector; a group is a clustering budget, so ``most`` bounds it.
    """
    kind = dict(df.dtypes)[group]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError(f"{len(rows)} terms in one group, {most} allowed")
        rows = rows.sort_values("term").reset_index(drop=True)
        terms, hood, size = rows["term"].tolist(), rows["termhood"].tolist(), rows["size"].tolist()
        canonical = list(terms)
        for cluster in _grouped(average_linkage(np.array(rows["vector"].tolist(), float), 1 - likeness)):
            for part in apart(cluster, terms):
                best = min(part, key=lambda i: (-hood[i], -size[i], terms[i]))
                for i in part:
                    canonical[i] = terms[best]
        return pd.DataFrame({group: rows[group], "term": terms, "canonical": canonical})

    return df.select(group, "term", "size", "termhood", "vector").groupBy(group).applyInPandas(run, f"{group} {kind}, term string, canonical string")


def merged_postings(posts: DataFrame, canonical: DataFrame) -> DataFrame:
    """Postings of canonical terms: distinct documents, occurrences summed."""
    return posts.join(canonical, "term").groupBy(F.col("canonical").alias("term"), "doc").agg(F.sum("tf").cast("long").alias("tf"))


class _Term:
    def __init__(self, row):
        self.name, self.size, self.hood, self.tf, self.docs = row.term, row.size, row.termhood, row.tf, set(row.docs)
        self.df = len(self.docs)

    def stands(self) -> bool:
        return self.size > 1 and self.df >= NAMED

    def words(self) -> list[str]:
        return names.parts_of(self.name)


def _two_topics(a: _Term, b: _Term) -> bool:
    """Whether two terms cannot be one topic: kinds of one thing; a word that mostly occurs outside the name; names with a word in common that mostly occur apart."""
    if a.stands() and b.stands() and names.siblings(a.name, b.name):
        return True
    short, long = sorted((a, b), key=lambda t: t.size)
    if short.size < long.size and names.within(short.name, long.name):
        return short.size == 1 and long.stands() and long.df < SHARE * short.df
    if not (a.stands() and b.stands() and {*a.words()} & {*b.words()}):
        return False
    return len(a.docs & b.docs) < SHARE * min(a.df, b.df)


def _cut(cluster: list[int], terms: list[_Term], unit_vectors: np.ndarray) -> list[list[int]]:
    """A cluster as topics, strongest term first: each term joins the allowed topic whose first term is nearest."""
    topics: list[list[int]] = []
    for i in sorted(cluster, key=lambda i: (-terms[i].hood, terms[i].name)):
        open_ = [t for t in topics if not any(_two_topics(terms[i], terms[j]) for j in t)]
        if open_:
            max(open_, key=lambda t: (round(float(unit_vectors[i] @ unit_vectors[t[0]]), 12), -t[0])).append(i)
        else:
            topics.append([i])
    return topics


def _name_of(members: list[_Term], documents: int) -> _Term:
    """The member with the highest c-TF-IDF times termhood, in its full form where the literature uses that."""
    total = sum(m.tf for m in members) or 1
    weight = lambda m: round(m.tf / total * math.log1p(documents / max(1, m.df)) * m.hood, 9)
    best = min(members, key=lambda m: (-weight(m), -m.size, m.name))
    fuller = [m for m in members if m.size > best.size and m.name.endswith(" " + best.name)]
    fuller = fuller or [m for m in members if m.size > best.size and m.name.startswith(best.name + " ") and m.df >= SHARE * best.df]
    return min(fuller, key=lambda m: (-m.size, m.name), default=best)


def topics(df: DataFrame, group: str = "direction", distance: float = 0.35, documents: int = 1, most: int = 5000) -> DataFrame:
    """Terms as members of topics: the group, topic, term, role ('label', 'member' or 'head').

    Average-linkage clusters up to ``distance``; a single word that is the last word of a name of its own
    cluster and mostly occurs without it is a head, and left out; clusters are cut by ``_two_topics``. Rows:
    the group, term, size, termhood, tf, vector, docs (ids); a group is a clustering budget.
    """
    kind = dict(df.dtypes)[group]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError(f"{len(rows)} terms in one group, {most} allowed")
        rows = rows.sort_values("term").reset_index(drop=True)
        terms = [_Term(r) for r in rows.itertuples(index=False)]
        v = np.array(rows["vector"].tolist(), float)
        lengths = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.where(lengths > 0, lengths, 1)
        out: list[tuple] = []
        for cluster in _grouped(average_linkage(v, distance)):
            named = [terms[i] for i in cluster if terms[i].stands()]
            heads = {i for i in cluster if terms[i].size == 1 and any(n.words()[-1] == terms[i].name and n.df < SHARE * terms[i].df for n in named)}
            out += [(None, terms[i].name, "head") for i in heads]
            for part in _cut([i for i in cluster if i not in heads], terms, v):
                best = _name_of([terms[i] for i in part], documents)
                out += [(best.name, terms[i].name, "label" if terms[i] is best else "member") for i in part]
        made = pd.DataFrame(out, columns=["topic", "term", "role"])
        made.insert(0, group, rows[group].iloc[0])
        return made

    return df.select(group, "term", "size", "termhood", "tf", "vector", "docs").groupBy(group).applyInPandas(run, f"{group} {kind}, topic string, term string, role string")


def with_proposals(corpus: DataFrame, proposed: DataFrame) -> DataFrame:
    """Corpus topics, and proposed ones whose key the corpus does not have."""
    key = F.lower(F.trim(F.col("topic")))
    new = proposed.withColumn("_k", key).join(corpus.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return corpus.withColumn("origin", F.lit("corpus")).unionByName(new.withColumn("origin", F.lit("proposed")))


def coherence(members: DataFrame, items: DataFrame, pairs: int = 10, weights=(0.6, 0.4), alone: float = 0.5) -> DataFrame:
    """0.6 of the members' mean cosine to their centroid, 0.4 of the mean NPMI of the pairs that occur together most, from 0 to 1.

    ``members``: topic, term, vector; ``items``: doc, term (postings). Topics of one term take ``alone`` for
    the second part. A topic's members are a cluster, so their pairs are few.
    """
    v = members.select("topic", "term", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    near = v.join(centroids(v, "topic", "v"), "topic").groupBy("topic").agg(F.avg(cosine(F.col("v"), F.col("centroid"))).alias("c_emb"), F.count("*").alias("members"))
    m = members.select("topic", "term")
    posts = items.join(m.select("term").distinct(), "term", "left_semi")
    df = posts.select("doc", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(items.agg(F.countDistinct("doc").alias("n")))
    couples = m.select("topic", F.col("term").alias("a")).join(m.select("topic", F.col("term").alias("b")), "topic").where("a < b")
    couples = couples.join(cooccurrence(posts, "doc", "term"), ["a", "b"], "left").withColumn("pair_df", F.coalesce("pair_df", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("pair_df"), "a", "b"))
    best = couples.withColumn("place", place).where(F.col("place") <= pairs)
    best = best.join(df.select(F.col("term").alias("a"), F.col("df").alias("da")), "a", "left").join(df.select(F.col("term").alias("b"), F.col("df").alias("db")), "b", "left").crossJoin(n)  # one row
    value = npmi_of(F.col("pair_df"), F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0)), F.col("n"))
    mean = best.groupBy("topic").agg(F.avg(value).alias("npmi"))
    second = F.when(F.col("npmi").isNull(), alone).otherwise((F.col("npmi") + 1) / 2)
    j = near.join(mean, "topic", "left")
    return j.select("topic", "members", "c_emb", "npmi", clamp01(weights[0] * clamp01(F.col("c_emb")) + weights[1] * clamp01(second)).alias("coherence"))


def _key(label: Column) -> Column:
    return F.array_join(F.transform(T.words(F.coalesce(label, F.lit(""))), stem_english), " ")


def subject_relevance(subjects: DataFrame, phrases: list[str], stems: list[str] | None = None) -> DataFrame:
    """Of the documents that their source classifies the share of the direction's targets that their labels cover: doc, relevance.

    ``subjects``: doc, label, code, score. A score of 0 is no classification, a null one is. Targets are
    ``phrases`` (stems of words, matched as whole phrases); without them single ``stems``.
    """
    given = subjects.where("score is null or score > 0").select("doc", F.explode(F.array("label", "code")).alias("l")).where("l is not null").select("doc", _key(F.col("l")).alias("l"))
    targets = phrases or stems or []
    if not targets:
        return given.select("doc", F.lit(0.0).alias("relevance")).distinct()
    hits = F.array_compact(F.array(*[F.when(T.label_matches(F.col("l"), F.lit(t)), F.lit(t)) for t in targets]))
    found = given.select("doc", F.explode_outer(hits).alias("t"))
    return found.groupBy("doc").agg((F.countDistinct("t") / len(targets)).alias("relevance"))


def documents_in_direction(docs: DataFrame, relevance: DataFrame) -> DataFrame:
    return docs.join(relevance.where("relevance > 0").select("doc"), "doc", "left_semi")


def topic_relevance(posts: DataFrame, relevance: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """Per topic (topic, doc) the share of its classified documents that are in the direction; 0 without any.

    Where no document at all is classified, the mean cosine of the topic's documents to the query.
    """
    one = posts.select("topic", "doc").distinct()
    by_subject = one.join(relevance.select("doc", F.when(F.col("relevance") > 0, 1.0).otherwise(0.0).alias("x")), "doc", "left")
    by_subject = by_subject.groupBy("topic").agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("share"))
    near = cosine(F.transform("vector", lambda x: x.cast("double")), F.array(*[F.lit(float(x)) for x in query]))
    by_vector = one.join(vectors.select("doc", near.alias("c")), "doc").groupBy("topic").agg(F.avg("c").alias("mean"))
    known = F.broadcast(relevance.agg((F.count("*") > 0).alias("_known")))  # one row
    j = by_subject.join(by_vector, "topic", "left").crossJoin(known)
    return j.select("topic", F.when(F.col("_known"), F.col("share")).otherwise(F.coalesce("mean", F.lit(0.0))).alias("relevance"))


def direction_cut(base_rate: Column, lift: float = 2.0, cap: float = 0.5) -> Column:
    """The share from which a topic counts as the direction's: ``lift`` times the corpus' odds, ``cap`` at most."""
    odds = lift * base_rate / (1 - base_rate)
    return F.when(base_rate <= 0, 0.0).when(base_rate >= 1, cap).otherwise(F.least(odds / (1 + odds), F.lit(cap)))


def relevant(df: DataFrame, cut: Column, least: int = 60) -> DataFrame:
    """Topics whose relevance reaches the cut, and the most relevant others while there are fewer than ``least``."""
    kept = df.where(F.col("relevance") >= cut)
    n = kept.agg((F.lit(least) - F.count("*")).alias("_left"))
    order = [F.desc("relevance"), F.asc("topic")]
    spare = df.where(~F.coalesce(F.col("relevance") >= cut, F.lit(False))).orderBy(*order).limit(least)
    spare = spare.withColumn("_n", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(n)).where("_n <= _left").drop("_n", "_left")  # one row
    return kept.unionByName(spare)
