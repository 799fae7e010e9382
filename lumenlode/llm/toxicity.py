"""Toxicity scores by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TABLE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: str | None) -> set[bytes]:
    """The different words of a text: A-Z lowered, other ASCII than letters and digits blank."""
    return set((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


class Model:
    """A linear score of the words that a text has, trained in numpy."""

    def __init__(self, bias: float = 0.0, weights: dict[bytes, float] | None = None):
        self.bias, self.weights = bias, weights or {}

    def score(self, text: str | None) -> float:
        get = self.weights.get
        x = self.bias + sum(w for w in map(get, words_of(text)) if w is not None)
        return 1 / (1 + exp(-max(-500.0, min(500.0, x))))


def fit(positive: list[set[bytes]], unlabelled: list[set[bytes]], prior: float, rounds: int = 300, decay: float = 2e-4, seed: int = 0) -> Model:
    """Minimise the non-negative estimate of the risk: prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)).

    With the logistic loss, full batches and Adam. Where the second term is negative, the step ascends it
    instead (the unlabelled risk is being overfitted). Words are inputs if the two samples differ in them.
    """
    if not positive or not unlabelled:
        return Model(log(prior / (1 - prior)))
    ours, theirs = Counter(w for s in positive for w in s), Counter(w for s in unlabelled for w in s)
    n, m = len(positive), len(unlabelled)

    def differs(w: bytes) -> bool:
        """By five standard errors of the difference of two shares: what differs less is mostly chance."""
        pooled = (ours[w] + theirs[w]) / (n + m)
        return ours[w] + theirs[w] >= 5 and abs(ours[w] / n - theirs[w] / m) >= 5 * (pooled * (1 - pooled) * (1 / n + 1 / m)) ** 0.5 > 0

    vocabulary = sorted(w for w in ours.keys() | theirs.keys() if differs(w))
    number = {w: i for i, w in enumerate(vocabulary)}

    def rows(sets: list[set[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        cols = [np.array(sorted(number[w] for w in s if w in number), np.int64) for s in sets]
        return np.concatenate(cols), np.repeat(np.arange(len(sets)), [len(c) for c in cols])

    n_features = len(vocabulary)
    (pc, pr), (uc, ur) = rows(positive), rows(unlabelled)
    w, b = np.zeros(n_features), log(prior / (1 - prior))
    first, second, t = np.zeros(n_features + 1), np.zeros(n_features + 1), 0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(rounds):
        zp = sigmoid(np.bincount(pr, w[pc], len(positive)) + b)
        zu = sigmoid(np.bincount(ur, w[uc], len(unlabelled)) + b)
        loss = lambda z: -np.log(np.maximum(1 - z, 1e-12)).mean()
        negative = loss(zu) - prior * loss(zp)
        dp, du = np.zeros(len(positive)), zu / len(unlabelled)
        if negative >= 0:
            dp = prior * (zp - 1) / len(positive) - prior * zp / len(positive)
        else:
            du, dp = -du, prior * zp / len(positive)
        grad = np.concatenate([np.bincount(pc, dp[pr], n_features) + np.bincount(uc, du[ur], n_features) + decay * w, [dp.sum() + du.sum()]])
        t += 1
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return Model(float(b), {x: float(v) for x, v in zip(vocabulary, w, strict=True) if abs(v) > 1e-3})


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; so is a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most_positive: int = 4000, most_unlabelled: int = 8000) -> Model:
    """Fit on confirmed toxic texts and on unlabelled ones, none of them held out.

    The class prior is the share of toxic rows among the labelled ones that are not held out. Of either
    kind a sample by hash of the id is taken, of ``most_positive`` confirmed and ``most_unlabelled`` other
    ids: the bounds of what the driver holds; every text is scored. A null text has no words, a null id or
    label is left out; of an id that comes twice the text with the least hash counts; without rows of either
    kind every score is the prior.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(~held_out(F.col("id")) & F.col("y").isNotNull())
    n, toxic = known.agg(F.count("*"), F.sum("y")).first()
    prior = min(0.9, max(0.001, (toxic or 0) / n)) if n else 0.05
    by_hash = F.xxhash64(F.lit("sample"), "id")
    positive = known.where("y = 1").select("id").distinct().orderBy(by_hash, "id").limit(most_positive)
    others = docs.select(F.col(id_col).alias("id")).where(~held_out(F.col("id"))).distinct()
    others = others.join(known.where("y = 1").select("id").distinct(), "id", "left_anti").orderBy(by_hash, "id").limit(most_unlabelled)
    ids = positive.withColumn("y", F.lit(1)).union(others.withColumn("y", F.lit(0)))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(F.broadcast(ids), "id")  # a bounded number of ids
    sample = sample.groupBy("id", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.col("t"))).alias("t"))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [b" ".join(sorted(words_of(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["y", "words"])

    found: dict[int, list[set[bytes]]] = {0: [], 1: []}
    shared: dict[bytes, bytes] = {}  # one object for each word
    rows = sample.orderBy("id").select("y", "t").mapInArrow(distinct_words, "y int, words binary")
    for r in rows.toLocalIterator():
        found[r["y"]].append({shared.setdefault(w, w) for w in bytes(r["words"]).split()})
    return fit(found[1], found[0], prior)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row's score from 0 to 1: row (struct of ``keep``, all columns but the text by default) and score.

    A null or empty text has no words and is scored like any other; repeated rows score alike; an empty
    table gives no rows; columns may be named like anything.
    """
    names = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("t"))
    schema = rows.select("row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores], names=["row", "score"])

    return rows.mapInArrow(run, schema)
