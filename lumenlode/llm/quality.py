"""Quality rules as weak supervision: rules vote or abstain, and the posterior of a label model decides."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stash, while_read
from .tables import literal_table

WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters with one mark after it at most.
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}+[.,;:]?(?![^\x20\x09-\x0D])"
WINDOW = 8
GOOD, BAD, ABSTAIN = 1, 0, 2
SURE, PRIOR = 8, 1000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Places that the windows whose hash occurs twice or more cover together."""

    def repeated(pairs: Column) -> Column:
        same = lambda p, k: F.get(pairs, k)["h"].eqNullSafe(p["h"])
        twice = F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1))
        at = F.sort_array(F.transform(twice, lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, start, step, lambda s: s["n"])

    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)


def measures(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) as a struct ``row``, and of each text what the rules look at."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row"),
        t.alias("t"),
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    n = F.size("w")
    rows = rows.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("wh", i, WINDOW)))
    rows = rows.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit("[A-Z]{2,}")).cast("long").alias("n_capitals"),
        F.regexp_count("t", F.lit(PLAIN)).cast("long").alias("n_plain"),
        F.regexp_count("t", F.lit(r"[.!?]")).cast("long").alias("n_stops"),
        F.size(F.array_distinct("wh")).cast("long").alias("n_distinct"),
        F.when(n >= WINDOW, windows).alias("windows"),
    )
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    return rows.select(
        *[c for c in rows.columns if c != "windows"],
        F.when(twice, _covered(F.col("windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def rules() -> dict[str, tuple[Column, Column]]:
    """Each rule: when it votes that a text is bad, and when that it is good; otherwise it abstains."""
    c, never = F.col, F.lit(False)
    n, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    mean, symbols, plain, stops = c("word_chars") / n, c("n_symbols") / n, c("n_plain") / n, c("n_stops") / n
    long = c("n_words") >= 50
    return {
        "length": (c("n_words") < 20, c("n_words") >= 50),
        "word_length": ((mean < 2.5) | (mean > 8.5), (mean >= 3.5) & (mean <= 7.5)),
        "symbols": (symbols > 0.1, never),
        "plain_words": (plain < 0.7, plain > 0.9),
        "duplicate_lines": (c("n_dup_lines") / lines > 0.3, never),
        "repeated_words": (c("n_repeat_words") / n > 0.25, never),
        "capitals": (c("n_capitals") / n > 0.3, never),
        "stops": ((stops < 0.01) & long | (stops > 0.7), (stops >= 0.03) & (stops <= 0.4)),
        "distinct_words": ((c("n_distinct") / n < 0.2) & (n < 2000), (c("n_distinct") / n > 0.35) & long),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Expectation maximisation over vote patterns and their counts; the posterior that a text is good, by pattern.

    Given the class, rules vote (good, bad or abstain) independently. A rule's chance of each vote in
    each class starts at what is expected of any rule and is re-estimated with that expectation as prior;
    a vote against a text stays at least ``SURE`` times as likely for a bad text as for a good one, so
    that the classes cannot change places. The expectation counts as ``PRIOR`` texts at most, and as a fiftieth of
    a small table, so it fades as the table grows.
    """
    total = sum(n for _, n in patterns)
    width = len(patterns[0][0]) if patterns else 0
    expected = {GOOD: {GOOD: 0.7, BAD: 0.02, ABSTAIN: 0.28}, BAD: {GOOD: 0.3, BAD: 0.4, ABSTAIN: 0.3}}
    prior, chance = 0.85, {y: [dict(p) for _ in range(width)] for y, p in expected.items()}

    def posterior(votes: tuple[int, ...]) -> float:
        odds = log(prior / (1 - prior)) + sum(log(chance[GOOD][j][v] / chance[BAD][j][v]) for j, v in enumerate(votes))
        return 1 / (1 + exp(-max(-500.0, min(500.0, odds))))

    for _ in range(rounds if total else 0):
        each = [(votes, n, posterior(votes)) for votes, n in patterns]
        weight = min(0.02 * total, PRIOR) + 2
        for y in (GOOD, BAD):
            mass = [(votes, n * (p if y == GOOD else 1 - p)) for votes, n, p in each]
            whole = sum(m for _, m in mass)
            for j in range(width):
                seen = {v: sum(m for votes, m in mass if votes[j] == v) for v in (GOOD, BAD, ABSTAIN)}
                chance[y][j] = {v: (seen[v] + weight * expected[y][v]) / (whole + weight) for v in seen}
        for j in range(width):
            good, bad = chance[GOOD][j], chance[BAD][j]
            if bad[BAD] < SURE * good[BAD]:
                rest = (1 - bad[BAD] / SURE) / (1 - good[BAD])  # the other votes of good texts, so that all sum to 1
                chance[GOOD][j] = {BAD: bad[BAD] / SURE, GOOD: good[GOOD] * rest, ABSTAIN: good[ABSTAIN] * rest}
        prior = (sum(n * p for _, n, p in each) + weight * 0.85) / (total + weight)
    return {votes: posterior(votes) for votes, _ in patterns}


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Measures, votes and verdict for each row of ``df``: row (struct of ``keep``), the measures, quality, base_failed, kept.

    ``quality`` is the posterior probability that the text is good under the label model fitted to this
    table's votes; a text is kept if it is at least ``threshold`` and the two base rules (20 words; at
    most 30 % of words in repeated windows) hold. A null text counts as empty, and an empty one fails; a
    row's other columns may be null or named like anything; repeated rows are judged alike; an empty
    table gives no rows. Only counts per vote pattern (3 ** rules at most) reach the driver.
    """
    spark, named = df.sparkSession, rules()
    votes = [F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN) for bad, good in named.values()]
    code = sum((v * 3**j for j, v in enumerate(votes)), F.lit(0))
    rows = while_read(stash(measures(df, text, keep).withColumn("votes", code), "measures"))
    counts = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    digits = {k: tuple(k // 3**j % 3 for j in range(len(named))) for k in counts}
    quality = fit([(digits[k], n) for k, n in sorted(counts.items())])
    table = literal_table(spark, [{"votes": k, "quality": quality[d]} for k, d in digits.items()], "votes int, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        rows.join(F.broadcast(table), "votes")  # 3 ** rules rows at most
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= threshold))
    )
