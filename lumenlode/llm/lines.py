"""Fuzzy line deduplication: normalised lines, keys that similar lines must share, edit similarity, connected groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .pairs import BUCKET, Ranks, candidates, connecting, packed, ranks, record
from .store import drop, release, stash

#: Words whose keys are made at a time: few enough for a processor's cache; texts that are split into lines at a time.
AT_ONCE, TEXTS = 1 << 16, 1024
#: Records of the index of lines, and the counters that their marks are parities of.
KIND, COUNTERS = record(2, wide=False), 128


#: Normal form: ASCII letters lower, other ASCII but digits and line ends blank; runs of blanks then become one.
_TABLE = bytes(c if c > 127 or c == 10 or chr(c).isalnum() else 32 for c in range(256)).lower()


def normalised(text: str | None) -> list[bytes]:
    """The normal form of each line of a text, empty for a line without words."""
    lines = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n")
    return [b" ".join(x.split()) for x in lines]


def _text_and_key(id_col: str, text: str) -> tuple[Column, Column]:
    """The text, and a key of the row's id and text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return t, F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), t)))


def _digest(norm: bytes) -> bytes:
    return hashlib.md5(norm, usedforsecurity=False).digest()


def _prefix(n: int, similarity: float) -> int:
    """Of the n - 1 pairs of words of a line of n words, so many must be keys for every similar line to share one.

    An edit changes two pairs of words at most. So lines of n <= m words within d edits share m - 1 - 2 d
    pairs, and the first 2 d - (m - n) + 1 pairs of the shorter, 2 d + 1 of the longer, in any order that
    is the same for all lines, have one in common.
    """
    most, m = 1, n
    while m - (d := int((1 - similarity) * m + 1e-9)) <= n and m <= n + 2 / (1 - similarity):  # beyond, the least is long past
        most, m = max(most, 2 * d - (m - n) + 1), m + 1
    return most


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the lines, and each line's number of words."""
    each = [x.split(b" ") for x in lines]
    n = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(each)), np.uint64, int(n.sum())), n


def _pairs_of(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbouring words of the lines, and the line of each."""
    line = np.repeat(np.arange(len(n)), n)
    inside = line[1:] == line[:-1]
    return _mixed(_mixed(h[:-1]) + h[1:])[inside], line[1:][inside]


def grams_of(texts: list[str | None], min_words: int) -> np.ndarray:
    """The pairs of words of the different lines of ``min_words`` words or more of some texts."""
    found = list({x for t in texts for x in normalised(t) if x.count(b" ") >= min_words - 1 and x})
    return _pairs_of(*_hashes(found))[0]


def _keys(lines: list[bytes], similarity: float, ranked: Ranks) -> tuple[np.ndarray, ...]:
    """Keys of some lines, the members and the line of each, and the lines' words and marks.

    Keys are the first of a line's pairs of words (see ``_prefix``) in the order of rank and hash, each with
    its number among the same pairs of the line. Marks are the parities of COUNTERS counters of words: an
    edit changes two of them at most.
    """
    h, n = _hashes(lines)
    line = np.repeat(np.arange(len(n)), n)
    odd = np.bincount(line * COUNTERS + (h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS * len(n)).reshape(-1, COUNTERS) & 1
    marks = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<u8")
    pair, line = _pairs_of(h, n)
    order = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (ranked(pair).astype(np.uint64) << np.uint64(40)) | (pair >> np.uint64(24)))
    pair, at = pair[order], np.arange(len(order))
    new_line = np.diff(line, prepend=-1) != 0  # lines are in sequence before and after
    sizes, of_size = np.unique(n, return_inverse=True)
    wanted = np.array([_prefix(k, similarity) for k in sizes.tolist()], np.int64)[of_size]
    keep = at - np.maximum.accumulate(np.where(new_line, at, 0)) < wanted[line]
    new_pair = new_line | (np.diff(pair, prepend=np.uint64(0)) != 0)
    nth = at - np.maximum.accumulate(np.where(new_pair, at, 0))
    return _mixed(pair + nth.astype(np.uint64))[keep], ranked.members(pair[keep]), line[keep], n, marks


def lines_of(df: DataFrame, id_col: str, text: str, min_words: int, similarity: float, ranked: Ranks) -> DataFrame:
    """Each line with a word: at, doc, nth, line (md5 of the normal form), words_n; and, once for each batch that has a line of ``min_words`` words or more, its marks, keys and members (null where all are 1)."""
    t, key = _text_and_key(id_col, text)
    rows = df.select(F.col(id_col).alias("at"), key.alias("doc"), t.alias("t"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    more = [null("int", "nth"), null("binary", "line"), null("int", "words_n"), null("binary", "marks"), null("binary", "keys"), null("binary", "members")]
    schema = rows.select("at", "doc", *more).schema

    def part(b: pa.RecordBatch, seen: set[bytes]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        row, nth, which = [], [], []
        for i, t in enumerate(b.column(2)):
            for k, norm in enumerate(normalised(t.as_py())):
                if norm:
                    row.append(i)
                    nth.append(k)
                    which.append(number.setdefault(norm, len(number)))
        found = list(number)
        digests, sizes = [_digest(x) for x in found], [x.count(b" ") + 1 for x in found]
        fresh = [d not in seen for d in digests]
        seen.update(digests)
        marks, keys, members = [None] * len(found), [None] * len(found), [None] * len(found)
        some, n = [], 0
        for i, size in enumerate(sizes):
            if size >= min_words and fresh[i]:
                some.append(i)
                n += size
            if some and (n >= AT_ONCE or i == len(found) - 1):
                k, common, line, _, m = _keys([found[x] for x in some], similarity, ranked)
                ends = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(some)))]).tolist()
                data, hot, many = k.tobytes(), common.astype("<f4").tobytes(), (np.bincount(line, common > 1, len(some)) > 0).tolist()
                for at, x in enumerate(some):
                    marks[x], keys[x] = m[at].tobytes(), data[8 * ends[at] : 8 * ends[at + 1]]
                    members[x] = hot[4 * ends[at] : 4 * ends[at + 1]] if many[at] else None
                some, n = [], 0
        taken, of = pa.array(row, pa.int64()), np.array(which, np.int64)
        again = np.ones(len(of), bool)
        again[np.unique(of, return_index=True)[1]] = False
        once = pa.array(of, mask=again)  # null for a line's later places
        cols = [b.column(0).take(taken), b.column(1).take(taken), pa.array(nth, pa.int32()), pa.array(digests, pa.binary()).take(pa.array(of)), pa.array(sizes, pa.int32()).take(pa.array(of))]
        cols += [pa.array(x, pa.binary()).take(once) for x in (marks, keys, members)]
        return pa.RecordBatch.from_arrays(cols, names=["at", "doc", "nth", "line", "words_n", "marks", "keys", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[bytes] = set()
            yield from (part(b.slice(k, TEXTS), seen) for k in range(0, b.num_rows, TEXTS))

    return rows.mapInArrow(run, schema)


def index_of(lines: DataFrame, buckets: int, passes: int, nth_pass: int) -> DataFrame:
    """bucket and blob: the records of the lines with keys for one of the passes. A line's id is the head of its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = b.column(3).to_pylist()
            keys = np.frombuffer(b"".join(each), "<u8")
            n = np.fromiter(map(len, each), np.int64, len(each)) // 8
            members = np.frombuffer(b"".join(m if m is not None else b"\0\0\x80\x3f" * k for m, k in zip(b.column(4).to_pylist(), n.tolist())), "<f4")
            marks = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u8").reshape(len(each), -1)
            ids = np.frombuffer(b"".join(x[:8] for x in b.column(0).to_pylist()), "<i8")
            yield packed(KIND, buckets, passes, nth_pass, keys, members, np.repeat(np.arange(len(each)), n), id=ids, size=b.column(1).to_numpy(), marks=marks)

    return lines.where("keys is not null").select("line", "words_n", "marks", "keys", "members").mapInArrow(run, "bucket bigint, blob binary")


def _edits(similarity: float):
    return lambda size: np.floor((1 - similarity) * size + 1e-9).astype(np.int64)


def word_distance(a: list, b: list) -> int:
    """Levenshtein distance of two word sequences, by bit vectors over the first (Hyyroe's form of Myers' method)."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    mask, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0  # where the column rises and falls
    for w in b:
        same = places.get(w, 0)
        either = same | down
        across = (((same & up) + up) ^ up) | same
        rise = (down | ~(across | up)) & mask
        fall = up & across
        score += bool(rise & last) - bool(fall & last)
        rise = (rise << 1 | 1) & mask
        fall = fall << 1 & mask
        up, down = (fall | ~(either | rise)) & mask, rise & either
    return score


def signature(words: list[bytes]) -> bytes:
    """Parities of 512 counters of words, of which an edit changes two at most."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.packbits((np.bincount(((h >> np.uint64(32)) & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).tobytes()


def wanted_lines(df: DataFrame, text: str, ids: DataFrame, few: int) -> DataFrame:
    """id, line, words_n, marks (see ``signature``) and norm of the lines whose id is in ``ids``, each line once.

    Up to ``few`` ids are sent to the tasks (8 bytes each), so that other lines stay where they are.
    """
    known = np.sort(ids.toArrow().column("id").to_numpy()) if ids.count() <= few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            found = list({x for t in b.column(0) for x in normalised(t.as_py()) if x})
            digests = [_digest(x) for x in found]
            heads = np.frombuffer(b"".join(d[:8] for d in digests), "<i8")
            if known is not None:
                at = np.flatnonzero(np.isin(heads, known))
                heads, digests, found = heads[at], [digests[i] for i in at], [found[i] for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["id", "line", "norm"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [x.split(b" ") for x in b.column(2).to_pylist()]
            marks = np.frombuffer(b"".join(map(signature, words)), "<i8").reshape(-1, 8)
            cols = [pa.array(list(map(len, words)), pa.int32()), *[pa.array(marks[:, k].copy()) for k in range(8)]]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["id", "line", "norm", "words_n", *[f"m{k}" for k in range(8)]])

    found = df.select(text).mapInArrow(run, "id bigint, line binary, norm binary")
    once = (found if known is not None else found.join(ids, "id")).groupBy("line").agg(F.first("id").alias("id"), F.first("norm").alias("norm"))
    return once.select("id", "line", "norm").mapInArrow(signed, "id bigint, line binary, norm binary, words_n int, " + ", ".join(f"m{k} bigint" for k in range(8)))


def possible(found: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Pairs of lines x < y whose ids are a pair of ``found`` and whose lengths and signatures leave the similarity possible."""
    names = ["line", "words_n", *[f"m{k}" for k in range(8)]]
    x, y = (lines.select(F.col("id").alias(c), F.struct(*names).alias(s)) for c, s in (("a", "x"), ("b", "y")))
    differ = sum((F.bit_count(F.col(f"x.m{k}").bitwiseXOR(F.col(f"y.m{k}"))) for k in range(8)), F.lit(0))
    short, long = F.least("x.words_n", "y.words_n"), F.greatest("x.words_n", "y.words_n")
    edits = F.floor((1 - similarity) * long + 1e-9)
    met = found.join(x, "a").join(y, "b").where((differ <= 2 * edits - (long - short)) & (long - short <= edits) & (F.col("x.line") != F.col("y.line")))
    return met.select(F.least("x.line", "y.line").alias("x"), F.greatest("x.line", "y.line").alias("y")).distinct()


def verified(found: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs x, y of lines whose texts (line, norm) have the edit similarity: 1 - distance / words of the longer."""
    a, b = texts.select(F.col("line").alias("x"), F.col("norm").alias("p")), texts.select(F.col("line").alias("y"), F.col("norm").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [[s.split(b" ") for s in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in ("p", "q")]
            keep = []
            for x, y in zip(*words, strict=True):
                edits = (1 - similarity) * max(len(x), len(y)) + 1e-9
                keep.append(len({*x} ^ {*y}) <= 2 * edits and word_distance(x, y) <= edits)  # an edit changes two words of the sets at most
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return found.join(a, "x").join(b, "y").select("x", "y", "p", "q").mapInArrow(run, "x binary, y binary")


def duplicate_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_words: int = 4,
    similarity: float = 0.8,
    broadcast_rows: int = 1_000_000,
    passes: int = 6,
) -> DataFrame:
    """The lines to remove: doc (key of a row's id and text), removed (line numbers from 0, ascending).

    Lines are equal if their normal forms are (A-Z lowered, runs of other ASCII than letters and digits as
    one blank); lines of ``min_words`` words or more are also linked if their edit similarity (1 - Levenshtein
    distance in words / words of the longer) is ``similarity`` (0.7 or more) or more. Every such pair is found:
    they share a key (see ``_prefix``). At 0.8 a line of three words or fewer has no other like it. Of each
    connected group the first occurrence stays (by id, a null first, then key and line). Lines without
    words stay. Rows alike in id and text are one document.

    The index of keys is shuffled in ``passes`` parts, one after the other, so that less lies on disk at a time.
    """
    spark = df.sparkSession
    ranked = ranks(df, text, lambda texts: grams_of(texts, min_words))
    release(spark)
    every = stash(lines_of(df, id_col, text, min_words, similarity, ranked), "lines")
    one = stash(every.groupBy("line").agg(F.min(F.struct("at", "doc", "nth")).alias("first"), F.first("words_n").alias("words_n")), "distinct")
    release(spark)
    words = one.where(F.col("words_n") >= min_words).agg(F.sum("words_n")).first()[0] or 0
    buckets = max(16, int(words * (1 - similarity) * 2 / passes / BUCKET))
    met, wide = candidates(lambda k: index_of(every, buckets, passes, k), KIND, passes, _edits(similarity), similarity)
    occurrences = stash(every.select("at", "doc", "nth", "line"), "occurrences")
    drop(every)

    ids = met.select(F.col("a").alias("id")).union(met.select("b")).union(wide.select("id")).distinct()
    ids = stash(ids, "ids")
    lines = stash(wanted_lines(df, text, ids, broadcast_rows), "wanted")
    drop(ids)
    release(spark)
    same = []

    def alike(found: DataFrame) -> DataFrame:
        """As ids, for ``connecting``; the pairs of lines are put by."""
        near = stash(possible(found, lines, similarity), "possible")
        same.append(stash(verified(near, lines.select("line", "norm"), similarity), "alike"))
        drop(near)
        release(spark)
        x, y = (lines.select(F.col("line").alias(c), F.col("id").alias(i)) for c, i in (("x", "a"), ("y", "b")))
        return same[-1].join(x, "x").join(y, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    joined = connecting(met, wide, KIND, _edits(similarity), similarity, alike)
    edges = same[0]
    for e in same[1:]:
        edges = edges.union(e)
    tree = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = tree.withColumnRenamed("node", "line")
    drop(lines, joined, *same)
    release(spark)

    placed = one.join(roots, "line", "left").select("line", "first", F.coalesce("root", "line").alias("root"))
    stays = placed.groupBy("root").agg(F.min("first").alias("stays"))
    of_line = placed.select("line", "root").join(stays, "root").select("line", "stays")
    gone = occurrences.select("line", F.struct("at", "doc", "nth").alias("here")).join(of_line, "line").where(~F.col("here").eqNullSafe(F.col("stays")))
    removed = gone.select("here.doc", "here.nth").distinct().groupBy("doc").agg(F.array_sort(F.collect_list("nth")).alias("removed"))
    removed = stash(removed, "removed")  # all that stays on the disks
    drop(one, occurrences, tree)
    release(spark)
    return removed


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """Each row of ``df`` without its duplicate lines: row (struct of ``keep``, all columns by default), kept_text, n_lines, n_removed.

    A null text counts as empty and has one line, which stays; a text of one very long line is a line like
    any other; an empty table gives no rows. Every row comes back, its columns named like anything.
    """
    removed = duplicate_lines(df, id_col, text, **options)
    t, key = _text_and_key(id_col, text)
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
    rows = df.select(row.alias("row"), key.alias("doc"), F.split(t, "\n").alias("lines"))
    rows = rows.join(removed, "doc", "left")
    n = F.size("lines")
    # the runs of lines between one removed line and the next
    gaps = F.zip_with(
        F.concat(F.array(F.lit(-1)), "removed"),
        F.concat("removed", F.array(n)),
        lambda i, j: F.slice("lines", i + 2, F.greatest(j - i - 1, F.lit(0))),
    )
    kept = F.when(F.col("removed").isNull(), F.col("lines")).otherwise(F.flatten(gaps))
    return rows.select(
        "row", F.array_join(kept, "\n").alias("kept_text"), n.cast("long").alias("n_lines"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
    )
