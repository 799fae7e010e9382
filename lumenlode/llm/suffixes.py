"""Repeated passages by enhanced suffix arrays, one for each anchor that windows of equal bytes must share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bucketed, drop, release, stash

#: Bytes of an anchor's own string, of text that is scanned at a time, and contexts that one suffix array holds.
ANCHOR, CHUNK, MOST = 100, 1 << 19, 8192

_BASE, _OTHER = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64."""
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (base, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Scanner:
    """For each window of ``length`` bytes, the anchor: the string of ANCHOR bytes in it with the least hash, the first of equals.

    That depends on the window's bytes alone, so equal windows have equal anchors at equal places.
    """

    def __init__(self, length: int):
        n = CHUNK + length + 1
        self.length, self.up, self.down = length, *_powers(_BASE, n)
        self.up2, self.down2 = _powers(_OTHER, n)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, anchor's place, first window, last window, anchor's hash, hash of the bytes of all its windows), by run of windows."""
        length, k, w = self.length, ANCHOR, self.length - ANCHOR + 1
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(data)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        zero = np.zeros(1, np.uint64)
        total = np.concatenate([zero, np.cumsum(data * self.down[:n])])
        m = n - k + 1
        hashes = _mixed((total[k:] - total[:m]) * self.up[k - 1 : n])
        order = (hashes & ~np.uint64((1 << 22) - 1)) | np.arange(m, dtype=np.uint64)
        rows = -(-m // w)
        padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:m] = order
        padded = padded.reshape(rows, w)
        before = np.minimum.accumulate(padded, axis=1).ravel()
        after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - w + 1
        owner = (np.minimum(after[:windows], before[w - 1 : w - 1 + windows]) & np.uint64((1 << 22) - 1)).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)[:windows]
        valid = np.arange(windows) + length <= ends[text]
        owner = np.where(valid, owner, -1)
        edge = np.flatnonzero((owner[1:] != owner[:-1]) | (text[1:] != text[:-1])) + 1
        first = np.concatenate([np.zeros(1, np.int64), edge])
        last = np.concatenate([edge, np.full(1, windows)]) - 1
        held = owner[first] >= 0
        first, last = first[held], last[held]
        at, doc = owner[first], text[first]
        total = np.concatenate([zero, np.cumsum(data * self.down2[:n])])
        until = last + length
        context = _mixed((total[until] - total[first]) * self.up2[until - 1] + (until - first).astype(np.uint64))
        start = (ends - sizes)[doc]
        return doc, at - start, first - start, last - start, hashes[at].view(np.int64), context.view(np.int64)


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """doc, pos, lo, hi, h, ch of each run of windows with one anchor in the texts (doc, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scanner(length)

        def scanned(docs: list, parts: list[bytes], offsets: list[int]) -> pa.RecordBatch:
            doc, *numbers, h, ch = scan(parts)
            moved = np.array(offsets, np.int64)[doc]
            cols = [pa.array(docs, pa.binary()).take(pa.array(doc)), *[pa.array(x + moved) for x in numbers], pa.array(h), pa.array(ch)]
            return pa.RecordBatch.from_arrays(cols, names=["doc", "pos", "lo", "hi", "h", "ch"])

        docs, parts, offsets, n = [], [], [], 0
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py().encode("utf-8", "surrogatepass")
                for at in range(0, len(t) - length + 1, CHUNK // 2):  # a longer text is cut where windows start
                    part = t[at : at + CHUNK // 2 + length - 1]
                    if n + len(part) > CHUNK:
                        yield scanned(docs, parts, offsets)
                        docs, parts, offsets, n = [], [], [], 0
                    docs.append(doc)
                    parts.append(part)
                    offsets.append(at)
                    n += len(part)
        if parts:
            yield scanned(docs, parts, offsets)

    return texts.select("doc", "t").mapInArrow(run, "doc binary, pos bigint, lo bigint, hi bigint, h bigint, ch bigint")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(prefixes: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The intervals of a suffix array by a stack scan of its common-prefix lengths: (length, first, last), ``least`` long or longer.

    ``prefixes[i]`` is common to the suffixes at i and i + 1 of the array. An interval's suffixes share
    exactly that many bytes, and no suffix beside it shares them.
    """
    stack = [(-1, 0)]
    for i, n in enumerate([*prefixes, -1]):
        first = i
        while stack[-1][0] > n:
            depth, first = stack.pop()
            if depth >= least:
                yield depth, first, i
        if stack[-1][0] < n:
            stack.append((n, first))


def maximal_repeats(contexts: list[bytes], at: list[int], length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Strings of ``length`` bytes or more around an anchor that occur in several contexts: (size, [(context, start)]).

    The suffixes that start at the anchor (``at[i]`` in context i) are sorted, with their common prefixes:
    an interval is a set of contexts that agree for ``depth`` bytes to the right. Inside it the reversed
    left parts are sorted and scanned alike; a set that agrees for so many bytes to the left that the
    whole is long enough is a repeat with all its occurrences. It is maximal to the left, being a whole
    interval, and is left out unless the bytes after it differ too.
    """
    rights = [c[a:] for c, a in zip(contexts, at, strict=True)]
    lefts = [c[:a][::-1] for c, a in zip(contexts, at, strict=True)]
    order = sorted(range(len(contexts)), key=rights.__getitem__)
    prefixes = [_common(rights[i], rights[j]) for i, j in zip(order, order[1:])]
    by_left = sorted(range(len(contexts)), key=lefts.__getitem__)
    rank = {i: k for k, i in enumerate(by_left)}
    longest = max(map(len, lefts), default=0)
    for depth, first, last in intervals(prefixes, max(1, length - longest)):
        inside = sorted(order[first : last + 1], key=rank.__getitem__)
        shared = [_common(lefts[i], lefts[j]) for i, j in zip(inside, inside[1:])]
        for left, i, j in intervals(shared, max(0, length - depth)):
            members = inside[i : j + 1]
            if len({rights[x][depth : depth + 1] for x in members}) > 1 or any(len(rights[x]) == depth for x in members):
                yield left + depth, [(x, at[x] - left) for x in members]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of the spans, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeats(texts: DataFrame, length: int, groups: bool = True) -> tuple[DataFrame, DataFrame]:
    """Maximal repeats among the texts (doc, t; each text once), and the runs of windows that have partners.

    Returns (spans, runs). runs: h, ch, doc, lo: the bytes from lo on of that doc form the context ch of
    anchor h. spans: h, ch, grp, s, e: the bytes s to e of every run with that context are an occurrence
    of the repeat grp of that anchor. Without ``groups`` the occurrences of a context are merged into
    disjoint spans, whose grp says nothing; that is a few rows per context, however repeats nest. A repeat is reported by anchor, clipped to the anchor's windows, so
    a longer one is the union of its anchors'. Equal contexts are one entry with a count; anchors with
    more than MOST different contexts are not put into one array: their windows are compared by digest,
    counted before they are shuffled.
    """
    found = stash(anchors(texts, length), "anchors")
    # written first, so that the join is not tied to the aggregation's partitions and a hot anchor can be split
    often = stash(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "often")
    runs = stash(found.join(often, "h"), "runs")
    drop(found, often)
    release(texts.sparkSession)
    kinds = runs.groupBy("h", "ch").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos", "lo", "hi")).alias("r"))
    several = kinds.groupBy("h").agg(F.count("*").alias("m"))
    kinds = stash(kinds.join(several, "h").select("h", "ch", "n", "m", "r.*"), "kinds")

    grp, zero = F.lit("copies").alias("grp"), F.lit(0).cast("bigint").alias("s")
    whole = kinds.where("n > 1").select("h", "ch", grp, zero, (F.col("hi") - F.col("lo") + length).alias("e"))
    part = F.substring(F.col("t").cast("binary"), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo") + length).cast("int"))
    wanted = kinds.where("m > 1").join(texts, "doc")
    contexts = stash(wanted.select("h", "ch", "n", "m", (F.col("pos") - F.col("lo")).cast("int").alias("at"), part.alias("bytes")), "contexts")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for h, members in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                members = sorted(members.as_py(), key=lambda x: x["ch"])
                own: list[list[tuple[int, int]]] = [[] for _ in members]
                rows = []
                for k, (size, where) in enumerate(maximal_repeats([x["bytes"] for x in members], [x["at"] for x in members], length)):
                    for i, start in where:
                        if groups:
                            rows.append((h, members[i]["ch"], f"{h}-{k}", start, start + size))
                        else:
                            own[i].append((start, start + size))
                            if len(own[i]) > 64:
                                own[i] = merged(own[i])
                rows += [(h, x["ch"], "", s, e) for x, spans in zip(members, own, strict=True) for s, e in merged(spans)]
                for c, values in zip(out, zip(*rows, strict=True), strict=False):
                    c.extend(values)
            kinds_of = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds_of, strict=True)], names=["h", "ch", "grp", "s", "e"])

    arrays = contexts.where(F.col("m") <= MOST).groupBy("h").agg(F.collect_list(F.struct("ch", "at", "bytes")).alias("members"))
    by_array = arrays.mapInArrow(scan, "h bigint, ch bigint, grp string, s bigint, e bigint")

    many = contexts.where(F.col("m") > MOST)
    starts = F.explode(F.sequence(F.lit(0), F.length("bytes") - length)).alias("s")
    windows = many.select("h", "ch", "n", "bytes", starts).select("h", "ch", "n", "s", F.unhex(F.md5(F.substring("bytes", F.col("s") + 1, F.lit(length)))).alias("d"))
    twice = windows.groupBy("h", "d").agg(F.count("*").alias("c")).where("c > 1").select("h", "d")
    by_digest = windows.join(twice, ["h", "d"]).select("h", "ch", F.hex("d").alias("grp"), F.col("s").cast("bigint"), (F.col("s") + length).cast("bigint").alias("e"))
    spans = stash(whole.union(by_array).union(by_digest), "spans")
    drop(contexts, kinds)
    slim = runs.select("h", "ch", "doc", "lo")
    slim._stash_path = runs._stash_path
    return spans, slim


def _spans_by_doc(texts: DataFrame, length: int, name: str) -> DataFrame:
    """doc and, as ``name``, the spans (s, e) of its bytes that strings of ``length`` bytes cover which also start elsewhere; written."""
    spans, runs = repeats(texts.select("doc", "t"), length, groups=False)
    # written first, so that a context with very many runs can be split among tasks of the join
    covered = stash(spans.groupBy("h", "ch").agg(F.array_distinct(F.collect_list(F.struct("s", "e"))).alias("own")), "covered")
    of_doc = runs.join(covered, ["h", "ch"]).select("doc", F.transform("own", lambda x: F.struct((x["s"] + F.col("lo")).alias("s"), (x["e"] + F.col("lo")).alias("e"))).alias("own"))
    out = stash(of_doc.groupBy("doc").agg(F.flatten(F.collect_list("own")).alias(name)), name)
    drop(spans, covered, runs)
    release(texts.sparkSession)
    return out


def remove_repeats(df: DataFrame, length: int = 400, text: str = "text", keep: list[str] | None = None, passage: int = 300) -> DataFrame:
    """Take out each byte that a string of ``length`` bytes covers which also starts anywhere else.

    Returns one row per row of ``df``: row (struct of ``keep``, all columns by default), n_bytes,
    n_removed, n_spans (maximal removed runs) and kept_sha256; and, as a report of what is repeated but may be
    too short to be removed, n_passages (maximal runs of bytes that strings of ``passage`` bytes cover which
    also start elsewhere: some fifty words) and passage_bytes. Texts are UTF-8 bytes, a null one none;
    matches never cross texts; what is repeated is judged on the input. Repeated rows are copies and lose
    every byte if they have ``length`` of them. An empty table gives no rows.

    Each different text is stored once, laid out by a digest, and scanned for anchors; only runs of
    windows whose anchor occurs twice go on.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    doc = F.substring(F.unhex(F.sha2(t, 256)), 1, 16)
    every = df.select(doc.alias("doc"), t.alias("t"))
    texts = bucketed(every.groupBy("doc").agg(F.first("t").alias("t"), F.count("*").alias("copies")), "doc", "texts")
    release(df.sparkSession)
    short = _spans_by_doc(texts, passage, "passages")
    long = _spans_by_doc(texts, length, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            rows = []
            for t, copies, own, more in zip(b.column(1), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                t = t.as_py().encode("utf-8", "surrogatepass")
                whole = lambda n, x: [(0, len(t))] if copies > 1 and len(t) >= n else merged([(y["s"], y["e"]) for y in x.as_py() or []])
                gone, shared = whole(length, own), whole(passage, more)
                kept, at = [], 0
                for s, e in gone:
                    kept.append(t[at:s])
                    at = e
                kept = b"".join([*kept, t[at:]])
                rows.append((len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), len(shared), sum(e - s for s, e in shared)))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"])

    done = texts.join(long, "doc", "left").join(short, "doc", "left").select("doc", "t", "copies", "spans", "passages")
    done = stash(done.mapInArrow(cut, "doc binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, passage_bytes bigint"), "cut")
    drop(short, long, texts)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row"), doc.alias("doc"))
    return rows.join(done, "doc").drop("doc")
