"""Pairs of items that share a key of their prefixes: an exact similarity join whose index travels as packed records.

Every item (a line, a text) is a set of grams, and similar items have many grams in common. All sets are
put in one order; then two similar sets share a gram among the first few of each (their prefixes), so that
only these are indexed. Any order will do, and the best one puts common grams last: a gram's rank is the
count of its slot in a sample of bounded size. The sample decides how many pairs are compared, never which
are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import drop, release, stash

#: Slots of the table of ranks (a byte each, few enough for a processor's cache), those that are kept at most, and documents that are sampled at most.
SLOTS, KEPT, SAMPLE = 1 << 22, 300_000, 20_000
#: Groups of a key beyond this size are first compared with so many leaders only, unless they have WIDEST members at most, of which FEW pairs a member may be similar.
WIDE, LEADERS, WIDEST, FEW = 32, 8, 512, 4
#: Keys that one task holds, about; members of a common key that one task holds at most, by estimate.
BUCKET, HOT = 1 << 19, 500_000


class Ranks:
    """How common grams are, from 0 (rare) to 15, by their slots."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray, scale: float):
        self.slots, self.counts, self.scale = slots, counts, scale

    def _table(self) -> np.ndarray:
        table = np.zeros(SLOTS, np.uint8)
        table[self.slots] = np.minimum(np.log2(np.maximum(self.counts, 1)).astype(np.int64), 15)
        return table

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        if not hasattr(self, "table"):
            self.table = self._table()
        return self.table[grams >> np.uint64(42)]

    def members(self, grams: np.ndarray) -> np.ndarray:
        """How many items of the whole table have the gram, at most about; 1 where the sample says little."""
        return np.where((r := self(grams)) >= 3, np.exp2(r + 1.0) * self.scale, 1.0)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}


def ranks(df: DataFrame, text: str, grams_of: Callable[[list], np.ndarray]) -> Ranks:
    """Counted over a sample of ``df`` by hash of the text, of about SAMPLE rows; ``grams_of``: the grams of some texts."""
    n = df.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = df.where(F.pmod(F.xxhash64(F.lit("sample"), text), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(text).dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots, counts = np.unique((grams_of(b.column(0).to_pylist()) >> np.uint64(42)).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts.astype(np.int64))], names=["slot", "n"])

    counted = sample.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), "slot").limit(KEPT).toArrow()  # KEPT rows of 12 bytes
    return Ranks(top.column("slot").to_numpy(), top.column("n").to_numpy(), 1 / share)


def record(marks: int, wide: bool) -> np.dtype:
    """An entry of the index: 32 bits of a key, an item's id and size, and so many times 64 marks that bound how far two items differ."""
    return np.dtype([("key", "<u4"), ("id", "<i8"), ("size", "<u4" if wide else "<u2")] + [("marks", "<u8", (marks,))] * (marks > 0))


def packed(kind: np.dtype, buckets: int, passes: int, nth: int, grams: np.ndarray, members: np.ndarray, item: np.ndarray, **of_item: np.ndarray) -> pa.RecordBatch:
    """The records of a batch, one blob per bucket; ``members``: see ``Ranks``. Members of a key too common for one task are cut into parts, and each two parts meet in a bucket."""
    bucket = (grams >> np.uint64(32)) % np.uint64(buckets * passes)
    if passes > 1:
        mine = bucket % np.uint64(passes) == nth
        grams, members, item, bucket = grams[mine], members[mine], item[mine], bucket[mine]
    parts = np.ceil(members / HOT).astype(np.int64)
    if parts.size and parts.max() > 1:
        many = parts > 1
        own = of_item["id"][item[many]] % parts[many]
        again = np.repeat(np.flatnonzero(many), parts[many])
        other = np.concatenate([np.arange(p) for p in parts[many]])
        own = np.repeat(own, parts[many])
        low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
        spread = (bucket[again] + (low * np.uint64(0x9E3779B1) + high + np.uint64(1)) * np.uint64(passes)) % np.uint64(buckets * passes)
        # a key of its own for each two parts, as buckets may fall together
        keyed = grams[again] ^ ((low << np.uint64(16)) + high + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        grams, item, bucket = (np.concatenate([x[~many], y]) for x, y in ((grams, keyed), (item, item[again]), (bucket, spread)))
    out = np.empty(len(grams), kind)
    order = np.argsort(bucket, kind="stable")
    bucket, item = bucket[order], item[order]
    out["key"] = (grams[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out["id"], out["size"] = of_item["id"][item], np.minimum(of_item["size"], np.iinfo(kind["size"]).max)[item]
    if "marks" in kind.names:
        out["marks"] = of_item["marks"][item]
    cuts = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else np.zeros(0, np.int64)
    firsts = np.concatenate([np.zeros(1, np.int64), cuts])[: len(bucket)]
    data, ends = out.tobytes(), np.concatenate([firsts, [len(bucket)]]) * kind.itemsize
    blobs = pa.array([data[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket[firsts].astype(np.int64)), blobs], names=["bucket", "blob"])


class _Bounds:
    """What sizes and marks say about two records, the first of which is no longer; a size at the top of its range may be any beyond."""

    def __init__(self, r: np.ndarray, edits: Callable[[np.ndarray], np.ndarray] | None, similarity: float):
        self.size, self.top = r["size"].astype(np.int64), np.iinfo(r.dtype["size"]).max
        self.marks, self.edits, self.similarity = r["marks"] if "marks" in r.dtype.names else None, edits, similarity

    def fits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.size[i] >= self.similarity * self.size[j] - 1e-9) | (self.size[j] == self.top)

    def passes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.marks is None:
            return np.ones(len(i), bool)
        differ = np.bitwise_count(self.marks[i] ^ self.marks[j]).sum(axis=1, dtype=np.int64)
        longer = self.size[j] - self.size[i]  # so many edits are insertions at least, each of which changes one mark, not two
        return (differ <= 2 * self.edits(self.size[j]) - longer) | (self.size[j] == self.top)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys start and end."""
    starts = np.concatenate([np.zeros(min(1, len(key)), np.int64), np.flatnonzero(key[1:] != key[:-1]) + 1])
    return starts, np.concatenate([starts[1:], np.full(min(1, len(key)), len(key))])


def meeting(r: np.ndarray, edits: Callable | None, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of the records with equal keys whose sizes and marks leave the similarity possible, and the records of wide groups.

    Of a wide group's pairs only those with a few leaders are among them; see ``across`` for the others. Wide
    are groups of over WIDEST records, and those of over WIDE in which more than FEW pairs a record are possible.
    """
    r = r[np.argsort(r["key"])]
    twice = np.zeros(len(r), bool)
    if len(r):
        same = r["key"][1:] == r["key"][:-1]
        twice[1:] |= same
        twice[:-1] |= same
    r = r[twice]
    r = r[np.lexsort((r["id"], r["size"], r["key"]))]
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r["key"][1:] != r["key"][:-1]) | (r["id"][1:] != r["id"][:-1])
    r = r[fresh]
    ids, bounds = r["id"], _Bounds(r, edits, similarity)
    starts, ends = _groups(r["key"])
    end, group = np.repeat(ends, ends - starts), np.repeat(np.arange(len(starts)), ends - starts)
    room = np.where(ends - starts > WIDE, FEW * (ends - starts), len(r) ** 2)  # for pairs
    room[ends - starts > WIDEST] = -1
    met, i, gap = [], np.flatnonzero(room[group] >= 0), 0
    while len(i):
        gap += 1
        i = i[i + gap < end[i]]
        i = i[bounds.fits(i, i + gap)]  # sizes ascend: what does not fit now never will
        x = i[bounds.passes(i, i + gap)]
        met.append((x, x + gap))
        np.subtract.at(room, group[x], 1)
        i = i[room[group[i]] >= 0]
    wide = (room < 0)[group]
    found = [(ids[x[~wide[x]]], ids[y[~wide[x]]]) for x, y in met]
    alone = np.flatnonzero(wide)
    for _ in range(LEADERS):  # in every wide group at once
        if not len(alone):
            break
        first = np.concatenate([np.ones(1, bool), np.diff(group[alone]) != 0])
        z, x = alone[first][np.cumsum(first) - 1][~first], alone[~first]
        ours = bounds.fits(z, x) & bounds.passes(z, x)  # z is the shortest left
        found.append((ids[z[ours]], ids[x[ours]]))
        alone = x[~ours]
    return *_distinct(found), r[wide]


def across(r: np.ndarray, key: np.ndarray, root: np.ndarray, edits: Callable | None, similarity: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the records with equal keys but different roots whose sizes and marks leave the similarity possible.

    In each group the records outside its commonest root are compared with all others; with ``most`` each
    until it has so many pairs with longer ones, and with shorter ones.
    """
    order = np.lexsort((r["id"], r["size"], key))
    r, key, root = r[order], key[order], root[order]
    starts, ends = _groups(key)
    start, end = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
    by_root = np.lexsort((root, start))
    runs, run_ends = _groups_of_two(start[by_root], root[by_root])
    longest = np.lexsort((runs - run_ends, start[by_root][runs]))  # of each group the longest run first
    firsts = np.unique(start[by_root][runs][longest], return_index=True)[1] if len(runs) else np.zeros(0, np.int64)
    common = np.repeat(root[by_root][runs][longest][firsts], ends - starts) if len(runs) else root
    odd, ids, bounds = root != common, r["id"], _Bounds(r, edits, similarity)
    found, up, down, gap = [], np.flatnonzero(odd), np.flatnonzero(odd), 0
    n_up, n_down = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
    while len(up) or len(down):
        gap += 1
        up = up[up + gap < end[up]]
        up = up[bounds.fits(up, up + gap)]
        x = up[root[up] != root[up + gap]]
        x = x[bounds.passes(x, x + gap)]
        found.append((ids[x], ids[x + gap]))
        n_up[x] += 1
        down = down[down - gap >= start[down]]
        down = down[bounds.fits(down - gap, down)]
        x = down[~odd[down - gap]]
        x = x[bounds.passes(x - gap, x)]
        found.append((ids[x - gap], ids[x]))
        n_down[x] += 1
        if most is not None:
            up, down = up[n_up[up] < most], down[n_down[down] < most]
    return _distinct(found)


def _groups_of_two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    starts = np.concatenate([np.zeros(min(1, len(a)), np.int64), new])
    return starts, np.concatenate([starts[1:], np.full(min(1, len(a)), len(a))])


def _distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = map(np.concatenate, zip(*found))
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    starts, _ = _groups_of_two(a[order], b[order])
    return a[order][starts], b[order][starts]


_MET = "a bigint, b bigint, key bigint, record binary"


def candidates(records: Callable[[int], DataFrame], kind: np.dtype, passes: int, edits: Callable | None, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All passes over the index; ``records(k)``: bucket and blob of the pass k. Returns the pairs (a < b, each once) and the records of wide groups (id, key, record)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b, wide = meeting(np.frombuffer(b"".join(table.column("blob").to_pylist()), kind), edits, similarity)
        n, m = len(a), len(wide)
        data = wide.tobytes()
        cols = [
            pa.array(np.concatenate([a, wide["id"]])),
            pa.array(np.concatenate([b, np.zeros(m, np.int64)]), mask=np.concatenate([np.zeros(n, bool), np.ones(m, bool)])),
            pa.array((key[0].as_py() << 32) + np.concatenate([np.zeros(n, np.int64), wide["key"].astype(np.int64)])),
            pa.array([None] * n + [data[i : i + kind.itemsize] for i in range(0, len(data), kind.itemsize)], pa.binary()),
        ]
        return pa.table(cols, names=["a", "b", "key", "record"])

    parts = []
    for k in range(passes):
        parts.append(stash(records(k).groupBy("bucket").applyInArrow(run, _MET), "met"))
        release(parts[0].sparkSession)
    met = parts[0]
    for p in parts[1:]:
        met = met.union(p)
    pairs = stash(met.where("b is not null").select("a", "b").distinct(), "pairs")
    wide = stash(met.where("b is null").select(F.col("a").alias("id"), "key", "record"), "wide")
    drop(*parts)
    release(pairs.sparkSession)
    return pairs, wide


def connecting(pairs: DataFrame, wide: DataFrame, kind: np.dtype, edits: Callable | None, similarity: float, alike: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges a, b that connect whatever the similar ones of all pairs with a key in common connect; ``alike`` keeps the similar ones of pairs a < b.

    Members of wide groups have been compared with leaders only. They are now compared with each other where
    what was found so far does not connect them: first each with a few, as what these connect need not be
    compared any more, then with all others.
    """
    links, tried = stash(alike(pairs), "links"), [pairs]
    for most in () if wide.isEmpty() else (1, None):
        tree = components(links)
        roots = stash(tree.distinct(), "roots")
        drop(tree)
        rooted = wide.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "record", F.coalesce("root", "id").alias("root"))

        def run(bucket: tuple, table: pa.Table) -> pa.Table:  # pickled before ``most`` changes
            r = np.frombuffer(b"".join(table.column("record").to_pylist()), kind)
            a, b = across(r, table.column("key").to_numpy(), table.column("root").to_numpy(), edits, similarity, most)
            return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

        rest = rooted.withColumn("bucket", F.shiftright("key", 32)).groupBy("bucket").applyInArrow(run, "a bigint, b bigint").distinct()
        for t in tried:
            rest = rest.join(t, ["a", "b"], "left_anti")
        rest = stash(rest, "rest")
        tried.append(rest)
        drop(roots)
        if not rest.isEmpty():
            more = stash(links.union(alike(rest)), "links")
            drop(links)
            links = more
    drop(wide, *tried)
    release(links.sparkSession)
    return links
