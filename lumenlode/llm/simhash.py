"""Near-duplicate documents by SimHash, found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .pairs import BUCKET, Ranks, candidates, connecting, packed, ranks, record
from .store import drop, release, stash

#: Records of the index of texts.
KIND = record(0, wide=True)

#: Shingles whose bits are spread out at a time: 64 bytes each.
_AT_ONCE = 1 << 15


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of so many words, repeats included; A-Z are lowered first."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: splits at 0x20, 0x09-0x0D, lowers A-Z only
    if not w:
        return []
    h, line = xxhash.xxh64_intdigest, b" ".join(w)
    if len(w) <= words:
        return [h(line, 42)]
    ends = list(accumulate(map(len, w), lambda at, n: at + n + 1))
    starts = [0, *(x + 1 for x in ends[: -words])]
    return [h(line[i:j], 42) for i, j in zip(starts, ends[words - 1 :], strict=True)]


def fingerprints(each: list[list[int]]) -> np.ndarray:
    """A 64-bit fingerprint of each list of hashes: a bit is 1 if it is set in over half of them; none give 0."""
    out = np.zeros(len(each), np.uint64)
    one = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))

    def flush(rows: list[int], of: list[list[int]]) -> None:
        hashes = np.fromiter((x for h in of for x in h), np.uint64, sum(map(len, of)))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sizes = np.array([len(h) for h in of])
        votes = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
        out[rows] = ((votes * 2 > sizes[:, None]) * one).sum(axis=1, dtype=np.uint64)

    rows, of, n = [], [], 0
    for i, h in enumerate(each):
        if len(h) > _AT_ONCE:
            votes = np.zeros(64, np.int64)
            for k in range(0, len(h), _AT_ONCE):
                part = np.array(h[k : k + _AT_ONCE], np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
                votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = ((votes * 2 > len(h)) * one).sum(dtype=np.uint64)
        elif h:
            rows.append(i)
            of.append(h)
            n += len(h)
            if n >= _AT_ONCE:
                flush(rows, of)
                rows, of, n = [], [], 0
    if rows:
        flush(rows, of)
    return out


def with_fingerprint(df: DataFrame, words: int = 5, text: str = "text", name: str = "fp") -> DataFrame:
    """``df`` (names without dots) with the fingerprint of ``text`` as a signed long in place of ``text``."""
    rest = [c for c in df.columns if c != text]
    columns = [F.col(f"`{c}`") for c in rest]
    schema = df.select(*columns, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            fps, hashes, n = [], [], 0
            for t in texts:
                hashes.append(shingle_hashes(t.as_py(), words))
                n += len(hashes[-1])
                if n >= 4 * _AT_ONCE:
                    fps.append(fingerprints(hashes))
                    hashes, n = [], 0
            fps.append(fingerprints(hashes))
            cols = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(fps).view(np.int64))], names=[*rest, name])

    return df.select(*columns, text).mapInArrow(run, schema)


def _ball(segment, width: int, radius: int):
    """The values of ``width`` bits within ``radius`` flips of ``segment``, as an array column."""
    from itertools import combinations

    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: segment.bitwiseXOR(m))


def links(fps: DataFrame, bits: int = 3, segments: int = 2, reach: tuple[int, int] = (0, 1), name: str = "fp") -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in ``bits`` bits or fewer, each pair once.

    Multi-index hashing: one of the segments differs in at most bits // segments places. Each fingerprint
    is entered in a table of each segment under the values within reach[0] flips, and looked up under
    those within reach[1]; what meets is verified by the whole distance. Every pair is found if the two
    reaches add up to bits // segments; with less, pairs whose flips are spread most evenly may be missed.
    """
    edges = [64 * s // segments for s in range(segments + 1)]
    one = fps.select(F.col(name).alias("x")).where("x is not null").distinct()

    def entries(flips: int, x: str) -> DataFrame:
        each = []
        for s, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            value = F.shiftrightunsigned("x", i).bitwiseAND(F.lit((1 << (j - i)) - 1).cast("long"))
            part = one.select("x", F.lit(s).alias("segment"), value.alias("part"))
            each.append(part.select("x", "segment", F.explode(_ball(F.col("part"), j - i, flips)).alias("value")))
        out = each[0]
        for e in each[1:]:
            out = out.union(e)
        return out.withColumnRenamed("x", x)

    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= bits
    meet = ["segment", "value"]
    # a plan knows nothing of how many values a ball has, and would send the larger side through the driver
    found = entries(reach[0], "x").join(entries(reach[1], "y").hint("merge"), meet).where((F.col("x") < F.col("y")) & near)
    return found.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, words: int = 5, bits: int = 3, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Group documents whose SimHash fingerprints are linked, directly or through others.

    Returns one row per row of ``df``: the id column, fp (signed long), component_id (the least id of the
    component; rows with a null id belong to components like any other and get the least non-null id, or
    null if there is none). A null text counts as empty; an empty text has fingerprint 0 and links like
    any other. Repeated rows come back repeated; an empty table gives none; other columns are left out.
    Links are sought between distinct fingerprints only, so a group of copies costs one fingerprint.
    """
    fps = stash(with_fingerprint(df.select(id_col, text), words, text), "fp")
    one = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(fps, bits))
    placed = one.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    labels = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.select("fp", "root").join(labels, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(id_col, "fp", "component_id")


def _sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The different shingle hashes of each text, ascending."""
    return [np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in texts]


def _index_of(df: DataFrame, words: int, similarity: float, ranked: Ranks, buckets: int, passes: int, nth: int) -> DataFrame:
    """bucket and blob of the texts (id, t; each id once in a batch): the first (1 - similarity) n + 1 of a set of n shingles, by rank and hash, are its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pa.array(np.unique(b.column(0).to_numpy(), return_index=True)[1]))
            sets = _sets(b.column(1).to_pylist(), words)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            grams, item = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), size)
            order = np.lexsort((grams, ranked(grams), item))
            grams, at = grams[order], np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
            keep = at < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)[item]
            grams, item = grams[keep], item[keep]
            yield packed(KIND, buckets, passes, nth, grams, ranked.members(grams), item, id=b.column(0).to_numpy(), size=size)

    return df.select("id", "t").mapInArrow(run, "bucket bigint, blob binary")


def _marked(df: DataFrame, words: int) -> DataFrame:
    """Of the texts (id, key, t), which may come more than once, id, key, size and the parities of 1024 counters of shingles, of which a shingle changes one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pa.array(np.unique(b.column(0).to_numpy(), return_index=True)[1])) if b.num_rows else b
            sets = _sets(b.column(2).to_pylist(), words)
            odd = [np.bincount((h & np.uint64(1023)).astype(np.int64), minlength=1024) & 1 for h in sets]
            marks = pa.array([np.packbits(x.astype(np.uint8)).view(np.int64) for x in odd], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, sets)), pa.int32()), marks], names=["id", "key", "size", "marks"])

    found = df.select("id", "key", "t").mapInArrow(run, "id bigint, key binary, size int, marks array<bigint>")
    return found.groupBy("key").agg(F.first("id").alias("id"), F.first("size").alias("size"), F.first("marks").alias("marks"))


def _possible(found: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """Pairs x < y of texts whose ids are a pair of ``found`` and whose sizes and parities leave the similarity possible."""
    x, y = (marked.select(F.col("id").alias(c), F.struct("key", "size", "marks").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    differ = F.aggregate(F.zip_with("x.marks", "y.marks", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    most = (F.col("x.size") + F.col("y.size")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    met = found.join(x, "a").join(y, "b").where((differ <= most) & (F.col("x.key") != F.col("y.key")))
    return met.select(F.least("x.key", "y.key").alias("x"), F.greatest("x.key", "y.key").alias("y")).distinct()


def _similar(found: DataFrame, texts: DataFrame, words: int, similarity: float, broadcast_rows: int) -> DataFrame:
    """The pairs x, y of texts (key, t; maybe more than once) whose shingle sets have the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([h.view(np.int64) for h in _sets(b.column(1).to_pylist(), words)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["key", "s"])

    wanted = stash(found.select(F.col("x").alias("key")).union(found.select("y")).distinct(), "keys")
    few = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted  # 16 bytes each
    sets = texts.join(few, "key", "left_semi").select("key", "t").mapInArrow(run, "key binary, s array<bigint>")
    sets = stash(sets.groupBy("key").agg(F.first("s").alias("s")), "shingles")
    drop(wanted)
    release(found.sparkSession)
    a, b = sets.select(F.col("key").alias("x"), F.col("s").alias("p")), sets.select(F.col("key").alias("y"), F.col("s").alias("q"))
    both = F.size(F.array_intersect("p", "q"))
    out = stash(found.join(a, "x").join(b, "y").where(both >= similarity * (F.size("p") + F.size("q") - both) - 1e-9).select("x", "y"), "similar")
    drop(sets)
    return out


def one_of_each(
    df: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    bits: int = 3,
    id_col: str = "doc_id",
    text: str = "text",
    broadcast_rows: int = 1_000_000,
    passes: int = 1,
) -> DataFrame:
    """``df`` with one row of each group of near copies, the one with the least id (a null first).

    Texts are linked if their sets of shingles have a Jaccard similarity of ``similarity`` or more, and
    groups are what links connect. Texts without words, null ones included, are one group. Of repeated rows
    one is kept; an empty table gives none; all columns come back, named like anything.

    Pairs are sought twice. Fingerprints that differ in ``bits`` bits at most meet by multi-index hashing;
    as that alone finds 72 to 95 % of the pairs (the fewer the nearer they are to the similarity), all texts
    also meet by the prefixes of their sets (see ``pairs``), which leaves no similar pair out. Both kinds are
    verified on the sets.
    """
    spark = df.sparkSession
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    names = [F.col(f"`{c}`") for c in df.columns]
    whole = df.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), key.alias("key"))
    rows = stash(with_fingerprint(df.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text).alias("t")), words, "t"), "rows")
    head = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    one = rows.groupBy("key", "id").agg(F.first("fp").alias("fp"), F.count("*").alias("times"))
    one = one.groupBy("key").agg(F.first("fp").alias("fp"), F.min(F.struct("id", "times")).alias("least"))
    one = stash(one.withColumn("n", head), "texts")
    drop(rows)
    release(spark)
    texts = whole.select("key", head.alias("id"), F.col("row")[text].alias("t"))  # copies are met again, but no text is moved

    fps = one.groupBy("fp").agg(F.min("n").alias("n"))
    near = links(fps, bits).join(fps.select(F.col("fp").alias("a"), F.col("n").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("n").alias("y")), "b")
    same = fps.withColumnRenamed("n", "x").join(one.select("fp", F.col("n").alias("y")), "fp").where("x <> y")
    close = stash(near.select("x", "y").union(same.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "close")
    release(spark)

    ranked = ranks(df.select(F.col(text).alias("t")), "t", lambda t: np.concatenate([*_sets(t, words), np.zeros(0, np.uint64)]))
    release(spark)
    letters = df.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
    buckets = max(16, int(letters / 6 * (1 - similarity) / passes / BUCKET))
    met, wide = candidates(lambda k: _index_of(texts, words, similarity, ranked, buckets, passes, k), KIND, passes, None, similarity)
    both = stash(met.union(close).distinct(), "both")
    drop(met, close)
    ids = stash(both.select(F.col("a").alias("id")).union(both.select("b")).union(wide.select("id")).distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= broadcast_rows else ids  # 8 bytes each
    marked = stash(_marked(texts.join(few, "id"), words), "marked")
    drop(ids)
    release(spark)
    found = []

    def alike(some: DataFrame) -> DataFrame:
        """As ids, for ``connecting``; the pairs of texts are put by."""
        possible = stash(_possible(some, marked, similarity), "possible")
        found.append(_similar(possible, texts, words, similarity, broadcast_rows))
        drop(possible)
        release(spark)
        x, y = (marked.select(F.col("key").alias(c), F.col("id").alias(i)) for c, i in (("x", "a"), ("y", "b")))
        return found[-1].join(x, "x").join(y, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    joined = connecting(both, wide, KIND, None, similarity, alike)
    edges = found[0]
    for e in found[1:]:
        edges = edges.union(e)
    tree = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    roots = tree.withColumnRenamed("node", "key")
    drop(marked, joined, *found)
    placed = one.join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    stays = placed.groupBy("root").agg(F.min(F.struct("least.id", "key", "least.times")).alias("s"))
    stays = stash(stays.select(F.col("s.key").alias("k"), F.col("s.id").alias("i"), F.col("s.times").alias("times")), "stays")
    drop(one, tree)
    release(spark)
    kept = lambda some: whole.join(some, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    out = kept(stays.where("times = 1")).select("row.*")
    again = stays.where("times > 1")
    return out if again.isEmpty() else out.union(kept(again).dropDuplicates(["key", "id"]).select("row.*"))
