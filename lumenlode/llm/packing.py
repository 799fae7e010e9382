"""Packing documents into sequences of a fixed number of tokens: best fit, then swap-based local search."""

from __future__ import annotations

import gc
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, stash
from .tokens import tokenizer

#: Pieces that one task packs at a time, about.
BLOCK = 24_000


def _best_fit(lengths: list[int], order: list[int], size: int) -> list[list[int]]:
    """Best fit, longest first. ``open_``: bit r is set if some bin has r places left."""
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = defaultdict(list)
    open_ = 0
    for i in order:
        n = lengths[i]
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                open_ ^= 1 << room
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            with_room[room - n].append(b)
            open_ |= 1 << (room - n)
    return bins


class _Search:
    """Bins with room to spare, and their pieces by length.

    An exchange takes one or two pieces (or none: a move) out of a bin and puts in a longer one of an
    emptier bin, so that the squared fill of the two rises; bins that are left with nothing vanish.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.lengths, self.size = bins, lengths, size
        self.fill = [sum(lengths[i] for i in b) for b in bins]

    def run(self, target: int, passes: int | None) -> None:
        """Until the bins are ``target`` or no exchange helps (every one raises the squared fill, so there is an end), or for so many passes."""
        for _ in count() if passes is None else range(passes):
            alive = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.size), key=lambda b: (-self.fill[b], b))
            n_bins = sum(f > 0 for f in self.fill)
            if n_bins <= target or len(alive) < 2:
                return
            # donors: the emptiest bins; as many as could be emptied, and a few more
            donors = alive[-max(4, 2 * (n_bins - target)) :]
            if not self._pass([b for b in alive if b not in set(donors)] + donors[:-1], donors):
                return

    def _pass(self, takers: list[int], donors: list[int]) -> bool:
        gained, lengths = False, self.lengths
        place = {b: k for k, b in enumerate(donors)}  # the later, the emptier
        singles: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length: (bin, piece)
        mask = 0
        for b in donors:
            for i in self.bins[b]:
                singles[lengths[i]].append((b, i))
                mask |= 1 << lengths[i]
        for taker in takers:
            while (room := self.size - self.fill[taker]) and (found := self._best(taker, room, singles, mask, place)):
                out, (donor, into) = found
                for i in out:
                    self.bins[taker].remove(i)
                self.bins[donor].remove(into)
                self.bins[taker].append(into)
                self.bins[donor].extend(out)
                gain = lengths[into] - sum(lengths[i] for i in out)
                self.fill[taker] += gain
                self.fill[donor] -= gain
                singles[lengths[into]].remove((donor, into))
                if not singles[lengths[into]]:
                    mask &= ~(1 << lengths[into])
                for i in out:
                    singles[lengths[i]].append((donor, i))
                    mask |= 1 << lengths[i]
                if taker in place:  # a donor that also takes: its own pieces changed
                    singles[lengths[into]].append((taker, into))
                    mask |= 1 << lengths[into]
                    for i in out:
                        singles[lengths[i]].remove((taker, i))
                        if not singles[lengths[i]]:
                            mask &= ~(1 << lengths[i])
                gained = True
        return gained

    def _best(self, taker: int, room: int, singles, mask: int, place: dict[int, int]):
        """The exchange that fills most of ``room``: pieces out, (bin, piece) in."""
        own, lengths, best, most = self.bins[taker], self.lengths, None, 0
        rank = place.get(taker, -1)
        by_length: dict[int, list[int]] = defaultdict(list)
        for i in own:
            by_length[lengths[i]].append(i)
        some = list(by_length.values())  # pieces of one length are alike
        outs = [()] + [(p[0],) for p in some] + [(p[0], q[0]) for k, p in enumerate(some) for q in some[k + 1 :]] + [(p[0], p[1]) for p in some if len(p) > 1]
        for out in outs:
            base = sum(lengths[i] for i in out)
            fits = mask & ((1 << (base + room + 1)) - 1) & ~((1 << (base + most + 1)) - 1)
            while fits:
                n = fits.bit_length() - 1
                donor = next(((b, i) for b, i in reversed(singles[n]) if b != taker and place[b] > rank and self.fill[b] <= self.fill[taker]), None)
                if donor:
                    best, most = (out, donor), n - base
                    break
                fits ^= 1 << n
            if most == room:
                break
        return best


def pack_block(lengths: list[int], size: int, passes: int | None = None) -> list[list[int]]:
    """Indexes of ``lengths`` (1 to ``size`` each) in as few bins as the search finds, none over ``size``."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins = _best_fit(lengths, order, size)
    search = _Search(bins, lengths, size)
    search.run(-(-sum(lengths) // size), passes)
    return [b for b in search.bins if b]


def pieces(df: DataFrame, path: str, size: int, id_col: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Each text's ids and ``end_id``, cut into pieces of ``size``: id, piece, start, length, ids_crc32."""
    schema = df.select(id_col).schema.simpleString()[7:-1] + ", piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # strings and bytes by the million, but no cycles
        ids_of, end = tokenizer(path), end_id.to_bytes(4, "little")
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), ids_of(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    return df.select(id_col, text).mapInArrow(run, schema)


def pack(
    df: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text: str = "text", end_id: int = 0
) -> DataFrame:
    """Pack all texts into sequences of at most ``size`` tokens, cutting only texts that are longer.

    Returns one row per piece: the id column, piece, start, length, ids_crc32, sequence_id, offset. A
    null or empty text is the single ``end_id``; repeated rows are packed apart; a null id is kept; an
    empty table gives no rows; other columns are ignored.

    Pieces are dealt evenly to blocks, whatever their ids, and each block is packed by one task: best
    fit, then local search until the block's lower bound is reached or no exchange helps. The bins of a
    block that are left with much room are opened again and pooled with those of other blocks, until one
    block holds them all (or a level settles less than three pieces of ten), so that blocks cost no sequences. Full
    pieces are sequences already.
    """
    schema = "tag bigint, sequence_id bigint, offset bigint, length bigint, room bigint"

    def packer(level: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("tag")
            lengths, tags = table.column("length").to_pylist(), table.column("tag").to_pylist()
            out: list[list[int]] = [[], [], [], [], []]
            for k, members in enumerate(pack_block(lengths, size)):
                at, room = 0, size - sum(lengths[i] for i in members)
                for i in members:
                    for c, v in zip(out, (tags[i], (level << 58) | (key[0].as_py() << 28) | k, at, lengths[i], room), strict=True):
                        c.append(v)
                    at += lengths[i]
            names = ["tag", "sequence_id", "offset", "length", "room"]
            return pa.table([pa.array(c, pa.int64()) for c in out], names=names)

        return run

    cut = stash(pieces(df, path, size, id_col, text, end_id).withColumn("tag", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == size).select(
        "tag", (-F.col("tag") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    left, placed, level = cut.where(F.col("length") < size).select("tag", "length"), full, 0
    n = left.count()
    stashed = [cut]
    while n:
        blocks = -(-n // BLOCK)
        dealt = left.withColumn("block", F.pmod(F.xxhash64("tag"), F.lit(blocks)))
        packed = stash(dealt.groupBy("block").applyInArrow(packer(level), schema), "level")
        stashed.append(packed)
        loose = F.col("room") * 32 > size
        open_again = packed.where(loose)
        m = open_again.count() if blocks > 1 else 0
        if blocks == 1 or m > 0.7 * n:
            placed = placed.union(packed.select("tag", "sequence_id", "offset"))
            break
        placed = placed.union(packed.where(~loose).select("tag", "sequence_id", "offset"))
        left, n, level = open_again.select("tag", "length"), m, level + 1
    out = stash(cut.join(placed, "tag").select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), "packed")
    drop(*stashed)
    return out
