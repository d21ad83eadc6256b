"""Packing of token sequences: dominance reduction on the histogram of lengths, then best fit.

Documents are encoded, an end id is appended, and only a document longer than the capacity is cut, into pieces of
the capacity, of which the first may be shorter. Lengths are at most the capacity, so an instance of any
number of pieces is its histogram, and bins of like content are one pattern with a number of copies:
what the driver holds is bounded by the capacity, whatever the size of the corpus.

Reduction (Martello and Toth): a set that holds item j dominates if the other members of every feasible set with j
can be put into the places of its members. Fixed for good, as often as the histogram allows, are: j with an item that
fills the bin exactly; j alone if nothing fits beside it; j with the largest item x that fits and the largest
item b that fits beside both (or none), if at most two items fit beside j and no two items larger than b fit together;
j with x if at most two fit and x is no smaller than any pair that fits. Each fixing shrinks the instance and may let
others follow. The remainder is packed by best fit, largest lengths first.

A piece's place follows from its rank among the pieces of its length. Tasks number their own pieces as they encode them;
sums over tasks turn these numbers into ranks. No window or group holds the pieces of one length.

Null texts count as empty: a piece of the end id alone. Rows with null or repeated doc_ids are packed like others,
extra columns are not read, an empty table gives no rows. Which of several pieces of like length gets which place is open.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, tables

#: Content of a bin: (length, times) for each length in it; and the number of such bins
Pattern = tuple[tuple[tuple[int, int], ...], int]


def dominating(h: np.ndarray, capacity: int, j: int) -> tuple[int, ...] | None:
    """A set with an item of length j that dominates every other one, or None. h: number of items by length."""
    room = capacity - j
    free = h[: room + 1].copy()
    if j <= room:
        free[j] -= 1
    there = np.flatnonzero(free)
    if not len(there):
        return (j,)
    x = int(there[-1])
    if x == room:
        return (j, x)

    def least(above: int, k: int) -> list[int]:
        """The k smallest items longer than `above` that fit beside j."""
        out: list[int] = []
        for s in there[there > above].tolist():
            out += [s] * min(k - len(out), int(free[s]))
            if len(out) == k:
                break
        return out

    small = least(0, 3)
    if len(small) == 3 and sum(small) <= room:
        return None
    free[x] -= 1
    beside = np.flatnonzero(free[: room - x + 1])
    b = int(beside[-1]) if len(beside) else 0
    free[x] += 1
    two = least(b, 2)
    if len(two) < 2 or sum(two) > room:
        return (j, x, b) if b else (j, x)
    best = 0
    for a in there.tolist():
        free[a] -= 1
        pair = np.flatnonzero(free[: max(room - a, 0) + 1])
        best = max(best, a + int(pair[-1])) if len(pair) else best
        free[a] += 1
    return (j, x) if x >= best else None


def reduce(h: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """Bins that are fixed by dominance, and the histogram of what is left."""
    h, fixed, again = h.copy(), [], True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while h[j] and (got := dominating(h, capacity, j)):
                need = Counter(got)
                copies = min(int(h[s]) // t for s, t in need.items())
                for s, t in need.items():
                    h[s] -= copies * t
                fixed.append((tuple(need.items()), copies))
                again = True
    return fixed, h


def best_fit(h: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit of items by falling length: each goes to the fullest bin that has room, like bins in one step."""
    by_room: dict[int, list[Pattern]] = {}

    def put(bins: tuple, room: int, copies: int) -> None:
        if copies:
            by_room.setdefault(room, []).append((bins, copies))

    for s in range(capacity, 0, -1):
        n = int(h[s])
        for room in sorted(r for r in by_room if r >= s):
            t, waiting = room // s, by_room.pop(room) if n else []
            for bins, copies in waiting:  # once begun, a bin is the fullest until it has no room for s
                full = min(copies, n // t)
                put((*bins, (s, t)), room - t * s, full)
                copies, n = copies - full, n - full * t
                if copies and n:
                    put((*bins, (s, n)), room - n * s, 1)
                    copies, n = copies - 1, 0
                put(bins, room, copies)
        t = capacity // s
        put(((s, t),), capacity - t * s, n // t)
        if n % t:
            put(((s, n % t),), capacity - (n % t) * s, 1)
    return [p for groups in by_room.values() for p in groups]


def plan(h: np.ndarray, capacity: int) -> list[Pattern]:
    fixed, rest = reduce(h, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """Where the piece of a length and rank goes: sequence and offset."""

    def __init__(self, patterns: list[Pattern]):
        rows, used, base = [], Counter(), 0
        for bins, copies in patterns:
            offset = 0
            for s, t in bins:
                rows.append((s, used[s], t, base, offset))
                used[s] += copies * t
                offset += s * t
            base += copies
        self.size, self.first, self.times, self.base, self.offset = (np.array(x, np.int64) for x in (zip(*sorted(rows), strict=True) if rows else [()] * 5))
        self.key = self.size << 44 | self.first
        self.sequences = base

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, size << 44 | rank, side="right") - 1
        at = rank - self.first[i]
        return self.base[i] + at // self.times[i], self.offset[i] + size * (at % self.times[i])


def pieces(docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 (and ids) of each piece, with the task (part) that made it and its number (k) among the task's pieces of that length."""
    tables.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = bpe.encoder(bpe.ByteBpe, path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                flat, ends = enc.encode_column(batch.column(1))
                ids = memoryview(np.insert(flat, ends, end_id).astype("<u4").tobytes())
                n = np.diff(ends, prepend=0) + 1
                count = -(-n // capacity)
                doc, piece = np.repeat(np.arange(len(n)), count), bpe.ramp(count)
                first = (n - capacity * (count - 1))[doc]
                start, length = np.where(piece, first + (piece - 1) * capacity, 0), np.where(piece, capacity, first)
                begin = (np.cumsum(n) - n)[doc] + start
                cut = [ids[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                order, k, many = np.argsort(length, kind="stable"), np.empty(len(length), np.int64), np.bincount(length, minlength=capacity + 1)
                k[order] = bpe.ramp(many)
                k += seen[length]
                seen += many
                out = {"doc_id": batch.column(0).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()), "part": pa.array(np.full(len(doc), part), pa.int32()), "k": pa.array(k)}
                if keep_ids:
                    out["ids"] = pa.array([bytes(x) for x in cut], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long" + ", ids binary" * keep_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Each piece with its sequence_id and its offset there; offsets of a sequence have no gaps.

    Pieces are encoded once, into a table in the shared folder. What is collected is the histogram, `capacity` rows at most.
    """
    made = tables.stored(pieces(docs, path, capacity=capacity, end_id=end_id, keep_ids=keep_ids), "pack-pieces")
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    h = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        h[r.length] = r.n
    places = Places(plan(h, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = made.join(base, ["part", "length"]).withColumn("k", F.col("k") + F.col("before")).drop("part", "before")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, offset = places.find(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "k")))
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in names} | {"sequence_id": pa.array(seq), "offset": pa.array(offset)})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (little-endian unsigned 32-bit) of each sequence of pack(..., keep_ids=True)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda out, x: F.concat(out, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))
