"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of about 4 MB. Its words are numbered by the benchmark's vocabulary; other words, ends of documents, and
runs too short for any window are separators, as no occurrence can touch them. All benchmark windows are searched backwards
at once, occurrences are located from sampled suffix positions, and their spans are merged.

A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. The benchmark is taken in
blocks of at most `block_words` words, so what a task holds of it is bounded; further blocks are further maps over the same
rows, without a shuffle.

Null and empty texts have no words and no hits; null items and items with a null id are left out; items with
the same id count once. Repeated documents and null doc_ids are each returned. `marked` packs all columns, so extra ones are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables, words
from .bpe import ramp
from .fmindex import ShardIndex

SIZE = 13
SHARD = 4 << 20


@dataclass
class Phrases:
    """The distinct windows of one block of the benchmark: some 150 bytes a window while they are made, 80 in all that is sent."""

    vocabulary: np.ndarray  # sorted word hashes; the symbol of a word is its place + 1
    rows: np.ndarray  # windows x SIZE symbols
    size: np.ndarray
    item_of: np.ndarray  # item names, by window
    item_at: np.ndarray

    @classmethod
    def of(cls, ids: list[str], texts: pa.Array, size: int = SIZE) -> Phrases:
        seqs = []
        for i, j, h, bounds in words.hashed_words(texts, words.ALNUM):
            seqs += [h[bounds[d] : bounds[d + 1]] for d in range(j - i)]
        every = np.concatenate([*seqs, np.zeros(0, np.uint64)])
        vocabulary = np.unique(every)
        symbols = np.concatenate([np.searchsorted(vocabulary, every) + 1, np.zeros(size, np.int64)]).astype(np.int32)
        names, code = np.unique(np.array(ids, object), return_inverse=True)
        length = np.array([len(h) for h in seqs], np.int64)
        count = np.where(length > 0, np.maximum(length - size + 1, 1), 0)
        at, width, item = np.repeat(np.cumsum(length) - length, count) + ramp(count), np.repeat(np.minimum(length, size), count), np.repeat(code, count)
        rows, mixed = np.empty((len(at), size), np.int32), np.zeros(len(at), np.uint64)
        for k in range(size):
            rows[:, k] = np.where(k < width, symbols[at + k], 0)
            mixed = (mixed ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        # equal windows stand together; should two others share a number, a window may be there twice, which changes no result
        order = np.lexsort((item, mixed))
        rows, item, width = rows[order], item[order], width[order]
        new = np.ones(len(order), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        keep = new.copy()
        keep[1:] |= item[1:] != item[:-1]
        per = np.bincount((np.cumsum(new) - 1)[keep], minlength=int(new.sum()))
        return cls(vocabulary, rows[new], width[new], names[item[keep]], np.concatenate([[0], np.cumsum(per)]).astype(np.int64))

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
        """For a shard's words: which are inside an occurrence, and each document's items."""
        n = len(bounds) - 1
        covered, items = np.zeros(len(h), bool), [[] for _ in range(n)]
        if not len(h) or not len(self.rows):
            return covered, items
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == h
        # runs of known words within a document
        edge = np.ones(len(h) + 1, bool)
        edge[1:-1] = known[1:] != known[:-1]
        edge[bounds] = True
        cut = np.flatnonzero(edge)
        begin, length = cut[:-1], np.diff(cut)
        keep = known[np.minimum(begin, len(h) - 1)] & (length >= self.size.min())
        begin, length = begin[keep], length[keep]
        if not len(begin):
            return covered, items
        place = np.repeat(begin, length + 1) + ramp(length + 1)  # the place after a run is its separator
        text = np.zeros(len(place), np.int64)
        inside = np.ones(len(place), bool)
        inside[np.cumsum(length + 1) - 1] = False
        text[inside] = at[place[inside]] + 1
        index = ShardIndex(text, len(self.vocabulary))
        which, lo, hi = index.search(self.rows, self.size)
        if not len(which):
            return covered, items
        start = place[index.locate(np.repeat(lo, hi - lo) + ramp(hi - lo))]
        which = np.repeat(which, hi - lo)
        change = np.zeros(len(h) + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + self.size[which], -1)
        covered = np.cumsum(change[:-1]) > 0
        doc = np.searchsorted(bounds, start, side="right") - 1
        pair = np.unique(doc * len(self.rows) + which)
        for d, w in zip((pair // len(self.rows)).tolist(), (pair % len(self.rows)).tolist(), strict=True):
            items[d].extend(self.item_of[self.item_at[w] : self.item_at[w + 1]])
        return covered, items


def runs(covered: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of True, in turn."""
    wide = np.concatenate([[False], covered, [False]])
    return np.flatnonzero(wide[1:] != wide[:-1])


def marked(docs: DataFrame, benchmark: DataFrame, *, size: int = SIZE, block_words: int = 2_000_000, slim: bool = False) -> DataFrame:
    """row (all columns of docs, without text if slim) with n_words, spans (merged word spans: start, end, in turn) and items."""
    spark = docs.sparkSession
    tables.small_batches(spark)
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    parts = max(1, -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // (2 * block_words)))
    out = tables.packed(docs, *(["text"] if slim else [])).select("row", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"), "text")
    schema = out.schema
    for part in range(parts):
        # a block: at most about block_words words, as a word and what parts it are two characters or more
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
        shared = spark.sparkContext.broadcast(Phrases.of(block["item_id"].to_pylist(), pa.array(block["text"].to_pylist(), pa.string()), size))

        more = part + 1 < parts  # the text goes on only to another block

        def run(batches: Iterator[pa.RecordBatch], shared=shared, more=more) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for b in batches:
                n_words, spans, found = [], [], []
                old_spans, old_items = b.column(2).to_pylist(), b.column(3).to_pylist()
                for i, j, h, bounds in words.hashed_words(b.column(4), words.ALNUM, SHARD):
                    covered, items_ = phrases.hits(h, bounds)
                    for d in range(j - i):
                        mine = covered[bounds[d] : bounds[d + 1]]
                        for s, e in zip(old_spans[i + d][::2], old_spans[i + d][1::2], strict=True):
                            mine[s:e] = True
                        n_words.append(len(mine))
                        spans.append(runs(mine).tolist() if mine.any() else [])
                        found.append(sorted({*old_items[i + d], *items_[d]}))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string())), *([b.column(4)] if more else [])], names=schema.names[: 4 + more])

        out = out.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields[: 4 + more]]))
    return out


def _hit_words():
    return F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)


def report(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    out = marked(docs.selectExpr("cast(doc_id as long) doc_id", "text"), benchmark, **how, slim=True).select("row.doc_id", "n_words", _hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without contaminated documents."""
    out = marked(docs, benchmark, **how)
    bad = (_hit_words() > 0) & (20 * _hit_words() >= F.col("n_words"))
    return tables.unpacked(out.filter(~bad))
