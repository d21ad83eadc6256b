"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct 5-word shingles; two are linked if the Jaccard similarity is 0.75 or more.

1. Documents with equal sets form a class; only its smallest doc_id goes on.
2. 128 minimum hashes in 32 bands of 4 make buckets: a pair at the threshold shares none with probability (1 - 0.75^4)^32 < 6e-6.
3. Each bucket's members meet a few pivots of the bucket (the minimum under several orders), so candidates grow with the
   members, not with their square.
4. A candidate's signatures are compared in batches of 16, 16, 32 and 64. After each, the posterior of the similarity (uniform prior)
   decides: P(J >= 0.75) under `miss` drops the pair.
5. Survivors are verified on the full sets, and linked documents get components.
6. Pairs of non-pivots that share a bucket but not a component are then compared as well, block by block, so no
   candidate pair that could join two components is left out. A pair inside one component changes nothing. These pairs have
   1024 further hashes of one byte (which match with probability J + (1 - J) / 256), as many lie near the threshold.

Null and empty texts, and texts without words, have empty sets and are linked with nothing. Repeated rows (same doc_id)
are each returned. Rows with a null doc_id are returned unlinked with a null component. Extra columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, words
from .components import components
from .tables import stored

HASHES, BANDS, ROWS = 128, 32, 4
BATCHES = (16, 32, 64, 128)
#: A bucket's pivots are its minima after these bits are flipped
PIVOTS = (0, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51)
BLOCK = 1024
BYTES, BYTE_BATCHES = 1024, (32, 64, 128, 256, 512, 1024)

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(1, 1 << 63, HASHES + BYTES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES + BYTES, dtype=np.uint64)
#: Ids (8 bytes each) that are broadcast to pick texts; more are joined by a shuffle
FEW_IDS = 1 << 21


def least_matches(threshold: float, miss: float, batches: tuple[int, ...] = BATCHES) -> list[int]:
    """For each batch, the fewest matches that keep a pair: with a uniform prior, P(J >= t | m of n) = P(Bin(n + 1, t) <= m)."""
    out = []
    for n in batches:
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for i, j, h, bounds in words.hashed_words(column, words.NOT_SPACE):
        s, at = words.shingles(h, bounds, k)
        for d in range(j - i):
            yield np.unique(s[at[d] : at[d + 1]])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, digest (of the set) and sig (128 unsigned 32-bit minima) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for i, j, h, bounds in words.hashed_words(batch.column(1), words.NOT_SPACE):
                s, at = words.shingles(h, bounds, k)
                size = np.diff(at)
                some = np.flatnonzero(size)
                sig = np.zeros((j - i, HASHES), np.uint32)
                with np.errstate(over="ignore"):
                    for p in range(HASHES if len(some) else 0):
                        sig[some, p] = np.minimum.reduceat(words.mix_light(s * _A[p] + _B[p]), at[some])
                sets = [np.unique(s[at[d] : at[d + 1]]) for d in range(j - i)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(i, j - i), "n": pa.array([len(x) for x in sets], pa.int64()),
                    "digest": pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)),
                    "sig": pa.array([sig[d].tobytes() if size[d] else b"" for d in range(j - i)], pa.binary()),
                })

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n long, digest long, sig binary")


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in the stored table ids."""
    small = ids.count() <= FEW_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def byte_signatures(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """rep and sig (1024 byte hashes, then the 128 minima of signatures()) of the documents in ids, none of which is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, bounds in words.hashed_words(batch.column(1), words.NOT_SPACE):
                s, at = words.shingles(h, bounds, k)
                sig, own = np.zeros((j - i, BYTES), np.uint8), np.zeros((j - i, HASHES), np.uint32)
                with np.errstate(over="ignore"):
                    for p in range(HASHES + BYTES if len(s) else 0):
                        least = np.minimum.reduceat(words.mix_light(s * _A[p] + _B[p]), at[:-1])
                        if p < HASHES:
                            own[:, p] = least
                        else:
                            sig[:, p - HASHES] = least & 255
                yield pa.RecordBatch.from_pydict({"rep": batch.column(0).slice(i, j - i), "sig": pa.array([x.tobytes() + y.tobytes() for x, y in zip(sig, own, strict=True)], pa.binary())})

    return picked(docs, ids).mapInArrow(run, "rep long, sig binary").dropDuplicates(["rep"])


def band_keys(reps: DataFrame) -> DataFrame:
    """key and rep, once for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _keys(_matrix(b.column(1)))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.ravel().view(np.int64)), "rep": pa.array(np.repeat(b.column(0).to_numpy(), BANDS))})

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _keys(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band of each signature."""
    sig = sig.astype(np.uint64).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), sig.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = words.mix(key * np.uint64(3) + sig[:, :, r])
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def plausible(pairs: DataFrame, reps: DataFrame, least: list[int]) -> DataFrame:
    """The pairs (a, b) that no batch of signatures rules out."""
    wide = pairs.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            same = _matrix(x.column(2)) == _matrix(x.column(3))
            keep, before, hits = np.arange(len(same)), 0, np.zeros(len(same), np.int64)
            for n, m in zip(BATCHES, least, strict=True):
                hits[keep] += same[keep, before:n].sum(axis=1)
                keep, before = keep[hits[keep] >= m], n
            yield pa.RecordBatch.from_pydict({"a": x.column(0).take(pa.array(keep)), "b": x.column(1).take(pa.array(keep))})

    return wide.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "pair-ids")
    texts = picked(docs, ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "hashes": pa.array([x.tobytes() for x in shingle_sets(b.column(1), k)], pa.binary())})

    full = stored(texts.mapInArrow(sets, "id long, hashes binary").dropDuplicates(["id"]), "sets")
    wide = pairs.join(full.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict({"a": t.column(0), "b": t.column(1)}).filter(pa.array(ok, pa.bool_()))

    return wide.mapInArrow(check, "a long, b long")


def block_pairs(members: DataFrame, reps: DataFrame, least: list[int]) -> DataFrame:
    """Plausible pairs of members (key, rep, c, n) of one bucket and different components.

    A bucket of more than BLOCK members is dealt into blocks, and each pair of blocks is a group of its own. A pair is given
    out in the first bucket that it shares only: there both are no pivots as well, or else a star has tested it.
    """
    g = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.join(reps.select("rep", "sig"), "rep").withColumn("g", g).withColumn("at", F.pmod(F.xxhash64("rep", "key"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "rep", "c", "sig")

    def run(table: pa.Table) -> pa.Table:
        at, i, j = table["at"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        rep, c, sig = table["rep"].to_numpy(), table["c"].to_numpy(), np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(table), BYTES + 4 * HASHES)
        own = sig[:, BYTES:].copy().view(np.uint32)
        band = int(np.flatnonzero(_keys(own[:1])[0].view(np.int64) == table["key"][0].as_py())[0])
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        found = []
        for s in range(0, len(left), 32):
            x, y = np.nonzero(c[left[s : s + 32], None] != c[right][None, :])
            x, y = left[s + x], right[y]
            if i == j:
                once = x < y
                x, y = x[once], y[once]
            hits, before = np.zeros(len(x), np.int64), 0
            for n, m in zip(BYTE_BATCHES, least, strict=True):
                hits += (sig[x, before:n] == sig[y, before:n]).sum(axis=1)
                keep = hits >= m
                x, y, hits, before = x[keep], y[keep], hits[keep], n
            if len(x):
                first = (own[x] == own[y]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
                x, y = x[first], y[first]
            found.append((rep[x], rep[y]))
        a, b = (np.concatenate([f[t] for f in found]) if found else np.zeros(0, np.int64) for t in (0, 1))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 75, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    tables.small_batches(docs.sparkSession)
    least = least_matches(percent / 100, miss)
    rows = stored(signatures(docs, k), "signatures")
    classes = stored(rows.filter("n > 0 and doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = stored(rows.filter("n > 0").select(F.col("doc_id").alias("rep"), "sig").join(classes.select("rep"), "rep", "left_semi").dropDuplicates(["rep"]), "reps")
    bands = band_keys(reps)
    pivot = [F.min(F.col("rep").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)) for x in PIVOTS]
    buckets = stored(bands.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*pivot)).alias("pivots")).filter("n > 1"), "buckets")
    members = stored(bands.join(buckets, "key"), "members")
    star = members.select("rep", F.explode("pivots").alias("p")).filter("rep <> p").select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct()
    tested = stored(plausible(star, reps, least), "plausible")
    edges = stored(verified(tested, docs, k, percent), "links")
    labels = components(edges)

    others = members.filter(~F.array_contains("pivots", F.col("rep"))).select("key", "rep")
    others = others.join(labels.select(F.col("v").alias("rep"), "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    others = stored(others, "others")
    mixed = stored(others.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key", "n"), "mixed")
    others = stored(others.join(mixed, "key"), "mixed-members")
    sigs = stored(byte_signatures(docs, stored(others.select(F.col("rep").alias("doc_id")).distinct(), "mixed-ids"), k), "byte-signatures")
    bar = percent / 100
    more = stored(block_pairs(others, sigs, least_matches(bar + (1 - bar) / 256, miss, BYTE_BATCHES)), "more")
    joining = stored(verified(more, docs, k, percent), "joining")
    name = lambda x: labels.select(F.col("v").alias(x), F.col("c").alias(f"c{x}"))
    between = joining.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(between).select(F.col("v").alias("c"), F.col("c").alias("top"))
    # single reps and components that got joined to others
    final = labels.join(top, "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    final = final.union(top.join(labels.select(F.col("v").alias("c")), "c", "left_anti").select("c", "top"))
    named = stored(classes.join(final.select(F.col("v").alias("rep"), "c"), "rep", "left").select("digest", "n", F.coalesce("c", "rep").alias("component_id")), "named")
    out = rows.drop("sig").join(named, ["digest", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id. Rows with a null doc_id stay."""
    found = stored(near_duplicates(docs, **how).filter(~F.col("kept")).select(F.col("doc_id").alias("__drop")).distinct(), "dropped")
    return docs.join(found, docs["doc_id"] == found["__drop"], "left_anti")
