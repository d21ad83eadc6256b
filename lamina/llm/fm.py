"""Toxicity: a factorization machine over hashed terms.

A text is its set of lower-cased words and word beginnings, hashed into 2^BITS places. Places in at least `least_df` sampled texts have a weight
and a vector of `rank` numbers, whether or not they depend on the label by themselves; penalties keep noise out; the score is the logistic of w0 + sum w_i + sum over pairs of <v_i, v_j>, so a pair such as an
insult beside the mention of a group counts beyond its parts.

The fit uses at most `bound` labelled rows (a documented limit) and at most 2^BITS terms, so its size
does not follow the input; scoring is a map over all whole texts.

Null texts count as empty; an empty text has the score of the intercept. With no labelled rows, or with one
class only, every score is the smoothed share of that class. Repeated rows and null doc_ids are scored
like others (held_out is null for a null doc_id). Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, tables, words


#: Bytes of the word beginnings that are terms beside whole words, for insults that are inflected or compounded.
STEMS = (4, 5)
#: Terms are hashed to so many bits
BITS = 20


@dataclass
class Model:
    names: np.ndarray  # sorted places of the terms
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from pairs of text and term numbers."""
        linear = self.w0 + np.bincount(doc, self.w[term], n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            linear += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return 1 / (1 + np.exp(-np.clip(linear, -50, 50)))


def term_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, text numbers, hashes): terms of the texts [first, last), each as often as it occurs."""
    raw, off = words.text_bytes(column)
    for i, j in words.chunks(off):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, bounds = words.spans(part, o, words.ALNUM)
        doc = np.repeat(np.arange(j - i), np.diff(bounds))
        docs, terms = [doc], [words.word_hashes(part, starts, ends)]
        for size in STEMS:
            long = np.flatnonzero(ends - starts > size)
            docs.append(doc[long])
            terms.append(words.word_hashes(part, starts[long], starts[long] + size) ^ words.U64(size))
        doc = np.concatenate(docs)
        order = np.argsort(doc, kind="stable")
        yield i, j, doc[order], np.concatenate(terms)[order]


def places(h: np.ndarray) -> np.ndarray:
    """The place of each hash in the feature space."""
    return (h >> words.U64(64 - BITS)).astype(np.int64)


def known(numbers: np.ndarray, n: int, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of text and number; numbers has that of each place (-1: none), n of them."""
    at = numbers[place]
    ok = at >= 0
    pair = np.unique(doc[ok] * max(n, 1) + at[ok])
    return pair // max(n, 1), pair % max(n, 1)


def numbered(names: np.ndarray) -> np.ndarray:
    out = np.full(1 << BITS, -1, np.int64)
    out[names] = np.arange(len(names))
    return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def log_loss(y: np.ndarray, z: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


class Sample:
    """Texts as pairs of text and term number, text by text."""

    def __init__(self, sets: list[np.ndarray], y: np.ndarray, m: int):
        self.n, self.m, self.y = len(sets), m, y
        self.size = np.array([len(x) for x in sets], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.doc, self.term = np.repeat(np.arange(self.n, dtype=np.int32), self.size), np.concatenate([*sets, np.zeros(0, np.int32)])

    def slices(self) -> Iterator[slice]:
        """Runs of pairs, so that what is computed for each pair stays small."""
        return (slice(i, i + (1 << 20)) for i in range(0, len(self.term), 1 << 20))

    def linear(self, w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(self.doc[k], w[self.term[k]], self.n) for k in self.slices()), np.zeros(self.n))

    def gradient(self, err: np.ndarray) -> np.ndarray:
        return sum((np.bincount(self.term[k], err[self.doc[k]], self.m) for k in self.slices()), np.zeros(self.m))

    def pairs(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for f in range(v.shape[1]):
            out += 0.5 * (self.linear(v[:, f]) ** 2 - self.linear(v[:, f] ** 2))
        return out


def sparse_weights(d: Sample, lam: float, w: np.ndarray, w0: float, offset: np.ndarray, steps: int = 40, rounds: int = 4) -> tuple[np.ndarray, float]:
    """Weights under an absolute-value penalty lam, from w on: accelerated proximal steps over the terms whose gradient exceeds the penalty, until no other's does."""
    active = w != 0
    for k in range(rounds):
        grad = d.gradient(logistic(w0 + offset + d.linear(w)) - d.y) / d.n
        more = (np.abs(grad) > lam) & ~active
        if k and not more.any():
            break
        active |= more
        if not active.any():
            break
        ids, keep = np.flatnonzero(active), active[d.term]
        number = np.cumsum(active, dtype=np.int32) - 1
        doc, term = d.doc[keep], number[d.term[keep]]
        by_term = np.argsort(term, kind="stable").astype(np.int32)
        doc_by_term = doc[by_term]
        first, begin = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (doc, term[by_term]))
        texts, own = doc[first], term[by_term][begin]

        def by_text(x: np.ndarray) -> np.ndarray:
            out = np.zeros(d.n)
            out[texts] = np.add.reduceat(x[term], first)
            return out

        def by_term_sums(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(ids))
            out[own] = np.add.reduceat(x[doc_by_term], begin)
            return out

        top = np.full(len(ids), 1 / np.sqrt(max(len(ids), 1)))
        norm = 0.0
        for _ in range(5):  # the largest curvature
            top = by_term_sums(by_text(top))
            norm = float(np.linalg.norm(top))
            top /= max(norm, 1e-300)
        rate = d.n / (0.25 * (1.2 * norm + d.n))
        x, at, at0, t = w[ids], w[ids], w0, 1.0
        for _ in range(steps):
            err = logistic(at0 + offset + by_text(at)) - d.y
            new = at - rate * by_term_sums(err) / d.n
            new = np.sign(new) * np.maximum(np.abs(new) - rate * lam, 0)
            new0, t2 = at0 - rate * err.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
            moved = max(float(np.abs(new - x).max(initial=0)), abs(new0 - w0))
            at, at0 = new + (t - 1) / t2 * (new - x), new0 + (t - 1) / t2 * (new0 - w0)
            x, w0, t = new, new0, t2
            if moved < 1e-4:
                break
        w = np.zeros(d.m)
        w[ids] = x
    return w, w0


def pair_vectors(d: Sample, w: np.ndarray, w0: float, v: np.ndarray, rng: np.random.Generator, epochs: int, steps: int, batch: int, rate: float, decay: float) -> np.ndarray:
    """Vectors of all terms, with the weights as they are: AdaGrad over shuffled mini-batches of about `batch` terms, a Gaussian prior of precision decay."""
    batch = int(np.clip(batch * d.n // max(len(d.term), 1), 16, 128))
    line, sums_of_squares = w0 + d.linear(w), np.full(v.shape, 1e-2)
    for _ in range(max(epochs, -(-steps * batch // d.n))):
        perm = rng.permutation(d.n)
        for k in range(0, d.n, batch):
            pick = perm[k : k + batch]
            size = d.size[pick]
            doc = np.repeat(np.arange(len(pick)), size)
            term = d.term[np.repeat(d.begin[pick] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            u, back = np.unique(term, return_inverse=True)
            x = v[u][back]
            sums = np.stack([np.bincount(doc, x[:, f], len(pick)) for f in range(v.shape[1])], axis=1)
            z = line[pick] + 0.5 * ((sums**2).sum(axis=1) - np.bincount(doc, (x * x).sum(axis=1), len(pick)))
            err = (logistic(z) - d.y[pick]) / len(pick) * 32
            for f in range(v.shape[1]):
                dv = np.bincount(back, err[doc] * (sums[doc, f] - x[:, f]), len(u)) + decay * v[u, f]
                sums_of_squares[u, f] += dv**2
                v[u, f] -= rate * dv / np.sqrt(sums_of_squares[u, f])
    return v


def calibrated(y: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (1 to 4) of the logistic of z, by Newton's method with a weak prior at 0 and 1: a penalty draws scores in."""
    a, c = 0.0, 1.0
    for _ in range(30):
        p = logistic(a + c * z)
        h, g = p * (1 - p), p - y
        hess = np.array([[h.sum() + 1, (h * z).sum()], [(h * z).sum(), (h * z * z).sum() + 1]])
        step = np.linalg.solve(hess, [g.sum() + a, (g * z).sum() + c - 1])
        a, c = a - float(np.clip(step[0], -1, 1)), c - float(np.clip(step[1], -1, 1))
    c = min(max(c, 1.0), 4.0)
    return (a, c) if np.isfinite(a) else (0.0, 1.0)


#: Penalties that are tried, from the largest on; each starts at the last one's weights
PENALTIES = tuple(0.02 * 0.5**k for k in range(11))


def fit(texts: DataFrame, *, rank: int = 4, least_df: int = 5, epochs: int = 2, steps: int = 300, batch: int = 20_000, rate: float = 0.03, decay: float = 0.02, rounds: int = 3, seed: int = 7) -> Model:
    """Fit to a bounded table of text and label (0 or 1).

    Spark makes the term sets and their document frequencies; the rows that come to the driver are numbers of known terms,
    bounded by the sample. Weights have an absolute-value penalty, which keeps noise at exactly 0 without a test of single terms; vectors of all terms a Gaussian prior.
    Weights and vectors are fitted in turn, `rounds` times. A fifth of the rows, of which the first fits know nothing, chooses the penalty, whether vectors
    are better at their prior's mean of 0, and the slope of the scores; then all rows are fitted. A fixed seed makes it repeatable.
    """
    spark = texts.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, doc, h in term_sets(b.column(1)):
                cut = np.searchsorted(doc, np.arange(1, j - i))
                yield pa.RecordBatch.from_pydict({"label": b.column(0).slice(i, j - i), "terms": pa.array([np.unique(places(x)).astype(np.int32) for x in np.split(h, cut)], pa.list_(pa.int32()))})

    rows = tables.stored(texts.select("label", "text").mapInArrow(sets, "label double, terms array<int>"), "fm-terms")
    counted = rows.select(F.explode("terms").alias("term")).groupBy("term").count().filter(F.col("count") >= least_df).toPandas()  # at most 2^BITS rows
    names = np.sort(counted["term"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(names)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers_of = numbered(shared.value)
            out = []
            for x in b.column(1):
                at = numbers_of[x.values.to_numpy(zero_copy_only=False)]
                out.append(at[at >= 0].astype(np.int32))
            yield pa.RecordBatch.from_pydict({"label": b.column(0), "terms": pa.array(out, pa.list_(pa.int32()))})

    got = rows.mapInArrow(numbers, "label double, terms array<int>").toArrow()
    y = got["label"].to_numpy().astype(np.float64)
    sets_ = [np.asarray(x, np.int32) for x in got["terms"].combine_chunks().to_numpy(zero_copy_only=False)] if len(y) else []
    mean, m = (y.sum() + 0.5) / (len(y) + 1), len(names)
    model = Model(names, float(np.log(mean / (1 - mean))), np.zeros(m), np.zeros((m, rank)))
    if len(y) == 0 or y.min() == y.max() or not m:
        return model
    order = np.lexsort((np.array([int(x.sum(dtype=np.int64)) for x in sets_]), y))  # the same whatever the partitions
    y, sets_ = y[order], [sets_[i] for i in order]
    rng = np.random.default_rng(seed)
    aside = np.zeros(len(y), bool)
    for label in (0, 1):
        mine = np.flatnonzero(y == label)
        aside[rng.permutation(mine)[: len(mine) // 5]] = True
    part = lambda on: Sample([x for x, k in zip(sets_, on, strict=True) if k], y[on], m)

    def with_pairs(d: Sample, lam: float, w: np.ndarray, w0: float) -> tuple[np.ndarray, float, np.ndarray]:
        own = np.random.default_rng(seed)
        v = own.normal(0, 0.02, (m, rank))
        for _ in range(rounds):
            v = pair_vectors(d, w, w0, v, own, epochs, steps, batch, rate, decay)
            w, w0 = sparse_weights(d, lam, w, w0, d.pairs(v))
        return w, w0, v

    first, judge = part(~aside), part(aside)
    w, w0, best = np.zeros(m), model.w0, None
    worse = 0
    for lam in PENALTIES:
        w, w0 = sparse_weights(first, lam, w, w0, np.zeros(first.n), rounds=2)
        z = w0 + judge.linear(w)
        if best is None or log_loss(judge.y, z) < best[0] - 1e-5:
            best, worse = (log_loss(judge.y, z), lam, w, w0, z), 0
        else:
            worse += 1
            if worse == 2:
                break
    _, lam, w, w0, z = best
    w2, w02, v2 = with_pairs(first, lam, w, w0)
    z2 = w02 + judge.linear(w2) + judge.pairs(v2)
    pairs = log_loss(judge.y, z2) < best[0]
    a, c = calibrated(judge.y, z2 if pairs else z)
    del first, judge, got, z2, v2, w2
    whole = part(np.ones(len(y), bool))
    w, w0 = sparse_weights(whole, lam, w, w0, np.zeros(whole.n), steps=150)
    v = np.zeros((m, rank))
    if pairs:
        w, w0, v = with_pairs(whole, lam, w, w0)
    return Model(names, a + c * w0, c * w, np.sqrt(c) * v)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text: a map over rows with the model broadcast (at most 2^BITS terms)."""
    tables.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        numbers, n = numbered(m.names), len(m.names)
        for b in batches:
            out = [m.score(*known(numbers, n, doc, places(h)), j - i) for i, j, doc, h in term_sets(b.column(1))]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(np.concatenate(out) if out else np.zeros(0))})

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, bound: int = 20_000, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(labelled.sample(docs, labels, "toxic", bound))
    return score(docs, model).select("doc_id", (labelled.remainder() == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
