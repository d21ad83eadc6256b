"""Quality by positive-unlabelled learning.

Trusted positives (labels.quality = 1) are set against unlabelled text. A model additive in binned text
statistics is fitted by the non-negative unbiased risk

    R = pi * E_P[loss(f)] + max(0, E_U[loss(-f)] - pi * E_P[loss(-f)])

with logistic loss. pi, the share of good text among the unlabelled, is estimated: a first model ranks the texts, and pi is
the smallest ratio of unlabelled to positive mass over upper score ranges that hold enough of both.

Negative labels are never read as such. The fit uses at most `bound` positives and `bound` unlabelled texts; scoring
is a map over all whole texts.

Null texts count as empty; empty texts get the score of their statistics (all zero). Without positives every score is
0.5. Repeated rows and null doc_ids are scored like others. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, tables, words

STATS = ("log_bytes", "upper", "digit", "space", "line", "bar", "bang", "sign", "dot", "comma", "high", "log_words", "word_len", "short", "long", "distinct", "sign_end", "caps_word", "repeat", "common", "digit_word", "top")


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGIT, BAR, BANG, LINE = _mask(bytes(range(65, 91))), _mask(b"0123456789"), _mask(b"|"), _mask(b"!"), _mask(b"\n")
SIGN, DOT, COMMA = _mask(b"#$%&*@^~_=+<>{}[]\\/"), _mask(b".?"), _mask(b",;:")
HIGH = np.arange(256) >= 192


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS for each text."""
    raw, off = words.text_bytes(column)
    out = [np.zeros((0, len(STATS)))]
    for i, j in words.chunks(off):
        out.append(_chunk(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
    return np.concatenate(out)


def _chunk(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    size = np.diff(off)

    def per(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        return np.diff(np.searchsorted(at, bounds)).astype(float)

    safe = np.maximum(size, 1)
    share = {k: per(m[raw], off) / safe for k, m in (("upper", UPPER), ("digit", DIGIT), ("bar", BAR), ("bang", BANG), ("sign", SIGN), ("dot", DOT), ("comma", COMMA), ("high", HIGH))}
    starts, ends, b = words.spans(raw, off, words.NOT_SPACE)
    h = words.word_hashes(raw, starts, ends)
    nw = np.diff(b).astype(float)
    w = np.maximum(nw, 1)
    length = ends - starts
    doc = np.repeat(np.arange(n), np.diff(b))
    key = np.sort((doc.astype(np.uint64) << np.uint64(43)) | (h >> np.uint64(21)))
    new = np.ones(len(h), bool)
    new[1:] = key[1:] != key[:-1]
    run = np.diff(np.append(np.flatnonzero(new), len(h)))
    of = (key[new] >> np.uint64(43)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, run)
    first, last = raw[starts] if len(starts) else starts, raw[ends - 1] if len(ends) else ends
    pair = np.zeros(len(h), bool)
    if len(h):
        pair[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    second = raw[np.minimum(starts + 1, len(raw) - 1)] if len(starts) else starts
    cols = {
        "log_bytes": np.log1p(size), "space": 1 - np.bincount(doc, length, n) / safe, "line": per(LINE[raw], off) / w, "log_words": np.log1p(nw),
        "word_len": np.bincount(doc, length, n) / w, "short": per(length <= 2, b) / w, "long": per(length > 12, b) / w, "distinct": np.bincount(of, minlength=n) / w,
        "sign_end": per(SIGN[last] | BANG[last], b) / w, "caps_word": per(UPPER[first] & UPPER[second] & (length > 1), b) / w, "repeat": per(pair, b) / w,
        "common": np.bincount(of, (run >= 3) * run, n) / w, "digit_word": per(DIGIT[first], b) / w, "top": most / w,
    }
    cols |= share
    return np.stack([cols[k] for k in STATS], axis=1)


@dataclass
class Model:
    edges: np.ndarray  # statistic x inner bin edges
    w0: float
    w: np.ndarray  # statistic x bin
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.w0 + sum(self.w[k, b[:, k]] for k in range(len(self.edges)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def _descend(b: np.ndarray, positive: np.ndarray, bins: int, prior: float | None, steps: int, rate: float = 0.05, decay: float = 2e-4):
    """Adam on all rows. With prior None: plain logistic loss of positives against unlabelled; else the non-negative risk."""
    k = b.shape[1]
    at = b + bins * np.arange(k)
    w, m, v = (np.zeros(k * bins + 1) for _ in range(3))
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    for t in range(1, steps + 1):
        z = w[-1] + w[at].sum(axis=1)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if prior is None:
            g = np.where(positive, (s - 1) / n_p, s / n_u)
        else:
            soft = np.logaddexp(0, z)  # loss(-f)
            rest = soft[~positive].mean() - prior * soft[positive].mean()
            if rest >= 0:
                g = np.where(positive, prior * (s - 1) / n_p - prior * s / n_p, s / n_u)
            else:  # undo what made the estimate of the negatives' risk negative
                g = np.where(positive, prior * s / n_p, -s / n_u)
        grad = np.bincount(at.ravel(), np.repeat(g, k), k * bins)
        grad = np.append(grad + decay * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[-1], w[:-1].reshape(k, bins)


def estimate_prior(z: np.ndarray, positive: np.ndarray, least: float = 0.3) -> float:
    """The smallest ratio of unlabelled to positive mass over score ranges that start anywhere and hold `least` of the positives."""
    p, u = np.sort(z[positive]), np.sort(z[~positive])
    if not len(p) or not len(u):
        return 0.5
    best = 1.0
    for q in np.linspace(0, 1 - least, 57):
        cut = p[int(q * (len(p) - 1))]
        in_p = 1 - np.searchsorted(p, cut) / len(p)
        in_u = 1 - np.searchsorted(u, cut) / len(u)
        slack = np.sqrt(in_u * (1 - in_u) / len(u)) + np.sqrt(in_p * (1 - in_p) / len(p))
        if in_p >= least:
            best = min(best, (in_u + slack) / in_p)
    return float(np.clip(best, 0.02, 0.98))


def fit(x: np.ndarray, positive: np.ndarray, *, bins: int = 16, steps: int = 400, prior: float | None = None) -> Model:
    edges = np.stack([np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]) if len(x) else np.zeros(bins - 1) for k in range(len(STATS))])
    model = Model(edges, 0.0, np.zeros((len(STATS), bins)), prior or 0.5)
    if not positive.any() or positive.all():
        return model
    b = model.bins(x)
    if prior is None:
        w0, w = _descend(b, positive, bins, None, steps // 2)
        z = w0 + sum(w[k, b[:, k]] for k in range(b.shape[1]))
        model.prior = estimate_prior(z, positive)
    model.w0, model.w = _descend(b, positive, bins, model.prior, steps)
    return model


def _with_statistics(df: DataFrame, keep: str, schema: str) -> DataFrame:
    """keep and the statistics of text, which is the last column."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(len(names)))
            yield pa.RecordBatch.from_pydict({n: b.column(i) for i, n in enumerate(names)} | {"stats": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATS)).cast(pa.list_(pa.float64()))})

    return df.selectExpr(*keep.split(", "), "cast(text as string) text").mapInArrow(run, f"{schema}, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, *, bound: int = 20_000, prior: float | None = None) -> Model:
    """Fit to bounded samples: positives, and unlabelled texts outside the held-out fifth, both by a hash of doc_id."""
    tables.small_batches(docs.sparkSession)
    positives = labelled.sample(docs, labels.filter("quality = 1"), "quality", bound).select("doc_id", F.lit(True).alias("positive"), "text")
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (labelled.remainder() != 0)).distinct()
    some = ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(bound)
    unlabelled = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", F.lit(False).alias("positive"), "text")
    got = _with_statistics(positives.unionByName(unlabelled), "doc_id, positive", "doc_id long, positive boolean").toArrow()
    n = got.num_rows
    x = np.asarray(got["stats"].combine_chunks().values.to_numpy(zero_copy_only=False)).reshape(n, len(STATS)) if n else np.zeros((0, len(STATS)))
    positive = got["positive"].to_numpy().astype(bool)
    order = np.lexsort((got["doc_id"].to_numpy(), positive))
    return fit(x[order], positive[order], prior=prior)


def accepted(docs: DataFrame, model: Model, *, cut: float = 0.3) -> DataFrame:
    """docs, with all columns whatever their names, whose whole text has a score of at least `cut`: a map over rows."""
    tables.small_batches(docs.sparkSession)
    rows = tables.packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = model.score(statistics(b.column(1))) >= cut
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good))], names=["row"])

    return tables.unpacked(rows.mapInArrow(run, rows.select("row").schema))


def quality(docs: DataFrame, labels: DataFrame, *, bound: int = 20_000, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, bound=bound)
    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    scored = _with_score(slim, model)
    return scored.select("doc_id", (labelled.remainder() == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def _with_score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score: the text does not go back to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(model.score(statistics(b.column(1))))})

    return docs.selectExpr("doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double")
