"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

Words are the maximal runs of A-Z, a-z and U+00C0..U+00FF of whole texts, A-Z lower-cased, that have `least_size` code
points and occur `least_n` times. Two words are near if one inserted, deleted or replaced code point makes one
of the other. Then their letter counts differ by one letter more (lengths l and l + 1), or by one letter more and one less
(like lengths). So near words lie in a small box around a word's counts. For each pair of lengths the words of
the one length stand in a k-d tree, those of the other search it; boxes that lie further away are pruned, and
what is left is verified letter by letter.

Letters are put into 32 dimensions (a-z, and six for the others), which only brings words nearer. A length with more than
`cell` words is split into cells by the upper levels of its tree, whose cuts come from a bounded sample of words; the
cuts decide where a word is compared, not with what. A word stands in one cell, and searches every cell that its box meets.
A group of one task is a cell and its searches, whatever share of the words has one length. Words with the very same counts cannot be split.

A word's form is its near word of the largest count (ties: the smallest in code-point order) if that is `ratio` times its
own; its root follows forms to the last. Counts grow by the factor in each step, so doubling of links ends in a few rounds.

Null texts have no words; a null doc_id is written as nothing in the damage below; repeated rows count again; an
empty table gives no words; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, words

DIMS, CAP = 32, 4
#: Dimension of each code point below 256
DIM = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], np.uint8)
UNARY = np.array([0, 1, 3, 7, 15], np.uint64)
#: Distinct words that a task counts before it gives them out
HELD = 200_000


def vocabulary(docs: DataFrame, *, least_size: int = 7, least_n: int = 2, damage: int | None = 31) -> DataFrame:
    """word and n, its occurrences. damage: an occurrence loses a letter if this number divides the CRC of `doc_id:word`."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_size},}}")

    def given(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            raw, off = words.text_bytes(batch.column(1))
            low = words.LOWER[raw].tobytes()
            for d, a, b in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                for w, n in Counter(runs.findall(low[a:b].decode())).items():
                    if damage and not (h := zlib.crc32(f"{'' if d is None else d}:{w}".encode())) % damage:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        if len(w) < least_size:
                            continue
                    total[w] += n
                if len(total) >= HELD:
                    yield given(total)
                    total.clear()
        yield given(total)

    tables.small_batches(docs.sparkSession)
    found = docs.selectExpr("cast(doc_id as string) doc_id", "cast(text as string) text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def letters(column: pa.Array, size: int) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(column.to_pylist()).encode("latin-1"), np.uint8).reshape(len(column), size)


def counts(matrix: np.ndarray) -> np.ndarray:
    """Letter counts, at most CAP a dimension."""
    out = np.empty((len(matrix), DIMS), np.uint8)
    for i in range(0, len(matrix), 1 << 14):
        part = DIM[matrix[i : i + (1 << 14)]].astype(np.int64) + DIMS * np.arange(len(matrix[i : i + (1 << 14)]))[:, None]
        out[i : i + (1 << 14)] = np.minimum(np.bincount(part.reshape(-1), minlength=DIMS * len(part)), CAP).reshape(-1, DIMS)
    return out


def codes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in unary, four bits a dimension: numbers of differing bits are distances."""
    bits = UNARY[points] << (np.arange(DIMS, dtype=np.uint64) % np.uint64(16) * np.uint64(4))
    return np.bitwise_or.reduce(bits[:, :16], axis=1), np.bitwise_or.reduce(bits[:, 16:], axis=1)


class KdTree:
    """Nodes with their boxes; tight boxes of the points, or (tight=False) regions that fill the space."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool = True):
        self.lo, self.hi, self.kids, self.members = [], [], [], []
        self._node(points, np.arange(len(points)), leaf, tight, np.zeros(DIMS, np.uint8), np.full(DIMS, 255, np.uint8))
        self.leaves = [i for i, k in enumerate(self.kids) if k is None]

    def _node(self, points, mine, leaf, tight, lo, hi) -> int:
        at, own = len(self.kids), points[mine]
        if tight and len(own):
            lo, hi = own.min(axis=0), own.max(axis=0)
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append(None)
        self.members.append(None)
        spread = own.var(axis=0) if len(own) > leaf else np.zeros(1)
        if spread.max() > 0:
            d = int(spread.argmax())
            below = np.cumsum(np.bincount(own[:, d]))[:-1]
            cut = int(np.abs(below - len(own) / 2).argmin())
            if not 0 < below[cut] < len(own):
                cut = int(own[:, d].min())
            left, right, under = hi.copy(), lo.copy(), own[:, d] <= cut
            left[d], right[d] = cut, cut + 1
            self.kids[at] = (self._node(points, mine[under], leaf, tight, lo, left), self._node(points, mine[~under], leaf, tight, right, hi))
        else:
            self.members[at] = mine
        return at

    def search(self, q: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, each with the queries whose box meets its own: counts up by `more` in all and down by `less`."""
        todo = [(0, np.arange(len(q)))]
        while todo:
            at, mine = todo.pop()
            own = q[mine]
            up = (np.maximum(own, self.lo[at]) - own).sum(axis=1)
            down = (own - np.minimum(own, self.hi[at])).sum(axis=1)
            mine = mine[(up <= more) & (down <= less)]
            if len(mine) and self.kids[at] is None:
                yield at, mine
            elif len(mine):
                todo += [(k, mine) for k in self.kids[at]]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b, of like lengths or b longer by one, are one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead, behind, n = a == b[:, :-1], a == b[:, 1:], a.shape[1]
    prefix = np.where(ahead.all(axis=1), n, ahead.argmin(axis=1))
    suffix = np.where(behind.all(axis=1), n, behind[:, ::-1].argmin(axis=1))
    return prefix + suffix >= n


def near_in_cell(mat: np.ndarray, others: np.ndarray, leaf: int = 24, pairs: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of others, row of mat) that are one edit apart; others are of the same length or shorter by one."""
    if not len(mat) or not len(others):
        return
    points, q = counts(mat), counts(others)
    less = int(mat.shape[1] == others.shape[1])
    tree, (p0, p1), (q0, q1) = KdTree(points, leaf), codes(points), codes(q)
    for at, mine in tree.search(q, 1, less):
        own = tree.members[at]
        for i in range(0, len(mine), max(1, pairs // len(own))):
            some = mine[i : i + max(1, pairs // len(own))]
            a0, a1, b0, b1 = q0[some, None], q1[some, None], p0[own], p1[own]
            up = np.bitwise_count(b0 & ~a0) + np.bitwise_count(b1 & ~a1)
            down = np.bitwise_count(a0 & ~b0) + np.bitwise_count(a1 & ~b1)
            x, y = np.nonzero((up <= 1) & (down <= less))
            x, y = some[x], own[y]
            ok = one_edit(others[x], mat[y])
            yield x[ok], y[ok]


def top_trees(vocab: DataFrame, cell: int, sample: int, cells: int) -> dict[int, KdTree]:
    """Upper levels for lengths with more than `cell` words, from about `sample` words taken by a hash; at most about `cells` cells in all."""
    sizes = {r.size: r.k for r in vocab.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("k")).filter(F.col("k") > cell).collect()}
    if not sizes:
        return {}
    total = sum(sizes.values())
    share, cell = min(1.0, sample / total), max(cell, total // cells)
    rows = vocab.filter(F.length("word").isin(*sizes)).filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word").collect()
    by: dict[int, list[str]] = {}
    for r in sorted(rows):
        by.setdefault(len(r.word), []).append(r.word)
    return {s: KdTree(counts(letters(pa.array(ws), s)), max(8, int(cell * share)), tight=False) for s, ws in by.items()}


def searched(vocab: DataFrame, summary: bool, cell: int, sample: int, cells: int) -> DataFrame:
    """Pairs of near words by cells; or, with summary, of each word in a cell the number of those near and the best of them."""
    trees = top_trees(vocab, cell, sample, cells)

    def routed(table: pa.Table) -> pa.RecordBatch:
        """kind 0: stands in the cell and searches it; 1 and 2: only searches, as a word of the cell's length or shorter by one."""
        word = table.column("word").combine_chunks()
        size, parts = np.array([len(w) for w in word.to_pylist()], np.int64), []
        for s in np.unique(size).tolist():
            rows = np.flatnonzero(size == s)
            q = counts(letters(word.take(pa.array(rows)), s)) if s in trees or s + 1 in trees else None
            for length, kind, more, less in ((s, 0, 0, 0), (s, 1, 1, 1), (s + 1, 2, 1, 0)):
                if length in trees:
                    parts += [(length << 20 | at, kind, rows[mine]) for at, mine in trees[length].search(q, more, less)]
                elif kind != 1:
                    parts.append((length << 20, kind, rows))
        n = [len(r) for _, _, r in parts]
        at, to, kind = np.concatenate([r for _, _, r in parts]), np.repeat([c for c, _, _ in parts], n), np.repeat([k for _, k, _ in parts], n)
        # a word that stands in a cell searches it already
        home = np.zeros(len(size), np.int64)
        home[at[kind == 0]] = to[kind == 0]
        keep = (kind != 1) | (home[at] != to)
        taken = table.take(pa.array(at[keep]))
        return pa.RecordBatch.from_pydict({"cell": pa.array(to[keep]), "kind": pa.array(kind[keep], pa.int32()), "word": taken.column("word").combine_chunks(), "n": taken.column("n").combine_chunks()})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= 50_000:
                yield routed(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield routed(pa.Table.from_batches(held))

    def compare(group: pa.Table) -> pa.Table:
        size, kind = int(group.column("cell")[0].as_py()) >> 20, group.column("kind").to_numpy()
        word, n = group.column("word").combine_chunks(), group.column("n").to_numpy()
        here, a, b = np.flatnonzero(kind == 0), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for searching, length in ((kind < 2, size), (kind == 2, size - 1)):
            other = np.flatnonzero(searching)
            if len(here) and len(other):
                for x, y in near_in_cell(letters(word.take(pa.array(here)), size), letters(word.take(pa.array(other)), length)):
                    a += [other[x], here[y]][: 1 + (length < size)]
                    b += [here[y], other[x]][: 1 + (length < size)]
        a, b = np.concatenate(a), np.concatenate(b)
        if summary:
            order = np.empty(len(word), np.int64)
            order[pc.sort_indices(word).to_numpy()] = np.arange(len(word))
            by = np.lexsort((order[b], -n[b], a))
            a, first, k = np.unique(a[by], return_index=True, return_counts=True)
            b = b[by][first]
        out = {"word": word.take(pa.array(a)), "n": pa.array(n[a]), "near": word.take(pa.array(b)), "near_n": pa.array(n[b])}
        return pa.table(out | ({"k": pa.array(k)} if summary else {}))

    rows = vocab.select("word", "n").mapInArrow(route, "cell long, kind int, word string, n long")
    return rows.groupBy("cell").applyInArrow(compare, "word string, n long, near string, near_n long" + ", k long" * summary)


def near_words(vocab: DataFrame, *, cell: int = 50_000, sample: int = 100_000, cells: int = 4096) -> DataFrame:
    """word, n, near and near_n for every pair of words one edit apart, in both directions."""
    return searched(vocab, False, cell, sample, cells)


def variants(docs: DataFrame, *, ratio: int = 10, least_size: int = 7, least_n: int = 2, damage: int | None = 31, cell: int = 50_000, sample: int = 100_000, cells: int = 4096) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    vocab = tables.stored(vocabulary(docs, least_size=least_size, least_n=least_n, damage=damage), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    near = searched(vocab, True, cell, sample, cells).groupBy("word", "n").agg(F.sum("k").alias("n_near"), best.alias("best"))
    strong = -F.col("best.n") >= ratio * F.col("n")
    found = tables.stored(near.select("word", "n_near", F.when(strong, F.col("best.w")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n")), "words-near")
    links = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        after = links.alias("a").join(links.select(F.col("word").alias("root"), F.col("root").alias("then")), "root", "left")
        after = tables.stored(after.select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "words-root")
        links = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            break
    out = vocab.join(found, "word", "left").join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
