"""Language-model scores by a probabilistic suffix tree over words.

Symbols are a text's lower-cased words and then one end. A context is the up to `depth` symbols before one (a start among them), named by a
64-bit hash. The root has the base distribution, (c + 0.5) / (N + 0.5 (V + 1)). Level by level, Spark counts what follows the contexts that
occur at least `least` times; a context's listed successors are those that follow it at least `few` times; all others share the rest of its mass in
proportion to the next shorter suffix. Both counts grow with the root of the corpus only, N^0.5 / 40 and N^0.5 / 1000, so the tree has up to
1000 N^0.5 entries a level: it grows with the input, and rarer contexts reach the test in a larger corpus. A context stays in the tree by a
divergence test: the log likelihood of what follows, over that under its suffix, is to exceed `gain` * (listed + 1) * ln(count) / 2.
Suffixes of what stays stay. Distributions are smoothed into the suffix's (Witten-Bell). A symbol's probability is that in the longest suffix of its
past in the tree.

Each level is one pass over the texts: it counts what follows the contexts of that level, all of them, by a shuffle on context and symbol. All suffixes
of a context end in the same word, so what is counted falls into blocks by that word: the driver builds them one by one, each with at most
about `block` entries a level, and what a block holds does not depend on their number. Trees that have passed the test are packed together up to `block` entries for scoring;
a further pack is a further map over the texts.

Symbols are 64-bit hashes of words. Words that occur less than `few` times cannot be listed nor be in a context, so they are counted as one symbol: a bitmap of
2^BITS places, made by Spark, tells most of them; those that it does not tell only make more rows to shuffle. Word counts are a table in the shared folder. For the base
score words of at least the share `frequent` of all tokens (at most 1 / frequent of them) are broadcast and the others joined, which changes no score.

Null texts count as empty: one end token. Rows with a null doc_id train nothing and have a null held_out; repeated rows count as often as
they are there. With no training documents every token has the base value of an empty count. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, words
from .labelled import remainder
from .tables import discard, stored

END_TOKEN = -(1 << 63)  # in place of a word's hash
#: In place of a word's hash: a start, and any word that is too rare
START, OTHER = END_TOKEN + 1, END_TOKEN + 2
#: Places of the bitmap of words that are not too rare
BITS = 26


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, bounds) of the texts [first, last), an end token after the words of each."""
    for i, j, h, bounds in words.hashed_words(column, words.NOT_SPACE):
        out = np.insert(h.view(np.int64), bounds[1:], END_TOKEN)
        yield i, j, out, bounds + np.arange(j - i + 1)


def lookup(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in the sorted names, or -1."""
    if not len(names):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(names, keys)
    at[at == len(names)] = 0
    at[names[at] != keys] = -1
    return at


def follow(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The name of a context and what follows it."""
    with np.errstate(over="ignore"):
        return words.mix(context.view(np.uint64) * np.uint64(3) + symbol.astype(np.uint64)).view(np.int64)


def symbols(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The hashes h, or OTHER where the bitmap says that a word is too rare."""
    place = h.view(np.uint64) >> np.uint64(64 - BITS)
    known = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return np.where(known | (h == END_TOKEN), h, OTHER)


def contexts(ids: np.ndarray, bounds: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 to depth the names of the k symbols before each token, and whether there are as many, none of them too rare.

    A context of k + 1 symbols is one of k, a place earlier, with what follows it.
    """
    n = len(ids)
    place, last = before(ids, bounds)
    name, ok = follow(np.zeros(n, np.int64), last), last != OTHER
    for k in range(1, depth + 1):
        yield name, ok
        name, ok = follow(name, ids)[np.arange(n) - 1], ok[np.arange(n) - 1] & (last != OTHER) & (place >= k)


def before(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each token in its text and the symbol before it."""
    place = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
    return place, np.where(place > 0, ids[np.arange(len(ids)) - 1], START)


def _sums(batches: Iterator[pa.RecordBatch], keys_of, names: tuple[str | None, ...], most: int) -> Iterator[pa.RecordBatch]:
    """The columns `names` (the first a key; None is not given out) and c, summed by key within a task and given out when more than `most` keys are held."""
    held, fresh = [], 0

    def merged(parts):
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(cols[0], kind="stable")
        cols = [x[order] for x in cols]
        first = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])) if len(order) else np.zeros(0, np.int64)
        return [*(x[first] for x in cols[:-1]), np.add.reduceat(cols[-1], first) if len(order) else cols[-1]]

    def out(cols):
        return pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in zip((*names, "c"), cols, strict=True) if name})

    for b in batches:
        for _, _, h, bounds in tokens(b.column(0)):
            cols = keys_of(h, bounds)
            _, first, c = np.unique(cols[0], return_index=True, return_counts=True)
            held.append([*(x[first] for x in cols), c])
            fresh += len(c)
            if fresh > most:
                cols = merged(held)
                held, fresh = [cols], 0
                if len(cols[0]) > most:
                    yield out(cols)
                    held = []
    if held:
        yield out(merged(held))


def word_counts(docs: DataFrame, most: int = 1 << 21) -> DataFrame:
    """key (a word's hash) and c over all texts."""
    return docs.select("text").mapInArrow(lambda batches: _sums(batches, lambda h, bounds: (h,), ("key",), most), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def bitmap(counts: DataFrame, few: float) -> np.ndarray:
    """2^BITS bits: which places have a word that occurs at least `few` times. Spark makes it; the driver gets at most 2^(BITS - 6) rows."""
    place = F.shiftrightunsigned("key", 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    got = counts.filter(F.col("c") >= few).groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def followers(docs: DataFrame, bits, known, k: int, blocks: int = 1, most: int = 1 << 20) -> DataFrame:
    """p (a known context of k symbols), s (what follows), c, and with several blocks that of the context."""
    more = ["block"] if blocks > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, have = bits.value, known.value

        def keys_of(h: np.ndarray, bounds: np.ndarray) -> tuple:
            ids = symbols(h, often)
            *_, (name, ok) = contexts(ids, bounds, k)
            some = np.flatnonzero(ok)
            some = some[lookup(have, name[some]) >= 0]
            block = [before(ids, bounds)[1][some] % blocks] if blocks > 1 else []
            return follow(name[some], ids[some]), name[some], ids[some], *block

        yield from _sums(batches, keys_of, (None, "p", "s", *more), most)

    schema = ", ".join(f"{x} long" for x in ("p", "s", *more, "c"))
    return docs.select("text").mapInArrow(run, schema).groupBy("p", "s", *more).agg(F.sum("c").alias("c"))


@dataclass
class Tree:
    """By level, from 1: sorted contexts and log10 of the factor of what they do not list; sorted names of contexts with what they list, and log10 of its probability over the root's."""

    names: list[np.ndarray]
    rest: list[np.ndarray]
    keys: list[np.ndarray]
    past: list[np.ndarray]

    def entries(self) -> int:
        return sum(map(len, self.names)) + sum(map(len, self.keys))

    def past_root(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 P(token | longest suffix in the tree) - log10 P(token) of each token."""
        out = np.zeros(len(ids))
        met = []
        live = np.arange(len(ids))  # the suffixes of a context of the tree are in the tree
        for k, (name, ok) in enumerate(contexts(ids, bounds, len(self.names))):
            live = live[ok[live]]
            at = lookup(self.names[k], name[live])
            live, at = live[at >= 0], at[at >= 0]
            met.append((live, at, follow(name[live], ids[live])))
        done = np.zeros(len(ids), bool)
        for k in range(len(met) - 1, -1, -1):  # from the longest suffix down to the one that lists the token
            live, at, key = met[k]
            now = ~done[live]
            live, at = live[now], at[now]
            hit = lookup(self.keys[k], key[now])
            listed = hit >= 0
            out[live[listed]] += self.past[k][hit[listed]]
            done[live[listed]] = True
            out[live[~listed]] += self.rest[k][at[~listed]]
        return out


def together(trees: list[Tree]) -> Tree:
    """One tree of those of several blocks, which share no context."""
    out = Tree([], [], [], [])
    for k in range(max((len(t.names) for t in trees), default=0)):
        for of, by in ((out.names, out.rest), (out.keys, out.past)):
            pairs = [(t.names[k], t.rest[k]) if of is out.names else (t.keys[k], t.past[k]) for t in trees if k < len(t.names)]
            x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
            order = np.argsort(x, kind="stable")
            of.append(x[order])
            by.append(y[order])
    return out


def grow(docs: DataFrame, counts: DataFrame, bits, bottom: float, depth: int, least: float, few: float, gain: float, blocks: int = 1) -> Iterator[Tree]:
    """The tree of docs, block by block. counts (stored): key and c of all words; root probabilities are (c + 0.5) over 10^bottom.

    A level's contexts come to the driver as names, at most one for every `least` tokens; counts of one block at a time.
    """
    spark = docs.sparkSession
    words_ = counts.filter((F.col("c") >= least) & (F.col("key") != END_TOKEN)).select("key").toArrow()["key"].to_numpy()
    last = np.append(words_, START)
    names = np.unique(follow(np.zeros(len(last), np.int64), last))
    ups = np.zeros(len(names), np.int64)  # names of their suffixes
    roots = counts.filter(F.col("c") >= few).select(F.col("key").alias("s"), F.col("c").alias("all"))
    tables_: list[tuple] = []
    for k in range(1, depth + 1):
        if not len(names):
            break
        got = stored(followers(docs, bits, spark.sparkContext.broadcast(names), k, blocks), f"pst-level{k}")
        more = ["block"] if blocks > 1 else []
        sums = got.groupBy("p", *more).agg(F.sum("c").alias("n")).filter(F.col("n") >= least)
        listed = got.filter((F.col("c") >= few) & (F.col("s") != OTHER)).join(roots, "s").select("p", "s", "c", "all", *more)
        if blocks > 1:
            tables_.append((names, ups, stored(sums, f"pst-sums{k}", "block"), stored(listed, f"pst-listed{k}", "block")))
        else:
            tables_.append((names, ups, sums.toArrow(), listed.toArrow()))
        longer = got.filter((F.col("c") >= least) & ~F.col("s").isin(OTHER, END_TOKEN)).select("p", "s").toArrow()
        p, s = longer["p"].to_numpy(), longer["s"].to_numpy()
        # contexts of the next level, whatever their block
        ups = follow(ups[lookup(names, p)], s)
        names, first = np.unique(follow(p, s), return_index=True)
        ups = ups[first]
        discard(got)
    for b in range(blocks):
        yield tree_of([(*row[:2], *(x.filter(F.col("block") == b).toArrow() if blocks > 1 else x for x in row[2:])) for row in tables_], bottom, gain)
    if blocks > 1:
        discard(*(x for row in tables_ for x in row[2:]))


def tree_of(counted: list[tuple], bottom: float, gain: float) -> Tree:
    """Distributions from the root down, and the test of each context against its suffix, from (contexts, their suffixes, sums, listed) of each level of a block."""
    tree, ups, owners, probs, stays = Tree([], [], [], []), [], [], [], []

    def prob(k: int, at: np.ndarray, s: np.ndarray, root: np.ndarray) -> np.ndarray:
        """P(s | context `at` of level k)."""
        out, at, live = np.ones(len(s)), at.copy(), np.arange(len(s))
        for j in range(k - 1, -1, -1):
            hit = lookup(tree.keys[j], follow(tree.names[j][at[live]], s[live]))
            found = hit >= 0
            out[live[found]] *= probs[j][hit[found]]
            live = live[~found]
            out[live] *= tree.rest[j][at[live]]
            at[live] = ups[j][at[live]]
        out[live] *= root[live]
        return out

    for k, (names, suffixes, sums, listed) in enumerate(counted):
        order = np.argsort(sums["p"].to_numpy())
        ctx, n = (sums[x].to_numpy()[order] for x in ("p", "n"))
        parent = lookup(tree.names[-1], suffixes[lookup(names, ctx)]) if k else np.zeros(len(ctx), np.int64)
        ctx, n, parent = ctx[parent >= 0], n[parent >= 0].astype(float), parent[parent >= 0]
        key = follow(listed["p"].to_numpy(), listed["s"].to_numpy())
        order = np.argsort(key)
        key, p_, s, c, all_ = key[order], *(listed[x].to_numpy()[order] for x in ("p", "s", "c", "all"))
        at = lookup(ctx, p_)
        key, s, c, all_, at = (x[at >= 0] for x in (key, s, c, all_, at))
        root = (all_ + 0.5) / 10.0**bottom
        below = prob(k, parent[at], s, root)
        kinds = np.bincount(at, minlength=len(ctx)) + 1.0
        p = (c + kinds[at] * below) / (n + kinds)[at]
        left = np.maximum(1 - np.bincount(at, p, len(ctx)), 1e-12)
        left_below = np.maximum(1 - np.bincount(at, below, len(ctx)), 1e-12)
        other = np.maximum(n - np.bincount(at, c, len(ctx)), 0)
        won = np.bincount(at, c * np.log(p / below), len(ctx)) + other * np.log(left / left_below)
        stays.append(won >= gain * kinds * np.log(np.maximum(n, 2)) / 2)
        for of, x in ((tree.names, ctx), (tree.rest, left / left_below), (tree.keys, key), (tree.past, np.log10(p / root)), (ups, parent), (owners, at), (probs, p)):
            of.append(x)
    for k in range(len(stays) - 1, 0, -1):  # the suffix of what stays stays
        stays[k - 1][ups[k][stays[k]]] = True
    for k, keep in enumerate(stays):
        mine = keep[owners[k]]
        tree.names[k], tree.rest[k], tree.keys[k], tree.past[k] = tree.names[k][keep], np.log10(tree.rest[k][keep]), tree.keys[k][mine], tree.past[k][mine]
    return tree


def packs(trees: Iterator[Tree], most: int) -> Iterator[Tree]:
    """The trees together, as many at a time as have at most `most` entries; one at least."""
    held: list[Tree] = []
    size = 0
    for tree in trees:
        if held and size + tree.entries() > most:
            yield together(held)
            held, size = [], 0
        held.append(tree)
        size += tree.entries()
    yield together(held)


def scores(docs: DataFrame, *, held_out: int = 1, depth: int = 5, gain: float = 1.0, frequent: float = 2.5e-7, block: int = 1 << 24) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    tables.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.filter(F.col("doc_id").isNotNull() & (remainder() != held_out))
    counts = stored(word_counts(training), "pst-words").select(F.col("key").alias("h"), "c")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    bottom = float(np.log10(n + 0.5 * (v + 1)))
    often = counts.filter((F.col("c") >= max(1.0, frequent * n)) | (F.col("h") == END_TOKEN)).toArrow()  # at most 1 / frequent rows and the end
    order = np.argsort(often["h"].to_numpy())
    names, logs = often["h"].to_numpy()[order], np.log10(often["c"].to_numpy()[order] + 0.5)
    least, few = max(n**0.5 / 40, 4.0), max(n**0.5 / 1000, 2.0)
    by_key = counts.withColumnRenamed("h", "key")
    blocks = max(1, int(np.ceil(1000 * n**0.5 / block)))
    words_, bits = spark.sparkContext.broadcast((names, logs)), spark.sparkContext.broadcast(bitmap(by_key, few))

    def run(batches: Iterator[pa.RecordBatch], shared, first: bool) -> Iterator[pa.RecordBatch]:
        names, logs = words_.value
        tree = shared.value
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for i, j, h, bounds in tokens(b.column(1)):
                doc = np.repeat(np.arange(j - i), np.diff(bounds))
                past = np.bincount(doc, tree.past_root(symbols(h, bits.value), bounds), j - i)
                rows = {"row": pa.array(row + np.arange(j - i)), "past": pa.array(past)}
                row += j - i
                if first:  # the other packs add their part of the score only
                    at = lookup(names, h)
                    known = at >= 0
                    own = np.where(known, logs[at], 0.0) if len(names) else np.zeros(len(h))
                    rare = ~known & (h != END_TOKEN)
                    cut = np.searchsorted(doc[rare], np.arange(j - i + 1)).astype(np.int32)
                    rows |= {
                        "doc_id": b.column(0).slice(i, j - i), "n_tokens": pa.array(np.diff(bounds)), "known": pa.array(np.bincount(doc[known], minlength=j - i).astype(np.int64)),
                        "base": pa.array(np.bincount(doc, own, j - i)), "rare": pa.ListArray.from_arrays(pa.array(cut), pa.array(h[rare])),
                    }
                yield pa.RecordBatch.from_pydict(rows)

    schema = "row long, past double"
    parts = []
    for k, tree in enumerate(packs(grow(training, by_key, bits, bottom, depth, least, few, gain, blocks), block)):
        shared = spark.sparkContext.broadcast(tree)
        more = "" if k else ", doc_id long, n_tokens long, known long, base double, rare array<long>"
        parts.append(stored(docs.mapInArrow(lambda batches, shared=shared, first=not k: run(batches, shared, first), schema + more), "pst-scored"))
    made = parts[0]
    for other in parts[1:]:
        made = made.join(other.withColumnRenamed("past", "part"), "row").withColumn("past", F.col("past") + F.col("part")).drop("part")
    asked = made.select("row", F.explode("rare").alias("h")).join(counts, "h").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 0.5)).alias("logs"))
    out = made.drop("rare").join(asked, "row", "left").fillna(0, ["more", "logs"])
    all_known = F.col("known") + F.col("more")
    base = F.col("base") + F.col("logs") + (F.col("n_tokens") - all_known) * F.log10(F.lit(0.5)) - F.col("n_tokens") * F.lit(bottom)
    out = out.withColumn("base_score", base)
    return out.select("doc_id", (remainder() == held_out).alias("held_out"), "n_tokens", all_known.alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("past")).alias("score"))
