"""Packing against the library's ids, an exhaustive packing and item-by-item best fit."""

import random
import zlib

import numpy as np
import pytest

from lamina.llm import packing, queries

path = lambda name: pytest.importorskip("public_tokenizers").path(name)


def exact(items, capacity):
    """The least number of bins, by trying everything."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(items):
            best = len(room)
            return
        for r in set(room):
            if r >= items[i]:
                k = room.index(r)
                go(i + 1, [*room[:k], r - items[i], *room[k + 1 :]])
        go(i + 1, [*room, capacity - items[i]])

    go(0, [])
    return best


def fits(items, capacity):
    room = []
    for s in sorted(items, reverse=True):
        k = min((i for i, r in enumerate(room) if r >= s), key=lambda i: room[i], default=None)
        if k is None:
            room.append(capacity - s)
        else:
            room[k] -= s
    return len(room)


def bins(patterns):
    return sum(copies for _, copies in patterns)


def test_reduction_keeps_the_optimum():
    r, fixed_items = random.Random(1), 0
    for _ in range(400):
        c = r.choice((10, 20, 37))
        items = [r.randint(r.choice((1, 3, c // 4)), r.choice((c, c // 2 + 1))) for _ in range(r.randint(0, 10))]
        h = np.bincount(items, minlength=c + 1).astype(np.int64)
        fixed, rest = packing.reduce(h, c)
        left = np.repeat(np.arange(c + 1), rest).tolist()
        fixed_items += len(items) - len(left)
        assert bins(fixed) + exact(left, c) == exact(items, c)
        assert bins(packing.best_fit(h, c)) == fits(items, c)
        held = np.zeros(c + 1, np.int64)
        for content, copies in packing.plan(h, c):
            assert sum(s * t for s, t in content) <= c
            for s, t in content:
                held[s] += t * copies
        assert (held == h).all()
    assert fixed_items > 500


def test_patterns_stay_few():
    """A histogram of any height has a plan of a bounded size, near the sum's bound."""
    h = np.random.default_rng(0).integers(0, 10**9, 1025)
    h[0] = 0
    plan = packing.plan(h, 1024)
    assert len(plan) < 4096 and bins(plan) < 1.01 * (h * np.arange(1025)).sum() / 1024


def check(rows, out, capacity, keep_ids=False):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = []
    for d, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = list(range(len(ids), 0, -capacity))[::-1]
        for p, (a, b) in enumerate(zip([0, *cuts], cuts)):
            want.append((-1 if d is None else d, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= capacity
    assert len(by) == bins(packing.plan(np.bincount([x[3] for x in want], minlength=capacity + 1), capacity))
    return by


SCHEMA = "doc_id long, text string, part int, k long, length long, n long, before long, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "x") for r in rows], SCHEMA).repartition(4)


def texts():
    r = random.Random(2)
    rows = [(d, " ".join(r.choice(("the", "anedly", "ouuon", "é", "12", "..")) for _ in range(r.choice((0, 1, 5, 40, 100, 700))))) for d in range(120)]
    return [*rows, (200, None), (201, ""), (None, "no id"), (None, None), rows[3], rows[3], (202, "word " * 20000), *((300 + i, "same text") for i in range(100))]


@pytest.mark.parametrize("capacity", [1024, 64, 1])
def test_pack(spark, capacity):
    rows = texts() if capacity > 1 else texts()[:20]
    out = packing.pack(frame(spark, rows), path("byte_bpe_50k.json"), capacity=capacity).collect()
    check(rows, out, capacity)


def test_sequences_hold_the_ids(spark):
    rows = texts()
    packed = packing.pack(frame(spark, rows), path("byte_bpe_50k.json"), capacity=128, keep_ids=True)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    out = packed.collect()
    assert set(whole) == {r.sequence_id for r in out}
    for r in out:
        ids = whole[r.sequence_id].ids
        assert len(ids) == 4 * whole[r.sequence_id].n_tokens and bytes(ids[4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids)


def test_no_documents(spark):
    assert packing.pack(frame(spark, texts()).limit(0), path("byte_bpe_50k.json")).count() == 0


def test_query_on_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(rows, queries.op13_best_fit_packing(spark, "/root/testdata/sf0.001").collect(), 1024)
