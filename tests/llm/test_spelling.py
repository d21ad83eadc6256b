"""Spelling variants against all pairs that share a text with one letter less."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lamina.llm import queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """word -> (form, root, n, n_near, form_n)"""
    n = Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    shorter, near = defaultdict(set), {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            shorter[less, i].add(w)
            if less in n:
                near[w].add(less)
                near[less].add(w)
    for ws in shorter.values():
        for w in ws:
            near[w] |= ws - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), k, len(near[w]), n[form[w]] if w in form else None) for w, k in n.items()}


def texts():
    r = random.Random(6)
    roots = ["".join(r.choice("aeiourstlnéèÀÿ×") for _ in range(r.randrange(6, 14))) for _ in range(40)]
    rows = []
    for d in range(300):
        ws = []
        for _ in range(r.randrange(3, 60)):
            w = r.choice(roots)
            for _ in range(r.choice((0, 0, 0, 0, 1, 1, 2))):
                i = r.randrange(len(w))
                w = r.choice((w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + r.choice("aeB") + w[i + 1 :]))
            ws.append(w)
        rows.append((d, r.choice((" ", "1", "_", "\n")).join(ws)))
    chain = ["abcdefgh"] * 3 + ["abcdefgx"] * 30 + ["abcdefxx"] * 300 + ["abcdexxx"] * 3000 + ["short"] * 9
    same = ["listens", "silents", "enlists", "tinsels"] * 2  # like counts, no near words
    long = ["z" * 5000, "z" * 4999, "z" * 5000, "z" * 4999]
    return [*rows, (None, " ".join(same)), (1000, None), (1001, ""), (1002, " ".join(chain)), (1002, " ".join(long)), (1003, " ".join(long)), rows[0], rows[0]]


SCHEMA = "doc_id long, text string, word string, n long, near string, cell long, kind int, form string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, "v", 2, 3, "f") for r in rows], SCHEMA).repartition(3)


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("sizes", [{}, {"cell": 20, "sample": 100}, {"cell": 5, "sample": 30, "cells": 9}])
def test_variants_equal_all_pairs(spark, sizes):
    rows = texts()
    want = plain(rows)
    assert sum(x[0] is not None for x in want.values()) > 20 and want["abcdefgh"][1] == "abcdexxx"
    out = spelling.variants(frame(spark, rows), **sizes)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(out) == want


def test_pairs_of_near_words(spark):
    rows = texts()
    vocab = spelling.vocabulary(frame(spark, rows))
    pairs = [(r.word, r.near) for r in spelling.near_words(vocab, cell=30, sample=200).collect()]
    assert len(set(pairs)) == len(pairs) == sum(x[3] for x in plain(rows).values())


def test_tree_search_is_exact():
    r = np.random.default_rng(3)
    mat, other = r.integers(97, 101, (700, 8)).astype(np.uint8), r.integers(97, 101, (500, 7)).astype(np.uint8)
    for q in (mat, other):
        found = {(a, b) for x, y in spelling.near_in_cell(mat, q, leaf=5, pairs=50) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
        near = {(i, j) for i, a in enumerate(map(bytes, q)) for j, b in enumerate(map(bytes, mat)) if (sum(p != s for p, s in zip(a, b)) == 1 if len(a) == len(b) else any(b[:k] + b[k + 1 :] == a for k in range(8)))}
        assert found == near


def test_no_words(spark):
    assert spelling.variants(frame(spark, texts()).limit(0)).count() == 0
    assert spelling.variants(frame(spark, [(1, "a b"), (2, None)])).count() == 0


def test_query_on_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(queries.op12_spelling_variants(spark, "/root/testdata/sf0.001")) == plain(rows)
