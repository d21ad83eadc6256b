"""Conversation repair against a plain search over edits."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lamina.llm import queries, turns

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of rows (turn, role, text) in order."""
    seen, must, late, n = set(), [], [], [0, 0, 0]
    for _, role, text in rows:
        fault = 0 if not text.strip(WS) else 1 if (role, text) in seen else 2 if text.rstrip(WS)[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            n[fault] += 1
        must.append(fault in (0, 1))
        late.append(fault == 2)
    legal = re.compile("(s?(ua)+)?")

    def ok(state):  # what may still come: a beginning of a legal sequence
        return any(legal.fullmatch(state + x) for x in ("", "a", "ua"))

    @functools.cache
    def best(i, state, made=0):
        """Cheapest cost and edits from row i on; state: the role initials so far, of pairs only the first; made: inserts just before."""
        found = [(0, "", ())] if i == len(rows) and legal.fullmatch(state) else []

        def then(c, label, i2, new, item, made=0):
            cost, audit, out = best(i2, new[:-2] if re.fullmatch("s?uaua", new) else new, made)
            found.append((c + cost, label + audit, item + out))

        if i < len(rows):
            _, role, text = rows[i]
            then(4, "D", i + 1, state, ())
            if not must[i]:
                if role and ok(state + role[0]):
                    then(3 * late[i], "K", i + 1, state + role[0], (f"{role}:{text}",))
                for to in ("user", "assistant"):
                    if ok(state + to[0]):
                        then(3 + 3 * late[i], "R", i + 1, state + to[0], (f"{to}:{text}",))
        for to in ("user", "assistant"):
            if made < 3 and ok(state + to[0]):
                then(3, "I", i, state + to[0], (f"{to}:",), made + 1)
        return min(found, default=(10**9, "", ()))

    cost, audit, out = best(0, "")
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def expected(rows, convs):
    want = {c: [] for c in convs}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        want[c].append((t, role, text))
    return {c: plain(x) for c, x in want.items()}


def talks(seed=3, n=120):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, 9)):
            role = r.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "U"))
            text = r.choice(("yes.", "no!", "why?", "half", " \t", None, "a\nb. ", "naïve é", "x" * r.randrange(5) + "."))
            rows.append((c if c else None, r.choice((t, t, t, t + 3, None)), role, text))
    return rows + rows[:9] + [(n + 1, 0, "system", "only."), (n + 2, 5, "user", ". ! ?" + "long " * 50000)]


SCHEMA = "conv_id long, turn long, role string, text string, here0 string, copy int, seg int, pos string, rows int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(3)


def got(df):
    return {r.conv_id: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"long_rows": 3, "seg_rows": 2}, {"long_chars": 1, "seg_rows": 1}, {"long_rows": 5, "seg_chars": 1}])
def test_repair_equals_plain_search(spark, limits):
    rows = talks()
    out = turns.repair(turns.damaged(frame(spark, rows)), **limits)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(out) == expected(damaged(rows), {r[0] for r in rows})


def test_one_conversation_of_many_rows(spark):
    """Cut into segments or whole, the result is one."""
    r = random.Random(8)
    rows = [(7, t, r.choice(("user", "assistant", "system")), r.choice(("ok.", f"t {t}", f"u {t}.", f"v {t}!"))) for t in range(3000)] + [(8, 0, "user", "hi."), (8, 1, "assistant", "yes.")]
    df = frame(spark, rows)
    whole = got(turns.repair(df))
    assert whole == got(turns.repair(df, long_rows=100, seg_rows=64)) and len(whole[7][6]) >= 3000


def test_empty_and_gone(spark):
    assert turns.repair(turns.damaged(frame(spark, talks()).limit(0))).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert got(turns.repair(turns.damaged(frame(spark, [(1, gone, "user", "x")])))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_ranks_order_audits():
    """A node's rank is its audit's place among all audits."""
    r = np.random.default_rng(2)
    role, must, late, size = r.integers(0, 4, 40), r.random(40) < 0.2, r.random(40) < 0.3, np.array([40])
    late &= ~must
    v = turns.cost_to_go(role, must, late, np.array([0]), size, turns.AT_END[None])
    paths = turns.Paths(role, must, late, np.array([0]), size, v, np.array([True]))
    nodes, count = paths.walk(np.arange(4 * 41))
    audits = [bytes(turns.LABELS[k] for k in paths.label[x]) for x in np.split(nodes, np.cumsum(count)[:-1])]
    assert np.argsort(np.argsort(sorted(set(audits)))).tolist() == list(range(len(set(audits))))
    order = {a: i for i, a in enumerate(sorted(set(audits)))}
    ranks = sorted(set(zip((order[a] for a in audits), paths.rank.tolist())))
    assert len(ranks) == len(order) and [y for _, y in ranks] == sorted(y for _, y in ranks)


def test_query_on_the_given_table(spark):
    import pandas as pd

    rows = [tuple(x) for x in pd.read_parquet("/root/testdata/sf0.001/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    assert got(queries.op11_conversation_repair(spark, "/root/testdata/sf0.001")) == expected(damaged(rows), {r[0] for r in rows})
