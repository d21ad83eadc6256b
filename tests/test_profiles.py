"""Profiles on common heights: clusters and inflections against numpy."""

import itertools

import numpy as np
import pytest

from lamina.operators import structure


def profiles(seed=1):
    """Three shapes with ranges of their own; the same shape over 10 m and 40 m is two kinds."""
    r = np.random.default_rng(seed)
    out = {}
    for i in range(36):
        top = (10.0, 40.0, 40.0)[i % 3]
        z = np.unique(np.round(np.r_[0.0, np.sort(r.uniform(0, top, 14)), top], 2))
        shape = (lambda u: 1 - u, lambda u: 1 - u, lambda u: u)[i % 3]
        out[i] = (z, shape(z / top) * r.uniform(1, 5) + r.uniform(0, 0.02, len(z)))
    return out


def frame(spark, ps):
    rows = [(k, float(z), float(v), "x") for k, (zs, vs) in ps.items() for z, v in zip(zs, vs, strict=True)] + [(0, 3.0, None, "x"), (0, None, 1.0, "x")]
    return spark.createDataFrame(rows, "p int, z double, lad double, i string").repartition(3)


@pytest.mark.parametrize("hold", [True, False])
def test_common_heights(spark, hold):
    ps = {1: ([2.0, 4.0, 4.0, 8.0], [1.0, 3.0, 5.0, 0.0]), 2: ([5.0], [7.0])}
    at = [0.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 9.0]
    got = {(r.p, r.i): (r.z, r.lad) for r in structure.on_heights(frame(spark, ps).filter("p > 0"), ["p"], "z", "lad", at, hold).collect()}
    want = {}
    for i, z in enumerate(at):
        if hold or 2 <= z <= 8:
            want[1, i] = (z, float(np.interp(z, [2, 4, 8], [1, 4, 0])))
        if hold or z == 5:
            want[2, i] = (z, 7.0)
    assert got == want


def test_clusters(spark):
    ps = profiles()
    got = {r.p: r.cluster for r in structure.profile_cluster(frame(spark, ps), ["p"], "z", "lad", starts=5).collect()}
    assert len(got) == 36
    grid = np.linspace(0, 40, 100)
    m = np.array([np.interp(grid, *ps[i]) for i in range(36)])
    m /= m.sum(axis=1, keepdims=True)
    m = (m - m.mean(axis=0)) / m.std(axis=0, ddof=1)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    x = u[:, :3] * s[:3]
    best = None
    for seed in range(200):  # many starts of plain k-means
        c = x[np.random.default_rng(seed).choice(36, 3, replace=False)]
        for _ in range(50):
            a = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[a == k].mean(axis=0) if (a == k).any() else c[k] for k in range(3)])
        cost = ((x - c[a]) ** 2).sum()
        if best is None or cost < best[0] - 1e-9:
            best = (cost, a)
    mine = np.array([got[i] for i in range(36)])
    assert any((mine == np.array(p)[best[1]]).all() for p in itertools.permutations((1, 2, 3)))
    assert len({got[i] for i in range(0, 36, 3)} | {got[i] for i in range(1, 36, 3)}) > 1  # one shape, two ranges


def test_no_profiles(spark):
    none = frame(spark, profiles()).limit(0)
    assert structure.profile_cluster(none, ["p"], "z", "lad").count() == 0
    assert structure.inflections(none, ["p"], "z", "lad").count() == 0


def test_inflections(spark):
    z = np.round(np.arange(0, 30.5, 0.5), 2)
    fall = lambda h: 2 / (1 + np.exp(h - 8)) + 1 / (1 + np.exp((h - 22) * 1.5))
    ps = {0: (z, fall(z)), 1: (np.r_[z[::3], 45.0], np.r_[fall(z[::3]) + 0.5, 0.0]), 2: (z[4::2], fall(z[4::2]) * 2)}
    got = structure.inflections(frame(spark, ps), ["p"], "z", "lad").collect()
    heights = z[(z >= 2.0) & (z <= 30)]  # those of the longest, where all have values
    mean = np.mean([np.interp(heights, *ps[k]) for k in ps], axis=0)
    fine = np.arange(2, 30, 0.05)
    slope = np.diff(np.interp(fine, heights, mean))
    assert {r.max_height for r in got} == {45.0}
    main = [r.inflection for r in got]
    assert any(abs(x - 8) < 1 for x in main) and any(abs(x - 22) < 1.5 for x in main) and len(main) <= 4
    assert all(2.0 <= x <= 30 for x in main) and slope.min() < 0
    for r in got:
        assert abs(r.density - np.interp(r.inflection, heights, mean)) < 0.1
