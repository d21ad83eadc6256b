"""Two-stream inversion against plain scalar arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import climate
from lamina.operators.grid import fill_gaps, fill_multiscale, usable_levels


def albedo(leaf, pai, ground, x):
    through = 0.33 * leaf
    om, de = leaf + through, leaf - through
    angle = min(9.65 * (3 + x) ** -1.65, math.pi / 2)
    j = 1 / 3 if x == 1 else math.cos(angle) ** 2
    a, g = 1 - om, 0.5 * (om + j * de)
    h = math.sqrt(a * a + 2 * a * g)
    s, u = math.exp(-h * pai), a + g * (1 - 1 / ground)
    d = (a + g + h) * (u - h) / s - (a + g - h) * (u + h) * s
    return g / (d * s) * (u - h) - g * s / d * (u + h)


def root(f, lo, hi):
    for _ in range(100):
        mid = (lo + hi) / 2
        y = f(mid)
        if abs(y) < 1e-6:
            return mid
        lo, hi = (lo, mid) if f(lo) * y < 0 else (mid, hi)
    return None


def cells(n=12, gaps=True):
    r = np.random.default_rng(3)
    out = []
    for i in range(n * n):
        leaf, ground, pai, x = r.uniform(0.2, 0.5), r.uniform(0.05, 0.4), r.uniform(0.1, 3), r.choice((1.0, 0.6, 1.7))
        a = albedo(leaf, pai, ground, x)
        if gaps and i % 11 == 3:
            a = 0.9  # no reflectance gives so much
        out.append((i // n, i % n, float(a), float(pai), None if gaps and i % 17 == 5 else float(x)))
    return out


SCHEMA = "row int, col int, albedo double, pai double, x double"


def test_albedo(spark):
    rows = [(leaf, ground, x, pai) for leaf in (0.1, 0.4, 0.7) for ground in (0.05, 0.5) for x in (0.3, 1.0, 2.5) for pai in (0.0, 0.5, 4.0)]
    df = spark.createDataFrame(rows, "leaf double, ground double, x double, pai double")
    got = df.select("*", climate.two_stream_albedo(*map(F.col, ("leaf", "ground", "x", "pai"))).alias("v")).collect()
    np.testing.assert_allclose([r.v for r in got], [albedo(r.leaf, r.pai, r.ground, r.x) for r in got], rtol=1e-10)
    assert all(abs(r.v - r.ground) < 1e-9 for r in got if r.pai == 0)


def test_roots(spark):
    rows = cells()
    df = spark.createDataFrame(rows, SCHEMA)
    c = F.col
    got = df.select("*", climate.ground_reflectance(F.lit(0.5), c("pai"), c("x"), c("albedo")).alias("g"), climate.leaf_reflectance(c("pai"), F.lit(0.15), c("x"), c("albedo")).alias("l")).collect()
    some = 0
    for r in got:
        g = l = None
        if r.x is not None:
            g = root(lambda v: albedo(0.5, r.pai, v, r.x) - r.albedo, 0.0001, 0.9999)
            l = root(lambda v: albedo(v, r.pai, 0.15, r.x) - r.albedo, 0.0001, 0.7499)
        assert (r.g is None) == (g is None) and (r.l is None) == (l is None)
        assert g is None or abs(r.g - g) < 1e-9
        assert l is None or abs(r.l - l) < 1e-9
        some += g is None and r.x is not None
    assert some > 5


@pytest.mark.parametrize("most, tol", [(2, 1e-3), (50, 0.03)])
def test_inversion(spark, most, tol):
    rows = cells(8)
    got = {(r.row, r.col): (r.leaf, r.ground) for r in climate.invert_reflectance(spark.createDataFrame(rows, SCHEMA), "albedo", "pai", "x", tol=tol, most=most).collect()}

    def filled(values):
        df = spark.createDataFrame([(a, b, v) for (a, b), v in values.items()], "row int, col int, v double")
        return {(r.row, r.col): r.v for r in fill_multiscale(df, "v", mask_df=spark.createDataFrame([(r[0], r[1], r[4]) for r in rows], "row int, col int, x double")).collect()}

    leaf, ground = ({(r[0], r[1]): None if r[4] is None else v for r in rows} for v in (0.5, 0.15))
    for _ in range(most):
        g2, l2 = {}, {}
        for a, b, alb, pai, x in rows:
            at = (a, b)
            g2[at] = None if x is None else root(lambda v: albedo(leaf[at], pai, v, x) - alb, 0.0001, 0.9999)
            l2[at] = None if x is None else root(lambda v: albedo(v, pai, ground[at], x) - alb, 0.0001, 0.7499)
        g2, l2 = filled(g2), filled(l2)
        ground = {k: None if v is None else (v + g2[k]) / 2 for k, v in ground.items()}
        leaf = {k: None if v is None else (v + l2[k]) / 2 for k, v in leaf.items()}
        if max(np.mean([abs(m[k] - f[k]) for k in m if m[k] is not None]) for m, f in ((ground, g2), (leaf, l2))) <= tol:
            break
    assert got.keys() == leaf.keys()
    for k, (a, b) in got.items():
        assert (a is None) == (leaf[k] is None) == (b is None)
        assert a is None or (abs(a - leaf[k]) < 1e-6 and abs(b - ground[k]) < 1e-6)


def test_no_cells(spark):
    assert climate.invert_reflectance(spark.createDataFrame([], SCHEMA), "albedo", "pai", "x").count() == 0


@pytest.mark.parametrize("tile", [16, 512])
def test_filled_gaps_are_those_of_the_whole_grid(spark, tile):
    r = np.random.default_rng(8)
    at = [(a, b) for a in range(-70, 60) for b in range(40) if not (0 < a < 40 and b > 3) or (a == 20 and b == 30)]
    rows = [(a, b, None if r.uniform() < 0.7 or a > 40 else float(r.uniform(0, 9)), None if b % 2 else float(a + b), bool((a + b) % 5)) for a, b in at]
    df = spark.createDataFrame(rows, "row int, col int, u double, v double, there boolean").repartition(3)
    got = {(x.row, x.col): x for x in fill_gaps(df, ["u", "v"], usable_levels(df), F.col("there"), tile).collect()}
    assert got.keys() == {x[:2] for x in rows if x[4] and None in x[2:4]}
    for k, c in enumerate("uv"):
        known = [x[2 + k] for x in rows if x[2 + k] is not None]
        want = {(x.row, x.col): x[c] for x in fill_multiscale(df.select("row", "col", c), c).collect()}
        for a, b, *values, there in rows:
            if there and values[k] is None:
                mine = got[a, b][c]
                assert abs((np.mean(known) if mine is None else mine) - want[a, b]) < 1e-9
            elif (a, b) in got:
                assert got[a, b][c] is None
