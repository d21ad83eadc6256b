"""The distributed quantile against numpy, forced through every step by small limits."""

import random

import numpy as np
import pytest

from lamina.functions.quantiles import quantiles
from lamina.operators import daily, grid, points

QS = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]


def columns():
    r = np.random.default_rng(5)
    return {
        "even": r.normal(size=3000).tolist(),
        "ties": r.integers(0, 7, 3000).astype(float).tolist(),
        "equal": [4.25] * 2500,
        "spread": [float(10.0**x * s) for x, s in zip(r.uniform(-200, 200, 2000), r.choice((-1, 1), 2000), strict=True)],
        "two": [1.0] * 1999 + [2.0],
        "few": [3.0, 1.0],
    }


def frame(spark, named):
    rows = [(k, v, "x") for k, vs in named.items() for v in [*vs, None, None]] + [("none", None, "x")]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, v double, __v string").repartition(5)


@pytest.mark.parametrize("limits", [{}, {"most": 100, "accuracy": 50}, {"most": 3, "accuracy": 10_000}])
def test_grouped(spark, limits):
    named = columns()
    named[None] = named.pop("few")
    got = {r.k: tuple(r)[1:] for r in quantiles(frame(spark, named), "v", QS, ("k",), **limits).collect()}
    for k, vs in named.items():
        np.testing.assert_allclose(got[k], np.quantile(vs, QS), rtol=1e-12, atol=1e-300)
    assert got.get("none", (None,) * len(QS)) == (None,) * len(QS)


@pytest.mark.parametrize("name", ["even", "ties", "equal", "spread", "two"])
def test_whole_column(spark, name):
    vs = columns()[name]
    got = quantiles(frame(spark, {"a": vs}), "v", QS, most=40, accuracy=100).collect()
    assert len(got) == 1
    np.testing.assert_allclose(tuple(got[0]), np.quantile(vs, QS), rtol=1e-12)


def test_a_bracket_that_misses(spark, monkeypatch):
    """A sketch of no use only costs further rounds."""
    from lamina.functions import quantiles as module

    vs = columns()["even"]
    real = module.F.percentile_approx
    monkeypatch.setattr(module.F, "percentile_approx", lambda c, p, a: real(c, [0.5] * len(p) if c == "__v" else p, a))
    got = quantiles(frame(spark, {"a": vs}), "v", QS, most=40).first()
    np.testing.assert_allclose(tuple(got), np.quantile(vs, QS), rtol=1e-12)


def test_no_rows(spark):
    df = frame(spark, {"a": [1.0]})
    assert [tuple(r) for r in quantiles(df.limit(0), "v", [0.5]).collect()] == [(None,)]
    assert quantiles(df.limit(0), "v", [0.5], ("k",)).count() == 0
    assert [tuple(r) for r in quantiles(df.filter("v is null"), "v", [0.5]).collect()] == [(None,)]


def test_no_task_ranks_the_column(spark):
    """The plan beyond the limit has no percentile and no window over more than the bracket."""
    df = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as double) v")
    out = quantiles(df, "v", [0.25, 0.75], most=50)
    assert "percentile(" not in out._jdf.queryExecution().toString()
    np.testing.assert_allclose(tuple(out.first()), np.quantile([i * 7919 % 20011 for i in range(20_000)], [0.25, 0.75]))


def test_operators_use_it(spark, monkeypatch):
    from lamina.functions import quantiles as module

    monkeypatch.setattr(module.quantiles, "__kwdefaults__", {"most": 20, "accuracy": 200})
    r = np.random.default_rng(0)
    z = [*r.normal(10, 2, 500).tolist(), 900.0, -900.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(z)], "cell int, z double")
    q1, q3 = np.quantile(z, [0.25, 0.75])
    kept = {i for i, v in enumerate(z) if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)}
    assert {x.cell for x in points.iqr_fence(df).collect()} == kept
    top = np.quantile(z, 0.95)
    assert {x.cell: x.z for x in daily.mean_trim_quantile(df, "z").collect()} == {i: v if v <= top else None for i, v in enumerate(z)}
    assert abs(grid.global_stats(df, "z").first().q - top) < 1e-9
    assert grid.global_stats(df.limit(0), "z").count() == 1
