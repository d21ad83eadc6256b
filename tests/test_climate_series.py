"""Daily to hourly series, wet days and bias correction against plain arithmetic."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from lamina.functions import splines
from lamina.operators import climate

DAY = datetime.date(2020, 1, 1)


def days(n, r):
    return [(c, DAY + datetime.timedelta(i), float(r.uniform(0, 2)), float(r.uniform(0.6, 1)), 100.0 + i, float(r.choice((0, 0, 3, 9)))) for c in (1, 2) for i in range(n)]


SCHEMA = "cell int, day date, vapour double, emissivity double, pres double, precip double"


def natural(x, y, at):
    """Natural cubic spline from its full linear system."""
    n, h = len(x), np.diff(x)
    a, b = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, b)
    out = []
    for v in at:
        i = min(max(int(np.searchsorted(x, v, side="right")) - 1, 0), n - 2)
        t, u = x[i + 1] - v, v - x[i]
        out.append((m[i] * t**3 + m[i + 1] * u**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * t + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * u)
    return np.array(out)


def test_hours_of_all_series(spark):
    r = np.random.default_rng(1)
    rows = days(9, r)
    n = 9 * 24
    temp = {(c, h): float(r.uniform(-20, 30)) for c in (1, 2) for h in range(n)}
    start = datetime.datetime(2020, 1, 1)
    temps = spark.createDataFrame([(c, start + datetime.timedelta(hours=h), t) for (c, h), t in temp.items()], "cell int, ts timestamp_ntz, temp double")
    got = {(x.cell, int((x.ts - start).total_seconds() // 3600)): x for x in climate.daily_to_hourly(spark.createDataFrame(rows, SCHEMA), temps).collect()}
    assert len(got) == 2 * n
    for c in (1, 2):
        mine = [x for x in rows if x[0] == c]
        noon, at = np.arange(9) * 24.0 + 12, np.arange(n, dtype=float)
        e, em, pres, rain = (natural(noon, np.array([x[k] for x in mine]), at) for k in (2, 3, 4, 5))
        for h in range(n):
            t, x = temp[c, h], got[c, h]
            es = 0.61078 * math.exp(17.27 * t / (t + 237.3) if t > 0 else 21.875 * t / (t + 265.5))
            assert abs(x.relhum - min(max(e[h] / es * 100, 10), 100)) < 1e-8 and abs(x.pres - pres[h]) < 1e-9
            assert abs(x.lwdown - em[h] * 5.67e-8 * (t + 273.15) ** 4) < 1e-8
            day = mine[h // 24][5]
            mean = rain[h // 24 * 24 : h // 24 * 24 + 24].mean()
            want = day / mean * rain[h]
            assert abs(x.precip - (want if want > 0 else day / 24)) < 1e-8 * max(1, abs(want))


def test_series_with_gaps(spark):
    rows = [(1, DAY + datetime.timedelta(i), 0.5 if i % 3 else None, None, 100.0, 0.0) for i in range(7)] + [(2, None, 1.0, 1.0, 1.0, 1.0), (3, DAY, None, None, None, None)]
    got = climate.daily_to_hourly_spline(spark.createDataFrame(rows, SCHEMA), ["vapour", "emissivity", "pres"]).collect()
    assert {x.cell for x in got} == {1} and len(got) == 7 * 24
    assert all(abs(x.vapour - 0.5) < 1e-9 and x.emissivity is None and abs(x.pres - 100) < 1e-9 for x in got)
    none = spark.createDataFrame([], SCHEMA)
    assert climate.daily_to_hourly(none, spark.createDataFrame([], "cell int, ts timestamp_ntz, temp double")).count() == 0


def plain_rain(rain, region, share, total):
    n = len(rain)
    if rain[0] is None:
        return rain
    want, wet = math.floor(share * n + 0.5), sum(v > 0 for v in rain)
    rain = list(rain)
    if wet < want:
        least = min((v for v in rain if v > 0), default=5001.0)
        for i in sorted((i for i in range(n) if rain[i] == 0), key=lambda i: region[i])[: want - wet]:
            rain[i] = least
    if wet > want:
        for i in sorted(range(n), key=lambda i: rain[i])[: n - want]:
            rain[i] = 0.0
    return [v * total / sum(rain) if sum(rain) else 0.0 for v in rain]


def test_wet_days(spark):
    r = np.random.default_rng(2)
    cells = {}
    for c in range(60):
        n = int(r.integers(1, 30))
        rain = [float(x) for x in r.choice((0, 0, 0, 1, 2, 5), n) * r.choice((1.0, 1.5), n)]
        cells[c] = ([0.0] * n if c == 7 else rain, [float(x) for x in r.integers(0, 6, n)], float(r.choice((0, 0.2, 0.5, 1))), 50.0)
    cells[99] = ([None, 1.0, 0.0], [1.0, 2.0, 3.0], 0.5, 10.0)
    rows = [(c, i, rain[i], region[i], share, total) for c, (rain, region, share, total) in cells.items() for i in range(len(rain))]
    df = spark.createDataFrame(rows, "cell int, step int, v double, region double, share double, total double").repartition(3)
    got = {(x.cell, x.step): x.v for x in climate.rain_adjust(df, "v", "step", "share", "total", "region").collect()}
    for c, (rain, region, share, total) in cells.items():
        want = plain_rain(rain, region, share, total)
        for i, v in enumerate(want):
            assert got[c, i] == v or abs(got[c, i] - v) < 1e-9
    assert len(got) == len(rows)


def test_smoother():
    r = np.random.default_rng(4)
    x = np.sort(r.uniform(0, 10, 300))
    knots, y, s = splines.smooth_map(x, 3 * x - 2)
    np.testing.assert_allclose(y, 3 * knots - 2, atol=1e-6)
    assert abs(s).max() < 1e-6
    knots, y, s = splines.smooth_map(x, np.sin(x / 2) * 5)
    assert np.abs(natural(knots, y, x) - np.sin(x / 2) * 5).max() < 0.05
    second, rough = splines.cubic_penalty(knots)
    at = np.linspace(knots[0], knots[-1], 200_001)
    np.testing.assert_allclose(y @ rough @ y, np.trapezoid(np.interp(at, knots, second @ y) ** 2, at), rtol=1e-6)
    noisy = np.sin(x / 2) * 5 + r.normal(0, 1, 300)
    knots, y, _ = splines.smooth_map(x, noisy)
    base = np.array([natural(knots, e, x) for e in np.eye(len(knots))]).T
    _, rough = splines.cubic_penalty(knots)
    hats = [base @ np.linalg.solve(base.T @ base + lam * rough, base.T) for lam in 10 ** np.linspace(-4, 4, 400)]
    gcv = [300 * ((noisy - h @ noisy) ** 2).sum() / (300 - np.trace(h)) ** 2 for h in hats]
    mine = natural(knots, y, x)
    assert np.abs(mine - hats[int(np.argmin(gcv))] @ noisy).max() < 0.05
    for few in (np.array([2.0, 2.0]), np.array([1.0, 2.0]), np.array([5.0])):
        assert all(np.isfinite(z).all() for z in splines.smooth_map(few, few * 2))


def test_bias_correction(spark):
    r = np.random.default_rng(6)
    frame = lambda rows: spark.createDataFrame(rows, "cell int, v double")
    hist = {c: r.normal(10 + c, 3, n) for c, n in ((1, 400), (2, 90), (3, 37))}
    obs = {c: 2 + 0.8 * h + 0.3 * np.sin(h) + r.normal(0, 0.1, len(h)) for c, h in hist.items()}
    obs[3] = obs[3][:20]  # histories of different sizes
    fut = {c: np.r_[r.normal(12 + c, 4, 60), 40.0, -20.0] for c in hist}
    rows = lambda d: [(c, float(v)) for c, vs in d.items() for v in vs]
    got = climate.bias_correct(frame(rows(obs) + [(1, None)]), frame(rows(hist)), frame([*rows(fut), (1, None), (9, 1.0)]), "v", ranks=50).collect()
    assert sum(x.v is None for x in got) == 1 and {x.cell for x in got} == {1, 2, 3}
    for c in hist:
        o, h = np.sort(obs[c]), np.sort(hist[c])
        m = min(len(o), len(h), 50)
        pick = lambda a: a[[i * (len(a) - 1) // (m - 1) for i in range(m)]]  # noqa: B023, E731
        knots, y, _ = splines.smooth_map(pick(h), pick(o))
        f, step = fut[c], 1e-6
        inner = natural(knots, y, np.clip(f, knots[0], knots[-1]))
        low, high = ((natural(knots, y, [a + step]) - natural(knots, y, [a]))[0] / step for a in (knots[0], knots[-1] - step))
        want = inner + np.where(f < knots[0], low * (f - knots[0]), 0) + np.where(f > knots[-1], high * (f - knots[-1]), 0)
        reach = lambda a: max(a.max() - a.mean(), a.mean() - a.min())
        mid, span = obs[c].mean() + f.mean() - hist[c].mean(), reach(obs[c]) / reach(hist[c]) * reach(f) * 1.05
        want = np.clip(want, mid - span, mid + span)
        np.testing.assert_allclose(sorted(x.v for x in got if x.cell == c and x.v is not None), np.sort(want), atol=1e-4)


def test_rain_of_days_without_a_value(spark):
    rows = [(1, 1, 2.0), (1, 1, None), (1, 1, 6.0), (2, 1, None), (3, 1, 0.0), (3, 1, 0.0), (4, 1, 5.0), (5, 1, 0.0), (6, 1, -1.0), (6, 1, 3.0)]
    totals = [(1, 1, 4.0), (2, 1, 4.0), (3, 1, 4.0), (4, 1, None), (5, 1, None), (6, 1, 4.0)]
    got = climate.blend_precip(spark.createDataFrame(rows, "cell int, day int, precip double"), spark.createDataFrame(totals, "cell int, day int, total double")).collect()
    by = {c: sorted((x.precip for x in got if x.cell == c), key=str) for c in range(1, 7)}
    assert by == {1: [1.0, 3.0, None], 2: [None], 3: [0.0, 0.0], 4: [None], 5: [None], 6: [0.0, 6.0]}


def test_days_of_a_360_calendar(spark):
    r = np.random.default_rng(5)
    rows = [(c, y, float(d), None if r.uniform() < 0.3 else float(r.uniform(0, 9))) for c in (1, 2, 3) for y in (2019, 2020) for d in sorted(r.choice(np.arange(1, 361), 25, False))]
    rows += [(4, 2020, 7.0, None), (4, 2020, 90.0, None), (5, 2020, 7.0, 2.0), (6, 2020, None, 1.0), (7, 2020, 7.0, None), (7, 2020, 7.0, 3.0), (7, 2020, 9.0, 5.0), (None, 2020, 1.0, 1.0), (None, 2020, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "cell int, year int, d double, v double").repartition(3)
    out = climate.fix_360_calendar(df, "v", "year", "d")
    want = {}
    for c in {x[0] for x in rows}:
        mine = [(datetime.date(y, 1, 1) + datetime.timedelta(math.floor((d - 1) * (366 if y == 2020 else 365) / 360)), v) for k, y, d, v in rows if k == c and d is not None]
        known = sorted((d.toordinal(), v) for d, v in mine if v is not None)
        ends = [d.toordinal() for d, _ in mine]
        for o in range(min(ends, default=1), max(ends, default=0) + 1):
            inside = known and known[0][0] <= o <= known[-1][0]
            want[c, datetime.date.fromordinal(o)] = float(np.interp(o, *zip(*known, strict=True))) if inside else None
    got = out.collect()
    assert len(got) == len(want) + 1  # two rows of one day
    for x in got:
        v = want[x.cell, x.day]
        assert (x.v is None and v is None) or abs(x.v - v) < 1e-9
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_hours_are_not_shuffled_with_a_temperature_column(spark):
    r = np.random.default_rng(9)
    rows = [x for i, x in enumerate(days(12, r)) if i % 5 != 3] + [(None, DAY, 1.0, 1.0, 1.0, 1.0), (3, DAY, 1.0, 1.0, 1.0, None), (4, DAY, None, None, 9.0, 0.0)]
    df, t = spark.createDataFrame(rows, SCHEMA), F.hour("ts") * 1.5 - 10 * F.col("cell")
    start = datetime.datetime(2020, 1, 1)
    temps = spark.createDataFrame([(c, start + datetime.timedelta(hours=h)) for c in (1, 2, 3, 4) for h in range(12 * 24)], "cell int, ts timestamp_ntz").withColumn("temp", t)
    hours = climate.daily_to_hourly(df, t)
    cols = ["cell", "ts", "temp", "pres", "relhum", "lwdown", "precip"]
    plain = climate.daily_to_hourly_spline(df, ["pres", "vapour", "emissivity", "precip"]).join(temps, ["cell", "ts"])
    want = climate.convert_hours(plain, df).select(*cols).orderBy("cell", "ts").collect()
    for got in (hours, climate.daily_to_hourly(df, temps)):
        got = got.select(*cols).orderBy("cell", "ts").collect()
        assert len(got) == len(want)
        for x, y in zip(got, want, strict=True):
            assert x[:2] == y[:2] and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9 * max(1, abs(b))) for a, b in zip(x[2:], y[2:], strict=True))
    plan = hours._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
