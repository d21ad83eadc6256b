"""Bootstrap by packed sums, ranks over tasks, all pairs of a variogram, the class table: against plain versions."""

import hashlib
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import models


def drawn(name, j, n):
    x = (int(hashlib.md5(name.encode()).hexdigest()[:8], 16) + j * 2654435769) % 2**32
    x = (x ^ x >> 16) * 73244475 % 2**32
    x = (x ^ x >> 16) * 73244475 % 2**32
    return (x ^ x >> 16) % n + 1


def test_draws_are_even():
    n = 13
    got = np.array([models.slots(np.array([int(hashlib.md5(f"1:{b}:s".encode()).hexdigest()[:8], 16)]), n)[0] for b in range(4000)])
    assert abs(np.bincount(got.reshape(-1), minlength=n) / 4000 - 1).max() < 0.06
    assert abs(np.corrcoef(got.T) - np.eye(n)).max() < 0.08


def test_packed_bootstrap_equals_drawn_blocks(spark):
    r = np.random.default_rng(1)
    rows = [(s, int(b), g, float(r.normal()), float(r.normal())) for s in ("a", "b", "c") for b in range(1, 8) for g in ("u", "v", None) for _ in range(int(r.integers(1, 5)))]
    sums = models.block_sums(spark.createDataFrame(rows, "site string, block int, g string, x double, y double"), "x", "y", ["site", "block", "g"])
    got = {x.b: x.slope for x in models.block_bootstrap(sums, "g", 40, seed=9, chunk=7).collect()}
    assert sorted(got) == list(range(1, 41))
    for b, slope in got.items():
        top = low = 0.0
        picked = [p for s in ("a", "b", "c") for j in range(1, 8) for p in rows if p[0] == s and p[1] == drawn(f"9:{b}:{s}", j, 7)]
        for g in ("u", "v", None):
            x, y = (np.array([p[k] for p in picked if p[2] == g]) for k in (3, 4))
            top, low = top + ((x - x.mean()) * (y - y.mean())).sum(), low + ((x - x.mean()) ** 2).sum()
        assert abs(slope - top / low) < 1e-9
    both = models.bootstrap_sizes(spark.createDataFrame([(s, x / 10, y / 10, 1, float(x * y), float(x + y)) for s in "ab" for x in range(10) for y in range(10)], "site string, x_km double, y_km double, g int, x double, y double"), (0.3, 0.5), "x", "y", "g", 20)
    assert Counter(x.block_size for x in both.collect()) == {0.3: 20, 0.5: 20}


def test_a_draw_without_spread_is_an_error(spark):
    sums = models.block_sums(spark.createDataFrame([("a", 1, 0, 1.0, 1.0), ("a", 2, 0, 1.0, 2.0)], "site string, block int, g int, x double, y double"), "x", "y", ["site", "block", "g"])
    with pytest.raises(Exception, match="cannot be estimated"):
        models.block_bootstrap(sums, "g", 5).collect()


def test_ranks_without_a_window_over_the_group(spark):
    r = np.random.default_rng(2)
    rows = [("hot", float(r.choice((1.0, 1.0, 1.0, r.normal())))) for _ in range(4000)] + [(None, 2.0), (None, 1.0), ("b", None), ("b", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    out = models.global_ranks(df, "v", "g").collect()
    by = defaultdict(list)
    for x in out:
        by[x.g].append((x.rank, x.v, x.size))
    assert set(by) == {"hot", None, "b"}
    for g, vs in by.items():
        want = sorted(v for k, v in rows if k == g and v is not None)
        vs.sort()
        assert [k for k, _, _ in vs] == list(range(1, len(want) + 1)) and [v for _, v, _ in vs] == want and {n for _, _, n in vs} == {len(want)}
    points = models.qq_points(df, "v", "g").filter("g = 'hot'").orderBy("v", "theoretical").collect()
    for i, x in enumerate(points):
        assert abs(x.theoretical - statistics.NormalDist().inv_cdf((i + 0.5) / 4000)) < 1e-6
    assert models.qq_points(df.limit(0), "v", "g").count() == 0


def test_variogram_of_all_pairs(spark):
    """A dense bucket, repeated points, points on bucket edges, a group of NULL."""
    r = np.random.default_rng(3)
    rows = [("a", float(x), float(y), float(v)) for x, y, v in zip(r.uniform(0, 0.2, 300), r.uniform(0, 0.2, 300), r.normal(size=300), strict=True)]
    rows += [("a", i / 4, j / 4, float(i * j)) for i in range(-4, 5) for j in range(-4, 5)] + rows[:5] + [(None, 0.0, 0.0, 1.0), (None, 0.3, 0.0, 4.0), ("b", None, 0.0, 1.0), ("c", 1.0, 1.0, None)]
    got = {(x.g, x.bin): (x.pairs, x.dist, x.gamma) for x in models.variogram(spark.createDataFrame(rows, "g string, x double, y double, v double").repartition(4), ["g"], "x", "y", "v", cutoff=0.5, width=0.05).collect()}
    want = defaultdict(list)
    for g in ("a", None):
        p = np.array([x[1:] for x in rows if x[0] == g])
        for i in range(len(p)):
            d = np.sqrt(((p[i + 1 :, :2] - p[i, :2]) ** 2).sum(axis=1))
            for dist, v in zip(d[d <= 0.5], p[i + 1 :, 2][d <= 0.5] - p[i, 2], strict=True):
                want[g, int(np.floor(dist / 0.05))].append((dist, v * v / 2))
    assert got.keys() == want.keys()
    for k, pairs in want.items():
        assert got[k][0] == len(pairs)
        np.testing.assert_allclose(got[k][1:], np.mean(pairs, axis=0), rtol=1e-9)
    capped = models.variogram(spark.createDataFrame(rows, "g string, x double, y double, v double"), ["g"], "x", "y", "v", cap=10)
    assert capped.agg(F.sum("pairs")).first()[0] <= 46


def test_class_table(spark):
    r = np.random.default_rng(4)
    cells = [(s, int(r.integers(1, 4)), float(r.normal()), float(r.uniform())) for s in ("p", "q", "r") for _ in range(50)]
    zones = [(s, c, float(z), float(z + r.uniform(1, 4))) for s in ("p", "q", "r") for c in (1, 2) for z in range(int(r.integers(1, 5)))]
    got = {x["class"]: x.asDict() for x in models.class_structure_table(spark.createDataFrame(cells, "site string, class int, chm double, pai double"), spark.createDataFrame(zones, "site string, class int, zone_start double, zone_end double"), ["chm", "pai"], 20.0, digits=9).collect()}
    for c in (1, 2, 3):
        mine = [[x for x in cells if x[:2] == (s, c)] for s in ("p", "q", "r")]
        strata = [[x[3] - x[2] for x in zones if x[:2] == (s, c)] for s in ("p", "q", "r")]
        x = got[c]
        assert x["n_sites"] == 3 and x["total_n_cells"] == sum(map(len, mine)) and abs(x["total_area_ha"] - 0.04 * sum(map(len, mine))) < 1e-9
        med = [np.median([y[2] for y in m]) for m in mine]
        assert abs(x["mean_median_chm"] - np.mean(med)) < 1e-8 and abs(x["sd_median_chm"] - np.std(med, ddof=1)) < 1e-8
        if c == 3:
            assert x["mean_n_zones"] is None and x["weighted_mean_zone_height"] is None and x["total_zone_count"] == 0
        else:
            flat = [z for s in strata for z in s]
            assert abs(x["weighted_mean_zone_height"] - np.mean(flat)) < 1e-8 and x["total_zone_count"] == len(flat)
            assert abs(x["mean_zone_height"] - np.mean([np.mean(s) for s in strata])) < 1e-8 and abs(x["sd_n_zones"] - np.std([len(s) for s in strata], ddof=1)) < 1e-8
    assert abs(sum(x["total_percent"] for x in got.values()) - 100) < 1e-6
