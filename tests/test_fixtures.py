"""Hand-worked cases of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from lamina.functions.columns import finite
from lamina.operators import climate, daily, grid, models, points, season, structure
from lamina.sources import tables as src


def near(a, b):
    return (a is None and b is None) or a == pytest.approx(b, abs=1e-6)


def test_non_finite_values_are_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in df.select(finite("v")).collect()] == [1.0, None, None, None]


def test_density(spark):
    df = spark.createDataFrame([(0, 0, i, n, 0.0, 1.5) for i, n in enumerate([1, 1, 2])], "cx int, cy int, z_bin int, n long, ground double, canopy double")
    got = [r.pad for r in points.leaf_density(df, 0.5).orderBy("z_bin").collect()]
    assert got[0] is None and near(got[1], math.log(2) / 0.5) and near(got[2], math.log(2) / 0.5)


def test_levelling(spark):
    df = spark.createDataFrame([(0, 0, i, n, 10.0, 12.0) for i, n in enumerate([0, 0, 3, 0, 2])], "cx int, cy int, z_bin int, n long, ground double, canopy double")
    got = points.level_columns(df).orderBy("z_bin").collect()
    assert [r.n for r in got] == [3, 0, 2, 0, 0] and got[0].canopy == 2


def test_cumulative(spark):
    df = spark.createDataFrame([("a", float(i), v) for i, v in enumerate([1.0, 2.0, 3.0])], "cell string, height_m double, pad double")
    assert [r.pai for r in points.cumulative_pai(df, 0.5).orderBy("height_m").collect()] == [3.0, 2.5, 1.5]


def test_harmonic_recovers_a_sinusoid(spark):
    df = spark.createDataFrame([("a", m, 2 + math.sin(2 * math.pi * m / 12)) for m in range(1, 13)] + [("b", 1, 1.0), ("b", 2, None)], "cell string, month int, y double")
    got = {r.cell: r for r in season.harmonic_fit(df, "y").collect()}
    assert near(got["a"].a0, 2) and near(got["a"].a1, 1) and near(got["a"].b1, 0) and got["b"].a0 is None


def test_vertical_and_canopy(spark):
    df = spark.createDataFrame([(1, 1, h, v) for h, v in ((1.0, 20.0), (2.0, 24.0), (3.0, -1.0))], "cell int, day int, height_m double, v double")
    chm = spark.createDataFrame([(1, 10.0)], "cell int, canopy double")
    r = daily.vertical_stats(df, chm).first()
    assert (r.max, r.min, r.range) == (24, 20, 4) and near(r.sd, 2.8284271) and near(r.q95, 23.8)
    edge = spark.createDataFrame([(1, 5.0, 1.0)], "cell int, height_m double, v double")
    five = spark.createDataFrame([(1, 5.0)], "cell int, canopy double")
    assert grid.mask_above_canopy(edge, five, ["cell"], "height_m", ["v"]).first().v is None
    assert grid.mask_above_canopy(edge, five, ["cell"], "height_m", ["v"], strict=True).first().v == 1


def test_temporal_sd(spark):
    df = spark.createDataFrame([(1, 1.0, v) for v in (1.0, 3.0, -5.0, None)], "cell int, height_m double, v double")
    assert near(daily.temporal_sd(df).first().sd, 1.4142136)


def test_distinctness(spark):
    df = spark.createDataFrame([(1, h, x, 0.0) for h, x in ((1.0, 0.0), (2.0, 1.0), (3.0, 3.0))] + [(2, 1.0, 0.0, 0.0)], "cell int, height_m double, a double, b double")
    out = models.climate_distinctness(df, ["cell"], ["a", "b"])
    got = {r.cell: r for r in out.collect()}
    assert near(got[1]["mean"], 2) and near(got[1].sd, 1) and got[2]["mean"] is None
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


def test_slopes(spark):
    df = spark.createDataFrame([(1, 2004, 20.0), (1, 2005, 20.5), (1, 2006, 21.0), (2, 2004, 1.0)], "cell int, year int, mean double")
    got = models.warming_slope(df, ["cell"]).collect()
    assert [(r.cell, round(r.estimate, 9)) for r in got] == [(1, 0.5)]
    xy = spark.createDataFrame([(g, float(x), 2.0 * x + 7 * g) for g in (0, 1) for x in range(5)], "g int, x double, y double")
    assert near(models.within_slope(models.block_sums(xy, "x", "y", ["g"]), "g", []).first().slope, 2)


def test_modal_and_hot_days(spark):
    df = spark.createDataFrame([(v,) for v in (0, 3, 3, 2, 2)], "v int")
    assert sorted(r.v for r in grid.modal_replace(df, "v").collect()) == [2, 2, 2, 3, 3]
    days = spark.createDataFrame([(1, f"2020-01-{i:02d}", float(i), float(i)) for i in range(1, 21)], "cell int, day string, max double, range double").withColumn("day", F.to_date("day"))
    assert daily.hot_day_range(days, days).first().range == 20


def test_extrema(spark):
    df = spark.createDataFrame([(1, float(i), v) for i, v in enumerate([3.0, 2.0, 2.0, 1.0, 4.0, 2.0], 1)], "class int, height_m double, pad double")
    assert [(r.height_m, r.kind) for r in structure.extrema(df).orderBy("height_m").collect()] == [(1.0, "peak"), (4.0, "trough"), (5.0, "peak")]


def test_mosaic_does_not_depend_on_order(spark):
    a, b = (spark.createDataFrame([(1, x), (2, 2 * x)], "cell int, v double") for x in (1.0, 3.0))
    assert sorted(grid.mosaic([a, b], ["cell"], "v").collect()) == sorted(grid.mosaic([b, a], ["cell"], "v").collect())


def test_errors_are_raised(spark):
    g = spark.createDataFrame([("a", 2, 2, 0.0, 0.0, 2.0, 1.0)], "site string, nrow int, ncol int, xmin double, ymin double, ymax double, res double")
    with pytest.raises(Exception, match="no such cell"):
        grid.cell_xy(spark.createDataFrame([("a", 5)], "site string, cell int"), g).collect()
    with pytest.raises(ValueError):
        grid.same_geometry(g, g.withColumn("res", F.lit(2.0)))
    with pytest.raises(ValueError):
        models.validate(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], ["k"])
    with pytest.raises(Exception, match="gap"):
        season.interpolate_cyclic(spark.createDataFrame([(1, 1, None), (1, 2, 2.0)], "cell int, month int, y double"), "y").collect()


def test_cell_round_trip(spark):
    g = spark.createDataFrame([("a", 3, 4, 10.0, 20.0, 35.0, 5.0)], "site string, nrow int, ncol int, xmin double, ymin double, ymax double, res double")
    cells = spark.createDataFrame([("a", i) for i in range(1, 13)], "site string, cell long")
    back = grid.xy_cell(grid.cell_xy(cells, g).select("site", F.col("cell").alias("c"), "x", "y"), g)
    assert all(r.c == r.cell for r in back.collect())


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [(s, b, g, float(x), float(x * (g + 1) + b)) for s in ("a", "b") for b in (1, 2, 3) for g in (0, 1) for x in range(4)]
    df = spark.createDataFrame(rows, "site string, block int, g int, x double, y double")
    sums = models.block_sums(df, "x", "y", ["site", "block", "g"])
    one = sorted((r.b, round(r.slope, 9)) for r in models.block_bootstrap(sums.repartition(1), "g", 20).collect())
    assert one == sorted((r.b, round(r.slope, 9)) for r in models.block_bootstrap(sums.repartition(7), "g", 20).collect())


def test_ols_drops_aliased_columns(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x, 3.0 * x + 1) for x in range(10)], "a double, b double, y double")
    fit = models.ols(df, "y", [("a",), ("b",)])
    assert near(fit.coef[1], 3) and math.isnan(fit.coef[2]) and near(fit.coef[0], 1)


def test_spline_goes_through_daily_values(spark):
    df = spark.createDataFrame([(1, f"2020-01-0{i}", float(v)) for i, v in enumerate((3, 5, 4, 8), 1)], "cell int, day string, v double").withColumn("day", F.to_date("day"))
    got = {str(r.ts): r.v for r in climate.daily_to_hourly_spline(df, "v").collect()}
    assert len(got) == 96 and near(got["2020-01-02 12:00:00"], 5)


def test_sources(spark, tmp_path):
    (tmp_path / "s.csv").write_text("SiteName,Sample,Year,Month,EPSG\nA,x,2020,3,32733\nA,x,2020,3,32733\nB,y,2020,4,1\n")
    assert [tuple(r) for r in src.read_sites(spark, str(tmp_path / "s.csv"), "x", 2020).collect()] == [("A", 3, 32733)]
    df = spark.createDataFrame([(1, 2.0)], "k int, value double")
    src.write_table(df, str(tmp_path / "out"), ["k"])
    back = src.with_path_keys(src.read_cells(spark, str(tmp_path / "out")), {"key": (r"k=(\d+)", "int")})
    assert back.first().key == 1 and back.first().value == 2.0


def test_stream(spark, tmp_path):
    from lamina.streaming.daily import daily_stats_stream

    df = spark.createDataFrame([(1, "2020-01-01 03:00:00", 1.0), (1, "2020-01-01 09:00:00", 3.0), (1, "2020-01-03 09:00:00", 9.0)], "cell int, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = daily_stats_stream(stream).writeStream.outputMode("append").format("memory").queryName("daily_out").start()
    q.processAllAvailable()
    q.stop()
    assert [(str(r.day), r.tmin, r.tmax, r.tmean) for r in spark.table("daily_out").collect()] == [("2020-01-01", 1.0, 3.0, 2.0)]


def test_idw_takes_the_nearest_across_wide_gaps(spark):
    """A gap of 60 cells, cells known on one side only, and two known cells alone."""
    known = [(r, c, float(r * 7 + c)) for r in range(0, 90, 3) for c in range(0, 90, 3) if not (10 <= r < 70 and 10 <= c < 70)]
    for cells, targets in ((known, [(40, 40), (12, 30), (0, 1), (69, 69), (200, 5)]), (known[:2], [(0, 1), (60, 60)]), ([(r, c, v) for r, c, v in known if c > 70] + [(40, 40, 1.0)], [(40, 41), (40, 66)])):
        df = spark.createDataFrame(cells, "row int, col int, value double")
        got = {(r.row, r.col): r.value for r in grid.fill_idw(df, spark.createDataFrame(targets, "row int, col int"), "value").collect()}
        assert len(got) == len(targets)
        for r, c in targets:
            best = sorted(((r - a) ** 2 + (c - b) ** 2, a, b, v) for a, b, v in cells)[:10]
            w = [1e12 if d == 0 else 1 / d for d, *_ in best]
            assert near(got[r, c], sum(x * y[3] for x, y in zip(w, best, strict=True)) / sum(w))


def test_points_of_a_large_tile_are_split_on_x(spark):
    rows = [("a", float(x)) for x in range(11)] + [("b", 5.0)] * 12 + [("c", 1.0), ("c", 9.0), ("a", None)]
    out = grid.tile_points(spark.createDataFrame(rows, "tile string, x double"), "tile", 10, 4).collect()
    got = {(r.tile, r.x): r.part for r in out}
    assert len(out) == len(rows) and [got["a", float(x)] for x in range(11)] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3]
    assert got["b", 5.0] == got["c", 1.0] == got["c", 9.0] == got["a", None] == 1


def test_all_cells_idw(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 4, 3.0), (3, 0, None)], "row int, col int, v double")
    got = {(r.row, r.col): r.v for r in grid.fill_idw_all(cells, cells, "v").collect()}
    assert got[0, 0] == 1 and got[0, 4] == 3 and got[3, 0] == pytest.approx((1 / 9 + 3 / 25) / (1 / 9 + 1 / 25))
    assert [r.v for r in grid.fill_idw_all(cells.filter("row = 3"), cells, "v").collect()] == [None] * 3
    with pytest.raises(ValueError, match="known cells"):
        grid.fill_idw_all(cells, cells, "v", most=1)


def test_all_cells_idw_in_blocks(spark):
    far = 1 << 26  # square distances of such points are not exact sums below 2^53
    known = [(r, c, float(7 * r - c * c)) for r in range(40) for c in range(5) if (r + c) % 3] + [(far, 2, 1e9)]
    cells = spark.createDataFrame([*known, (None, 1, 9.0), (2, 4, None)], "row int, col int, v double")
    asked = [(r, c) for r in range(-3, 44, 2) for c in (0, 4)] + [(0, 0), (0, 0), (far, 2)]
    target = spark.createDataFrame([*asked, (None, 3)], "row int, col int")
    for block, power in ((7, 2), (1 << 16, 2), (50, 3)):
        got = grid.fill_idw_all(cells, target, "v", power=power, block=block).collect()
        assert len(got) == len(asked) + 1 and [x.v for x in got if x.row is None] == [None]
        by = {(x.row, x.col): x.v for x in got}
        values = {(r, c): v for r, c, v in known}
        for r, c in asked:
            w = [((r - a) ** 2 + (c - b) ** 2, v) for (a, b), v in values.items()]
            want = values[r, c] if (r, c) in values else sum(v / d ** (power / 2) for d, v in w) / sum(1 / d ** (power / 2) for d, _ in w)
            assert by[r, c] == pytest.approx(want, rel=1e-12)


def test_all_cells_idw_has_no_limit_of_cells(spark):
    known = spark.range(1_000_001).selectExpr("cast(id div 50 as int) as row", "cast(id % 50 as int) as col", "cast(5.0 as double) as v")
    target = spark.createDataFrame([(-2, 3), (30_000, 60)], "row int, col int")
    assert [x.v for x in grid.fill_idw_all(known, target, "v").collect()] == pytest.approx([5.0, 5.0])
