"""M queries over the yearly cube, the part table and the customer grid."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators import models as m_
from .registry import G, Y, classes, grid, layers, query, strata, table, yearly

VARS = ["tmax", "tmin", "tmean"]


@query(Y + " select " + ", ".join(f"avg({c}) as {c}_mean, stddev_samp({c}) as {c}_sd" for c in VARS) + " from l", "", "", " ".join(f"{c}_{n}" for c in VARS for n in ("mean", "sd")))
def m1_global_scale(spark, d):
    return m_.global_scale(layers(spark, d), VARS)


def scaled(spark, d):
    x = layers(spark, d)
    return m_.zscore(x, m_.global_scale(x, VARS), VARS)


Z = Y + ", z as (select site, cell, height_m, year, " + ", ".join(f"({c} - (select avg({c}) from l)) / (select stddev_samp({c}) from l) as {c}" for c in VARS) + " from l)"


@query(Z + " select * from z", "", "cell year", "height_m tmax tmin tmean")
def m2_zscore(spark, d):
    return scaled(spark, d)


M3 = ", dd as (select a.cell, a.year, avg(sqrt((a.tmax - b.tmax) ** 2 + (a.tmin - b.tmin) ** 2 + (a.tmean - b.tmean) ** 2)) as mean, stddev_samp(sqrt((a.tmax - b.tmax) ** 2 + (a.tmin - b.tmin) ** 2 + (a.tmean - b.tmean) ** 2)) as sd from z a join z b on a.cell = b.cell and a.year = b.year and a.height_m < b.height_m group by all)"


@query(Z + M3 + " select c.cell, c.year, mean, sd from (select distinct cell, year from z) c left join dd using (cell, year)", "", "cell year", "mean sd")
def m3_climate_distinctness(spark, d):
    return m_.climate_distinctness(scaled(spark, d), ["cell", "year"], VARS)


M4 = Z + ", o as (select z.*, st.class, zone from z join st on height_m >= zone_start and height_m < zone_end join k on k.cell = z.cell and k.class = st.class), d4 as (select a.cell, a.year, a.class, a.zone, avg(sqrt((a.tmax - b.tmax) ** 2 + (a.tmin - b.tmin) ** 2 + (a.tmean - b.tmean) ** 2)) as mean from o a join o b on a.cell = b.cell and a.year = b.year and a.zone = b.zone and a.height_m < b.height_m group by all), m4 as (select q.cell, q.year, q.class, q.zone, mean from (select distinct cell, year, class, zone from o) q left join d4 using (cell, year, class, zone))"


def zoned(spark, d):
    return m_.distinctness_by_zone(scaled(spark, d), strata(spark, d), classes(spark, d), ["cell", "year"], VARS)


@query(M4 + " select * from m4", "", "cell year class zone", "mean")
def m4_distinctness_by_zone(spark, d):
    return zoned(spark, d)


@query(M4 + " select cell, class, zone, avg(mean) as mean from m4 group by all", "", "cell class zone", "mean")
def m5_distinctness_mean(spark, d):
    return m_.distinctness_mean(zoned(spark, d), ["cell", "class", "zone"])


M6 = Y + ", m6 as (select l.cell, st.class, zone, year, avg(tmax) as mean from l join st on height_m >= zone_start and height_m < zone_end join k on k.cell = l.cell and k.class = st.class group by all), m7 as (select cell, class, zone, regr_slope(mean, year) as estimate from m6 group by all having count(distinct year) > 1)"


def zone_years(spark, d):
    return m_.zone_year_mean(layers(spark, d), strata(spark, d), classes(spark, d), value="tmax")


def slopes(spark, d):
    return m_.warming_slope(zone_years(spark, d), ["cell", "class", "zone"])


@query(M6 + " select * from m6", "", "cell class zone year", "mean")
def m6_zone_year_mean(spark, d):
    return zone_years(spark, d)


@query(M6 + " select * from m7", "", "cell class zone", "estimate")
def m7_warming_slope(spark, d):
    return slopes(spark, d)


@query(M6 + ", m8 as (select class, 10 * zone || '-' || 10 * zone + 10 || 'm' as zone, median(estimate) as median, quantile_cont(estimate, 0.25) as q25, quantile_cont(estimate, 0.75) as q75, 10 * median(estimate) as per_decade, count(*) as n, 10 * min(zone) + 5 as midpoint from (select *, zone from m7) group by class, zone) select * from m8", "zone", "class n", "median q25 q75 per_decade midpoint")
def m8_slope_summary(spark, d):
    x = slopes(spark, d).withColumn("zone", F.concat((10 * F.col("zone")).cast("string"), F.lit("-"), (10 * F.col("zone") + 10).cast("string"), F.lit("m")))
    return m_.slope_summary(x, ["class", "zone"], zone="zone")


@query(M6 + " select cell, zone, estimate from m7 order by estimate desc, cell, zone limit 12", "", "cell zone", "estimate")
def m9_top_n(spark, d):
    return m_.top_n(slopes(spark, d), "estimate", 12, ("cell", "zone"))


@query("with f as (select regr_slope(p_retailprice, log10(p_size)) as b, regr_intercept(p_retailprice, log10(p_size)) as a, regr_sxx(p_retailprice, log10(p_size)) as sxx, regr_syy(p_retailprice, log10(p_size)) as syy, regr_sxy(p_retailprice, log10(p_size)) as sxy, count(*) as n, avg(log10(p_size)) as mx, min(log10(p_size)) as lo, max(log10(p_size)) as hi from part), g as (select *, lo + (hi - lo) * i / 49 as lx, (syy - sxy * sxy / sxx) / (n - 2) as s2 from f cross join (select unnest(range(0, 50)) as i) q) select 10 ** lx as p_size, a + b * lx as fit, a + b * lx - 1.96 * sqrt(s2 * (1.0 / n + (lx - mx) ** 2 / sxx)) as lower, a + b * lx + 1.96 * sqrt(s2 * (1.0 / n + (lx - mx) ** 2 / sxx)) as upper from g", "", "", "p_size fit lower upper")
def m10_log_trend(spark, d):
    return m_.log_trend(table(spark, d, "part"), "p_retailprice", "p_size")


@query("select c_custkey, c_mktsegment || ':' || c_nationkey as class_zone, log10(c_acctbal) - avg(log10(c_acctbal)) over () as log_c_acctbal from customer where c_acctbal > 0", "class_zone", "c_custkey", "log_c_acctbal")
def m11_prepare(spark, d):
    return m_.prepare(table(spark, d, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string")), ["c_acctbal"], "c_mktsegment", "c_nationkey", "c_acctbal")[0]


@query("select count(*) filter (where c_acctbal > 0) as kept, count(*) filter (where not c_acctbal > 0) as excluded from customer", "", "kept excluded")
def m11_prepare_counts(spark, d):
    return m_.prepare(table(spark, d, "customer"), ["c_acctbal"], "c_mktsegment", "c_name", "c_acctbal")[1]


@query("select count(*) as rows, 1 as valid from part", "", "rows valid")
def m12_validate(spark, d):
    p = table(spark, d, "part")
    m_.validate(p, ["p_partkey"], ["p_size", "p_retailprice"], ["p_type"], ["p_retailprice"])
    return p.agg(F.count("*").alias("rows"), F.lit(1).alias("valid"))


PARTS = [("p_size",), ("p_type",)]


def centred(spark, d):
    p = table(spark, d, "part").withColumn("p_retailprice", F.col("p_retailprice") - 950)
    return p.withColumn("p_size", F.col("p_size") - 25.0)


def coefficients(spark, fit):
    return spark.createDataFrame([(n, None if c != c else float(c)) for n, c in zip(fit.names, fit.coef, strict=True)], "term string, estimate double")


@query("with c as (select p_type, p_size - 25 as x, p_retailprice - 950 as y from part), w as (select sum((x - mx) * (y - my)) / sum((x - mx) ** 2) as b from (select *, avg(x) over (partition by p_type) as mx, avg(y) over (partition by p_type) as my from c)), l as (select p_type, avg(y) - (select b from w) * avg(x) as a from c group by all), f as (select a as a0 from l where p_type = (select min(p_type) from c)) select '(intercept)' as term, a0 as estimate from f union all select 'p_size', b from w union all select 'p_type=' || p_type, a - a0 from l, f where p_type <> (select min(p_type) from c)", "term", "", "estimate")
def m14_ols(spark, d):
    return coefficients(spark, m_.ols(centred(spark, d), "p_retailprice", PARTS, ["p_type"]))


@query("with b as (select count(*) as n, regr_r2(p_retailprice, p_size) as r2, regr_syy(p_retailprice, p_size) * (1 - regr_r2(p_retailprice, p_size)) as rss, regr_syy(p_retailprice, p_size) as tss from part), w as (select sum((p_size - mx) * (p_retailprice - my)) as sxy, sum((p_size - mx) ** 2) as sxx, sum((p_retailprice - my) ** 2) as syy from (select *, avg(p_size) over (partition by p_type) as mx, avg(p_retailprice) over (partition by p_type) as my from part)), k as (select count(distinct p_type) as k from part), t as (select 'size' as model, n, r2, rss, n - 2 as df, n * (ln(2 * pi() * rss / n) + 1) + 6 as aic from b union all select 'size_type', n, 1 - (syy - sxy * sxy / sxx) / tss, syy - sxy * sxy / sxx, n - k - 1, n * (ln(2 * pi() * (syy - sxy * sxy / sxx) / n) + 1) + 2 * (k + 2) from b, w, k) select model, n, df, r2, 1 - (1 - r2) * (n - 1) / df as adj_r2, rss, aic, aic - (select min(aic) from t) as delta_aic, r2 - (select r2 from b) as delta_r2 from t", "model", "n df", "r2 adj_r2 rss aic delta_aic delta_r2")
def m15_model_table(spark, d):
    p = centred(spark, d)
    return m_.model_table(spark, {"size": m_.ols(p, "p_retailprice", [("p_size",)]), "size_type": m_.ols(p, "p_retailprice", PARTS, ["p_type"])}, "size")


@query("with f as (select regr_slope(p_retailprice, p_size) as b, regr_intercept(p_retailprice, p_size) as a, regr_sxx(p_retailprice, p_size) as sxx, avg(p_size) as mx, count(*) as n, regr_syy(p_retailprice, p_size) * (1 - regr_r2(p_retailprice, p_size)) as rss from part) select p_partkey, a + b * p_size - 950 as fitted, p_retailprice - a - b * p_size as residual, (p_retailprice - a - b * p_size) / sqrt(rss / (n - 2) * (1 - 1.0 / n - (p_size - mx) ** 2 / sxx)) as standardised from part, f", "", "p_partkey", "fitted residual standardised")
def m16_residuals(spark, d):
    p = centred(spark, d)
    return m_.residuals(p, m_.ols(p, "p_retailprice", [("p_size",)]), "p_retailprice", [("p_size",)])


def normal_sql(p: str) -> str:
    """The normal quantile of p by the constants of inverse_normal."""
    a = "-39.6968302866538 220.946098424521 -275.928510446969 138.357751867269 -30.6647980661472 2.50662827745924".split()
    b = "-54.4760987982241 161.585836858041 -155.698979859887 66.8013118877197 -13.2806815528857 1.0".split()
    c = "-0.00778489400243029 -0.322396458041136 -2.40075827716184 -2.54973253934373 4.37466414146497 2.93816398269878".split()
    d = "0.00778469570904146 0.32246712907004 2.445134137143 3.75440866190742 1.0".split()
    poly = lambda cs, x: functools.reduce(lambda out, v: f"({out} * {x} + {v}::double)", cs)
    q, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"case when {p} < 0.02425 then {poly(c, low)} / {poly(d, low)} when {p} > 0.97575 then -{poly(c, high)} / {poly(d, high)} else {q} * {poly(a, f'({q} * {q})')} / {poly(b, f'({q} * {q})')} end"


@query("select c_mktsegment, c_acctbal, " + normal_sql("p") + " as theoretical from (select *, (row_number() over (partition by c_mktsegment order by c_acctbal) - 0.5)::double / count(*) over (partition by c_mktsegment) as p from customer)", "c_mktsegment", "", "c_acctbal theoretical")
def m17_qq_points(spark, d):
    return m_.qq_points(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")


_M18 = G + ", pt as (select seg, cell, value, col / 10.0::double as x, row / 10.0::double as y from g), pr as (select a.seg, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dist, (a.value - b.value) * (a.value - b.value) as v from pt a join pt b on a.seg = b.seg and a.cell < b.cell and abs(a.x - b.x) <= 0.51)"


@query(_M18 + " select seg, cast(floor(dist / 0.1::double) as bigint) as bin, avg(dist) as dist, avg(v) / 2 as gamma, count(*) as pairs from pr where dist <= 0.5 group by all", "seg", "bin pairs", "dist gamma")
def m18_variogram(spark, d):
    return m_.variogram(grid(spark, d).withColumn("x", F.col("col") / 10).withColumn("y", F.col("row") / 10), ["seg"], "x", "y", "value", width=0.1)


def block_cells(spark, d):
    return grid(spark, d).select(F.col("class").alias("site"), "cell", "seg", (F.col("col") / 10).alias("x_km"), (F.col("row") / 10).alias("y_km"), (F.col("value") / 1000).alias("value"), (F.col("cell") % 17).cast("double").alias("px"))


def blocks(spark, d):
    return m_.assign_blocks(block_cells(spark, d), 1.0)


B = G + ", bx as (select class as site, cell, seg, floor(col / 10.0) as a, floor(row / 10.0) as b, value / 1000 as value, cell % 17 as px from g), bl as (select *, dense_rank() over (partition by site order by a, b) as block from bx), bs as (select site, block, seg, count(*) as n, sum(px) as sx, sum(value) as sy, sum(px * px) as sxx, sum(px * value) as sxy, sum(value * value) as syy from bl group by all)"


@query(B + " select cell, site, block from bl", "", "cell site block")
def m19_assign_blocks(spark, d):
    return blocks(spark, d)


@query(B + " select * from bs", "seg", "site block n", "sx sy sxx sxy syy")
def m20_block_sums(spark, d):
    return m_.block_sums(blocks(spark, d), "px", "value", ["site", "block", "seg"])


def sums(spark, d):
    return m_.block_sums(blocks(spark, d), "px", "value", ["site", "block", "seg"])


@query(B + " select seg, count(*) as n, regr_slope(value, px) as slope, regr_intercept(value, px) as intercept from bl group by all", "seg", "n", "slope intercept")
def m21_fit_from_sums(spark, d):
    return m_.fit_from_sums(sums(spark, d), "seg", [])


@query(B + " select sum((px - mx) * (value - my)) / sum((px - mx) ** 2) as slope from (select *, avg(px) over (partition by seg) as mx, avg(value) over (partition by seg) as my from bl)", "", "", "slope")
def m22_within_slope(spark, d):
    return m_.within_slope(sums(spark, d), "seg", [])


#: The study's replicates and block sides (km)
REPS, SIZES = 4999, (0.3, 0.5)
_ONE = "b{i} as (select site, seg, px, value, dense_rank() over (partition by site order by floor(col / 10.0::double / {size}::double), floor(row / 10.0::double / {size}::double)) as block from (select class as site, seg, row, col, value / 1000 as value, cell % 17 as px from g)), s{i} as (select site, block, seg, count(*) as n, sum(px) as sx, sum(value) as sy, sum(px * px) as sxx, sum(px * value) as sxy from b{i} group by all), n{i} as (select site, count(distinct block) as n from s{i} group by all), h{i} as (select b, site, n, ('0x' || substr(md5('123:' || b || ':' || site), 1, 8))::bigint as h from n{i} cross join (select unnest(range(1, {reps} + 1)) as b) q), x{i} as (select b, site, n, (h + unnest(range(1, n + 1)) * 2654435769) % 4294967296 as x from h{i}), y{i} as (select b, site, n, xor(x, x >> 16) * 73244475 % 4294967296 as x from x{i}), z{i} as (select b, site, n, xor(x, x >> 16) * 73244475 % 4294967296 as x from y{i}), d{i} as (select b, site, xor(x, x >> 16) % n + 1 as block, count(*) as times from z{i} group by all), j{i} as (select b, seg, sum(times * n) as n, sum(times * sx) as sx, sum(times * sy) as sy, sum(times * sxx) as sxx, sum(times * sxy) as sxy from d{i} join s{i} using (site, block) group by all), r{i} as (select {size}::double as block_size, b, sum(sxy - sx * sy / n) / sum(sxx - sx * sx / n) as slope from j{i} group by all)"
DRAWS = G + ", " + ", ".join(_ONE.format(i=i, size=size, reps=REPS) for i, size in enumerate(SIZES)) + ", sl2 as (select * from r0 union all select * from r1)"


@query(DRAWS + " select * from sl2", "", "b", "block_size slope")
def m23_block_bootstrap(spark, d):
    return m_.bootstrap_sizes(block_cells(spark, d), SIZES, "px", "value", "seg", REPS)


@query(DRAWS + " select block_size, quantile_cont(slope, 0.025) as lower, quantile_cont(slope, 0.975) as upper, 10 * quantile_cont(slope, 0.025) as lower_decade, 100 * (exp(quantile_cont(slope, 0.975)) - 1) as upper_percent from sl2 group by all", "", "", "block_size lower upper lower_decade upper_percent")
def m24_bootstrap_ci(spark, d):
    return m_.bootstrap_ci(m_.bootstrap_sizes(block_cells(spark, d), SIZES, "px", "value", "seg", REPS), by=["block_size"])


@query(B + " select site, count(*) as rows, count(distinct cell) as cells, count(distinct block) as blocks from bl group by all", "", "site rows cells blocks")
def m25_block_counts(spark, d):
    return m_.block_counts(blocks(spark, d))


@query(B + " select seg, regr_slope(value, px) as slope from bl group by all", "seg", "", "slope")
def m26_check_reproduced(spark, d):
    s = m_.fit_from_sums(sums(spark, d), "seg", [])
    full = blocks(spark, d).groupBy("seg").agg(F.regr_slope("value", "px").alias("slope"))
    m_.check_reproduced(full, s, "seg", ["slope"])
    return full


@query(B + " select seg, 10 * regr_slope(value, px) * (quantile_cont(px, 0.75) - quantile_cont(px, 0.25)) as iqr_decade, 20 * regr_slope(value, px) * (max(px) - min(px)) as span_20y from bl group by all", "seg", "", "iqr_decade span_20y")
def m27_effect_scaling(spark, d):
    return m_.effect_scaling(m_.fit_from_sums(sums(spark, d), "seg", []), blocks(spark, d), "seg", "px")


_M28 = "with c as (select c_nationkey as site, c_mktsegment as class, c_acctbal as chm, c_custkey % 97 / 10.0 as pai from customer), z as (select s_nationkey as site, seg as class, s_suppkey % 7 as zone_start, s_suppkey % 7 + 1.5 + s_suppkey % 3 as zone_end from supplier join (select distinct c_mktsegment as seg from customer where c_mktsegment <> 'BUILDING') q on (s_suppkey + length(seg)) % 2 = 0), p as (select site, class, count(*) as n_cells, count(*) * 0.04 as area_ha, median(chm) as mc, median(pai) as mp from c group by all), zz as (select site, class, count(*) as nz, avg(zone_end - zone_start) as zh from z group by all), j as (select * from p left join zz using (site, class))"
_M28_COLS = "total_area_ha mean_n_zones sd_n_zones mean_zone_height sd_zone_height mean_median_chm sd_median_chm mean_median_pai sd_median_pai weighted_mean_zone_height total_percent"


@query(_M28 + " select class, count(*) as n_sites, sum(n_cells) as total_n_cells, round(sum(area_ha)::double, 2) as total_area_ha, round(avg(nz), 2) as mean_n_zones, round(stddev_samp(nz), 2) as sd_n_zones, round(avg(zh), 2) as mean_zone_height, round(stddev_samp(zh), 2) as sd_zone_height, round(avg(mc), 2) as mean_median_chm, round(stddev_samp(mc), 2) as sd_median_chm, round(avg(mp), 2) as mean_median_pai, round(stddev_samp(mp), 2) as sd_median_pai, round(sum(zh * nz) / sum(nz), 2) as weighted_mean_zone_height, coalesce(sum(nz), 0) as total_zone_count, round((100 * sum(area_ha) / (select sum(area_ha) from p))::double, 2) as total_percent from j group by all", "class", "n_sites total_n_cells total_zone_count", _M28_COLS)
def m28_class_structure_table(spark, d):
    cells = table(spark, d, "customer").selectExpr("c_nationkey as site", "c_mktsegment as class", "c_acctbal as chm", "c_custkey % 97 / 10 as pai")
    segs = cells.filter("class <> 'BUILDING'").select("class").distinct()
    zones = table(spark, d, "supplier").join(segs, F.expr("(s_suppkey + length(class)) % 2 = 0")).selectExpr("s_nationkey as site", "class", "cast(s_suppkey % 7 as double) as zone_start", "s_suppkey % 7 + 1.5D + s_suppkey % 3 as zone_end")
    return m_.class_structure_table(cells, zones, ["chm", "pai"], 20.0)


@query("select c_mktsegment as metric, count(c_acctbal) as n, avg(c_acctbal) as mean, stddev_samp(c_acctbal) as sd, min(c_acctbal) as min, quantile_cont(c_acctbal, 0.05) as q05, quantile_cont(c_acctbal, 0.25) as q25, quantile_cont(c_acctbal, 0.5) as q50, quantile_cont(c_acctbal, 0.75) as q75, quantile_cont(c_acctbal, 0.95) as q95, max(c_acctbal) as max, count(distinct c_nationkey) as sites from customer group by all", "metric", "n sites", "mean sd min q05 q25 q50 q75 q95 max")
def m29_pooled_stats(spark, d):
    return m_.pooled_stats(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "c_nationkey").withColumnRenamed("c_mktsegment", "metric")


@query("with p as (select p_brand as site, p_type as cellname, cast(p_size as double) as h, avg(p_retailprice) / 1000 as pad from part group by all), tot as (select site, sum(pad) as pai_total from p group by all) select n_name as site, n_nationkey + 1 as cell, pai_total from nation join tot on tot.site = 'Brand#' || (n_nationkey + 1)", "site", "cell", "pai_total")
def m13_pair_pai_response(spark, d):
    from ..operators.points import cumulative_pai  # noqa: F401
    from .queries_grid import grids

    n = table(spark, d, "nation").select(F.col("n_name").alias("site"), (F.col("n_nationkey") + 1).cast("long").alias("cell"))
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").cast("double").alias("height_m")).agg((F.avg("p_retailprice") / 1000).alias("pad"))
    p = p.join(n, F.col("b") == F.concat(F.lit("Brand#"), F.col("cell").cast("string"))).groupBy("site", "cell", "height_m").agg(F.sum("pad").alias("pad"))
    full = n.withColumn("height_m", F.explode(F.sequence(F.lit(0), F.lit(50)))).withColumn("height_m", F.col("height_m").cast("double")).join(p, ["site", "cell", "height_m"], "left").fillna(0, ["pad"])
    st = strata(spark, d).filter("zone = 0")
    return m_.pair_pai_response(full, st, n.withColumn("var", F.lit(1.0)), grids(spark, d), 1.0)
