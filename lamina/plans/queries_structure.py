"""K and T queries over part profiles, the monthly series and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import season, structure
from ..sources.checkpoints import cut
from .registry import G, M, P, classes, grid, layers, monthly, pads, profiles, query, strata, table


#: All dimensions of the given embeddings
DIMS = [f"f{i}" for i in range(1, 65)]


def features(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"f{i + 1}") for i in range(len(DIMS))])


@query(M + " select cell, month, y as raw, case when y between 0 and 100 then y * 0.1 end as y from m", "", "cell month", "raw y")
def t1_scale_lai(spark, d):
    return season.scale_lai(monthly(spark, d).withColumn("raw", F.col("y")), "y")


@query(M + " select cell, month, y + 0.2 * max(y) over (partition by cell) as y from m", "", "cell month", "y")
def t2_lai_to_pai(spark, d):
    return season.lai_to_pai(monthly(spark, d), "y")


@query(M + " select cell, month, y - 0.2 * max(y) over (partition by cell) as y from m", "", "cell month", "y")
def t2_pai_to_lai(spark, d):
    return season.lai_to_pai(monthly(spark, d), "y", back=True)


@query("select o_custkey as cell, month(o_orderdate) as month, avg(o_totalprice) as y from orders group by all", "", "cell month", "y")
def t3_month_climatology(spark, d):
    return season.month_climatology(table(spark, d, "orders").selectExpr("o_custkey as cell", "month(o_orderdate) as month", "o_totalprice as y"), "y")


_T4 = M + """, w as (select cell, y, sin(2 * pi() * month / 12) as s, cos(2 * pi() * month / 12) as c from m),
o as (select cell, count(*) as n, avg(y) as ym, avg(s) as sm, avg(c) as cm from w group by all),
x as (select cell, any_value(n) as n, any_value(ym) as ym, any_value(sm) as sm, any_value(cm) as cm, sum((s - sm) * (s - sm)) as ss, sum((c - cm) * (c - cm)) as cc, sum((s - sm) * (c - cm)) as sc, sum((s - sm) * (y - ym)) as sy, sum((c - cm) * (y - ym)) as cy from w join o using (cell) group by cell),
f as (select cell, ym, sm, cm, case when n >= 3 then (sy * cc - cy * sc) / (ss * cc - sc * sc) end as a1, case when n >= 3 then (cy * ss - sy * sc) / (ss * cc - sc * sc) end as b1 from x),
k as (select cell, ym - a1 * sm - b1 * cm as a0, a1, b1 from f)"""


@query(_T4 + " select cell, a0, a1, b1 from k", "", "cell", "a0 a1 b1")
def t4_harmonic_fit(spark, d):
    return season.harmonic_fit(monthly(spark, d), "y")


@query(_T4 + " select cell, month, greatest(a0 + a1 * sin(2 * pi() * month / 12) + b1 * cos(2 * pi() * month / 12), case when a0 is not null then 0 end) as pred from k cross join (select unnest(range(1, 13)) as month)", "", "cell month", "pred")
def t5_harmonic_predict(spark, d):
    return season.harmonic_predict(season.harmonic_fit(monthly(spark, d), "y"))


@query(M + " select c_custkey as cell, a.month, case when b.y > 0 then c_acctbal * a.y / b.y end as v from customer join m a on a.cell = c_custkey join m b on b.cell = c_custkey and b.month = 6", "", "cell month", "v")
def t6_seasonal_scale(spark, d):
    fine = table(spark, d, "customer").selectExpr("c_custkey as cell", "c_acctbal as v")
    return season.seasonal_scale(fine, monthly(spark, d).withColumnRenamed("y", "pred"), 6, "v")


@query(M + ", c as (select l_suppkey as cell, quantile_cont(l_extendedprice / 1000, 0.99) as c from lineitem group by all), f as (select cell, quantile_cont(y, 0.99) as f from m group by all) select m.cell, month, y * least(greatest(case when c / f >= 0 then c / f end, 0.3), 3) as y from m join c using (cell) join f using (cell)", "", "cell month", "y")
def t7_range_scale(spark, d):
    return season.range_scale(monthly(spark, d), table(spark, d, "lineitem").selectExpr("l_suppkey as cell", "l_extendedprice / 1000 as y"), "y")


@query(P + ", q as (select cell, height_m, case when height_m % 5 <> 0 then pad end as pad from p) select cell, height_m, pad from q where height_m in (select height_m from q where pad is not null)", "cell", "", "height_m pad")
def t8_drop_empty_layers(spark, d):
    return season.drop_empty_layers(pads(spark, d).withColumn("pad", F.when(F.col("height_m") % 5 == 0, 0.0).otherwise(F.col("pad"))), "pad")


T9 = "i as (select *, row_number() over (partition by cell order by month) as i, count(*) over (partition by cell) as n, first(y) over (partition by cell order by month) as fv from t), j as (select *, last_value(y ignore nulls) over w as lv, last_value(case when y is not null then i end ignore nulls) over w as li, coalesce(first_value(y ignore nulls) over a, fv) as rv, coalesce(first_value(case when y is not null then i end ignore nulls) over a, n + 1) as ri from i window w as (partition by cell order by month rows between unbounded preceding and current row), a as (partition by cell order by month rows between current row and unbounded following)), k as (select cell, month, coalesce(y, lv + (rv - lv) * (i - li) / (ri - li)) as y from j)"
GAPS = ", s as (select *, row_number() over (partition by cell order by month) as q from m), t as (select cell, month, case when q = 1 or (cell + month) % 3 <> 0 then y end as y from s), "


def holes(spark, d):
    from pyspark.sql import Window

    q = F.row_number().over(Window.partitionBy("cell").orderBy("month"))
    return monthly(spark, d).withColumn("q", q).withColumn("y", F.when((F.col("q") == 1) | ((F.col("cell") + F.col("month")) % 3 != 0), F.col("y"))).drop("q")


@query(M + GAPS + T9 + " select * from k", "", "cell month", "y")
def t9_interpolate_cyclic(spark, d):
    return season.interpolate_cyclic(holes(spark, d), "y")


_T10 = M + GAPS.replace(", t as", ", t0 as") + """g0 as (select cell, y, row_number() over (partition by cell order by month) as i from t0), g1 as (select cell, i - row_number() over (partition by cell order by i) as g from g0 where y is null),
lg as (select cell from (select cell, g, count(*) as n from g1 group by all) group by cell having max(n) > 1), t as (select * from t0 where cell not in (select cell from lg)), """ + T9 + """,
ef as (select cell % 3 as class, month, avg(y) as e from t0 group by all), r as (select t0.cell, t0.month, y, e, avg(y / nullif(e, 0)) over (partition by t0.cell) as ra from t0 join lg using (cell) left join ef on ef.class = t0.cell % 3 and ef.month = t0.month)
select cell, month, cell % 3 as class, y from k union all select cell, month, cell % 3, coalesce(y, e * ra) from r"""


@query(_T10, "", "cell month class", "y")
def t10_fill_seasonal(spark, d):
    x = holes(spark, d).withColumn("class", (F.col("cell") % 3).cast("int"))
    return season.fill_seasonal(x, season.season_effect(x, "y", keys=("class",)), "y", most=1)


@query(M + GAPS[:-2] + " select month, avg(y) as effect from t group by all", "", "month", "effect")
def t11_season_effect(spark, d):
    return season.season_effect(holes(spark, d), "y")


_T11 = M + """, s as (select cell, month, case when (cell + month) % 3 <> 0 then y end as y from m), f as (select cell, 2 * count(y) >= count(*) and arg_min(y is not null, month) as ok, avg(y) as own from s group by cell),
t as (select cell, month, y from s join f using (cell) where ok), """ + T9 + """, ef as (select month, avg(y) as e from s group by month)
select cell, month, y from k union all select cell, month, e / (select avg(e) from ef) * own from s join f using (cell) join ef using (month) where not ok"""


@query(_T11, "", "cell month", "y")
def t11_season_adjust(spark, d):
    return season.season_adjust(monthly(spark, d).withColumn("y", F.when((F.col("cell") + F.col("month")) % 3 != 0, F.col("y"))), "y")


@query(M + ", i as (select *, row_number() over (partition by cell order by month) as i, count(*) over (partition by cell) as n from m), u as (select * from i union all select cell, month, y, i - n, n from i where i > n - 2), w as (select cell, month, i, avg(y) over (partition by cell order by i rows between 2 preceding and current row) as y from u) select cell, month, y from w where i > 0", "", "cell month", "y")
def t12_moving_average_cyclic(spark, d):
    return season.moving_average_cyclic(monthly(spark, d), 3, "y")


E4 = "with e as (select vec_id, label, " + ", ".join(f"cast(embedding[{i}] as double) as f{i}" for i in range(1, len(DIMS) + 1)) + " from embeddings)"


@query(E4 + " select vec_id, f1, f64 from e where " + " + ".join(DIMS) + " > 0", "", "vec_id", "f1 f64")
def k1_complete_positive(spark, d):
    return structure.complete_positive(features(spark, d), DIMS)


@query(None, "", "vec_id", "pc1 pc2")
def k2_pca(spark, d):
    return structure.pca(features(spark, d), DIMS, 2)[0]


@query(None, "variable", "", "pc1 pc2 pc3 pc4")
def k2_pca_table(spark, d):
    return structure.pca_table(spark, DIMS, *structure.pca(features(spark, d), DIMS)[1:])


@query(None, "", "vec_id class")
def k3_gmm(spark, d):
    """Four components of all dimensions, written as a table since the fit reads them in each iteration."""
    pcs = [f"pc{i}" for i in range(1, 5)]
    return structure.gmm(cut(structure.pca(features(spark, d), DIMS, 4)[0].select("vec_id", *pcs)), pcs)


@query(E4 + " select label, count(*) as n, " + ", ".join(f"avg({c}) as {c}_mean, stddev_samp({c}) as {c}_sd" for c in DIMS) + " from e group by all", "", "label n", " ".join(f"{c}_mean {c}_sd" for c in DIMS))
def k4_cluster_summary(spark, d):
    return structure.cluster_summary(features(spark, d), DIMS, "label")


@query(E4 + " select label, " + ", ".join(f"avg({c}) as {c}" for c in DIMS) + " from e group by all", "", "label", " ".join(DIMS))
def k4_centroids(spark, d):
    return structure.centroids(features(spark, d), DIMS, "label")


@query(G + " select g.row, g.col, c.class from g left join (select row // 10 as row, col // 10 as col, min(class) as class from g group by all) c on c.row = g.row // 10 and c.col = g.col // 10", "", "row col class")
def k5_classes_to_grid(spark, d):
    from ..operators.grid import coarsen

    return structure.classes_to_grid(coarsen(grid(spark, d), 10, "class", fun="min"), grid(spark, d), 10)


@query(None, "cell", "cluster")
def k6_profile_cluster(spark, d):
    return structure.profile_cluster(pads(spark, d), ["cell"], "height_m", "pad")


@query("with l as (select l_suppkey % 4 as class, l_quantity as height_m, l_discount as pad from lineitem), a as (select class, height_m, avg(pad) as pad from l group by all union all select 0 - 1 + 1, height_m, avg(pad) from (select * from l) group by height_m) select -1 as class, height_m, avg(pad) as pad from l group by height_m union all select class, height_m, avg(pad) from l group by class, height_m", "", "class", "height_m pad")
def k7_mean_profiles(spark, d):
    l = table(spark, d, "lineitem").selectExpr("cast(l_suppkey % 4 + 1 as int) as class", "l_quantity as height_m", "l_discount as pad")
    return structure.mean_profiles(l).withColumn("class", F.col("class") - 1)


@query("select p_size as height_m, avg(p_retailprice) as mean, quantile_cont(p_retailprice, 0.1) as q10, quantile_cont(p_retailprice, 0.9) as q90 from part group by all", "", "", "height_m mean q10 q90")
def k8_profile_bands(spark, d):
    return structure.profile_bands(table(spark, d, "part").withColumnRenamed("p_size", "height_m"), "height_m", "p_retailprice")


@query(None, "class", "", "height_m pad")
def k9_smooth_profile(spark, d):
    return structure.smooth_profile(profiles(spark, d))


EXT = P + ", a as (select *, lead(pad) over w as nx, sign(lead(pad) over w - pad) as s from pr window w as (partition by class order by height_m)), b as (select *, coalesce(last_value(nullif(s, 0) ignore nulls) over w1, first_value(nullif(s, 0) ignore nulls) over w2) as t from a window w1 as (partition by class order by height_m rows between unbounded preceding and current row), w2 as (partition by class order by height_m rows between current row and unbounded following)), c as (select *, lag(t) over (partition by class order by height_m) as u from b), ex as (select class, height_m, pad, case when (u is null or u > 0) and t < 0 then 'peak' when u < 0 and t > 0 then 'trough' end as kind from c where nx is not null), x as (select * from ex where kind is not null)"


@query(EXT + " select class, height_m, pad, kind from x", "class kind", "", "height_m pad")
def k10_extrema(spark, d):
    return structure.extrema(profiles(spark, d))


@query(EXT + ", y as (select *, abs(pad - lag(pad) over w) as a, abs(pad - lead(pad) over w) as b from x window w as (partition by class order by height_m)), t as (select class, max(pad) as top from pr where height_m >= 2 group by all), z as (select y.class, height_m, kind, 100 * least(coalesce(a, b), coalesce(b, a)) / top as prominence from y join t using (class)) select * from z where prominence >= 2", "class kind", "", "height_m prominence")
def k11_prominence(spark, d):
    return structure.prominence(structure.extrema(profiles(spark, d)), profiles(spark, d), 2.0, least=2.0)


def _strata(spark, d):
    p = structure.smooth_profile(profiles(spark, d))
    e = structure.prominence(structure.extrema(p), p, 1.0, least=0.05)
    c = structure.anchors(e, p)
    return p, c, structure.zones(c, structure.boundaries(c, structure.gradient(p)), p, 0.5)


@query(EXT + ", f as (select class, arg_min(kind, height_m) as k0, arg_max(kind, height_m) as k1 from x group by all), e as (select class, min(height_m) as lo, max(height_m) as hi from pr group by all) select class, height_m as centre_height, case when kind = 'peak' then 'dense' else 'open' end as type from x union all select class, lo, 'dense' from e join f using (class) where k0 <> 'peak' union all select class, hi, 'open' from e join f using (class) where k1 <> 'trough'", "class type", "", "centre_height")
def k12_anchors(spark, d):
    return structure.anchors(structure.extrema(profiles(spark, d)), profiles(spark, d))


@query(P + " select class, height_m, (coalesce(lead(pad) over w, pad) - coalesce(lag(pad) over w, pad)) / nullif(coalesce(lead(height_m) over w, height_m) - coalesce(lag(height_m) over w, height_m), 0) as slope from pr window w as (partition by class order by height_m)", "class", "", "height_m slope")
def k13_gradient(spark, d):
    return structure.gradient(profiles(spark, d))


BND = ", g as (select class, height_m as h, abs((coalesce(lead(pad) over w, pad) - coalesce(lag(pad) over w, pad)) / nullif(coalesce(lead(height_m) over w, height_m) - coalesce(lag(height_m) over w, height_m), 0)) as s from pr window w as (partition by class order by height_m)), f as (select class, arg_min(kind, height_m) as k0, arg_max(kind, height_m) as k1 from x group by all), e as (select class, min(height_m) as lo, max(height_m) as hi from pr group by all), ce as (select class, height_m as ch from x union all select class, lo from e join f using (class) where k0 <> 'peak' union all select class, hi from e join f using (class) where k1 <> 'trough'), zz as (select class, ch, row_number() over (partition by class order by ch) as zone, lead(ch) over (partition by class order by ch) as ct from ce), pt as (select zz.class, zone, h, s, max(s) over (partition by zz.class, zone) as st from zz join g on g.class = zz.class and h between ch and ct), pa as (select *, min(case when s = st then h end) over (partition by class, zone) as hx from pt), bb as (select class, zone, case when zone = 1 then coalesce(min(h) filter (where h > hx and s <= 0.1 * st), arg_min(h, (case when h > hx then s else 1e300 end, h))) else min(hx) end as boundary from pa group by class, zone)"


@query(EXT + BND + " select class, zone, boundary from bb", "class", "zone", "boundary")
def k14_boundaries(spark, d):
    p = profiles(spark, d)
    return structure.boundaries(structure.anchors(structure.extrema(p), p), structure.gradient(p))


@query(None, "class type", "zone", "centre_height zone_start zone_end")
def k15_zones(spark, d):
    return _strata(spark, d)[2]


@query(None, "class", "", "height_m pad")
def k16_zone_points(spark, d):
    p, _, z = _strata(spark, d)
    return structure.zone_points(z, p)


@query(None, "", "", "inflection density max_height")
def k17_inflections(spark, d):
    return structure.inflections(pads(spark, d), ["cell"], "height_m", "pad")
