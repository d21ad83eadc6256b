"""G, P and R queries over the customer grid, part profiles and soil-like tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import climate, grid as g_, points
from ..sources import checkpoints, tables as src
from .registry import G, H, P, chm, gappy, grid, hourly, layers, pads, query, strata, sun_sql, table

GRIDS = "(select n_name as site, 50 as ncol, 100 as nrow, 0.0 as xmin, 0.0 as ymin, 500.0 as ymax, 5.0 as res from nation)"


def grids(spark, d):
    return table(spark, d, "nation").selectExpr("n_name as site", "50 as ncol", "100 as nrow", "cast(0 as double) as xmin", "cast(0 as double) as ymin", "cast(500 as double) as ymax", "cast(5 as double) as res")


def cloud(spark, d):
    """lineitem as a point cloud: x, y on 100 m, z to 50, class 2 where there is no discount."""
    return table(spark, d, "lineitem").selectExpr("cast(l_suppkey % 10 * 10 + l_linenumber as double) as x", "cast(l_partkey % 10 * 10 + l_tax * 100 as double) as y", "l_quantity as z", "case when l_discount < 0.02 then 2 else 1 end as class")


CL = "with c as (select cast(l_suppkey % 10 * 10 + l_linenumber as double) as x, cast(l_partkey % 10 * 10 + l_tax * 100 as double) as y, l_quantity as z, case when l_discount < 0.02 then 2 else 1 end as class from lineitem)"


@query(f"select n_name as site, c_custkey % 5000 + 1 as cell, (c_custkey % 5000) // 50 as row, (c_custkey % 5000) % 50 as col, ((c_custkey % 5000) % 50 + 0.5) * 5.0 as x, 500 - ((c_custkey % 5000) // 50 + 0.5) * 5.0 as y, ((c_custkey % 5000) % 50 + 0.5) * 5.0 / 1000 as x_km from customer join nation on c_nationkey = n_nationkey", "site", "cell row col", "x y x_km")
def g1_cell_xy(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("site"), (F.col("c_custkey") % 5000 + 1).alias("cell"))
    return g_.cell_xy(c, grids(spark, d))


@query("select c_custkey, n_name as site, case when c_acctbal >= 0 and c_acctbal / 20 < 250 then floor((500 - c_custkey % 500 - 0.5) / 5) * 50 + floor(c_acctbal / 20 / 5) + 1 end as cell from customer join nation on c_nationkey = n_nationkey", "site", "c_custkey cell")
def g1_xy_cell(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("site"), (F.col("c_acctbal") / 20).alias("x"), (F.col("c_custkey") % 500 + 0.5).alias("y"))
    return g_.xy_cell(c, grids(spark, d))


@query(G + " select row, col, max(value) as value from (select row, col, value from g where col < 30 union all select row, col, value + 1 from g where col >= 20) group by all", "", "row col", "value")
def g3_mosaic(spark, d):
    g = grid(spark, d)
    return g_.mosaic([g.filter("col < 30").select("row", "col", "value"), g.filter("col >= 20").select("row", "col", (F.col("value") + 1).alias("value"))], ["row", "col"], "value", "max")


@query(G + " select row // 5 as row, col // 5 as col, avg(value) as value from gg group by all", "", "row col", "value")
def g4_coarsen(spark, d):
    return g_.coarsen(gappy(spark, d), 5, "value")


@query(G + ", k as (select row // 5 as row, col // 5 as col, class, count(*) as n from g group by all) select row, col, class from (select *, row_number() over (partition by row, col order by n desc, class) as r from k) where r = 1", "", "row col class")
def g4_coarsen_mode(spark, d):
    return g_.coarsen(grid(spark, d), 5, "class", fun="mode")


BILIN = "select c.row, c.col, sum((1 - abs((c.row + 0.5) / {f} - 0.5 - k.row)) * (1 - abs((c.col + 0.5) / {f} - 0.5 - k.col)) * k.{v}) / sum((1 - abs((c.row + 0.5) / {f} - 0.5 - k.row)) * (1 - abs((c.col + 0.5) / {f} - 0.5 - k.col))) as {v} from {cells} c join {coarse} k on k.row between floor((c.row + 0.5) / {f} - 0.5) and floor((c.row + 0.5) / {f} - 0.5) + 1 and k.col between floor((c.col + 0.5) / {f} - 0.5) and floor((c.col + 0.5) / {f} - 0.5) + 1 where k.{v} is not null group by all"


@query(G + ", k5 as (select row // 5 as row, col // 5 as col, avg(value) as value from gg group by all) " + BILIN.format(f="5.0", v="value", cells="g", coarse="k5"), "", "row col", "value")
def g5_resample_bilinear(spark, d):
    return g_.resample_bilinear(g_.coarsen(gappy(spark, d), 5, "value"), grid(spark, d), 5, "value")


_SRC = "select n_nationkey as site, 7 + n_nationkey % 4 as nrow, 6 + n_nationkey % 3 as ncol, 10.0 * n_nationkey as xmin, 50.0 as ymax, 3.0 as res from nation"
_DST = "select n_nationkey as site, 11 as nrow, 9 as ncol, 10.0 * n_nationkey - 0.7 as xmin, 51.3 as ymax, 2.0 as res from nation"
_G5 = f"with src as ({_SRC}), dst as ({_DST}), c as (select c_nationkey as site, row_number() over (partition by c_nationkey order by c_custkey) - 1 as i, c_acctbal as v from customer), v as (select c.site, i // ncol as r, i % ncol as k, v from c join src using (site) where i < nrow * ncol and i % 5 <> 3), t as (select dst.site, a.row, b.col, (dst.xmin + (b.col + 0.5) * dst.res - src.xmin) / src.res - 0.5 as fx, (src.ymax - dst.ymax + (a.row + 0.5) * dst.res) / src.res - 0.5 as fy, src.nrow, src.ncol from dst join src using (site) cross join (select unnest(range(11)) as row) a cross join (select unnest(range(9)) as col) b), w as (select t.site, row, col, v.v, greatest(0, 1 - abs(fy - r)) * greatest(0, 1 - abs(fx - k)) as w from t join v on t.site = v.site and abs(fy - r) < 1 and abs(fx - k) < 1 where fx between -0.5 and ncol - 0.5 and fy between -0.5 and nrow - 0.5), m as (select site, row, col, sum(w * v) / sum(w) as value from w where w > 0 group by all)"


@query(_G5 + " select t.site, t.row, t.col, value from t left join m using (site, row, col)", "", "site row col", "value")
def g5_resample_grid(spark, d):
    """Grids of three-unit cells at two-unit cells with another corner."""
    n = table(spark, d, "nation")
    src = n.selectExpr("n_nationkey as site", "7 + n_nationkey % 4 as nrow", "6 + n_nationkey % 3 as ncol", "10.0D * n_nationkey as xmin", "50.0D as ymax", "3.0D as res")
    dst = n.selectExpr("n_nationkey as site", "11 as nrow", "9 as ncol", "10.0D * n_nationkey - 0.7D as xmin", "51.3D as ymax", "2.0D as res")
    i = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    v = table(spark, d, "customer").select(F.col("c_nationkey").alias("site"), i.alias("i"), F.col("c_acctbal").alias("value")).join(src, "site").filter("i < nrow * ncol and i % 5 <> 3")
    return g_.resample_grid(v.selectExpr("site", "cast(i div ncol as int) as row", "cast(i % ncol as int) as col", "value"), src, dst, "value")


@query(G + ", k5 as (select row // 5 as row, col // 5 as col, min(class) as class from g group by all) select g.row, g.col, k5.class from g left join k5 on k5.row = g.row // 5 and k5.col = g.col // 5", "", "row col class")
def g6_resample_near(spark, d):
    return g_.resample_near(g_.coarsen(grid(spark, d), 5, "class", fun="min"), grid(spark, d), 5, "class")


@query(G + " select row, col, value from g where row between 3 and 12 and col between 7 and 33", "", "row col", "value")
def g7_crop(spark, d):
    return g_.crop(grid(spark, d), (3, 12), (7, 33))


@query(G + " select (select max(row) // 4 from g) as lo_row, (select max(row) from g) as hi_row, 10 as lo_col, 40 as hi_col", "", "lo_row hi_row lo_col hi_col")
def g7_intersect_extent(spark, d):
    g = grid(spark, d)
    lo = g.agg((F.max("row") / 4).cast("int")).first()[0]
    return g_.intersect_extent(g.filter("col >= 10"), g.filter((F.col("col") <= 40) & (F.col("row") >= lo)))


@query(G + " select r.row, c.col, value from (select unnest(range(0, 45)) as row) r cross join (select unnest(range(0, 55)) as col) c left join g on g.row = r.row and g.col = c.col", "", "row col", "value")
def g7_extend(spark, d):
    return g_.extend(grid(spark, d).select("row", "col", "value"), (0, 44), (0, 54))


@query(G + ", v as (select row, col, case when row > 2 and col > 3 and col < 45 then value end as value from g) select row, col, value from v where row between (select min(row) from v where value is not null) and (select max(row) from v where value is not null) and col between 4 and 44", "", "row col", "value")
def g7_trim(spark, d):
    return g_.trim(grid(spark, d).select("row", "col", F.when((F.col("row") > 2) & (F.col("col") > 3) & (F.col("col") < 45), F.col("value")).alias("value")), "value")


@query(G + " select row, col, case when class not in (1, 2, 3) then value end as value from g", "", "row col", "value")
def g8_mask(spark, d):
    g = grid(spark, d)
    return g_.mask(g.select("row", "col", "value"), g.select("row", "col", "class"), ["row", "col"], "value", "class", [1, 2, 3])


@query(H + ", c as (select distinct user_id as cell, cast(user_id % 12 as double) as canopy from events) select h.cell, height_m, v as raw, case when canopy > height_m then v end as v from h left join c using (cell)", "", "cell", "height_m raw v")
def g9_mask_above_canopy(spark, d):
    return g_.mask_above_canopy(hourly(spark, d).withColumn("raw", F.col("v")), chm(spark, d), ["cell"], "height_m", ["v"])


@query(G + " select a.row, a.col, avg(b.value) as value from gg a left join gg b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by all", "", "row col", "value")
def g10_focal_mean(spark, d):
    return g_.focal_mean(gappy(spark, d), "value")


@query(G + ", base as (select row, col, case when row % 9 < 6 and cell % 7 <> 0 then value end as value from g), k2 as (select row // 2 as row, col // 2 as col, avg(value) as value from base group by all), k4 as (select row // 4 as row, col // 4 as col, avg(value) as value from base group by all), k8 as (select row // 8 as row, col // 8 as col, avg(value) as value from base group by all), k16 as (select row // 16 as row, col // 16 as col, avg(value) as value from base group by all), f2 as (" + BILIN.format(f="2.0", v="value", cells="base", coarse="k2") + "), f4 as (" + BILIN.format(f="4.0", v="value", cells="base", coarse="k4") + "), f8 as (" + BILIN.format(f="8.0", v="value", cells="base", coarse="k8") + "), f16 as (" + BILIN.format(f="16.0", v="value", cells="base", coarse="k16") + ") select b.row, b.col, coalesce(b.value, f2.value, f4.value, f8.value, f16.value, (select avg(value) from base)) as value from base b left join f2 using (row, col) left join f4 using (row, col) left join f8 using (row, col) left join f16 using (row, col)", "", "row col", "value")
def g11_fill_multiscale(spark, d):
    b = gappy(spark, d).withColumn("value", F.when(F.col("row") % 9 < 6, F.col("value"))).select("row", "col", "value")
    return g_.fill_multiscale(b, "value")


@query(G + ", k as (select row, col, value from g where cell % 7 <> 0), t as (select row, col from g where cell % 7 = 0), p as (select t.row, t.col, k.value, (t.row - k.row) ** 2 + (t.col - k.col) ** 2 as d2, row_number() over (partition by t.row, t.col order by (t.row - k.row) ** 2 + (t.col - k.col) ** 2, k.row, k.col) as r from t join k on abs(t.row - k.row) <= 24 and abs(t.col - k.col) <= 24) select row, col, sum(value / d2) / sum(1 / d2) as value from p where r <= 10 group by all", "", "row col", "value")
def g12_fill_idw(spark, d):
    g = gappy(spark, d)
    return g_.fill_idw(g, g.filter("value is null"), "value")


@query(G + ", t as (select row, col, value as v0 from g where cell % 50 = 0) select t.row, t.col, coalesce(any_value(k.value) filter (where t.row = k.row and t.col = k.col), sum(k.value / nullif((t.row - k.row) ** 2 + (t.col - k.col) ** 2, 0)) / sum(1 / nullif((t.row - k.row) ** 2 + (t.col - k.col) ** 2, 0))) as value from t cross join (select row, col, value from g where cell % 7 <> 0) k group by all", "", "row col", "value")
def g12_fill_idw_all(spark, d):
    """Every 50th cell, a stated set of targets, from all known cells."""
    return g_.fill_idw_all(gappy(spark, d), grid(spark, d).filter("cell % 50 = 0"), "value")


@query(G + " select s_suppkey, value from supplier left join g on g.row = s_suppkey % 30 and g.col = s_suppkey % 50", "", "s_suppkey", "value")
def g13_extract_at_points(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50 + 0.5).alias("x"), (F.col("s_suppkey") % 30 + 0.5).alias("y"))
    return g_.extract_at_points(p, grid(spark, d), "value")


@query("select p_partkey, case when p_size >= 7.5 then 10.0 when p_size >= 3.5 then 5.0 when p_size >= 1.5 then 2.0 else 1.0 end as height_m from part", "", "p_partkey", "height_m")
def g14_nearest_layer(spark, d):
    return g_.nearest_layer(table(spark, d, "part").withColumn("z", F.col("p_size").cast("double")), [1, 2, 5, 10])


@query("select c_custkey, case when c_nationkey % 5 = 0 then (select v from (select c_nationkey % 5 as v, count(*) as n from customer where c_nationkey % 5 <> 0 group by all order by n desc, v limit 1)) else c_nationkey % 5 end as v from customer", "", "c_custkey v")
def g15_modal_replace(spark, d):
    return g_.modal_replace(table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("v")), "v")


@query("with x as (select p_partkey, p_type, p_size, case when p_partkey % 5 <> 0 then p_retailprice end as v from part), f as (select p_type, regr_slope(v, p_size) as b, regr_intercept(v, p_size) as a, count(v) as n from x group by all) select p_partkey, coalesce(v, case when n >= 10 then a + b * p_size end) as v from x join f using (p_type)", "", "p_partkey", "v")
def g16_fill_by_regression(spark, d):
    x = table(spark, d, "part").withColumn("v", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")))
    return g_.fill_by_regression(x, "p_type", "v", "p_size")


@query(None, "", "row col class", "value")
def g17_sharpen(spark, d):
    coarse = g_.coarsen(grid(spark, d).withColumn("value", F.abs("value")), 5, "value")
    return g_.sharpen(coarse, grid(spark, d).select("row", "col", "class"), 5, "value", "class")


@query(G + ", mx as (select max(row) // 10 as r, max(col) // 10 as c from g) select g.row, g.col, tr.t as tile_row, tc.t as tile_col from g cross join mx join (select unnest(range(0, 100000)) as t) tr on tr.t <= mx.r and g.row >= tr.t * 10 - 2 and g.row < (tr.t + 1) * 10 + 2 join (select unnest(range(0, 5)) as t) tc on tc.t <= mx.c and g.col >= tc.t * 10 - 2 and g.col < (tc.t + 1) * 10 + 2", "", "row col tile_row tile_col")
def g18_tile_with_buffer(spark, d):
    return g_.tile_with_buffer(grid(spark, d), 10, 2)


@query("with p as (select p_type as tile, p_partkey, p_retailprice as x from part), e as (select tile, count(*) as n, min(x) as lo, max(x) as hi, case when count(*) > 10 then ceil(count(*) / 4.0) else 1 end as k from p group by all) select tile, p_partkey, least(coalesce(floor((x - lo) / nullif((hi - lo) / k, 0)) + 1, 1), k) as part from p join e using (tile)", "tile", "p_partkey part")
def g18_tile_points(spark, d):
    return g_.tile_points(table(spark, d, "part").selectExpr("p_type as tile", "p_partkey", "p_retailprice as x"), "tile", 10, 4)


@query(CL + " select min(x) as xmin, max(x) as xmax, min(y) as ymin, max(y) as ymax from c", "", "", "xmin xmax ymin ymax")
def g19_bbox(spark, d):
    return g_.bbox(cloud(spark, d))


@query(G + " select class, count(*) as cells, count(*) * 0.0025 as hectares, 100.0 * count(*) / (select count(*) from g) as percent from g group by all", "", "class cells", "hectares percent")
def g20_class_area(spark, d):
    return g_.class_area(grid(spark, d), "class", 5.0)


@query("with q as (select l_suppkey as cell, l_quantity as h, avg(l_extendedprice - 40000) / 20000 as m from lineitem where l_quantity <= 2 group by all), r as (select *, dense_rank() over (partition by cell order by h) as k from q), t as (select cell, max(m) filter (where k = 1) as low, coalesce(max(m) filter (where k = 2), 0) as nxt from r group by all) select cell, case when nxt > 0 then 2 when nxt = 0 and low < 1 then 16 when nxt = 0 and low >= 1 then 10 else 0 end as cover from t", "", "cell cover")
def g21_landcover_rules(spark, d):
    x = table(spark, d, "lineitem").filter("l_quantity <= 2").selectExpr("l_suppkey as cell", "l_quantity as h", "(l_extendedprice - 40000) / 20000 as pai")
    return g_.landcover_rules(x, "cell", "h", "pai")


@query(G + " select seg, max(value) as max, avg(value) as mean, sum(value) as sum, quantile_cont(value, 0.95) as q from g group by all", "seg", "", "max mean sum q")
def g22_global_stats(spark, d):
    return g_.global_stats(grid(spark, d), "value", keys=("seg",))


@query(G + " select cell, coalesce(value, avg(value) over (partition by class)) as value from gg", "", "cell", "value")
def g23_class_mean_fill(spark, d):
    return g_.class_mean_fill(gappy(spark, d), "class", "value")


@query(G + ", m as (select class, avg(value) as value from gg group by all) select s_suppkey, value from supplier left join m on s_nationkey = class", "", "s_suppkey", "value")
def g23_expected_by_class(spark, d):
    return g_.expected_by_class(gappy(spark, d), table(spark, d, "supplier").withColumnRenamed("s_nationkey", "class"), "class", "value")


@query("select c_custkey, n_regionkey / 10.0 as leafr, 0.5 * n_regionkey / 10.0 as leaft from customer join nation on c_nationkey = n_nationkey", "", "c_custkey", "leafr leaft")
def g24_habitat_params(spark, d):
    look = table(spark, d, "nation").selectExpr("n_nationkey as c_nationkey", "n_regionkey / 10.0D as leafr")
    return g_.habitat_params(table(spark, d, "customer"), look, "c_nationkey")


@query("with q as (select quantile_cont(c_acctbal, 0.25) as a, quantile_cont(c_acctbal, 0.75) as b from customer) select c_custkey, c_acctbal as z from customer, q where c_acctbal between a - 1.5 * (b - a) and b + 1.5 * (b - a)", "", "c_custkey", "z")
def p1_iqr_fence(spark, d):
    return points.iqr_fence(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("z")))


VOX = CL + ", b as (select cast(floor(x / 20) as bigint) as cx, cast(floor(y / 20) as bigint) as cy, cast(floor(z / 5) as bigint) as z_bin, z, class from c), n as (select cx, cy, z_bin, count(*) as n from b group by all), k as (select cx, cy, min(z) filter (where class = 2) as ground, max(z) as canopy from b group by all), vox as (select cx, cy, z_bin, coalesce(n, 0) as n, ground, canopy from (select unnest(range((select min(cx) from b), (select max(cx) + 1 from b))) as cx) cross join (select unnest(range((select min(cy) from b), (select max(cy) + 1 from b))) as cy) cross join (select unnest(range((select min(z_bin) from b), (select max(z_bin) + 1 from b))) as z_bin) left join n using (cx, cy, z_bin) left join k using (cx, cy))"


def voxels(spark, d):
    return points.voxelise(cloud(spark, d), 20.0, 5.0)


@query(VOX + " select * from vox", "", "cx cy z_bin n", "ground canopy")
def p2_voxelise(spark, d):
    return voxels(spark, d)


LEV = VOX + ", f as (select *, min(case when n > 0 then z_bin end) over (partition by cx, cy) as f, min(z_bin) over (partition by cx, cy) as lo, max(z_bin) over (partition by cx, cy) as hi from vox), lev as (select cx, cy, case when z_bin - lo - (f - lo) < 0 then z_bin - f + hi - lo + 1 else z_bin - f end as z_bin, case when ground is not null then n end as n, ground, canopy - ground as canopy from f)"


@query(LEV + " select * from lev", "", "cx cy z_bin n", "ground canopy")
def p3_level_columns(spark, d):
    return points.level_columns(voxels(spark, d))


@query(LEV + ", s as (select *, sum(n) over (partition by cx, cy order by z_bin) as i, sum(n) over (partition by cx, cy order by z_bin rows between unbounded preceding and 1 preceding) as t from lev) select cx, cy, z_bin, case when t > 0 and i > 0 and z_bin + 1 < ceil(canopy / 5) + 2 then ln(i / t) / 5 end as pad from s", "", "cx cy z_bin", "pad")
def p4_leaf_density(spark, d):
    return points.leaf_density(points.level_columns(voxels(spark, d)), 5.0)


@query(CL + ", t as (select floor(y / 10) as row, floor(x / 10) as col, max(z) as z from c group by all), f as (select row, col from (select unnest(range((select min(row) from t)::bigint, (select max(row) + 1 from t)::bigint)) as row) cross join (select unnest(range((select min(col) from t)::bigint, (select max(col) + 1 from t)::bigint)) as col)) select f.row, f.col, avg(t.z) as z from f left join t on abs(f.row - t.row) <= 1 and abs(f.col - t.col) <= 1 group by all", "", "row col", "z")
def p5_surface_height(spark, d):
    return points.surface_height(cloud(spark, d), 10.0)


@query(CL + ", n as (select distinct floor(y)::bigint as row, floor(x)::bigint as col from c), g as (select floor(y)::bigint as row, floor(x)::bigint as col, avg(z) as ground from c where class = 2 group by all), gap as (select * from n anti join g using (row, col)), w as (select gap.row, gap.col, g.ground, (gap.row - g.row) ** 2 + (gap.col - g.col) ** 2 as d2, row_number() over (partition by gap.row, gap.col order by (gap.row - g.row) ** 2 + (gap.col - g.col) ** 2, g.row, g.col) as k from gap cross join g) select row, col, ground from g union all select row, col, sum(ground / d2) / sum(1 / d2) from w where k <= 10 group by row, col", "", "row col", "ground")
def p5_ground_height(spark, d):
    return points.ground_height(cloud(spark, d), 1.0)


@query(CL + ", g as (select floor(y / 10) as row, floor(x / 10) as col, avg(z) as ground from c where class = 2 group by all), u as (select x, y, z - ground as z from c join g on g.row = floor(y / 10) and g.col = floor(x / 10) where z >= ground) select x - (select min(x) from u) as x, y - (select min(y) from u) as y, z from u", "", "", "x y z")
def p6_normalise_height(spark, d):
    p = cloud(spark, d)
    known = p.filter("class = 2").groupBy(F.floor(F.col("y") / 10).cast("int").alias("row"), F.floor(F.col("x") / 10).cast("int").alias("col")).agg(F.avg("z").alias("ground"))
    return points.normalise_height(p, known, 10.0)


@query(P + ", q as (select cell, height_m, case when height_m % 7 <> 0 then pad end as pad from p) select cell, height_m, case when count(pad) over (partition by cell) > 0 then coalesce(pad, 0) end as pad from q", "cell", "", "height_m pad")
def p7_clean_density(spark, d):
    return points.clean_density(pads(spark, d).withColumn("pad", F.when(F.col("height_m") % 7 != 0, F.col("pad"))))


@query(P + " select cell, height_m, 0.5 * sum(pad) over (partition by cell order by height_m desc) as pai from p", "cell", "", "height_m pai")
def p8_cumulative_pai(spark, d):
    return points.cumulative_pai(pads(spark, d), 0.5)


@query(P + " select cell, 0.5 * coalesce(sum(pad) filter (where height_m < 2), 0) as pai_1, 0.5 * coalesce(sum(pad) filter (where height_m >= 2 and height_m < 10), 0) as pai_2, 0.5 * coalesce(sum(pad) filter (where height_m >= 10), 0) as pai_3 from p group by all", "cell", "", "pai_1 pai_2 pai_3")
def p9_band_pai(spark, d):
    return points.band_pai(pads(spark, d), 0.5)


@query("with p as (select p_type as cell, cast(p_size as double) as height_m, avg(p_retailprice) / 1000 as pad from part group by all), f as (select c.cell, h.h as height_m, coalesce(pad, 0) as pad from (select distinct cell from p) c cross join (select unnest(range(0, 51))::double as h) h left join p on p.cell = c.cell and p.height_m = h.h) select cell, r_regionkey as zone, sum(pad) as pai from f join region on height_m >= 10.0 * r_regionkey and height_m + 1 <= 10.0 * r_regionkey + 10 group by all", "cell", "zone", "pai")
def p10_stratum_pai(spark, d):
    from ..sources.tables import pad_layers

    p = table(spark, d, "part").groupBy(F.lit(1).alias("tile"), F.col("p_type").alias("cell"), F.col("p_size").cast("double").alias("height_m")).agg((F.avg("p_retailprice") / 1000).alias("pad"))
    return points.stratum_pai(pad_layers(p, "tile", "cell", "height_m", "pad", 1.0).fillna(0, ["pad"]), strata(spark, d), 1.0)


@query(P + " select cell, quantile_cont(pad, 0.95) as p95, arg_max(height_m, (pad, -height_m)) as h_max, stddev_samp(pad) as sd from p group by all", "cell", "", "p95 h_max sd")
def p11_density_shape(spark, d):
    return points.density_shape(pads(spark, d))


@query(None, "", "class", "x y z value")
def p12_cross_section(spark, d):
    temps = layers(spark, d).groupBy((F.col("cell") % 10).cast("int").alias("row"), F.col("site").cast("int").alias("col"), "height_m").agg(F.avg("tmax").alias("value"))
    return points.cross_section(cloud(spark, d), temps, [1, 2, 5, 10, 20], 50.0, 10.0, 500, 10.0, "value")


SIX = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


@query("select l_suppkey, (" + " + ".join(f"{c} * {w!r}" for c, w in zip(SIX, climate.planck_weights(), strict=True)) + ") / 10000 as albedo from lineitem", "", "l_suppkey", "albedo")
def r1_band_albedo(spark, d):
    return climate.band_albedo(table(spark, d, "lineitem"), SIX)


@query("with a as (select c_custkey, (c_acctbal + 2000) / 20000 as v from customer), b as (select (s_acctbal + 2000) / 20000 as v from supplier), x as (select avg(ln(v / (1 - v))) as m1, stddev_samp(ln(v / (1 - v))) as s1 from a), y as (select avg(ln(v / (1 - v))) as m2, stddev_samp(ln(v / (1 - v))) as s2 from b) select c_custkey, 1 / (1 + exp(-((ln(v / (1 - v)) - m1) * s2 / s1 + m2))) as v from a, x, y", "", "c_custkey", "v")
def r2_match_logit(spark, d):
    one = lambda n, k, b: table(spark, d, n).select(F.col(k), ((F.col(b) + 2000) / 20000).alias("v"))
    return climate.match_logit(one("customer", "c_custkey", "c_acctbal"), one("supplier", "s_suppkey", "s_acctbal"), "v")


@query(None, "", "cell", "albedo leaf ground")
def r3_invert_reflectance(spark, d):
    x = grid(spark, d).select("cell", "row", "col", (0.08 + F.pmod(F.abs("value"), F.lit(2000.0)) / 10000).alias("albedo"), (F.col("class") / 5.0).alias("pai"), F.when(F.col("cell") % 41 != 0, 0.6 + (F.col("row") % 9) / 10).alias("x"))
    return climate.invert_reflectance(x, "albedo", "pai", "x")


@query("select l_suppkey as cell, sum(w * l_quantity) / sum(w) as v from (select *, list_value(5.0, 5.0, 3.75, 3.75, 2.5, 3.125)[l_linenumber] as w from lineitem where l_linenumber <= 6) group by all", "", "cell", "v")
def r4_depth_mean(spark, d):
    x = table(spark, d, "lineitem").filter("l_linenumber <= 6").selectExpr("l_suppkey as cell", "l_linenumber as depth", "l_quantity as v")
    return climate.depth_mean(x, ["v"])


@query(None, "", "row col class", "sand")
def r5_soil_downscale(spark, d):
    soil = g_.coarsen(gappy(spark, d).withColumn("sand", F.abs("value")), 5, "sand")
    return climate.soil_downscale(soil, grid(spark, d).select("row", "col", "class"), 5, ["sand"], water=3)


@query("with t as (select r_name as type, r_regionkey * 10.0 + 3 as a, (r_regionkey * 3) % 5 * 0.02 as b from region), s as (select stddev_samp(a) as sa, stddev_samp(b) as sb from t) select id, arg_min(type, (abs(x.a - t.a) / sa + abs(x.b - t.b) / sb, type)) as type from (select row_number() over () as r, l_orderkey * 10000000 + l_partkey * 100 + l_linenumber as id, l_quantity as a, l_discount as b from lineitem) x, t, s group by r, id", "type", "id")
def r6_soil_type(spark, d):
    t = table(spark, d, "region").selectExpr("r_name as type", "r_regionkey * 10.0D + 3 as a", "(r_regionkey * 3) % 5 * 0.02D as b")
    x = table(spark, d, "lineitem").selectExpr("l_orderkey * 10000000 + l_partkey * 100 + l_linenumber as id", "l_quantity as a", "l_discount as b")
    return climate.soil_type(x, t, ["a", "b"])


@query(G + " select row, col, value from gg", "", "row col", "value")
def s1_read_cells(spark, d):
    """NaN and infinities become NULL on reading."""
    g = grid(spark, d).withColumn("value", F.when(F.col("cell") % 14 == 0, float("nan")).when(F.col("cell") % 7 == 0, float("inf")).otherwise(F.col("value")))
    path = checkpoints.new_path(spark, "cells")
    src.write_table(g, path)
    return src.read_cells(spark, path)


@query("select n_regionkey, count(*) as n from nation group by all", "", "n_regionkey n")
def s7_write_table(spark, d):
    """nation written in partitions of the shared folder and read back."""
    path = checkpoints.new_path(spark, "nations")
    src.write_table(table(spark, d, "nation"), path, ["n_regionkey"])
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("select n_name as site from nation", "site")
def g2_same_geometry(spark, d):
    """Grids as given against those found again from the ends of their cells."""
    g = grids(spark, d)
    ends = g_.grid_cells(g).groupBy("site").agg(F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("row").alias("r"), F.max("col").alias("c"))
    again = ends.join(g.select("site", "res"), "site").select("site", (F.col("r") + 1).alias("nrow"), (F.col("c") + 1).alias("ncol"), (F.col("x0") - F.col("res") / 2).alias("xmin"), (F.col("y1") + F.col("res") / 2).alias("ymax"))
    g_.same_geometry(g.select(*[F.col(c).cast("double") for c in again.columns if c != "site"], "site"), again.select(*[F.col(c).cast("double") for c in again.columns if c != "site"], "site"))
    return g


@query("with r as (select user_id as cell, 280 + value / 100 as t2m, 275 + value / 200 as d2m, value * 100 as ssrd, value as u10, value / 2 as v10, value * 50 as fdir, ts from events), x as (select *, t2m - 273.15 as t, d2m - 273.15 as d from r) select cell, t as temp, least(100 * exp(case when d > 0 then 17.27 * d / (d + 237.3) else 21.875 * d / (d + 265.5) end - case when t > 0 then 17.27 * t / (t + 237.3) else 21.875 * t / (t + 265.5) end), 100) as relhum, ssrd / 3600 as swdown, sqrt(u10 * u10 + v10 * v10) * 0.7477849 as windspeed, ssrd / 3600 - fdir / 3600 * greatest(0, cos(z)) as difrad, 101.325 as pres, 300.0 as lwdown, (atan2(u10, v10) * 180 / pi() + 180) % 360 as winddir, 1.0 as precip from (select *, " + sun_sql("cast(ts as date)", "(hour(ts) + minute(ts) / 60.0 + floor(second(ts)) / 3600.0)", "10", "20") + " as z from x)", "", "cell", "temp relhum swdown windspeed difrad pres lwdown winddir precip")
def c1_normalise_climate(spark, d):
    x = table(spark, d, "events").selectExpr("user_id as cell", "cast(ts as timestamp) as ts", "280 + value / 100 as t2m", "275 + value / 200 as d2m", "101325D as sp", "value as u10", "value / 2 as v10", "0.001D as tp", "300D as avg_sdlwrf", "value * 50 as fdir", "value * 100 as ssrd", "10D as lat", "20D as lon")
    return climate.normalise_climate(x)


_C7 = """with x as (select event_id, value * 3 as sw, event_id % 90 as deg, radians(event_id % 90) as z from events),
a as (select *, 0.83 - 0.56 * exp(-0.06 * (90 - deg)) as k1, 0.56 - 0.32 * exp(-0.06 * (90 - deg)) as kx from x),
b as (select *, greatest(0, least(k1, sw / (1352 * cos(z)))) as k, 0.95 * k1 as k2, case when deg < 88.6 then 0.07 + 0.046 * deg / (93.0 - deg) else 1 end as d1 from a),
c as (select *, 0.021 + 0.397 * k / k1 - 0.231 * (k / k1) ** 2 - 0.13 * exp(-0.834 * ((k / k1 - 0.931) / 0.134) ** 2) as s3, greatest(0, 0.5 * (1 + sin(pi() * (k - 0.22) / (k1 - 0.22) - pi() / 2))) as kk from b),
e as (select *, 1 - (1 - d1) * (0.11 * sqrt(kk) + 0.15 * kk + 0.74 * kk * kk) as d2, 0.81 ** ((1 / cos(z)) ** 0.6) as kb from c),
f as (select *, (kb + d2 * k2 / (1 - k2)) / (1 + d2 * k2 / (1 - k2)) as km from e),
g as (select *, case when k <= 0.22 then 1 when k <= k2 then d2 when k <= km then d2 * k2 * (1 - k) / (k * (1 - k2)) else 1 - km * (1 - d2 * k2 * (1 - km) / (km * (1 - k2))) / k end as share from f where sw > 0),
i as (select *, case when k >= 0.14 and k < kx then -3 * ((k - 0.14) / (kx - 0.14)) ** 2 * (1 - (k - 0.14) / (kx - 0.14)) * s3 ** 1.3 when k >= kx and k < kx + 0.71 then 3 * (k - kx) / 0.71 * (1 - (k - kx) / 0.71) ** 2 * s3 ** 0.6 else 0 end as delta from g where s3 > 0.01)
select event_id, sw * (share + coalesce(delta, 0)) as difrad from g left join (select event_id, delta from i) using (event_id) union all select event_id, sw from x where sw <= 0"""


@query(_C7, "", "event_id", "difrad")
def c7_diffuse_partition(spark, d):
    x = table(spark, d, "events").select("event_id", (F.col("value") * 3).alias("swdown"), F.radians((F.col("event_id") % 90).cast("double")).alias("zenith"))
    return climate.diffuse_partition(x)
