"""Point cloud and vertical density operators (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pct
from ..functions.quantiles import quantiles
from .grid import fill_idw, focal_mean, nearest_layer


def iqr_fence(points: DataFrame, z: str = "z") -> DataFrame:
    """P1. Points with z within 1.5 interquartile ranges of the quartiles, ends included."""
    q = quantiles(points, z, [0.25, 0.75]).toDF("__a", "__b")
    spread = 1.5 * (F.col("__b") - F.col("__a"))
    return points.join(F.broadcast(q), how="cross").filter(F.col(z).between(F.col("__a") - spread, F.col("__b") + spread)).drop("__a", "__b")  # one row


def voxelise(points: DataFrame, res: float, dz: float, classified: bool = True) -> DataFrame:
    """P2. Counts by column and height bin, zero bins and empty columns included; ground and canopy of each column.

    Ground is the lowest point of class 2 (or of all). Bins are counted from floor(min z / dz).
    """
    p = points.withColumn("cx", F.floor(F.col("x") / res).cast("int")).withColumn("cy", F.floor(F.col("y") / res).cast("int")).withColumn("z_bin", F.floor(F.col("z") / dz).cast("int"))
    low = F.min(F.when(F.col("class") == 2, F.col("z"))) if classified else F.min("z")
    counts = p.groupBy("cx", "cy", "z_bin").agg(F.count("*").alias("n"))
    cols = p.groupBy("cx", "cy").agg(low.alias("ground"), F.max("z").alias("canopy"))
    ext = p.agg(*[f(c).alias(f"{a}_{c}") for c in ("cx", "cy", "z_bin") for a, f in (("lo", F.min), ("hi", F.max))])
    frame = ext
    for c in ("cx", "cy", "z_bin"):
        frame = frame.withColumn(c, F.explode(F.sequence(f"lo_{c}", f"hi_{c}")))
    return frame.select("cx", "cy", "z_bin").join(counts, ["cx", "cy", "z_bin"], "left").join(cols, ["cx", "cy"], "left").select("cx", "cy", "z_bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "ground", "canopy")


def level_columns(vox: DataFrame, keys: tuple[str, ...] = ("cx", "cy")) -> DataFrame:
    """P3. Columns shifted so that the first positive bin is the first, zeros above; canopy above ground; NULL without ground or pulses."""
    w = Window.partitionBy(*keys)
    first = F.min(F.when(F.col("n") > 0, F.col("z_bin"))).over(w)
    out = vox.withColumn("__f", first).withColumn("__lo", F.min("z_bin").over(w)).withColumn("__hi", F.max("z_bin").over(w))
    shift = F.coalesce(F.col("__f"), F.col("__lo")) - F.col("__lo")
    size = F.col("__hi") - F.col("__lo") + 1
    at = F.col("z_bin") - F.col("__lo") - shift
    ok = F.col("__f").isNotNull() & F.col("ground").isNotNull()
    # bins below the first positive one become the zeros above
    at = F.when(at < 0, at + size).otherwise(at)
    return out.select(*keys, (at.cast("int")).alias("z_bin"), F.when(ok, F.col("n")).alias("n"), "ground", F.when(ok, F.col("canopy") - F.col("ground")).alias("canopy"))


def leaf_density(vox: DataFrame, dz: float, k: float | str | None = None, keys: tuple[str, ...] = ("cx", "cy"), drop_first: bool = True) -> DataFrame:
    """P4. ln(in / through) / (k dz) by bin of a levelled column: in sums the bins up to this one, through those below it.

    NULL where it is not finite and from bin ceil(canopy / dz) + 2 (from 1) up. k: none, a number, or a column.
    """
    w = Window.partitionBy(*keys).orderBy("z_bin")
    enter = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    through = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    div = F.lit(dz) * (F.lit(1.0) if k is None else F.col(k) if isinstance(k, str) else F.lit(float(k)))
    number = F.col("z_bin") + 1
    out = vox.withColumn("__in", enter).withColumn("__th", through)
    keep = (F.col("__in") > 0) & (F.col("__th") > 0) & (number < F.ceil(F.col("canopy") / dz) + 2)
    if drop_first:
        keep &= number > 1
    return out.withColumn("pad", F.when(keep, F.log(F.col("__in") / F.col("__th")) / div)).drop("__in", "__th")


def surface_height(points: DataFrame, res: float) -> DataFrame:
    """P5. Canopy surface: the highest point of each cell, then the 3 x 3 mean, gaps of the extent filled from neighbours."""
    top = points.groupBy(F.floor(F.col("y") / res).cast("int").alias("row"), F.floor(F.col("x") / res).cast("int").alias("col")).agg(F.max("z").alias("z"))
    ext = top.agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("col").alias("c"), F.max("col").alias("d"))
    full = ext.withColumn("row", F.explode(F.sequence("a", "b"))).withColumn("col", F.explode(F.sequence("c", "d"))).select("row", "col")
    return focal_mean(full.join(top, ["row", "col"], "left"), "z")


def ground_height(points: DataFrame, res: float, k: int = 10) -> DataFrame:
    """P5. Ground surface: mean of class-2 points by cell, gaps by inverse distance."""
    cell = points.withColumn("row", F.floor(F.col("y") / res).cast("int")).withColumn("col", F.floor(F.col("x") / res).cast("int"))
    known = cell.filter("class = 2").groupBy("row", "col").agg(F.avg("z").alias("ground"))
    every = cell.select("row", "col").distinct()
    gaps = fill_idw(known, every.join(known, ["row", "col"], "left_anti"), "ground", k)
    return known.unionByName(gaps)


def normalise_height(points: DataFrame, ground: DataFrame, res: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """P6. z above ground without points below it; x and y from their minimum."""
    at = points.withColumn("row", F.floor(F.col("y") / res).cast("int")).withColumn("col", F.floor(F.col("x") / res).cast("int"))
    up = at.join(ground.select("row", "col", "ground"), ["row", "col"]).withColumn("z", F.col("z") - F.col("ground")).filter("z >= 0").drop("row", "col", "ground")
    low = up.groupBy(*keys).agg(F.min("x").alias("__x"), F.min("y").alias("__y")) if keys else up.agg(F.min("x").alias("__x"), F.min("y").alias("__y"))
    out = up.join(F.broadcast(low), list(keys)) if keys else up.join(F.broadcast(low), how="cross")
    return out.withColumn("x", F.col("x") - F.col("__x")).withColumn("y", F.col("y") - F.col("__y")).drop("__x", "__y")


def clean_density(pad: DataFrame, value: str = "pad", keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """P7. NULL becomes 0 where the column has any value."""
    some = F.max(F.col(value).isNotNull()).over(Window.partitionBy(*keys))
    return pad.withColumn(value, F.when(some, F.coalesce(value, F.lit(0.0))))


def cumulative_pai(pad: DataFrame, dz: float, value: str = "pad", keys: tuple[str, ...] = ("cell",), height: str = "height_m") -> DataFrame:
    """P8. Sum from each bin to the top, times dz."""
    w = Window.partitionBy(*keys).orderBy(F.desc(height)).rowsBetween(Window.unboundedPreceding, 0)
    return pad.withColumn("pai", F.sum(value).over(w) * dz)


def band_pai(pad: DataFrame, dz: float, breaks: tuple[float, ...] = (2.0, 10.0), value: str = "pad", keys: tuple[str, ...] = ("cell",), height: str = "height_m") -> DataFrame:
    """P9. Sums times dz of the bins in [0, b1), [b1, b2), .. [bn, top)."""
    ends = [0.0, *breaks, float("inf")]
    return pad.groupBy(*keys).agg(*[(F.coalesce(F.sum(F.when((F.col(height) >= a) & (F.col(height) < b), F.col(value))), F.lit(0.0)) * dz).alias(f"pai_{i}") for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True), 1)])


def stratum_pai(pad: DataFrame, strata: DataFrame, dz: float, value: str = "pad", keys: tuple[str, ...] = ("cell",), height: str = "height_m") -> DataFrame:
    """P10. Density of the bins wholly inside each stratum; an error where they do not cover it. strata: a few rows."""
    inside = (F.col(height) >= F.col("zone_start")) & (F.col(height) + dz <= F.col("zone_end") + 1e-9)
    out = pad.join(F.broadcast(strata), inside).groupBy(*keys, "zone", "zone_start", "zone_end").agg((F.sum(value) * dz).alias("pai"), F.count_distinct(height).alias("__k"))
    whole = F.col("__k") == F.round((F.col("zone_end") - F.col("zone_start")) / dz)
    return out.withColumn("pai", F.when(whole, F.col("pai")).otherwise(F.raise_error(F.lit("bins do not cover a stratum")).cast("double"))).drop("__k")


def density_shape(pad: DataFrame, value: str = "pad", keys: tuple[str, ...] = ("cell",), height: str = "height_m") -> DataFrame:
    """P11. 95th percentile, height of the (first) maximum and sd of each column's density."""
    some = pad.filter(F.col(value).isNotNull())
    return some.groupBy(*keys).agg(pct(value, 0.95).alias("p95"), F.min_by(height, F.struct(-F.col(value), F.col(height))).alias("h_max"), F.stddev_samp(value).alias("sd"))


def cross_section(points: DataFrame, temps: DataFrame, heights: list[float], y: float, half_width: float, n: int, res: float, value: str, x_max: float = 250.0, seed: int = 1) -> DataFrame:
    """P12. A sample of n points of a strip about y, with the value at the nearest height. The sample is by a hash of the point."""
    strip = points.filter(F.col("y").between(y - half_width, y + half_width) & F.col("x").between(0, x_max))
    some = strip.orderBy(F.xxhash64("x", "y", "z", F.lit(seed)), "x", "y", "z").limit(n)
    at = nearest_layer(some, heights).withColumn("row", F.floor(F.col("y") / res).cast("int")).withColumn("col", F.floor(F.col("x") / res).cast("int"))
    return at.join(temps.select("row", "col", "height_m", value), ["row", "col", "height_m"], "left")
