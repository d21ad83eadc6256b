"""Structure classes and strata (K)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pct
from ..functions.splines import smooth_map
from ..sources.checkpoints import cut
from .grid import resample_near


def complete_positive(df: DataFrame, cols: list[str]) -> DataFrame:
    """K1. Rows with every value and a positive sum."""
    return df.dropna(subset=cols).filter(sum((F.col(c) for c in cols), F.lit(0.0)) > 0)


def _vectors(df: DataFrame, cols: list[str], scaled: bool = True) -> DataFrame:
    out = VectorAssembler(inputCols=cols, outputCol="__raw").transform(df.dropna(subset=cols))
    if scaled:
        out = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True).fit(out).transform(out).drop("__raw")
    return out if scaled else out.withColumnRenamed("__raw", "__x")


def pca(df: DataFrame, cols: list[str], k: int | None = None) -> tuple[DataFrame, list[list[float]], list[float]]:
    """K2. Centred and scaled principal components: scores pc1.., loadings, variance explained."""
    x = _vectors(df, cols)
    model = PCA(k=k or len(cols), inputCol="__x", outputCol="__pc").fit(x)
    out = model.transform(x).withColumn("__a", vector_to_array("__pc"))
    n = k or len(cols)
    return out.select(*df.columns, *[F.col("__a")[i].alias(f"pc{i + 1}") for i in range(n)]), model.pc.toArray().tolist(), model.explainedVariance.toArray().tolist()


def pca_table(spark, cols: list[str], loadings: list[list[float]], explained: list[float]) -> DataFrame:
    """K2. Rounded loadings and a row of the variance explained (percent)."""
    names = ", ".join(f"pc{i + 1} double" for i in range(len(explained)))
    rows = [(c, *[float(round(x, 3)) for x in r]) for c, r in zip(cols, loadings, strict=True)]
    return spark.createDataFrame([*rows, ("variance", *[float(round(100 * x, 1)) for x in explained])], f"variable string, {names}")


def gmm(df: DataFrame, cols: list[str], k: int = 4, seed: int = 1, order: str | None = None) -> DataFrame:
    """K3. Hard classes 1..k of a Gaussian mixture, numbered by their mean of `order` (the first column)."""
    x = _vectors(df, cols)
    out = GaussianMixture(k=k, featuresCol="__x", predictionCol="__k", probabilityCol="__p", seed=seed).fit(x).transform(x)
    means = out.groupBy("__k").agg(F.avg(order or cols[0]).alias("__m")).withColumn("class", F.row_number().over(Window.orderBy("__m", "__k")).cast("int"))  # k rows
    return out.join(F.broadcast(means.select("__k", "class")), "__k").select(*df.columns, "class")


def cluster_summary(df: DataFrame, cols: list[str], cls: str = "class") -> DataFrame:
    """K4. n, mean and sd by class."""
    return df.groupBy(cls).agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def centroids(df: DataFrame, pcs: list[str], cls: str = "class") -> DataFrame:
    """K4. Mean components by class."""
    return df.groupBy(cls).agg(*[F.avg(c).alias(c) for c in pcs])


def classes_to_grid(classes: DataFrame, cells: DataFrame, factor: int, cls: str = "class") -> DataFrame:
    """K5. Class labels of coarse cells at finer ones."""
    return resample_near(classes.select("row", "col", cls), cells, factor, cls)


def on_heights(df: DataFrame, keys: list[str], height: str, value: str, at: list[float], hold: bool) -> DataFrame:
    """keys, i, height and value: each profile at the rising heights `at` (a few hundred at most), linear between its own, of equal heights the mean.

    Beyond its ends a profile keeps its end values, or (hold=False) has no rows.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(height).isNotNull()).groupBy(*keys, F.col(height).cast("double").alias("__h")).agg(F.avg(value).alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__h")
    seg = known.withColumn("__h2", F.lead("__h").over(w)).withColumn("__v2", F.lead("__v").over(w)).withColumn("__first", F.lag("__h").over(w).isNull())
    points = F.transform(F.array(*map(F.lit, at)), lambda z, i: F.struct(i.alias("i"), z.alias("z")))
    before = F.lit(hold) & F.col("__first")
    last = lambda z: F.col("__h2").isNull() & (F.lit(hold) | (z == F.col("__h")))
    inside = F.filter(points, lambda p: (before & (p["z"] < F.col("__h"))) | ((p["z"] >= F.col("__h")) & F.coalesce(p["z"] < F.col("__h2"), last(p["z"]))))
    d = seg.withColumn("__p", F.explode(inside))
    z = F.col("__p.z")
    v = F.when((z < F.col("__h")) | F.col("__h2").isNull(), F.col("__v")).otherwise(F.col("__v") + (F.col("__v2") - F.col("__v")) * (z - F.col("__h")) / (F.col("__h2") - F.col("__h")))
    return d.select(*keys, F.col("__p.i").alias("i"), z.alias(height), v.alias(value))


def profile_cluster(df: DataFrame, keys: list[str], height: str, value: str, n: int = 100, k: int = 3, components: int = 3, starts: int = 25, seed: int = 123) -> DataFrame:
    """K6. Profiles at n even heights from the lowest to the highest of all (ends held), as shares of their sums, scaled; their components; k-means, the best of `starts`.

    A cluster by profile, numbered by falling size. A profile without any density has shares of 0; a height at which all agree counts as 0.
    """
    ends = df.filter(F.col(value).isNotNull()).agg(F.min(height).cast("double"), F.max(height).cast("double")).first()  # two numbers
    if ends[0] is None:
        return df.select(*keys).limit(0).withColumn("cluster", F.lit(0))
    at = np.linspace(ends[0], ends[1], n).tolist()
    a = on_heights(df, keys, height, value, at, hold=True)
    wide = a.groupBy(*keys).agg(F.sum(value).alias("__sum"), *[F.max(F.when(F.col("i") == i, F.col(value))).alias(f"s{i}") for i in range(n)])
    share = wide.select(*keys, *[F.coalesce(F.col(f"s{i}") / F.nullif(F.col("__sum"), F.lit(0.0)), F.lit(0.0)).alias(f"s{i}") for i in range(n)])
    x = cut(share)
    x = VectorAssembler(inputCols=[f"s{i}" for i in range(n)], outputCol="__raw").transform(x)
    x = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True).fit(x).transform(x)
    x = PCA(k=components, inputCol="__x", outputCol="__pc").fit(x).transform(x)
    pcs = cut(x.select(*keys, vector_to_array("__pc").alias("__a")))
    x = pcs.withColumn("__pc", array_to_vector("__a")).drop("__a")
    best = min((KMeans(k=k, featuresCol="__pc", predictionCol="__k", seed=seed + i).fit(x) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    out = best.transform(x)
    size = out.groupBy("__k").agg(F.count("*").alias("__n")).withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("__n"), "__k")))  # k rows
    return out.join(F.broadcast(size), "__k").select(*keys, "cluster")


def mean_profiles(pad: DataFrame, cls: str = "class", height: str = "height_m", value: str = "pad") -> DataFrame:
    """K7. Mean density by class and height, and class 0 for all, up to the tallest bin with any."""
    each = pad.groupBy(cls, height).agg(F.avg(value).alias(value))
    all_ = pad.groupBy(height).agg(F.avg(value).alias(value)).select(F.lit(0).cast(pad.schema[cls].dataType).alias(cls), height, value)
    out = each.unionByName(all_)
    top = out.filter(F.col(value) > 0).groupBy(cls).agg(F.max(height).alias("__t"))
    return out.join(F.broadcast(top), cls).filter(F.col(height) <= F.col("__t")).drop("__t")


def profile_bands(df: DataFrame, height: str, value: str) -> DataFrame:
    """K8. Mean and the 0.1 and 0.9 quantiles by height."""
    return df.groupBy(height).agg(F.avg(value).alias("mean"), pct(value, 0.1).alias("q10"), pct(value, 0.9).alias("q90"))


def penalised_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, knots: int = 20) -> np.ndarray:
    """A cubic B-spline with a second-difference penalty; the penalty by generalised cross-validation over a grid."""
    lo, hi = float(x.min()), float(x.max())
    if len(x) < 4 or hi <= lo:
        return np.interp(at, x, y)
    m = min(knots, max(4, len(x) // 2))
    step = (hi - lo) / m
    t = lo + step * np.arange(-3, m + 4)

    def basis(z: np.ndarray) -> np.ndarray:
        b = ((z[:, None] >= t[:-1]) & (z[:, None] < t[1:])).astype(float)
        b[z >= hi] = 0
        b[z >= hi, m + 2] = 1
        for d in range(1, 4):
            b = (z[:, None] - t[: len(t) - 1 - d]) / (d * step) * b[:, :-1] + (t[d + 1 :] - z[:, None]) / (d * step) * b[:, 1:]
        return b

    b = basis(x)
    pen = np.diff(np.eye(b.shape[1]), 2, axis=0)
    best = None
    for lam in 10.0 ** np.arange(-6, 5, 0.5):
        inv = np.linalg.pinv(b.T @ b + lam * pen.T @ pen)
        fit = inv @ (b.T @ y)
        edf = np.trace(b @ inv @ b.T)
        score = len(x) * np.sum((y - b @ fit) ** 2) / max(len(x) - edf, 1e-6) ** 2
        if best is None or score < best[0]:
            best = (score, fit)
    return basis(np.clip(at, lo, hi)) @ best[1]


def smooth_profile(df: DataFrame, cls: str = "class", height: str = "height_m", value: str = "pad", step: float = 0.01) -> DataFrame:
    """K9. A smoother of sqrt(density) on height by class, every `step`, not below 0, squared. A group is one aggregated profile."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values(height)
        if not len(p):
            return pd.DataFrame({cls: [], height: [], value: []})
        x = p[height].to_numpy(float)
        at = np.round(np.arange(x.min(), x.max() + step / 2, step), 6)
        y = penalised_spline(x, np.sqrt(np.maximum(p[value].to_numpy(float), 0)), at)
        return pd.DataFrame({cls: p[cls].iloc[0], height: at, value: np.maximum(y, 0) ** 2})

    return df.select(cls, height, value).groupBy(cls).applyInPandas(run, f"{cls} {df.schema[cls].dataType.simpleString()}, {height} double, {value} double")


def extrema(df: DataFrame, cls: str = "class", height: str = "height_m", value: str = "pad") -> DataFrame:
    """K10. Points where the slope's sign turns: "peak" or "trough"; flats take the sign before, else after; a ground peak if the profile falls at once."""
    w = Window.partitionBy(cls).orderBy(height)
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = df.withColumn("__s", F.signum(F.lead(value).over(w) - F.col(value)))  # the slope that leaves the point
    d = d.withColumn("__s", F.when(F.col("__s") != 0, F.col("__s")))
    d = d.withColumn("__s", F.coalesce(F.last("__s", True).over(past), F.first("__s", True).over(ahead)))
    d = d.withColumn("__n", F.lead(value).over(w)).withColumn("__before", F.lag("__s").over(w))
    kind = F.when(F.col("__n").isNull(), None).when(F.col("__before").isNull() & (F.col("__s") < 0), "peak").when((F.col("__before") > 0) & (F.col("__s") < 0), "peak").when((F.col("__before") < 0) & (F.col("__s") > 0), "trough")
    return d.withColumn("kind", kind).filter("kind is not null").select(cls, height, value, "kind")


def prominence(ext: DataFrame, profile: DataFrame, dz: float, cls: str = "class", height: str = "height_m", value: str = "pad", least: float = 0.2) -> DataFrame:
    """K11. The smaller contrast with both neighbours in percent of the greatest density from dz up; those of `least` or more stay."""
    w = Window.partitionBy(cls).orderBy(height)
    top = profile.filter(F.col(height) >= dz).groupBy(cls).agg(F.max(value).alias("__top"))
    a, b = F.abs(F.col(value) - F.lag(value).over(w)), F.abs(F.col(value) - F.lead(value).over(w))
    d = ext.withColumn("__c", F.least(F.coalesce(a, b), F.coalesce(b, a)))
    return d.join(F.broadcast(top), cls).withColumn("prominence", 100 * F.col("__c") / F.col("__top")).filter(F.col("prominence") >= least).drop("__c", "__top")


def anchors(ext: DataFrame, profile: DataFrame, cls: str = "class", height: str = "height_m") -> DataFrame:
    """K12. Centres "dense" (peaks) and "open" (troughs), a dense one on the ground and an open one on top if the last is not open."""
    base = ext.select(cls, F.col(height).alias("centre_height"), F.when(F.col("kind") == "peak", "dense").otherwise("open").alias("type"))
    ends = profile.groupBy(cls).agg(F.min(height).alias("lo"), F.max(height).alias("hi"))
    first = base.groupBy(cls).agg(F.min_by("type", "centre_height").alias("t0"), F.max_by("type", "centre_height").alias("t1"), F.min("centre_height").alias("c0"))
    e = ends.join(first, cls, "left")
    ground = e.filter("t0 is null or t0 <> 'dense' or c0 > lo").filter("t0 is null or t0 <> 'dense'").select(cls, F.col("lo").alias("centre_height"), F.lit("dense").alias("type"))
    top = e.filter("t1 is null or t1 <> 'open'").select(cls, F.col("hi").alias("centre_height"), F.lit("open").alias("type"))
    return base.unionByName(ground).unionByName(top)


def gradient(df: DataFrame, cls: str = "class", height: str = "height_m", value: str = "pad") -> DataFrame:
    """K13. Centred difference, one-sided at the ends."""
    w = Window.partitionBy(cls).orderBy(height)
    v0, v1 = F.coalesce(F.lag(value).over(w), F.col(value)), F.coalesce(F.lead(value).over(w), F.col(value))
    h0, h1 = F.coalesce(F.lag(height).over(w), F.col(height)), F.coalesce(F.lead(height).over(w), F.col(height))
    return df.withColumn("slope", (v1 - v0) / F.nullif(h1 - h0, F.lit(0.0)))


def boundaries(centres: DataFrame, slopes: DataFrame, cls: str = "class", height: str = "height_m") -> DataFrame:
    """K14. The boundary above each centre but the last: for the first, the first point past the steepest with a slope of a tenth
    of it or less (else the weakest); for others the steepest point up to the next centre."""
    w = Window.partitionBy(cls).orderBy("centre_height")
    c = centres.withColumn("zone", F.row_number().over(w)).withColumn("__to", F.lead("centre_height").over(w)).filter("__to is not null")
    pts = c.join(slopes.select(F.col(cls).alias("__k"), F.col(height).alias("h"), F.abs("slope").alias("s")), (F.col(cls) == F.col("__k")) & F.col("h").between(F.col("centre_height"), F.col("__to"))).drop("__k")
    zone = Window.partitionBy(cls, "zone")
    pts = pts.withColumn("__steep", F.max("s").over(zone))
    pts = pts.withColumn("__at", F.min(F.when(F.col("s") == F.col("__steep"), F.col("h"))).over(zone))
    past = F.min(F.when((F.col("h") > F.col("__at")) & (F.col("s") <= 0.1 * F.col("__steep")), F.col("h")))
    weak = F.min_by("h", F.struct(F.when(F.col("h") > F.col("__at"), F.col("s")).otherwise(F.lit(float("inf"))), F.col("h")))
    return pts.groupBy(cls, "zone").agg(past.alias("__p"), weak.alias("__w"), F.first("__at").alias("__a")).select(cls, "zone", F.when(F.col("zone") == 1, F.coalesce("__p", "__w")).otherwise(F.col("__a")).alias("boundary"))


def zones(centres: DataFrame, bounds: DataFrame, profile: DataFrame, dz: float, cls: str = "class", height: str = "height_m") -> DataFrame:
    """K15. zone, type, centre, start and end, ends snapped to dz (half to even); a centre on the very top is NULL."""
    w = Window.partitionBy(cls).orderBy("centre_height")
    top = profile.groupBy(cls).agg(F.max(height).alias("__top"))
    z = centres.withColumn("zone", F.row_number().over(w)).join(bounds, [cls, "zone"], "left").join(F.broadcast(top), cls)
    snap = lambda c: F.bround(c / dz) * dz
    start = F.coalesce(F.lag("boundary").over(Window.partitionBy(cls).orderBy("zone")), F.lit(0.0))
    return z.select(cls, "zone", "type", F.when(F.col("centre_height") < F.col("__top"), F.col("centre_height")).alias("centre_height"), snap(start).alias("zone_start"), snap(F.coalesce("boundary", "__top")).alias("zone_end"))


def zone_points(zone: DataFrame, profile: DataFrame, cls: str = "class", height: str = "height_m", value: str = "pad") -> DataFrame:
    """K16. The inner boundaries with the density there."""
    b = zone.select(cls, F.explode(F.array("zone_start", "zone_end")).alias(height)).distinct()
    w = Window.partitionBy(cls)
    inner = b.withColumn("__lo", F.min(height).over(w)).withColumn("__hi", F.max(height).over(w)).filter((F.col(height) > F.col("__lo")) & (F.col(height) < F.col("__hi"))).drop("__lo", "__hi")
    return inner.join(profile.select(cls, height, value), [cls, height], "left")


def inflections(df: DataFrame, keys: list[str], height: str, value: str, step: float = 0.05, knots: int = 20, q: float = 0.2) -> DataFrame:
    """K17. Heights where density falls off most: strict minima of the slope under its q quantile, the density there, and the greatest height of all profiles.

    Profiles are taken at the heights of the longest one (most heights; of equals the first by keys), only where all have a value. Their mean is one
    profile; a penalised spline of it, every `step`, gives the slopes.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(height).isNotNull())
    sizes = known.groupBy(*keys).agg(F.count_distinct(height).alias("__n"), F.sort_array(F.collect_set(F.col(height).cast("double"))).alias("__z"))
    longest = sizes.orderBy(F.desc("__n"), *keys).limit(1).collect()  # one profile's heights
    at = longest[0]["__z"] if longest else [0.0]
    many = sizes.count()
    each = on_heights(known, keys, height, value, at, hold=False)
    mean = each.groupBy(height).agg(F.avg(value).alias(value), F.count("*").alias("__k")).filter(F.col("__k") == many).select(F.lit(0).alias("class"), height, value)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x, y, s = smooth_map(p[height].to_numpy(float), p[value].to_numpy(float), knots)
        z = np.arange(p[height].min(), p[height].max() + step * 1e-6, step)
        i = np.clip(np.searchsorted(x, z, side="right") - 1, 0, len(x) - 2)
        h, t, u = x[i + 1] - x[i], x[i + 1] - z, z - x[i]
        return pd.DataFrame({"class": 0, height: z, value: (t * y[i] + u * y[i + 1]) / h + (t**3 / h - h * t) * s[i] / 6 + (u**3 / h - h * u) * s[i + 1] / 6})

    w = Window.partitionBy("class").orderBy(height)  # one smoothed profile
    d = mean.groupBy("class").applyInPandas(run, f"class int, {height} double, {value} double").withColumn("slope", (F.col(value) - F.lag(value).over(w)) / step)
    d = d.withColumn("__a", F.lag("slope").over(w)).withColumn("__b", F.lead("slope").over(w))
    low = d.agg(pct("slope", q).alias("__q"))
    top = known.agg(F.max(height).cast("double").alias("max_height"))
    out = d.join(F.broadcast(low), how="cross").filter("slope < __a and slope < __b and slope < __q")
    return out.join(F.broadcast(top), how="cross").select(F.col(height).alias("inflection"), F.col(value).alias("density"), "max_height")  # one row each
