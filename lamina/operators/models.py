"""Distinctness, warming, regression and the block bootstrap (M)."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pct
from ..sources.checkpoints import cut
from .daily import in_strata
from .grid import cell_xy
from .points import stratum_pai


def global_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """M1. One row: pooled mean and sd of each column."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


def zscore(df: DataFrame, scale: DataFrame, cols: list[str]) -> DataFrame:
    """M2. (x - mean) / sd by the one row of M1."""
    return df.join(F.broadcast(scale), how="cross").withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0)) for c in cols}).select(*df.columns)


def climate_distinctness(df: DataFrame, keys: list[str], cols: list[str], height: str = "height_m") -> DataFrame:
    """M3. Mean and sd of the Euclidean distances between all pairs of a key's heights with complete variables; NULL with fewer than 2.

    One aggregation: a key's complete heights (some hundred at most) are an array in order, pairs are taken inside it. Equal heights are no pair.
    """
    whole = F.col(height).isNotNull() & F.coalesce(*[F.when(F.col(c).isNull(), F.lit(False)) for c in cols], F.lit(True))
    row = F.struct(F.col(height).alias("h"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    d = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(whole, row))).alias("__a"))
    apart = lambda a, b: F.sqrt(sum(((a[f"v{i}"] - b[f"v{i}"]) ** 2 for i in range(len(cols))), F.lit(0.0)))
    later = lambda a, i: F.filter(F.slice("__a", i + 2, F.size("__a")), lambda b: b["h"] > a["h"])
    d = d.withColumn("__d", F.flatten(F.transform("__a", lambda a, i: F.transform(later(a, i), lambda b: apart(a, b)))))
    total = lambda f: F.aggregate("__d", F.lit(0.0), lambda s, x: s + f(x))
    n = F.size("__d")
    d = d.withColumn("mean", F.when(n > 0, total(lambda x: x) / n))
    return d.select(*keys, "mean", F.when(n > 1, F.sqrt(total(lambda x: (x - F.col("mean")) ** 2) / (n - 1))).alias("sd"))


def distinctness_by_zone(df: DataFrame, strata: DataFrame, classes: DataFrame, keys: list[str], cols: list[str], cell: str = "cell", height: str = "height_m") -> DataFrame:
    """M4. M3 inside each class's strata, for the cells of that class."""
    own = in_strata(df, strata, height).join(classes.select(cell, "class"), [cell, "class"])
    return climate_distinctness(own, [*keys, "class", "zone"], cols, height)


def distinctness_mean(df: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """M5. Mean over years."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def zone_year_mean(df: DataFrame, strata: DataFrame, classes: DataFrame, dist: DataFrame | None = None, value: str = "tmax_mean", cell: str = "cell", year: str = "year", height: str = "height_m") -> DataFrame:
    """M6. Mean over the heights of a zone by cell and year, for the cells of its class, with the mean distinctness."""
    own = in_strata(df, strata, height).join(classes.select(cell, "class"), [cell, "class"]).groupBy(cell, "class", "zone", year).agg(F.avg(value).alias("mean"))
    return own if dist is None else own.join(dist, [cell, "class", "zone"], "left")


def warming_slope(df: DataFrame, keys: list[str], value: str = "mean", year: str = "year") -> DataFrame:
    """M7. Slope on year by key with more than one distinct year."""
    ok = df.filter(F.col(value).isNotNull() & F.col(year).isNotNull())
    return ok.groupBy(*keys).agg(F.regr_slope(F.col(value), F.col(year)).alias("estimate"), F.count_distinct(year).alias("__k")).filter("__k > 1").drop("__k")


def slope_summary(df: DataFrame, keys: list[str], value: str = "estimate", dist: str | None = None, site: str | None = None, zone: str | None = None) -> DataFrame:
    """M8. Median and quartiles of the slopes, per decade too, n and sites; a zone "a-bm" gets its midpoint."""
    aggs = [pct(value, 0.5).alias("median"), pct(value, 0.25).alias("q25"), pct(value, 0.75).alias("q75"), F.count(value).alias("n"), (10 * pct(value, 0.5)).alias("per_decade")]
    aggs += [pct(dist, 0.5).alias("dist_median")] if dist else []
    aggs += [F.count_distinct(site).alias("sites")] if site else []
    out = df.groupBy(*keys).agg(*aggs)
    if zone:
        a, b = (F.regexp_extract(zone, r"([0-9.]+)-([0-9.]+)m", i).try_cast("double") for i in (1, 2))
        out = out.withColumn("midpoint", (a + b) / 2)
    return out


def top_n(df: DataFrame, by: str, n: int = 12, ties: tuple[str, ...] = ()) -> DataFrame:
    """M9. The n highest rows."""
    return df.orderBy(F.desc(by), *ties).limit(n)


def log_trend(df: DataFrame, y: str, x: str, points: int = 50) -> DataFrame:
    """M10. The line of y on log10 x and its standard-error band at even places of log10 x."""
    lx = F.log10(x)
    d = df.filter((F.col(x) > 0) & F.col(y).isNotNull())
    f = d.agg(F.regr_slope(F.col(y), lx).alias("b"), F.regr_intercept(F.col(y), lx).alias("a"), F.regr_sxx(F.col(y), lx).alias("sxx"), F.regr_syy(F.col(y), lx).alias("syy"), F.regr_sxy(F.col(y), lx).alias("sxy"), F.count("*").alias("n"), F.avg(lx).alias("mx"), F.min(lx).alias("lo"), F.max(lx).alias("hi"))
    out = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("lx", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    s2 = (F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")) / (F.col("n") - 2)
    fit, se = F.col("a") + F.col("b") * F.col("lx"), F.sqrt(s2 * (1 / F.col("n") + (F.col("lx") - F.col("mx")) ** 2 / F.col("sxx")))
    return out.select(F.pow(F.lit(10.0), "lx").alias(x), fit.alias("fit"), (fit - 1.96 * se).alias("lower"), (fit + 1.96 * se).alias("upper"))


def prepare(df: DataFrame, positive: list[str], cls: str, zone: str, logged: str) -> tuple[DataFrame, DataFrame]:
    """M11. (rows, counts kept and excluded): finite and positive rows, a combined key, the centred log10 of a column."""
    ok = F.lit(True)
    for c in positive:
        ok &= F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(c), F.lit(False))
    counts = df.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("excluded"))
    out = df.filter(ok).withColumn("class_zone", F.concat_ws(":", cls, zone))
    mean = out.agg(F.avg(F.log10(logged)).alias("__m"))
    return out.join(F.broadcast(mean), how="cross").withColumn(f"log_{logged}", F.log10(logged) - F.col("__m")).drop("__m"), counts


def validate(df: DataFrame, keys: list[str], need: list[str], factors: list[str] = (), numbers: list[str] = (), xy: tuple[str, str] | None = None, cell: list[str] = ()) -> None:
    """M12. Raise on missing columns, duplicate keys, a factor of one level, a number without variation, a cell at two places or two cells at one."""
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if df.groupBy(*keys).count().filter("count > 1").take(1):
        raise ValueError("duplicate keys")
    got = df.agg(*[F.count_distinct(f).alias(f"f_{f}") for f in factors], *[(F.max(n) - F.min(n)).alias(f"n_{n}") for n in numbers]).first() if factors or numbers else None
    for f in factors:
        if got[f"f_{f}"] < 2:
            raise ValueError(f"fewer than two levels: {f}")
    for n in numbers:
        if not got[f"n_{n}"]:
            raise ValueError(f"no variation: {n}")
    if xy:
        at = df.select(*cell, *xy).distinct()
        if at.groupBy(*cell).count().filter("count > 1").take(1) or at.groupBy(*[c for c in cell[:-1]], *xy).count().filter("count > 1").take(1):
            raise ValueError("coordinates are not one to one with cells")


def pair_pai_response(pad: DataFrame, strata: DataFrame, response: DataFrame, grids: DataFrame, dz: float, var: str = "var", site: str = "site", cell: str = "cell") -> DataFrame:
    """M13. Per site, cell and stratum: its PAI, the total PAI, a positive response, and place in km."""
    s = stratum_pai(pad, strata, dz, keys=(site, cell))
    total = pad.groupBy(site, cell).agg((F.sum("pad") * dz).alias("pai_total"))
    out = s.join(total, [site, cell]).join(response.filter(F.col(var) > 0), [site, cell])
    return cell_xy(out, grids, cell, site).drop("row", "col", "x", "y")


class Fit:
    """An OLS fit: names, coefficients (NaN for aliased columns), (X'X)^-1 of those kept, rss, tss, n."""

    def __init__(self, names, coef, inv, kept, rss, tss, n):
        self.names, self.coef, self.inv, self.kept, self.rss, self.tss, self.n = names, coef, inv, kept, rss, tss, n

    @property
    def rank(self) -> int:
        return len(self.kept)


def design(df: DataFrame, terms: list[tuple[str, ...]], factors: list[str]) -> tuple[list[str], list[Column]]:
    """Names and columns of a design: an intercept, and each term as the product of its parts. A factor's first level is left out of
    its main effect; a product with a factor has a column for each level where the number itself is no term (class-specific slopes)."""
    levels = {f: sorted(r[0] for r in df.select(f).distinct().collect()) for f in factors}  # few levels
    names, cols = ["(intercept)"], [F.lit(1.0)]
    single = {t[0] for t in terms if len(t) == 1}
    for t in terms:
        parts: list[tuple[str, Column]] = [("", F.lit(1.0))]
        for v in t:
            if v in factors:
                use = levels[v][1:] if len(t) == 1 or any(x in single for x in t if x not in factors) or all(x in factors for x in t) else levels[v]
                options = [(f"{v}={x}", F.when(F.col(v) == x, 1.0).otherwise(0.0)) for x in use]
            else:
                options = [(v, F.col(v).cast("double"))]
            parts = [(f"{a}:{b}".strip(":"), c * d) for a, c in parts for b, d in options]
        names += [n for n, _ in parts]
        cols += [c for _, c in parts]
    return names, cols


def ols(df: DataFrame, y: str, terms: list[tuple[str, ...]], factors: list[str] = ()) -> Fit:
    """M14. OLS from the Gram matrix, which one aggregation makes; aliased columns drop out. Numbers are best centred before."""
    names, cols = design(df, terms, list(factors))
    d = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], F.col(y).cast("double").alias("y")).dropna()
    p = len(cols)
    aggs = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)] + [F.sum(F.col(f"x{i}") * F.col("y")) for i in range(p)] + [F.sum(F.col("y") ** 2), F.count("*"), F.sum("y")]
    row = list(d.agg(*[a.alias(f"s{i}") for i, a in enumerate(aggs)]).first())  # p (p + 5) / 2 numbers
    if not row[-2]:
        return Fit(names, np.full(p, np.nan), np.zeros((0, 0)), [], 0.0, 0.0, 0)
    g = np.zeros((p, p))
    k = 0
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = row[k]
            k += 1
    b, yy, n, sy = np.array(row[k : k + p], float), row[-3], row[-2], row[-1]
    return solve(names, g, b, yy, n, yy - sy * sy / n)


def solve(names: list[str], g: np.ndarray, b: np.ndarray, yy: float, n: int, tss: float) -> Fit:
    """OLS from sums; columns that depend on earlier ones are left out."""
    kept: list[int] = []
    for i in range(len(b)):
        if g[i, i] <= 0:
            continue
        if kept:
            a = g[np.ix_(kept, kept)]
            rest = g[i, i] - g[i, kept] @ np.linalg.pinv(a) @ g[kept, i]
            if rest <= 1e-9 * g[i, i]:
                continue
        kept.append(i)
    inv = np.linalg.inv(g[np.ix_(kept, kept)])
    coef = np.full(len(b), np.nan)
    coef[kept] = inv @ b[kept]
    return Fit(names, coef, inv, kept, float(max(yy - coef[kept] @ b[kept], 0.0)), float(tss), int(n))


def model_table(spark, fits: dict[str, Fit], base: str) -> DataFrame:
    """M15. n, R2, adjusted R2, RSS, residual df, AIC, and differences to the best AIC and to a base's R2."""
    rows = []
    for name, f in fits.items():
        df, r2 = f.n - f.rank, 1 - f.rss / f.tss if f.tss else float("nan")
        rows.append((name, f.n, r2, 1 - (1 - r2) * (f.n - 1) / df if df > 0 else float("nan"), f.rss, df, f.n * (math.log(2 * math.pi * max(f.rss, 1e-300) / f.n) + 1) + 2 * (f.rank + 1) if f.n else float("nan")))
    out = spark.createDataFrame(rows, "model string, n long, r2 double, adj_r2 double, rss double, df long, aic double")
    best, ref = min(r[6] for r in rows), next(r[2] for r in rows if r[0] == base)
    return out.withColumn("delta_aic", F.col("aic") - best).withColumn("delta_r2", F.col("r2") - ref)


def residuals(df: DataFrame, fit: Fit, y: str, terms: list[tuple[str, ...]], factors: list[str] = ()) -> DataFrame:
    """M16. Fitted, residual and standardised residual (by leverage); the small matrices are literals."""
    _, cols = design(df, terms, list(factors))
    fitted = sum((cols[i] * float(fit.coef[i]) for i in fit.kept), F.lit(0.0))
    lev = sum((cols[i] * cols[j] * float(fit.inv[a, b]) for a, i in enumerate(fit.kept) for b, j in enumerate(fit.kept)), F.lit(0.0))
    s2 = fit.rss / max(fit.n - fit.rank, 1)
    out = df.withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted"))
    return out.withColumn("standardised", F.col("residual") / F.sqrt(F.lit(s2) * F.greatest(1 - lev, F.lit(1e-12))))


def inverse_normal(p: Column) -> Column:
    """The normal quantile by Acklam's rational approximation (1e-9)."""
    # fixed values
    a = (-39.6968302866538, 220.946098424521, -275.928510446969, 138.357751867269, -30.6647980661472, 2.50662827745924)
    b = (-54.4760987982241, 161.585836858041, -155.698979859887, 66.8013118877197, -13.2806815528857)
    c = (-0.00778489400243029, -0.322396458041136, -2.40075827716184, -2.54973253934373, 4.37466414146497, 2.93816398269878)
    d = (0.00778469570904146, 0.32246712907004, 2.445134137143, 3.75440866190742)

    def poly(cs, x):
        out = F.lit(cs[0])
        for v in cs[1:]:
            out = out * x + v
        return out

    q = p - 0.5
    mid = q * poly(a, q * q) / poly((*b, 1.0), q * q)
    tail = lambda x: poly(c, x) / poly((*d, 1.0), x)
    return F.when(p < 0.02425, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(mid)


def global_ranks(df: DataFrame, value: str, group: str, rank: str = "rank", size: str = "size") -> DataFrame:
    """group and value of the rows with a value, with their rank (from 1, ties in some order) and number in the group.

    Rows are sorted by range over many tasks, also those of one group or one value; a task ranks its own, and sums over
    the tasks before it are added. No window holds a group.
    """
    rows = df.filter(F.col(value).isNotNull()).select(group, value).withColumn("__id", F.monotonically_increasing_id())
    parts = cut(rows.repartitionByRange(group, value, "__id").withColumn("__p", F.spark_partition_id()))
    counts = parts.groupBy(group, "__p").agg(F.count("*").alias("__k"))  # a row a group and task
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("__k").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), before.alias("__before"), F.sum("__k").over(w).alias(size))
    own = F.row_number().over(Window.partitionBy(group, "__p").orderBy(value, "__id"))
    out = parts.withColumn(rank, own).join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return out.select(group, value, (F.col(rank) + F.col("__before")).alias(rank), size)


def qq_points(df: DataFrame, value: str, group: str) -> DataFrame:
    """M17. Ordered values of each group against normal quantiles at (rank - 0.5) / n."""
    return global_ranks(df, value, group).select(group, value, inverse_normal((F.col("rank") - 0.5) / F.col("size")).alias("theoretical"))


def variogram(df: DataFrame, groups: list[str], x: str, y: str, value: str, cutoff: float = 0.5, width: float = 0.01, cap: int | None = None, seed: int = 1) -> DataFrame:
    """M18. Semivariance by distance bin over all pairs of a group's points that are at most `cutoff` apart; repeated points are points of their own.

    Points meet by buckets of half the cutoff's side: each bucket its own pairs in order of a row number, and the twelve buckets around it that lie ahead,
    so a pair is made once. AQE splits full buckets; bins are summed before the shuffle. With cap, at most so many points a group, by a hash.
    """
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull()).select(*groups, x, y, value)
    if cap is not None:
        w = Window.partitionBy(*groups).orderBy(F.xxhash64(x, y, value, F.lit(seed)), x, y, value)
        known = known.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= cap).drop("__i")
    side = cutoff / 2
    d = cut(known.withColumn("__i", F.monotonically_increasing_id()).withColumn("__bx", F.floor(F.col(x) / side)).withColumn("__by", F.floor(F.col(y) / side)))
    other = d.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("__i").alias("__j"), F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(value).alias("__v"), F.col("__bx").alias("__cx"), F.col("__by").alias("__cy"))
    ahead = [(a, b) for a in range(3) for b in range(-2, 3) if a > 0 or b >= 0]
    near = d.withColumn("__o", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ahead])))
    near = near.withColumn("__tx", F.col("__bx") + F.col("__o.a")).withColumn("__ty", F.col("__by") + F.col("__o.b"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    dx, dy, dv = F.col(x) - F.col("__x"), F.col(y) - F.col("__y"), F.col(value) - F.col("__v")
    pairs = near.join(other, [*same, F.col("__tx") == F.col("__cx"), F.col("__ty") == F.col("__cy")])
    pairs = pairs.filter((F.col("__o.a") > 0) | (F.col("__o.b") > 0) | (F.col("__i") < F.col("__j"))).withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= cutoff)
    return pairs.groupBy(*groups, F.floor(F.col("dist") / width).cast("int").alias("bin")).agg(F.avg("dist").alias("dist"), (F.avg(dv * dv) / 2).alias("gamma"), F.count("*").alias("pairs"))


def assign_blocks(df: DataFrame, size: float, x: str = "x_km", y: str = "y_km", site: str = "site", check: bool = False) -> DataFrame:
    """M19. Square blocks by site with a dense number; check: an error unless every site has 2 or more."""
    d = df.withColumn("__bx", F.floor(F.col(x) / size)).withColumn("__by", F.floor(F.col(y) / size))
    ids = d.select(site, "__bx", "__by").distinct().withColumn("block", F.dense_rank().over(Window.partitionBy(site).orderBy("__bx", "__by")).cast("int"))
    if check and ids.groupBy(site).count().filter("count < 2").take(1):
        raise ValueError("a site has fewer than two blocks")
    return d.join(ids, [site, "__bx", "__by"]).drop("__bx", "__by")


def block_sums(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """M20. n, sx, sy, sxx, sxy and syy by block and group."""
    a, b = F.col(x), F.col(y)
    return df.filter(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"))


SUMS = ("n", "sx", "sy", "sxx", "sxy", "syy")


def fit_from_sums(sums: DataFrame, group: str, by: list[str]) -> DataFrame:
    """M21. Exact group intercepts and slopes from sums, for each `by`; NULL where a group's x does not vary."""
    g = sums.groupBy(*by, group).agg(*[F.sum(s).alias(s) for s in SUMS])
    d = F.col("sxx") - F.col("sx") ** 2 / F.col("n")
    slope = F.when(d > 1e-9 * F.greatest(F.col("sxx"), F.lit(1e-300)), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / d)
    return g.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).select(*by, group, "n", "intercept", "slope")


def within_slope(sums: DataFrame, group: str, by: list[str]) -> DataFrame:
    """M22. The common slope within groups, from sums."""
    g = sums.groupBy(*by, group).agg(*[F.sum(s).alias(s) for s in SUMS]).filter("n > 0")
    top, low = F.sum(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")), F.sum(F.col("sxx") - F.col("sx") ** 2 / F.col("n"))
    return (g.groupBy(*by) if by else g.groupBy()).agg((top / F.nullif(low, F.lit(0.0))).alias("slope"))


def packed_blocks(sums: DataFrame, group: str, site: str = "site") -> DataFrame:
    """site, blocks (their number) and sums: one row a site, an entry for each of its blocks and groups."""
    entry = F.struct(F.col("block").cast("int").alias("block"), F.col(group).alias("g"), *[F.col(c).cast("double").alias(c) for c in SUMS[:5]])
    return sums.groupBy(site).agg(F.max("block").cast("int").alias("blocks"), F.sort_array(F.collect_list(entry)).alias("sums"))


def slots(start: np.ndarray, n: int) -> np.ndarray:
    """For each start (the first 32 bits of the MD5 of `seed:b:site`) n draws from 0..n-1: start + j * 2654435769 for j = 1..n, mixed by two rounds of shifted XOR and multiplication modulo 2^32."""
    x = (start.astype(np.int64)[:, None] + np.arange(1, n + 1) * 2654435769) & 0xFFFFFFFF
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73244475) & 0xFFFFFFFF
    return (x ^ (x >> 16)) % n


def block_bootstrap(sums: DataFrame, group: str, replicates: int = 4999, seed: int = 123, site: str = "site", chunk: int = 250) -> DataFrame:
    """M23. The within slope of each replicate of resampled blocks; an error if one cannot be estimated.

    In each site as many blocks are drawn as it has, with replacement (`slots`). A site's block sums
    are one row; for each `chunk` of replicates the numbers of draws are a matrix of weights, and its product with the sums gives the replicates' sums by
    group. So no row is made for a draw, and sites and chunks are spread over tasks.
    """
    kind = sums.schema[group].dataType.simpleString()
    first = F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(chunk)))
    work = packed_blocks(sums, group, site).select(F.col(site).cast("string").alias("site"), "blocks", "sums", first.alias("first")).repartition("site", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, n, begin, entries = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(3)[k].as_py(), batch.column(2).slice(k, 1).flatten()
                groups = entries.field("g").dictionary_encode(null_encoding="encode")
                at, many = groups.indices.to_numpy(), len(groups.dictionary)
                table = np.zeros((n, many, 5))
                for c, s in enumerate(SUMS[:5]):
                    table[entries.field("block").to_numpy() - 1, at, c] = entries.field(s).to_numpy()
                reps = range(begin, min(begin + chunk, replicates + 1))
                drawn = slots(np.array([int(hashlib.md5(f"{seed}:{b}:{name}".encode()).hexdigest()[:8], 16) for b in reps]), n)
                weights = np.bincount((drawn + n * np.arange(len(reps))[:, None]).reshape(-1), minlength=n * len(reps)).reshape(len(reps), n).astype(float)
                total = (weights @ table.reshape(n, -1)).reshape(len(reps), many, 5)
                out = {"b": pa.array(np.repeat(np.array(reps, np.int32), many)), group: groups.dictionary.take(pa.array(np.tile(np.arange(many), len(reps))))}
                yield pa.RecordBatch.from_pydict(out | {s: pa.array(np.ascontiguousarray(total[:, :, c]).reshape(-1)) for c, s in enumerate(SUMS[:5])})

    drawn = work.mapInArrow(run, f"b int, {group} {kind}, " + ", ".join(f"{s} double" for s in SUMS[:5]))
    out = within_slope(drawn.withColumn("syy", F.lit(None).cast("double")), group, ["b"])
    return out.withColumn("slope", F.when(F.col("slope").isNotNull(), F.col("slope")).otherwise(F.raise_error(F.lit("a draw cannot be estimated")).cast("double")))


def bootstrap_sizes(df: DataFrame, sizes: tuple[float, ...], x: str, y: str, group: str, replicates: int = 4999, seed: int = 123, site: str = "site") -> DataFrame:
    """M23 for several block sizes (km): block_size, b and slope. df has x_km and y_km."""
    parts = [block_bootstrap(block_sums(assign_blocks(df, size, site=site), x, y, [site, "block", group]), group, replicates, seed, site).withColumn("block_size", F.lit(size)) for size in sizes]
    return functools.reduce(DataFrame.unionByName, parts).select("block_size", "b", "slope")


def bootstrap_ci(draws: DataFrame, value: str = "slope", by: list[str] = ()) -> DataFrame:
    """M24. 0.025 and 0.975 quantiles, per decade, and as percent change."""
    lo, hi = pct(value, 0.025), pct(value, 0.975)
    aggs = [lo.alias("lower"), hi.alias("upper"), (10 * lo).alias("lower_decade"), (10 * hi).alias("upper_decade"), (100 * F.expm1(lo)).alias("lower_percent"), (100 * F.expm1(hi)).alias("upper_percent")]
    return draws.groupBy(*by).agg(*aggs) if by else draws.agg(*aggs)


def block_counts(df: DataFrame, site: str = "site", cell: str = "cell") -> DataFrame:
    """M25. Rows, cells and blocks by site."""
    return df.groupBy(site).agg(F.count("*").alias("rows"), F.count_distinct(cell).alias("cells"), F.count_distinct("block").alias("blocks"))


def check_reproduced(full: DataFrame, sums: DataFrame, key: str, values: list[str], tol: float = 1e-7) -> None:
    """M26. Raise unless both tables of estimates agree."""
    j = full.select(key, *[F.col(v).alias(f"__a_{v}") for v in values]).join(sums.select(key, *values), key, "full")
    off = F.lit(False)
    for v in values:
        off |= ~F.coalesce(F.abs(F.col(v) - F.col(f"__a_{v}")) <= tol * (1 + F.abs(F.col(v))), F.col(v).isNull() & F.col(f"__a_{v}").isNull())
    if j.filter(off).take(1):
        raise ValueError("block sums do not reproduce the fit")


def effect_scaling(effects: DataFrame, df: DataFrame, cls: str, predictor: str, effect: str = "slope") -> DataFrame:
    """M27. Effects times the interquartile range and the range of the predictor, per decade and per 20 years."""
    r = df.groupBy(cls).agg((pct(predictor, 0.75) - pct(predictor, 0.25)).alias("iqr"), (F.max(predictor) - F.min(predictor)).alias("span"))
    out = effects.join(r, cls, "left")
    return out.withColumns({f"{n}_{p}": F.col(effect) * F.col(n) * k for n in ("iqr", "span") for p, k in (("decade", 10), ("20y", 20))})


def class_structure_table(cells: DataFrame, zones: DataFrame, values: list[str], res: float, cls: str = "class", site: str = "site", digits: int = 2) -> DataFrame:
    """M28. Classes over all sites: area, zones, medians of cell values, weighted zone height, percent of the area; rounded.

    cells (site, class, values), side res in metres; zones (site, class, zone_start, zone_end). First by site and class: cells, hectares, number and mean height of zones and
    the median of each value. Then over sites: sums of cells and hectares, mean and sample sd of the others, and the zone heights weighted by the zones' number. Classes without zones
    have no zone columns.
    """
    per = cells.groupBy(site, cls).agg(F.count("*").alias("n_cells"), (F.count("*") * F.lit(res * res / 10000)).alias("area_ha"), *[pct(v, 0.5).alias(f"median_{v}") for v in values])
    strata = zones.groupBy(site, cls).agg(F.count("*").alias("n_zones"), F.avg(F.col("zone_end") - F.col("zone_start")).alias("zone_height"))
    per = per.join(strata, [site, cls], "left")
    both = [f(F.col(v)).alias(f"{n}_{v}") for v in ("n_zones", "zone_height", *[f"median_{v}" for v in values]) for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    weighted = F.sum(F.col("zone_height") * F.col("n_zones")) / F.nullif(F.sum("n_zones"), F.lit(0))
    out = per.groupBy(cls).agg(F.count("*").alias("n_sites"), F.sum("n_cells").alias("total_n_cells"), F.sum("area_ha").alias("total_area_ha"), *both, weighted.alias("weighted_mean_zone_height"), F.coalesce(F.sum("n_zones"), F.lit(0)).alias("total_zone_count"))
    out = out.withColumn("total_percent", 100 * F.col("total_area_ha") / F.sum("total_area_ha").over(Window.partitionBy(F.lit(0))))  # a row a class
    return out.withColumns({c: F.round(c, digits) for c, t in out.dtypes if t == "double" and c != cls})


def pooled_stats(df: DataFrame, metric: str, value: str, site: str) -> DataFrame:
    """M29. n, mean, sd, min, quantiles, max and sites by metric."""
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    q = F.percentile(value, list(qs))
    return df.groupBy(metric).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), *[q[i].alias(f"q{int(100 * x):02d}") for i, x in enumerate(qs)], F.max(value).alias("max"), F.count_distinct(site).alias("sites"))
