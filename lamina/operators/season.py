"""Seasonality and gap filling (T) on (cell, month or step) tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, pct

OMEGA = 2 * math.pi / 12


def scale_lai(df: DataFrame, value: str) -> DataFrame:
    """T1. NULL outside 0..100, else a tenth."""
    return df.withColumn(value, F.when(F.col(value).between(0, 100), F.col(value) * 0.1))


def lai_to_pai(df: DataFrame, value: str, cell: str = "cell", share: float = 0.2, back: bool = False) -> DataFrame:
    """T2. Plus (back: minus) a share of the cell's maximum over all months."""
    top = share * F.max(value).over(Window.partitionBy(cell))
    return df.withColumn(value, F.col(value) - top if back else F.col(value) + top)


def month_climatology(df: DataFrame, value: str, cell: str = "cell", strict: bool = False) -> DataFrame:
    """T3. Mean by cell and calendar month; strict: an error unless every cell has 12 months a year."""
    if strict and df.groupBy(cell).agg(F.count("*").alias("n"), F.count_distinct("year").alias("y")).filter("n <> 12 * y").take(1):
        raise ValueError("months are not 12 a year")
    return df.groupBy(cell, "month").agg(F.avg(value).alias(value))


def harmonic_fit(df: DataFrame, value: str, cell: str = "cell") -> DataFrame:
    """T4. a0 + a1 sin(wm) + b1 cos(wm) by least squares over the months present; NULL with fewer than 3.

    The 3 x 3 normal equations are sums of one aggregation, solved by Cramer's rule.
    """
    y, m = F.col(value), F.col("month")
    s, c = F.sin(OMEGA * m), F.cos(OMEGA * m)
    sums = df.filter(y.isNotNull()).groupBy(cell).agg(*[F.sum(e).alias(n) for n, e in (("n", F.lit(1.0)), ("s", s), ("c", c), ("ss", s * s), ("cc", c * c), ("sc", s * c), ("y", y), ("sy", s * y), ("cy", c * y))], F.count_distinct("month").alias("months"))

    def det(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    k = {x: F.col(x) for x in ("n", "s", "c", "ss", "cc", "sc", "y", "sy", "cy")}
    base = [[k["n"], k["s"], k["c"]], [k["s"], k["ss"], k["sc"]], [k["c"], k["sc"], k["cc"]]]
    right = [k["y"], k["sy"], k["cy"]]
    swapped = lambda j: [[right[i] if q == j else base[i][q] for q in range(3)] for i in range(3)]
    d = det(base)
    ok = (F.col("months") >= 3) & (F.abs(d) > 1e-9)
    fit = sums.select(cell, *[F.when(ok, det(swapped(j)) / d).alias(n) for j, n in enumerate(("a0", "a1", "b1"))])
    return df.select(cell).distinct().join(fit, cell, "left")


def harmonic_predict(coef: DataFrame, cell: str = "cell", value: str = "pred") -> DataFrame:
    """T5. 12 monthly values, not below 0."""
    m = F.col("month")
    out = coef.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    y = F.col("a0") + F.col("a1") * F.sin(OMEGA * m) + F.col("b1") * F.cos(OMEGA * m)
    return out.select(cell, "month", F.when(y.isNotNull(), F.greatest(y, F.lit(0.0))).alias(value))


def seasonal_scale(pai: DataFrame, pred: DataFrame, month0: int, value: str, cell: str = "cell") -> DataFrame:
    """T6. A value known at month0 at all months: times pred(m) / pred(month0), NULL if that is not positive."""
    start = pred.filter(F.col("month") == month0).select(cell, F.col("pred").alias("__p0"))
    return pai.join(pred, cell).join(start, cell).withColumn(value, F.when(F.col("__p0") > 0, F.col(value) * F.col("pred") / F.col("__p0"))).drop("pred", "__p0")


def range_scale(fine: DataFrame, coarse: DataFrame, value: str, cell: str = "cell", q: float = 0.99, lo: float = 0.3, hi: float = 3.0) -> DataFrame:
    """T7. Fine values times the clamped ratio of coarse to fine quantiles by cell; NULL if it is negative or infinite."""
    a, b = fine.groupBy(cell).agg(pct(value, q).alias("__f")), coarse.groupBy(cell).agg(pct(value, q).alias("__c"))
    r = F.col("__c") / F.nullif(F.col("__f"), F.lit(0.0))
    return fine.join(a, cell).join(b, cell).withColumn(value, F.col(value) * clamp(F.when(r >= 0, r), lo, hi)).drop("__f", "__c")


def drop_empty_layers(df: DataFrame, value: str, height: str = "height_m") -> DataFrame:
    """T8. 0 becomes NULL; heights without a value go."""
    out = df.withColumn(value, F.when(F.col(value) != 0, F.col(value)))
    return out.join(out.groupBy(height).agg(F.count(value).alias("__n")).filter("__n > 0").select(height), height, "left_semi")


def interpolate_cyclic(df: DataFrame, value: str, cell: str = "cell", step: str = "month") -> DataFrame:
    """T9. NULLs linearly between the neighbours on a ring: after the last step comes the first again. A leading gap is an error."""
    w = Window.partitionBy(cell).orderBy(step)
    all_ = Window.partitionBy(cell)
    at = F.row_number().over(w)
    d = df.withColumn("__i", at).withColumn("__n", F.count("*").over(all_)).withColumn("__first", F.first(value).over(w))
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    have = F.when(F.col(value).isNotNull(), F.col("__i"))
    d = d.withColumn("__lv", F.last(value, ignorenulls=True).over(past)).withColumn("__li", F.last(have, ignorenulls=True).over(past))
    d = d.withColumn("__rv", F.coalesce(F.first(value, ignorenulls=True).over(ahead), "__first")).withColumn("__ri", F.coalesce(F.first(have, ignorenulls=True).over(ahead), F.col("__n") + 1))
    line = F.col("__lv") + (F.col("__rv") - F.col("__lv")) * (F.col("__i") - F.col("__li")) / F.nullif(F.col("__ri") - F.col("__li"), F.lit(0))
    lead = F.col("__lv").isNull() & F.col("__rv").isNotNull()
    filled = F.when(lead, F.raise_error(F.lit("a series begins with a gap")).cast("double")).otherwise(F.coalesce(F.col(value), line))
    return d.withColumn(value, filled).select(*df.columns)


def longest_gap(df: DataFrame, value: str, cell: str = "cell", step: str = "month") -> DataFrame:
    """The longest run of NULLs of each cell."""
    w = Window.partitionBy(cell).orderBy(step)
    d = df.withColumn("__i", F.row_number().over(w)).filter(F.col(value).isNull()).withColumn("__g", F.col("__i") - F.row_number().over(w))
    return df.select(cell).distinct().join(d.groupBy(cell, "__g").agg(F.count("*").alias("gap")).groupBy(cell).agg(F.max("gap").alias("gap")), cell, "left").fillna(0, ["gap"])


def fill_seasonal(df: DataFrame, effect: DataFrame, value: str, cell: str = "cell", step: str = "month", cls: str = "class", most: int = 3) -> DataFrame:
    """T10. Cells with a gap longer than `most`: the class's month effect times the mean ratio to it; others: T9."""
    gaps = longest_gap(df, value, cell, step)
    long = df.join(gaps.filter(F.col("gap") > most), cell, "left_semi").join(F.broadcast(effect.withColumnRenamed("effect", "__e")), [cls, step], "left")
    ratio = F.avg(F.col(value) / F.nullif(F.col("__e"), F.lit(0.0))).over(Window.partitionBy(cell))
    long = long.withColumn(value, F.coalesce(value, F.col("__e") * ratio)).select(*df.columns)
    short = interpolate_cyclic(df.join(gaps.filter(F.col("gap") <= most), cell, "left_semi"), value, cell, step)
    return long.unionByName(short)


def season_effect(df: DataFrame, value: str, step: str = "month", keys: tuple[str, ...] = ()) -> DataFrame:
    """T11. Mean by month over all cells."""
    return df.groupBy(*keys, step).agg(F.avg(value).alias("effect"))


def season_adjust(df: DataFrame, value: str, cell: str = "cell", step: str = "month") -> DataFrame:
    """T11. T9 where the first month and at least half are present, else effect / mean effect * the cell's mean."""
    w = Window.partitionBy(cell)
    have, n = F.count(value).over(w), F.count("*").over(w)
    first = F.first(value).over(w.orderBy(step))
    d = df.withColumn("__ok", first.isNotNull() & (2 * have >= n))
    good = interpolate_cyclic(d.filter("__ok").drop("__ok"), value, cell, step)
    e = season_effect(df, value, step)
    e = e.join(e.agg(F.avg("effect").alias("__me")), how="cross")  # 12 rows and one
    rest = d.filter("not __ok").join(F.broadcast(e), step).withColumn(value, F.col("effect") / F.col("__me") * F.avg(value).over(w)).select(*df.columns)
    return good.unionByName(rest)


def moving_average_cyclic(df: DataFrame, n: int, value: str, cell: str = "cell", step: str = "month") -> DataFrame:
    """T12. Mean of a step and the n - 1 before it, the year's end coming before its start."""
    w = Window.partitionBy(cell).orderBy(step)
    d = df.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(cell)))
    tail = d.filter(F.col("__i") > F.col("__n") - (n - 1)).withColumn("__i", F.col("__i") - F.col("__n"))
    both = d.unionByName(tail)
    avg = F.avg(value).over(Window.partitionBy(cell).orderBy("__i").rowsBetween(-(n - 1), 0))
    return both.withColumn(value, avg).filter("__i > 0").select(*df.columns)
