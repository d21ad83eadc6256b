"""Temperature summaries (D): every one a groupBy on cell keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pct
from ..functions.quantiles import quantiles
from ..sources.checkpoints import cut
from .grid import mask_above_canopy


def daily_stats(df: DataFrame, ts: str = "ts", value: str = "v", keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """D1. Daily min, max and mean; minus infinity counts as 0."""
    v = F.when(F.col(value) == float("-inf"), 0.0).otherwise(F.col(value))
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.min(v).alias("tmin"), F.max(v).alias("tmax"), F.avg(v).alias("tmean"))


def monthly_stats(df: DataFrame, ts: str = "ts", value: str = "v", keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """D2. The same by year and month."""
    return df.groupBy(*keys, F.to_date(F.date_trunc("month", F.col(ts))).alias("month")).agg(F.min(value).alias("tmin"), F.max(value).alias("tmax"), F.avg(value).alias("tmean"))


def merge_daily_tiles(tiles: list[DataFrame], chm: DataFrame, keys: tuple[str, ...] = ("cell", "height_m", "day")) -> DataFrame:
    """D3. Tiles on one grid: mean of tmean, max of tmax, min of tmin where they overlap, NULL over the canopy."""
    every = reduce(DataFrame.unionByName, [t.select(*keys, "tmean", "tmax", "tmin") for t in tiles])
    out = every.groupBy(*keys).agg(F.avg("tmean").alias("tmean"), F.max("tmax").alias("tmax"), F.min("tmin").alias("tmin"))
    return mask_above_canopy(out, chm, ["cell"], "height_m", ["tmean", "tmax", "tmin"], strict=True)


def yearly_vars(df: DataFrame, keys: tuple[str, ...] = ("cell", "height_m"), year: str = "year") -> DataFrame:
    """D4. Means of tmin and tmax, their difference, the 0.9 quantile of tmax and the sd of tmean by year: one pass."""
    return df.groupBy(*keys, year).agg(F.avg("tmin").alias("tmin_mean"), F.avg("tmax").alias("tmax_mean"), (F.avg("tmax") - F.avg("tmin")).alias("diurnal_range"), pct("tmax", 0.9).alias("tmax_q90"), F.stddev_samp("tmean").alias("tmean_sd"))


def mean_daily_max(df: DataFrame, pai: DataFrame, keys: tuple[str, ...] = ("cell", "height_m"), value: str = "tmax") -> DataFrame:
    """D5. Mean over all days, where there is plant material."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value)).join(pai.filter("pai > 0").select(*keys).distinct(), list(keys), "left_semi")


def temporal_sd(df: DataFrame, value: str = "v", keys: tuple[str, ...] = ("cell", "height_m")) -> DataFrame:
    """D6. sd over days of values not below 0; NULL with fewer than 2."""
    return df.groupBy(*keys).agg(F.stddev_samp(F.when(F.col(value) >= 0, F.col(value))).alias("sd"))


def vertical_stats(df: DataFrame, chm: DataFrame | None = None, keys: tuple[str, ...] = ("cell", "day"), height: str = "height_m", value: str = "v") -> DataFrame:
    """D7. Max, min, sd, 0.95 quantile and range over heights; values below 0 are NULL, and those over the canopy."""
    d = df.withColumn(value, F.when(F.col(value) >= 0, F.col(value)))
    if chm is not None:
        d = mask_above_canopy(d, chm, [keys[0]], height, [value])
    return d.groupBy(*keys).agg(F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("sd"), pct(value, 0.95).alias("q95"), (F.max(value) - F.min(value)).alias("range"))


def in_strata(df: DataFrame, strata: DataFrame, height: str = "height_m") -> DataFrame:
    """Rows with the class and zone whose start <= height < end; strata are tens of rows."""
    return df.join(F.broadcast(strata.select("class", "zone", "zone_start", "zone_end")), (F.col(height) >= F.col("zone_start")) & (F.col(height) < F.col("zone_end"))).drop("zone_start", "zone_end")


def strata_stats(df: DataFrame, strata: DataFrame, chm: DataFrame | None = None, keys: tuple[str, ...] = ("cell", "day"), height: str = "height_m", value: str = "v") -> DataFrame:
    """D8. D7 inside each class's strata."""
    return vertical_stats(in_strata(df, strata, height), chm, (*keys, "class", "zone"), height, value)


def trim_above(df: DataFrame, value: str, q: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """NULL above the whole layer's quantile q (or each key's), which is exact however many rows a layer has.

    The layer is read several times, so it is written to the shared folder first.
    """
    layer = cut(df)
    top = quantiles(layer, value, [q], keys)
    wide = layer.join(top, list(keys), "left") if keys else layer.join(F.broadcast(top), how="cross")  # a row
    return wide.withColumn(value, F.when(F.col(value) <= F.col("q0"), F.col(value))).drop("q0")


def mean_trim_quantile(df: DataFrame, value: str, q: float = 0.95, cell: str = "cell", classes: DataFrame | None = None) -> DataFrame:
    """D9. Mean over days, NULL above the quantile q of all cells, and outside the classes."""
    out = trim_above(df.groupBy(cell).agg(F.avg(value).alias(value)), value, q)
    return out if classes is None else out.join(classes.select(cell).distinct(), cell, "left_semi")


def max_range_trim(df: DataFrame, chm: DataFrame, value: str, cell: str = "cell", canopy: str = "canopy", q: float = 0.95, low: float = 0.5) -> DataFrame:
    """D10. Max over days, trimmed, NULL where the canopy is not above `low`."""
    out = trim_above(df.groupBy(cell).agg(F.max(value).alias(value)), value, q)
    return out.join(chm.select(cell, F.col(canopy).alias("__c")), cell, "left").withColumn(value, F.when(F.col("__c") > low, F.col(value))).drop("__c")


def hot_day_range(colmax: DataFrame, rng: DataFrame, value: str = "max", range_: str = "range", cell: str = "cell", day: str = "day", q: float = 0.95) -> DataFrame:
    """D11. Mean range by cell over the days whose spatial mean is at or above its quantile q, trimmed. Both must have the same years."""
    years = lambda d: {r[0] for r in d.select(F.year(day)).distinct().collect()}  # noqa: E731  a few numbers
    if years(colmax) != years(rng):
        raise ValueError("years differ")
    days = colmax.groupBy(day).agg(F.avg(value).alias("__m"))
    hot = days.join(F.broadcast(days.agg(pct("__m", q).alias("__q"))), how="cross").filter("__m >= __q").select(day)
    return trim_above(rng.join(F.broadcast(hot), day, "left_semi").groupBy(cell).agg(F.avg(range_).alias(range_)), range_, q)


def zone_temporal_mean(sds: DataFrame, strata: DataFrame, value: str = "sd", cell: str = "cell", height: str = "height_m") -> DataFrame:
    """D12. Mean of the sd by height in each zone."""
    return in_strata(sds, strata, height).groupBy(cell, "class", "zone").agg(F.avg(value).alias(value))


def mean_tmax_by_height(df: DataFrame, value: str = "tmax", cell: str = "cell", height: str = "height_m") -> DataFrame:
    """D13. Mean by cell and height, with the height's place; heights rise strictly by the grouping."""
    from pyspark.sql import Window

    out = df.groupBy(cell, height).agg(F.avg(value).alias(value))
    return out.withColumn("layer", F.row_number().over(Window.partitionBy(cell).orderBy(height)))
