"""Daily statistics of an unbounded hourly stream: D1 with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stats_stream(stream: DataFrame, ts: str = "ts", value: str = "v", keys: tuple[str, ...] = ("cell",), late: str = "6 hours") -> DataFrame:
    """Min, max and mean by key and day; a day is given out when the watermark passes its end, and later rows are dropped."""
    w = F.window(ts, "1 day")
    v = F.when(F.col(value) == float("-inf"), 0.0).otherwise(F.col(value))
    out = stream.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.min(v).alias("tmin"), F.max(v).alias("tmax"), F.avg(v).alias("tmean"))
    return out.select(*keys, F.to_date(F.col("w.start")).alias("day"), "tmin", "tmax", "tmean")
