"""Sources, sinks and catalogue checks (S)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite


def clean_values(df: DataFrame, values: Iterable[str]) -> DataFrame:
    """Non-finite values become NULL."""
    return df.withColumns({v: finite(v) for v in values})


def read_cells(spark: SparkSession, path: str, values: Iterable[str] = ("value",), fmt: str = "parquet", schema=None) -> DataFrame:
    """S1. A cell table from Parquet or CSV, with non-finite values as NULL."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return clean_values(reader.load(path), values)


SITES = "SiteName string, Sample string, Year int, Month int, EPSG int"


def read_sites(spark: SparkSession, csv: str, sample: str, year: int) -> DataFrame:
    """S2. The month and EPSG code of a sample in a year."""
    return spark.read.csv(csv, schema=SITES, header=True).filter((F.col("Sample") == sample) & (F.col("Year") == year)).select("SiteName", "Month", "EPSG").distinct()


def with_path_keys(df: DataFrame, patterns: dict[str, tuple[str, str]], path: str | None = None) -> DataFrame:
    """S3. Key columns from file paths: name -> (pattern with one group, type). path: a column, else the file each row came from."""
    source = F.col(path) if path else F.col("_metadata.file_path")
    return df.withColumns({name: F.nullif(F.regexp_extract(source, pattern, 1), F.lit("")).cast(kind) for name, (pattern, kind) in patterns.items()})


def check_layers(df: DataFrame, keys: list[str], year: str, years: Iterable[int]) -> tuple[DataFrame, DataFrame]:
    """S4. (kept, dropped keys): a series with an unknown or a repeated year goes as a whole."""
    bad = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(year).alias("k"), F.max((~F.coalesce(F.col(year).isin(list(years)), F.lit(False))).cast("int")).alias("odd")).filter("n <> k or odd = 1").select(*keys)
    return df.join(bad, keys, "left_anti"), bad


def align_years(df: DataFrame, keys: list[str], year: str, first: int, last: int) -> DataFrame:
    """S5. Each series on the whole calendar first..last, missing years as NULL."""
    calendar = df.select(*keys).distinct().withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return calendar.join(df.withColumn(year, F.col(year).cast("int")), [*keys, year], "left")


def pad_layers(df: DataFrame, tile: str, cell: str, height: str, value: str, step: float) -> DataFrame:
    """S6. Each cell on all bins 0, step, .. up to the tallest tile's; new bins are NULL; bins are named lo..hi."""
    top = df.agg(F.max(height)).first()[0]  # one number
    n = 0 if top is None else round(top / step) + 1
    bins = df.select(tile, cell).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0))))) if n else df.select(tile, cell).distinct().withColumn("bin", F.lit(0))
    own = df.withColumn("bin", F.round(F.col(height) / step).cast("int")).select(tile, cell, "bin", value)
    return bins.join(own, [tile, cell, "bin"], "left").select(tile, cell, (F.col("bin") * step).alias(height), value, F.concat_ws("_", F.format_number(F.col("bin") * step, 1), F.concat(F.format_number((F.col("bin") + 1) * step, 1), F.lit("m"))).alias("name"))


def write_table(df: DataFrame, path: str, keys: Iterable[str] = (), mode: str = "errorifexists", fmt: str = "parquet") -> None:
    """S7. Write partitioned by the keys; CSV gets a header."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*keys) if list(keys) else writer).save(path)


def missing_outputs(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """S8. The wanted keys that no output has yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def collect_monthly(df: DataFrame, keys: list[str], date: str, band: str, first: int, last: int, region: tuple[float, float, float, float] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """S9. Mean of a band by key, year and month, one column a month; region: xmin, ymin, xmax and ymax, both ends included."""
    months = [F.avg(F.when(F.month(date) == m, F.col(band))).alias(f"m{m:02d}") for m in range(1, 13)]
    if region is not None:
        df = df.filter(F.col(x).between(region[0], region[2]) & F.col(y).between(region[1], region[3]))
    return df.filter(F.year(date).between(first, last)).groupBy(*keys, F.year(date).alias("year")).agg(*months)


#: Scene classes that are not clear ground
BAD_SCENE_CLASSES = (0, 1, 3, 8, 9, 10, 11)


def cloud_free_median(df: DataFrame, cell: str, cloud: str, scl: str, bands: list[str], max_cloud: float = 50, bad: Iterable[int] = BAD_SCENE_CLASSES) -> DataFrame:
    """S10. Median of each band by cell, without cloudy scenes and bad pixels."""
    return df.filter((F.col(cloud) < max_cloud) & ~F.col(scl).isin(list(bad))).groupBy(cell).agg(*[F.median(b).alias(b) for b in bands])


def clip_time(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """S11. Rows from start to end, both included."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def point_series(df: DataFrame, points: DataFrame, cell: str, ts: str, values: list[str]) -> DataFrame:
    """S12. Series at points: points carry the cell they fall in."""
    return points.join(df, cell).select(*[c for c in points.columns], ts, *values)
