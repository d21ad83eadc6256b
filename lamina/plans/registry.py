"""Queries of the operators over the given tables, with their SQL.

The tables stand in for layered data: events are an hourly cube (user = cell, event type = height), lineitem a yearly one (supplier = cell,
nation = site, quantity = height), customer a grid, part profiles, orders monthly series, region strata. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 5


def query(sql: str | None = None, keys: str = "", ints: str = "", nums: str = ""):
    """Register a query: keys as they are, ints as BIGINT, nums rounded, on both sides."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            zero = F.lit(0.0)
            return df.select(*keys.split(), *[F.col(c).cast("long").alias(c) for c in ints.split()], *[(F.round(F.col(c).cast("double") + 1.7e-8, DIGITS) + zero).alias(c) for c in nums.split()])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            cols = [*keys.split(), *[f"cast({c} as bigint) as {c}" for c in ints.split()], *[f"round(cast({c} as double) + 1.7e-8, {DIGITS}) + 0.0 as {c}" for c in nums.split()]]
            ORACLES[f.__name__] = f"select {', '.join(cols)} from ({sql}) as t"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Heights of the event types
HEIGHTS = {"view": 0.2, "click": 1.0, "error": 2.0, "purchase": 5.0, "signup": 10.0}
_CASE = "case event_type " + " ".join(f"when '{k}' then cast({v} as double)" for k, v in HEIGHTS.items()) + " end"


def hourly(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id as cell", "cast(ts as timestamp) as ts", f"{_CASE} as height_m", "value as v", "cast(ts as date) as day")


def yearly(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.selectExpr("s_nationkey as site", "l_suppkey as cell", "l_quantity as height_m", "year(l_shipdate) as year", "month(l_shipdate) as month", "l_extendedprice / 1000 as tmax", "l_extendedprice / 1000 * (1 - l_discount) as tmin", "l_extendedprice / 1000 * (1 - l_tax) as tmean")


def layers(spark, d) -> DataFrame:
    """One row a cell, height and year."""
    return yearly(spark, d).groupBy("site", "cell", "height_m", "year").agg(F.avg("tmax").alias("tmax"), F.avg("tmin").alias("tmin"), F.avg("tmean").alias("tmean"))


def grid(spark, d) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey as cell", "cast(c_custkey div 50 as int) as row", "cast(c_custkey % 50 as int) as col", "c_acctbal as value", "c_nationkey as class", "c_mktsegment as seg")


def gappy(spark, d) -> DataFrame:
    return grid(spark, d).withColumn("value", F.when(F.col("cell") % 7 != 0, F.col("value")))


def monthly(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell"), F.month("o_orderdate").alias("month")).agg((F.avg("o_totalprice") / 1000).alias("y"))


def pads(spark, d) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("cell"), F.col("p_size").cast("double").alias("height_m")).agg((F.avg("p_retailprice") / 1000).alias("pad"))


def profiles(spark, d) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("class"), F.col("p_size").cast("double").alias("height_m")).agg((F.avg("p_retailprice") / 1000).alias("pad"))


def strata(spark, d) -> DataFrame:
    return table(spark, d, "region").selectExpr("cast(r_regionkey % 2 + 1 as int) as class", "cast(r_regionkey as int) as zone", "cast(10 * r_regionkey as double) as zone_start", "cast(10 * r_regionkey + 10 as double) as zone_end")


def classes(spark, d) -> DataFrame:
    return table(spark, d, "supplier").selectExpr("s_suppkey as cell", "cast(s_suppkey % 2 + 1 as int) as class")


def chm(spark, d) -> DataFrame:
    """Canopy height of the event cells."""
    return table(spark, d, "events").selectExpr("user_id as cell").distinct().withColumn("canopy", (F.col("cell") % 12).cast("double"))


H = f"with h as (select user_id as cell, ts, {_CASE} as height_m, value as v, cast(ts as date) as day from events)"
Y = "with y as (select s_nationkey as site, l_suppkey as cell, l_quantity as height_m, year(l_shipdate) as year, month(l_shipdate) as month, l_extendedprice / 1000 as tmax, l_extendedprice / 1000 * (1 - l_discount) as tmin, l_extendedprice / 1000 * (1 - l_tax) as tmean from lineitem join supplier on l_suppkey = s_suppkey), l as (select site, cell, height_m, year, avg(tmax) as tmax, avg(tmin) as tmin, avg(tmean) as tmean from y group by all), st as (select r_regionkey % 2 + 1 as class, r_regionkey as zone, 10.0 * r_regionkey as zone_start, 10.0 * r_regionkey + 10 as zone_end from region), k as (select s_suppkey as cell, s_suppkey % 2 + 1 as class from supplier)"
G = "with g as (select c_custkey as cell, c_custkey // 50 as row, c_custkey % 50 as col, c_acctbal as value, c_nationkey as class, c_mktsegment as seg from customer), gg as (select cell, row, col, case when cell % 7 <> 0 then value end as value, class, seg from g)"
M = "with m as (select o_custkey as cell, month(o_orderdate) as month, avg(o_totalprice) / 1000 as y from orders group by all)"
P = "with p as (select p_brand as cell, cast(p_size as double) as height_m, avg(p_retailprice) / 1000 as pad from part group by all), pr as (select p_type as class, cast(p_size as double) as height_m, avg(p_retailprice) / 1000 as pad from part group by all)"


def sun_sql(day: str, hour: str, lat: str, lon: str) -> str:
    """SQL of the solar zenith angle (radians) at an hour (UTC) of a date."""
    jd = f"(datediff('day', date '1970-01-01', {day}) + 2440588.0)"
    m = f"(6.24004077 + 0.01720197 * ({jd} - 2451545.0))"
    dec = f"(pi() * 23.5 / 180 * cos(2 * pi() * ({jd} - 159.5) / 365.25))"
    noon = f"({hour} + (4.0 * ({lon}) - 7.659 * sin({m}) + 9.863 * sin(2 * {m} + 3.5932)) / 60 - 12)"
    return f"acos(greatest(-1.0, least(1.0, sin({dec}) * sin(radians({lat})) + cos({dec}) * cos(radians({lat})) * cos(radians(15 * {noon})))))"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """D7 then D9: vertical ranges averaged over days and trimmed."""
    from ..operators import daily

    return daily.mean_trim_quantile(daily.vertical_stats(hourly(spark, d), chm(spark, d)), "range")


from . import queries_daily, queries_grid, queries_models, queries_structure  # noqa: E402, F401
