"""Exact quantiles of columns of any length: a bracket from a sketch, counts below it, ranks only inside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import cut
from .columns import pct

#: Distinct values that one task may rank
MOST = 1 << 17
#: Parts of a bracket that is still too large
PARTS = 100


def quantiles(df: DataFrame, value: str, qs: Sequence[float], keys: Sequence[str] = (), *, most: int = MOST, accuracy: int = 10_000) -> DataFrame:
    """keys and q0, q1, ...: quantiles with linear interpolation, equal to `percentile`. NULLs are left out; without values a quantile is NULL.

    Groups of at most `most` values are ranked at once. Beyond that a sketch of rank error 1 / accuracy gives a
    bracket for each quantile; one pass counts what lies below it and each distinct value inside it. A bracket of more than `most` distinct
    values is cut into parts at its own quantiles and only the parts that hold the rank are kept, until it fits. A bracket that misses
    its rank is replaced by all values. So no task ranks more than `most` values, and equal values count as one.
    """
    group = ["__g"]  # a struct of the keys: NULLs in it are equal in joins too
    d = df.select((F.struct(*keys) if keys else F.lit(0)).alias("__g"), F.col(value).cast("double").alias("__v"))
    some = d.filter("__v is not null")
    margin = 2 / accuracy
    ends = [min(max(x, 0.0), 1.0) for q in qs for x in (q - margin, q + margin)]
    sketch = some.groupBy(*group).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.percentile_approx("__v", ends, accuracy).alias("p"))
    if keys:
        sketch = cut(sketch)
        largest = sketch.agg(F.max("n")).first()[0] or 0
    else:
        row = sketch.collect()  # a row
        largest = row[0].n if row else 0
        sketch = df.sparkSession.createDataFrame(row, sketch.schema)
    names = [f"q{i}" for i in range(len(qs))]
    if largest <= most:
        ranked = [pct("__v", q).alias(n) for q, n in zip(qs, names, strict=True)]
        return d.groupBy("__g").agg(*ranked).select("__g.*", *names) if keys else d.agg(*ranked)
    bracket = lambda i, q: F.struct(
        F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("n") - 1)).alias("r"),
        (F.get("p", F.lit(2 * i)) if q > margin else F.col("lo")).alias("a"), (F.get("p", F.lit(2 * i + 1)) if q < 1 - margin else F.col("hi")).alias("b"),
    )
    state = sketch.select(*group, "lo", "hi", F.inline(F.array(*[bracket(i, q) for i, q in enumerate(qs)])))
    held = _held(some, state, group, bool(keys))
    missed = _sums(held, group).filter("below > floor(r) or ceil(r) >= below + inside").select(*group, "i", F.lit(True).alias("missed"))
    if missed.limit(1).count():
        wide = state.join(missed, [*group, "i"], "left").select(*group, "lo", "hi", "i", "r", F.when(F.col("missed"), F.col("lo")).otherwise(F.col("a")).alias("a"), F.when(F.col("missed"), F.col("hi")).otherwise(F.col("b")).alias("b"))
        held = _held(some, wide, group, bool(keys))
    while _sums(held, group).filter(F.col("distinct") > most).limit(1).count():
        held = _narrowed(held, group)
    return _ranked(held, group, names).select(*["__g.*"] * bool(keys), *names)


def _held(some: DataFrame, state: DataFrame, group: list[str], keyed: bool) -> DataFrame:
    """group, i, r, w and c: the count of each distinct value inside a bracket, and with w NULL of those below it."""
    brackets = state.drop("lo", "hi")
    inside = some.join(brackets if keyed else F.broadcast(brackets), group).filter(F.col("__v") <= F.col("b"))  # without keys a row for each quantile asked for
    return cut(inside.groupBy(*group, "i", "r", F.when(F.col("__v") >= F.col("a"), F.col("__v")).alias("w")).agg(F.count("*").alias("c")))


def _sums(held: DataFrame, group: list[str]) -> DataFrame:
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0))
    return held.groupBy(*group, "i", "r").agg(part(F.col("w").isNull()).alias("below"), part(F.col("w").isNotNull()).alias("inside"), F.count("w").alias("distinct"))


def _narrowed(held: DataFrame, group: list[str]) -> DataFrame:
    """The parts of each bracket, cut at quantiles of its distinct values, in which its ranks lie; what is below them becomes one count."""
    id_ = [*group, "i", "r"]
    cuts = held.groupBy(*id_).agg(F.percentile_approx("w", [k / PARTS for k in range(1, PARTS)], 100 * PARTS).alias("cuts"))
    parts = held.join(cuts, id_).withColumn("part", F.when(F.col("w").isNull(), -1).otherwise(F.size(F.filter("cuts", lambda x: x < F.col("w"))))).drop("cuts")
    parts = cut(parts)
    sums = parts.groupBy(*id_, "part").agg(F.sum("c").alias("k"))
    upto = sums.withColumn("upto", F.sum("k").over(Window.partitionBy(*id_).orderBy("part")))  # PARTS + 1 rows a bracket
    keep = upto.filter("part >= 0 and upto > floor(r) and upto - k <= ceil(r)").select(*id_, "part")
    lowest = keep.groupBy(*id_).agg(F.min("part").alias("least"))
    below = parts.join(lowest, id_).filter("part < least").groupBy(*id_).agg(F.sum("c").alias("c")).select(*id_, F.lit(None).cast("double").alias("w"), "c")
    return cut(parts.join(keep, [*id_, "part"], "left_semi").select(*id_, "w", "c").unionByName(below))


def _ranked(held: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """The values at the ranks around r, and between them."""
    upto = F.sum("c").over(Window.partitionBy(*group, "i").orderBy(F.asc_nulls_first("w")))
    at = lambda rank: F.min(F.when((F.col("upto") > rank) & F.col("w").isNotNull(), F.col("w")))
    two = held.withColumn("upto", upto).groupBy(*group, "i", "r").agg(at(F.floor("r")).alias("x"), at(F.ceil("r")).alias("y"))
    between = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise((F.ceil("r") - F.col("r")) * F.col("x") + (F.col("r") - F.floor("r")) * F.col("y"))
    return two.groupBy(*group).agg(*[F.max(F.when(F.col("i") == i, between)).alias(n) for i, n in enumerate(names)])
