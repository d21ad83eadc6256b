"""Connected components by minimum labels and pointer jumping, as joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(edges: DataFrame, most: int = 64) -> DataFrame:
    """v and c, the smallest vertex reachable from v, for each vertex of edges (a, b).

    Each round takes the least label of a vertex's neighbours and then the label of that label, so the
    rounds grow with the logarithm of the longest path. A hub's edges are combined before the shuffle.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stored(pairs.union(pairs.select("v", "u")).distinct(), "cc-edges")
    labels = stored(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")), "cc-labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("c"))
        least = stored(near.union(labels).groupBy("v").agg(F.min("c").alias("c")), "cc-least")
        jump = least.select(F.col("v").alias("at"), F.col("c").alias("to"))
        after = stored(least.join(jump, F.col("c") == F.col("at")).select("v", F.least("c", "to").alias("c")), "cc-labels")
        same = labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0] == after.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
        labels = after
        if same:
            return labels
    raise RuntimeError("components did not settle")
