"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """node, root: the smallest node that every node of an edge (a, b) reaches.

    Each round hangs every node's larger neighbours, then the smaller ones, on the smallest node next to it; a hub of
    any size is a combined minimum and an equi join. A round's edges are saved, so a lost executor costs one round at
    most. The number of rounds grows with the logarithm of the graph's size; ``most`` guards against a defect.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
               "edges")
    for _ in range(most):
        # done when every node hangs on one root at most, and no root hangs on another
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or up > 0 and down > 0").isEmpty():
            rooted = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return rooted.unionAll(rooted.select("root").distinct().select(F.col("root").alias("node"), "root"))
        # edges point from the larger to the smaller node
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # of the smaller neighbours, the smallest takes the others and the node itself
        small = (large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                             F.col("m").alias("b")).distinct())
        now = save(small, "edges")
    raise RuntimeError("components did not settle")
