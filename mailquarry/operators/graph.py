"""Connected components of an edge table by star contraction, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.operators.store import delete, written


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node of edges (a, b) that isn't a root itself.

    Rounds of large-star and small-star steps; their number grows with the logarithm of the longest chain. Minima are
    aggregated before the shuffle. Edges and minima are written to the shared folder before they are joined, so a node with
    many neighbours is seen and split, and a lost executor costs one step. Folders of earlier rounds are deleted.
    """
    spark = edges.sparkSession
    now, own = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = now.selectExpr("u AS n", "v AS m").union(now.selectExpr("v AS n", "u AS m"))
        low, first = written(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")))
        large, second = written(both.filter("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct())
        low, third = written(large.groupBy("u").agg(F.min("v").alias("low")))
        rest = large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        done = (own, first, second, third)
        now, own = written(rest.union(low.select("u", F.col("low").alias("v"))).distinct())
        for path in done:
            delete(spark, path)
