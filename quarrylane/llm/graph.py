"""Connected components of very large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import join_counted, saved


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected to, for every node that has an edge.

    Alternates large and small stars until the edges stop changing. A hub's edges are joined by ``join_counted``.
    """

    def least(pairs: DataFrame) -> DataFrame:
        best = saved(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")))
        return join_counted(pairs, best, "u", "w").withColumn("m", F.least("m", "u"))

    def mark(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = saved(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    was = mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        large = saved(least(both).where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = least(large)
        small = low.select("u", F.col("m").alias("v")).union(low.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = saved(small.distinct())
        seen = mark(now)
        if seen == was:
            break
        was = seen
    tail = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tail.union(tail.select(F.col("root").alias("node"), "root").distinct())
