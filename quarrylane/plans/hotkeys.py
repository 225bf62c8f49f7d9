"""Joins on keys that a large share of all rows may have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Heavy keys are those with at least a (HEAVY_SHARE x partitions)-th of all rows, so there are at most that many.
HEAVY_SHARE = 8


def partition_count(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def heavy_cut(total: int, partitions: int) -> int:
    """Rows from which a key is heavy; at most HEAVY_SHARE x partitions keys can reach it."""
    return max(2, -(-total // (HEAVY_SHARE * partitions)))


def join_counted(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join many rows per key to one row per key without gathering a heavy key's rows in one task.

    ``right`` has one row per key, and ``weight`` says how many rows of ``left`` have it. Heavy keys are at most
    HEAVY_SHARE x partitions by their definition, so their side is broadcast; all others are shuffled.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    cut = heavy_cut(int(total), partition_count(left.sparkSession))
    heavy = right.where(F.col(weight) >= cut).drop(weight)
    light = right.where(F.col(weight) < cut).drop(weight)
    first = left.join(F.broadcast(heavy), key)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return first.unionByName(rest)
