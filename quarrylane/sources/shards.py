"""Sharded Parquet tables: a kept list of shards with row counts and bounds, from which shards are chosen before any is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.plans.bounded import bounded_rows
from quarrylane.sources import sinks

#: Shards that one scan may name; more are refused, not cut.
MAX_SHARDS = 100_000


def shard_list(spark: SparkSession, folders: list[str], bound: str, counted: tuple[str, ...] = ()) -> DataFrame:
    """One row per shard file: ``shard`` (its path), ``bytes``, ``rows``, ``low`` and ``high`` of ``bound``, ``unset`` (rows without it),
    and ``has_<name>`` (rows with a value) per name in ``counted``.

    Shards may differ in their columns; a column that a shard does not have counts as unset there. Only the named columns
    are read.
    """
    d = spark.read.option("mergeSchema", "true").parquet(*folders)
    kept = [c for c in counted if c in d.columns]
    # Without them, a name that no shard has is all unset.
    missing = [F.lit(0).cast("long").alias(f"has_{c}") for c in counted if c not in d.columns]
    d = d.select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes"), F.col(f"`{bound}`").alias("at"),
                 *[F.col(f"`{c}`").alias(f"c_{c}") for c in kept])
    g = d.groupBy("shard").agg(
        F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("at").alias("low"), F.max("at").alias("high"),
        F.count_if(F.col("at").isNull()).alias("unset"), *[F.count(f"c_{c}").alias(f"has_{c}") for c in kept])
    return g.select("*", *missing)


def keep_list(shards: DataFrame, path: str) -> DataFrame:
    """The list written as a table and read back; later scans read it instead of the shards."""
    return shards.sparkSession.read.parquet(sinks.write_parquet(shards, path))


def chosen(shards: DataFrame, low=None, high=None) -> DataFrame:
    """The shards that can hold a bound between ``low`` and ``high`` (both included; None: open)."""
    if low is not None:
        shards = shards.where(F.col("high") >= F.lit(low))
    return shards if high is None else shards.where(F.col("low") <= F.lit(high))


def scan(shards: DataFrame, schema: T.StructType, bound: str, low=None, high=None) -> DataFrame:
    """Rows whose ``bound`` is between ``low`` and ``high``, with the columns of ``schema``; other shards are not opened.

    A column that a shard does not have is NULL there. Without limits every row is returned, also those without a bound.
    """
    spark = shards.sparkSession
    paths = [r["shard"] for r in bounded_rows(chosen(shards, low, high).select("shard"), MAX_SHARDS, "shard list")]
    if not paths:
        return spark.createDataFrame([], schema)
    d = spark.read.schema(schema).parquet(*paths)
    if low is not None:
        d = d.where(F.col(f"`{bound}`") >= F.lit(low))
    return d if high is None else d.where(F.col(f"`{bound}`") <= F.lit(high))
