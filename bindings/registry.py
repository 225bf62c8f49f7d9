"""Registry of bound queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
#: Rows of one partition of a spread table, on average.
SPREAD_ROWS = 300_000


def hash_sql(key: str, seed: int) -> str:
    """``plans.bounded.hash_order`` in SQL."""
    return f"md5(coalesce({key}::VARCHAR, '') || '/{seed}')"


def hash_number_sql(key: str, seed: int) -> str:
    """``plans.bounded.hash_number`` in SQL."""
    return f"('0x' || substr({hash_sql(key, seed)}, 1, 15))::BIGINT"


class Tables:
    """Test tables of one scale folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._kept: dict[str, DataFrame] = {}

    def spread(self, name: str) -> DataFrame:
        """A table for heavy work on each row. One that fills fewer partitions than there are cores (a test table is one
        row group), or whose partitions would hold over SPREAD_ROWS rows, is dealt out; others are read as they are."""
        d = getattr(self, name)
        parts = max(self.spark.sparkContext.defaultParallelism, -(-d.count() // SPREAD_ROWS))  # counted from the files' footers
        return d.repartition(parts) if d.rdd.getNumPartitions() < parts else d

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that one query reads several times: built once and written in the shared folder."""
        if name not in self._kept:
            path = sinks.write_parquet(build(), sinks.shared_folder(self.spark, name))
            self._kept[name] = self.spark.read.parquet(path)
        return self._kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; doubles are rounded so both engines print the same value."""

    def keep(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(Tables(spark, folder)), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return keep


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Plain result types: whole numbers as BIGINT, doubles rounded."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)
