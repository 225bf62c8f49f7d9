"""Helpers shared by the training-data operators: shared folders, hot keys, row packing."""

from __future__ import annotations

import contextlib
import weakref
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.plans.hotkeys import heavy_cut, join_counted, partition_count
from quarrylane.session import checkpointed
from quarrylane.sources.sinks import shared_folder

__all__ = ["SPACES", "freed", "heavy_cut", "join_counted", "packed", "partition_count", "saved", "shared_folder", "short_shuffles", "unpacked", "written"]

#: White space that separates words, as a Java and Python character class.
SPACES = r"\x20\x09-\x0D"
#: Folders of the tables that ``written`` returned and that are still in use.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """The table written as Parquet in the shared folder and read again; cuts the lineage in fewer bytes than a checkpoint."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def freed(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned; nothing that is still to be computed may read them."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(df))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the job that made them has ended, not when the driver happens to collect its garbage.

    For steps that each end in a table of their own: a frame made in here that runs twice would shuffle twice.
    """
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def packed(df: DataFrame, name: str = "row") -> Column:
    """All input columns as one struct, so that no column can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: Sequence[str], added: Sequence[str], row: str = "row") -> DataFrame:
    """The input columns back from the struct, then the added ones; an input column named like an added one gives way."""
    taken = {a.lower() for a in added}
    kept = [F.col(row).getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *added)


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared folder."""
    return checkpointed(df)
