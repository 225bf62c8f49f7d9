"""Writers: versioned tables, report files, cached results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators.catalog import COLUMNS


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place the session names; a temporary one only in a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with quotes doubled inside quoted cells, so that any cell comes back as it was."""
    df.write.mode("errorifexists").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").json(path)
    return path


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> str:
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    return path


def write_catalog(df: DataFrame, path: str) -> str:
    """Canonical 15-column catalog file."""
    return write_csv(df.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS]), path)


def write_ranked_decisions(decisions: DataFrame, path: str, ident: str, label: str) -> str:
    """Scored customers in working order: priority first, then expected value."""
    cols = [ident, label, *[c for c in decisions.columns if c not in (ident, label)]]
    return write_csv(decisions.select(*cols).orderBy("priority", F.desc("expected_value"), ident), path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is complete."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached_parquet(spark: SparkSession, path: str, build: Callable[[], DataFrame], by: Sequence[str] = (),
                   force: bool = False) -> DataFrame:
    """Table at ``path``; built and written only when it is not there yet."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").partitionBy(*by).parquet(path)
    return spark.read.parquet(path)


def next_version(df: DataFrame, root: str) -> str:
    """Write the next version of a table beside the current one; readers switch after it is complete."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path
