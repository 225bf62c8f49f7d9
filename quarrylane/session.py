"""Session settings for local runs; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import weakref

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quarrylane", cpus: int | str = "*",
                  partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Tables that ``checkpointed`` returned and that are still in use.
_CUT: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder named by the session, once.

    The folder comes from ``spark.checkpoint.dir``; only where that is unset, as
    in tests, a temporary folder is used.
    """
    if df in _CUT:
        return df
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    out = df.checkpoint()
    _CUT.add(out)
    return out
