"""Tables that change together: new versions are written beside the old ones and made current by one commit row."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, parent long, id string, tables map<string, string>"


class Conflict(RuntimeError):
    """Another writer committed first, or two writers committed the same version."""


class TableSet:
    """Named tables under one shared folder, read at a version and changed by commits.

    A change writes whole new tables, then one log row that names the folder of every table. Readers follow log rows
    only, so tables without a row are never seen, and the folders of a version do not change after it. One writer at a
    time is expected: a writer whose base is no longer current is refused, and should two pass that test at the same
    moment, their version holds two rows and is refused by name instead of one of them being lost.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        """All commits; empty before the first."""
        try:
            return self.spark.read.schema(COMMIT).json(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMIT)

    def version(self) -> int:
        """The current version, 0 before the first commit."""
        return self.log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def tables(self, version: int | None = None) -> dict[str, str]:
        """Folder of every table at a version (default: the current one)."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        rows = self.log().where(F.col("version") == version).limit(2).collect()
        if not rows:
            raise KeyError(f"no version {version} below {self.root}")
        if len(rows) > 1:
            raise Conflict(f"version {version} below {self.root} was committed twice")
        return dict(rows[0]["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table at a version; later commits do not change what was read."""
        return self.spark.read.parquet(self.tables(version)[name])

    def commit(self, changes: Mapping[str, DataFrame], base: int | None = None) -> int:
        """Write the changed tables in the order given, then make them current with the others; the new version.

        ``base`` is the version that the changes were made from (default: the current one). Where a write fails, the
        old version stays current and complete.
        """
        base = self.version() if base is None else base
        tables = self.tables(base)
        for name, df in changes.items():
            path = f"{self.root}/{name}/v{base + 1}-{uuid.uuid4().hex}"
            df.write.mode("errorifexists").parquet(path)
            tables[name] = path
        if self.version() != base:
            raise Conflict(f"version {base} below {self.root} is no longer current")
        row = self.spark.createDataFrame([(base + 1, base, uuid.uuid4().hex, tables)], COMMIT)
        row.coalesce(1).write.mode("append").json(f"{self.root}/commits")
        self.tables(base + 1)
        return base + 1
