"""Quoted CSV that splits: byte ranges of a file are read in parallel although cells may hold line ends.

A range does not know whether it starts inside a quoted cell. One pass counts the quotes of every range; the running total of
the ranges before it, odd or even, tells. A second pass joins the lines of each record inside its range. What a record has on
the other side of a range's border (at most the last record of a range and the lines that continue one) is put together
from the few pieces left over.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.plans.bounded import fits
from quarrylane.session import checkpointed

#: Ranges whose parities may travel to every task; more of them are joined by a shuffle.
MAX_BROADCAST_RANGES = 1_000_000


class OddQuotes(ValueError):
    """A file whose quotes do not pair up."""


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files with the range they were read from, in order of ``line`` inside it."""
    d = spark.read.option("lineSep", "\n").text(path)
    return d.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                    F.monotonically_increasing_id().alias("line"), "value")


def range_parities(lines: DataFrame) -> DataFrame:
    """``file``, ``start`` and ``inside``: 1 where a range starts inside a quoted cell. Raises where a file ends inside one."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = checkpointed(lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes")))
    if counts.groupBy("file").agg(F.sum("quotes").alias("n")).where("n % 2 = 1").limit(1).count():
        raise OddQuotes("a file ends inside a quoted cell")
    # One row per range.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int").alias("inside"))


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range; ``part`` is 0 for a whole record, 1 for lines that continue an earlier one, 2 for one that goes on."""
    names = ["file", "start", "head", "part", "closed", "value"]
    where: tuple[int, int] | None = None
    held: list[str] = []  # lines of the record that is open
    part = 0
    first = False

    def row(closed: bool) -> tuple:
        return (*where, first, part if closed else max(part, 2) if part != 1 else 1, closed, "\n".join(held))

    for batch in batches:
        file, start, inside = (batch.column(i).to_numpy() for i in (0, 1, 3))
        odd = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).astype(np.int64) % 2
        cuts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (start[1:] != start[:-1])]) if len(file) else []
        out: list[tuple] = []
        for a, b in zip(cuts, [*cuts[1:], len(file)]):
            here = (int(file[a]), int(start[a]))
            fresh = here != where
            if fresh:
                if held:
                    out.append(row(False))
                where, held, first = here, [], here[1] == 0
                part = 1 if inside[a] else 0
            open_ = bool(held) or part == 1
            if not open_ and not first and not odd[a:b].any():
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.zeros(b - a, bool)), pa.array(np.zeros(b - a, np.int32)),
                                                  pa.array(np.ones(b - a, bool)), batch.column(2)[a:b]], names=names)
                continue
            for k, value in enumerate(batch.column(2)[a:b].to_pylist(), a):
                held.append(value)
                open_ ^= bool(odd[k])
                if not open_:
                    out.append(row(True))
                    held, part, first = [], 0, False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()))], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(False), (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.string()))], names=names)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``value`` (the text of one record) and ``head`` (whether it is the first of its file), from all ranges in parallel."""
    lines = physical_lines(spark, path)
    parities = range_parities(lines)
    if fits(parities, MAX_BROADCAST_RANGES):
        placed = lines.join(F.broadcast(parities), ["file", "start"])  # keeps the order of lines
    else:
        placed = lines.join(parities, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "line")
    found = placed.select("file", "start", "value", "inside").mapInArrow(
        _stitched, "file long, start long, head boolean, part int, closed boolean, value string")
    whole = found.where("part = 0").select("head", "value")
    pieces = found.where("part > 0")
    # At most two pieces per range: an opened record and the lines that continue it, up to the range that closes it.
    order = Window.partitionBy("file").orderBy("start", "part")
    pieces = pieces.withColumn("nth", F.sum(F.when(F.col("part") == 2, 1).otherwise(0)).over(order))
    joined = pieces.groupBy("file", "nth").agg(F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("start", "part", "value"))).alias("p"))
    return whole.unionByName(joined.select("head", F.array_join("p.value", "\n").alias("value")))


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Cells of one file's first record, without a byte-order mark; a header's cells hold no line ends."""
    first = spark.read.option("lineSep", "\n").text(path).where("_metadata.file_block_start = 0 AND value != ''").first()
    return next(csv.reader([first["value"].lstrip("﻿").rstrip("\r")])) if first else []


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, named by the header; quoted cells may hold quotes (doubled), commas and line ends.

    Quotes stand only around cells, doubled inside them, so that they pair up; a file whose quotes do not is refused with
    ``OddQuotes``. Every file starts with its header; empty lines are left out; an empty cell is NULL.
    """
    names = header_names(spark, path)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    text = F.regexp_replace("value", "\r$", "")
    rows = records(spark, path).where("NOT head").select(text.alias("value")).where("value != ''")
    cells = F.from_csv("value", _ddl(names), {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})
    return rows.select(cells.alias("c")).select("c.*")


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
