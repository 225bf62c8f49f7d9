"""Exact dedup by content sort, in DataFrame functions only.

Texts are normalised in one scan and written with their keys, which every later step reads. Rows are range-partitioned by
sampled splitters over the leading bytes of the normalised text, then its hash; each partition is sorted externally, so
equal texts are adjacent, and neighbours are compared in full by the window over the whole normalised text. The sampled
key is short, so the splitters that the driver holds stay small however long texts are.

A text with very many copies would fill one partition. Such texts are found exactly by a count per 64-bit hash (heavy ones
are at most ``HEAVY_SHARE x partitions``), their copies carry a salt in the sort key, and the totals of the salted parts
are added up per (hash, SHA-256) before they are attached to the rows by a broadcast of that bounded table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.common import heavy_cut, packed, partition_count, saved, unpacked, written

ADDED = ("keep_id", "group_size", "kept", "text_sha256")
#: White space that is not one plain space already; replacing only this equals replacing every run.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space.

    Most texts hold no other white space than single spaces and line ends; only the others need the pattern.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.replace(whole, F.lit("\n"), F.lit(" "))
    others = plain.contains("  ")
    for c in "\t\v\f\r":
        others = others | plain.contains(c)
    return F.when(others, F.regexp_replace(whole, _RUNS, " ")).otherwise(plain)


def _marked(df: DataFrame, id_col: str, text_col: str, columns: Sequence[str]) -> DataFrame:
    """``row`` (a struct of the asked columns) of every input row, and what ``mark_exact`` adds."""
    parts = partition_count(df.sparkSession)
    own = F.col("row").getField(text_col) if text_col in columns else None
    keyed = df.select(packed(df.select(*[f"`{c}`" for c in columns])), F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"), F.spark_partition_id().alias("at"))
    keyed = keyed.select("row", "id", "norm", F.xxhash64("norm").alias("h"), F.substring("norm", 1, 24).alias("head"), F.pmod(F.xxhash64("id", "at"), F.lit(parts)).cast("int").alias("deal"))
    # Written, since the steps below read it again: a row must keep its deal, which another run may change. The normalised
    # text is kept where no asked column holds the text.
    keyed = written(keyed if own is None else keyed.drop("norm"), "keyed")
    norm = F.col("norm") if own is None else normalised(own)
    counts = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    heavy = saved(counts.where(F.col("n") >= heavy_cut(keyed.count(), parts)).select("h", F.lit(True).alias("heavy")))
    keyed = keyed.join(F.broadcast(heavy), "h", "left").withColumn("salt", F.when(F.col("heavy"), F.col("deal")).otherwise(0)).drop("deal")

    parted = (keyed.where("heavy").select("h", "salt", "id", F.sha2(norm, 256).alias("text_sha256"))
              .groupBy("h", "text_sha256", "salt").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    totals = parted.groupBy("h", "text_sha256").agg(F.min("id").alias("all_id"), F.sum("n").alias("all_n"),
                                                    F.coalesce(F.min_by("salt", "id"), F.min("salt")).alias("all_salt"))

    placed = keyed.repartitionByRange("head", "h", "salt").withColumn("norm", norm)
    near = Window.partitionBy("head", "h", "salt", "norm").orderBy(F.col("id").asc_nulls_last())
    group = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = placed.select("row", "h", "heavy", "salt", F.sha2("norm", 256).alias("text_sha256"), F.row_number().over(near).alias("nth"),
                          F.first("id").over(group).alias("own_id"), F.count(F.lit(1)).over(group).alias("own_n"))
    whole = found.join(F.broadcast(totals), ["h", "text_sha256"], "left")
    many = F.col("all_n").isNotNull()
    return whole.select("row", "text_sha256",
                        F.when(many, F.col("all_id")).otherwise(F.col("own_id")).alias("keep_id"),
                        F.coalesce("all_n", "own_n").alias("group_size"),
                        ((F.col("nth") == 1) & (~many | (F.col("salt") == F.col("all_salt")))).alias("kept"))


def mark_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """Every input row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; of the input's columns all, or those in ``columns``.

    The row with the smallest id of each group of equal normalised texts is kept; null counts as an empty text; null ids
    come last; of rows that repeat the smallest id, one is kept. An empty table gives an empty result. Input columns
    named like an added one are replaced by it.
    """
    columns = df.columns if columns is None else columns
    return unpacked(_marked(df, id_col, text_col, columns), columns, ADDED)


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows alone, with the input's columns."""
    return _marked(df, id_col, text_col, df.columns).where("kept").select("row.*")
