"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. Sizes are summed by source and hash bucket; running sums of a source's buckets tell in
which bucket its budget runs out. Only that boundary bucket is split again by the next bits, until it holds one hash, so
each source ends with one threshold and the mix is a filter on the hash: no sort, and a larger budget takes a superset.

A source whose target is above its size is repeated: every document is taken ``floor(target / size)`` times, and those
below the threshold once more.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.common import SPACES, packed, unpacked, written
from quarrylane.plans.bounded import bounded_rows

ADDED = ("size", "source_size", "target", "taken")
#: Bits of a document's hash, and bits by which each round splits a bucket.
HASH_BITS, ROUND_BITS = 60, 12
#: A document is taken at most so often.
MOST = 3
#: Weights are a table by source that the caller could have written down; more sources than this are refused.
MAX_SOURCES = 200_000


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def document_hash(ident: Column) -> Column:
    """60 bits of the MD5 of the id as text; null as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: dict[str | None, int], cycle: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Shares of all sizes by weight; what exceeds MOST times a source's size is reshared by weight until none does."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        level = Fraction(total - sum(MOST * sizes[s] for s in order if s not in free), sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level > MOST * sizes[s]}
        if not over:
            target |= {s: float(weight[s] * level) for s in free}
            break
        target |= {s: float(MOST * sizes[s]) for s in over}
        free -= over
    return target


def _thresholds(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """``source``, ``below``: the hash below which a source's documents add up closest to ``rest``.

    ``budget`` has one row per source (``source``, ``rest``). Each round sums the boundary buckets alone; a bucket of one
    hash is taken or left, whichever is nearer.
    """
    spark = docs.sparkSession
    state = [(r["source"], r["rest"], 0, HASH_BITS) for r in budget.collect()]
    done: dict[str | None, int] = {}
    kind = f"source {docs.schema['source'].dataType.simpleString()}, rest double, low long, width int"
    while state:
        open_ = spark.createDataFrame(state, kind)
        same = docs["source"].eqNullSafe(open_["source"])
        inside = docs.join(F.broadcast(open_), same & (F.expr("shiftright(hash, width)") == F.expr("shiftright(low, width)"))).select(
            open_["source"].alias("source"), "rest", "low", "width", "hash", "size")
        step = F.greatest(F.col("width") - ROUND_BITS, F.lit(0)).alias("step")
        sums = (inside.withColumn("step", step).withColumn("bucket", F.expr("shiftright(hash, step)"))
                .groupBy("source", "rest", "step", "bucket")
                .agg(F.sum("size").alias("size"), F.min("hash").alias("first"), F.max("hash").alias("last")))
        along = Window.partitionBy("source").orderBy("bucket")
        cut = sums.withColumn("upto", F.sum("size").over(along)).where("upto > rest")
        cut = cut.withColumn("nth", F.row_number().over(along)).where("nth = 1")
        found = {r["source"]: r for r in cut.collect()}
        left = []
        for source, rest, low, width in state:
            r = found.get(source)
            if r is None:
                done[source] = low + (1 << width)
            elif r["first"] == r["last"]:
                before, after = rest - (r["upto"] - r["size"]), r["upto"] - rest
                done[source] = r["first"] + (1 if after < before else 0)
            else:
                left.append((source, float(rest - (r["upto"] - r["size"])), r["bucket"] << r["step"], r["step"]))
        state = left
    return spark.createDataFrame(list(done.items()), f"source {docs.schema['source'].dataType.simpleString()}, below long")


def mark_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Every input row with its ``size``, ``source_size``, ``target`` (of its source) and ``taken`` words.

    ``taken`` is a whole multiple of the size, at most MOST. Rows that repeat an id share its hash and are taken together.
    Null sources form one source, null texts have size 0, null ids hash alike. An empty table gives an empty result.
    Input columns named like an added one are replaced by it.
    """
    spark = df.sparkSession
    full = df.select(packed(df), F.col(f"`{source_col}`").alias("source"), document_hash(F.col(f"`{id_col}`")).alias("hash"),
                     word_count(F.col(f"`{text_col}`")).alias("size"))
    slim = written(full.select("source", "hash", "size"), "sizes")
    rows = bounded_rows(slim.groupBy("source").agg(F.sum("size").alias("size")), MAX_SOURCES, "sources")
    sizes = {r["source"]: r["size"] for r in rows}
    target = source_targets(sizes, cycle)
    times = {s: min(MOST, int(target[s] // sizes[s])) if sizes[s] else 0 for s in sizes}
    kind = slim.schema["source"].dataType.simpleString()
    budget = spark.createDataFrame([(s, float(target[s] - times[s] * sizes[s])) for s in sizes if sizes[s]], f"source {kind}, rest double")
    below = {r["source"]: r["below"] for r in _thresholds(slim, budget).collect()} if sizes else {}
    plan = spark.createDataFrame([(s, sizes[s], round(target[s], 6), times[s], 0 if times[s] == MOST else below.get(s, 0)) for s in sizes],
                                 f"source {kind}, source_size long, target double, times int, below long")
    out = full.join(F.broadcast(plan.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
    taken = F.col("size") * (F.col("times") + (F.col("hash") < F.col("below")).cast("int"))
    return unpacked(out.select("row", "size", "source_size", "target", taken.alias("taken")), df.columns, ADDED)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixed rows themselves, each repeated as often as it is taken, with the input's columns.

    Documents without a word add nothing to a mix measured in words and are left out.
    """
    body = df.select(packed(df, "doc"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"))
    marked = mark_mix(body, "id", "text", "source", cycle).where("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return marked.select("doc", copies.alias("copy")).select("doc.*")
