"""Ordered running totals and exact quantiles without a one-task sort.

A window without a partition moves every row to one task. Here the order column is
cut into buckets at split points; each bucket is summed on its own and receives the
total of the buckets before it. The split points only balance the work: any set of
points gives the same exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.session import checkpointed

BUCKET = "__bucket"
#: Rows of a text column sampled per bucket, and how much of a text a split point holds.
SAMPLE_PER_BUCKET = 16
POINT_CHARS = 256


def split_points(df: DataFrame, order: Column, buckets: int) -> list[float]:
    """At most ``buckets - 1`` distinct interior split points of a numeric expression."""
    probs = [i / buckets for i in range(1, buckets)]
    if not probs:
        return []
    found = df.select(order.cast("double").alias("v")).approxQuantile("v", probs, 1.0 / (4 * buckets))
    return sorted(set(found))


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return buckets
    return max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_points(df: DataFrame, order: str, buckets: int, keys: Sequence[str] = ()) -> list[str]:
    """At most ``buckets - 1`` split points of a text column, bytewise ascending: even steps through a sample of its rows.

    The sample is the rows of least hash over order and keys, so it is the same in every run; a point is the head of a text.
    """
    if buckets < 2:
        return []
    place = F.xxhash64(F.lit("sample"), order, *keys)
    rows = (df.where(F.col(order).isNotNull()).select(F.left(F.col(order), F.lit(POINT_CHARS)).alias("v"), place.alias("h"))
            .orderBy("h", "v").limit(buckets * SAMPLE_PER_BUCKET).collect())
    seen = sorted((r["v"] for r in rows), key=str.encode)
    return sorted({seen[len(seen) * i // buckets] for i in range(1, buckets)} if seen else (), key=str.encode)


def points_up_to(value: Column, points: Sequence[str]) -> Column:
    """How many of the ascending points are at most ``value``, by halving steps; NULL for NULL."""
    held = F.array(*[F.lit(p) for p in points])
    steps = [1 << i for i in reversed(range(len(points).bit_length()))]

    def further(n: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(held, n + step - 1) <= value, F.lit(False)), n + step).otherwise(n)

    return F.when(value.isNotNull(), F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further))


def bucketed(df: DataFrame, order: str, buckets: int | None = None,
             descending: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Add a bucket number that grows in the requested order; NULL comes first ascending and last descending, as in a sort."""
    many = _bucket_count(df, buckets)
    if isinstance(df.schema[order].dataType, T.StringType):
        texts = text_points(df, order, many, keys)
        out = df.withColumn(BUCKET, points_up_to(F.col(order), texts).cast("double") if texts else F.lit(0.0))
    else:
        number = F.col(order).cast("double")
        points = split_points(df, number, many)
        if not points:
            return df.withColumn(BUCKET, F.lit(0.0))
        cut = Bucketizer(splits=[-float("inf"), *points, float("inf")],
                         inputCol="__order", outputCol=BUCKET, handleInvalid="keep")
        out = cut.transform(df.withColumn("__order", number)).drop("__order")
    place = F.coalesce(BUCKET, F.lit(-1.0))
    return out.withColumn(BUCKET, -place if descending else place)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys appear once."""
    other = right.select(*[F.col(k).alias(f"__k_{k}") if k in keys else F.col(k) for k in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"__k_{k}" for k in keys])


def running_totals(df: DataFrame, order: str, sums: Sequence[str],
                   keys: Sequence[str] = (), descending: bool = False,
                   buckets: int | None = None) -> DataFrame:
    """Inclusive running sums ``cum_<name>`` of ``sums`` along ``order`` within ``keys``.

    The input must hold one row per (keys, order), so aggregate equal order values
    first; that also keeps a popular value from filling one bucket. NULL is an order
    value (first ascending, last descending) and a key like any other.
    """
    keys = list(keys)
    # The input is read three times (split points, bucket totals, running sums).
    d = bucketed(checkpointed(df), order, buckets, descending, keys)
    by = F.col(order).desc() if descending else F.col(order).asc()
    local = Window.partitionBy(*keys, BUCKET).orderBy(by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, BUCKET).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    # At most one row per bucket (and key): the window over it is small by construction.
    offsets = totals.select(*keys, BUCKET, *[
        F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums])
    part = d.withColumns({f"cum_{s}": F.sum(s).over(local) for s in sums})
    joined = join_null_safe(part, offsets if keys else F.broadcast(offsets), [*keys, BUCKET])
    return joined.withColumns(
        {f"cum_{s}": F.col(f"cum_{s}") + F.col(f"__o_{s}") for s in sums}
    ).drop(BUCKET, *[f"__o_{s}" for s in sums])


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float],
                    keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles per key; ``probs`` maps output name to probability.

    Values are counted first, so the data that moves is one row per distinct value,
    and a key with very many values is spread over the buckets.
    """
    keys = list(keys)
    counts = checkpointed(df.where(F.col(value).isNotNull()).groupBy(*keys, value)
                          .agg(F.count(F.lit(1)).alias("n")))
    ranked = running_totals(counts, value, ["n"], keys, buckets=buckets)
    if keys:
        ranked = join_null_safe(ranked, counts.groupBy(*keys).agg(F.sum("n").alias("__total")), keys)
    else:
        total = counts.agg(F.sum("n").alias("t")).scalar()
        ranked = ranked.withColumn("__total", total)
    first = F.col("cum_n") - F.col("n")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < F.col("cum_n")), F.col(value).cast("double")))

    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        picks += [at(F.floor(pos)).alias(f"__lo_{name}"), at(F.ceil(pos)).alias(f"__hi_{name}"),
                  F.max(pos - F.floor(pos)).alias(f"__f_{name}")]
    got = ranked.groupBy(*keys).agg(*picks)
    return got.select(*keys, *[
        (F.col(f"__lo_{n}") + F.col(f"__f_{n}") * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n)
        for n in probs])


def quantile_value(df: DataFrame, value: str, p: float) -> float | None:
    """One exact quantile as a driver scalar."""
    row = exact_quantiles(df, value, {"q": p}).first()
    return None if row is None else row["q"]
