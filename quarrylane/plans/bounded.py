"""Small inputs whose size is checked before they travel to every task."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class TooManyRows(ValueError):
    """A table meant to be small is not."""


def bounded_rows(df: DataFrame, limit: int, what: str = "table") -> list[Row]:
    """Rows of a small table; raises when it holds more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooManyRows(f"{what} holds more than {limit} rows")
    return rows


def fits(df: DataFrame, limit: int) -> bool:
    """Whether a table holds at most ``limit`` rows, reading no more than needed."""
    return df.limit(limit + 1).count() <= limit


def small_side(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast a join side only when its checked row count allows it."""
    return F.broadcast(df) if fits(df, limit) else df


def hash_order(key: Column, seed: int) -> Column:
    """Text whose order shuffles rows repeatably: the MD5 of key and seed, the same in every engine."""
    return F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))


def hash_number(key: Column, seed: int) -> Column:
    """The first 60 bits of ``hash_order`` as a number."""
    return F.conv(F.substring(hash_order(key, seed), 1, 15), 16, 10).cast("long")


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Value of a fixed mapping, NULL where the key is absent."""
    parts: list[Column] = []
    for k, v in mapping.items():
        parts += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*parts), key)


def each(values: Iterable, alias: str | None = None) -> Column:
    """Repeat a row once per literal value: a parameter grid without a join."""
    col = F.explode(F.array(*[F.lit(v) for v in values]))
    return col.alias(alias) if alias else col


def each_record(records: Sequence[Mapping]) -> Column:
    """Repeat a row once per literal record (a struct with the record's fields)."""
    return F.explode(F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in records]))
