"""Batch retrieval: exact cosine top-k, keyword channels, more-like-this."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.functions import text as tx
from quarrylane.functions import vectors as vx
from quarrylane.plans.bounded import fits, small_side
from quarrylane.session import checkpointed

MAX_BROADCAST_QUERIES = 4096
SCORE_CELLS = 4_000_000  # scores held at once by a task
PIVOTS = 256  # cells of the catalog in a large search
BLOCK_VALUES = 4_000_000  # vector values of one block of products
ASK_ROWS = 1024  # queries whose bounds against all cells a task holds at once
BOUND_SLACK = 1e-7  # covers the rounding of scores and angles
SCORE_DIGITS = 9  # equal vectors must tie, whatever order the sums were taken in


def pool_size(top_k: int, offset: int = 0, floor: int = 50, factor: int = 4) -> int:
    """Candidates to fetch per channel before fusion."""
    return max(floor, (top_k + offset) * factor)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


class _Best:
    """Running top-k per query inside one task: flat arrays of query number, score and id, sorted once per slice."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.j, self.s, self.i = np.array([], dtype="int64"), np.array([]), np.array([], dtype=object)
        self.floor = np.full(len(queries), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take rows in slices of bounded score matrices; only rows that can still enter a query's list are sorted."""
        step = max(1, SCORE_CELLS // max(1, len(self.q)))
        for at in range(0, len(ids), step):
            part, scores = ids[at:at + step], np.round(_unit_rows(vectors[at:at + step]) @ self.q.T, SCORE_DIGITS)
            floor = self.floor
            if len(part) > self.k:
                floor = np.maximum(floor, np.partition(scores, len(part) - self.k, axis=0)[len(part) - self.k])
            row, col = np.nonzero(scores >= floor)
            j, s, i = np.concatenate([self.j, col]), np.concatenate([self.s, scores[row, col]]), np.concatenate([self.i, part[row]])
            order = np.lexsort((i, -s, j))
            j, s, i = j[order], s[order], i[order]
            rank = np.arange(len(j)) - np.searchsorted(j, j)
            last, keep = rank == self.k - 1, rank < self.k
            self.floor[j[last]] = s[last]
            self.j, self.s, self.i = j[keep], s[keep], i[keep]

    @property
    def kept(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Scores and ids of each query, best first."""
        at = np.searchsorted(self.j, np.arange(len(self.q) + 1))
        return [(self.s[a:b], self.i[a:b]) for a, b in zip(at, at[1:])]

    def frame(self, query_ids: Sequence, ident: str) -> pd.DataFrame:
        return pd.DataFrame({"query_id": [query_ids[j] for j in self.j], ident: list(self.i), "score": self.s.astype("float64")})


def top_per_query(df: DataFrame, k: int, keys: Sequence[str], ident: str) -> DataFrame:
    """Rank by score within ``keys`` and keep the first k; Spark trims each partition first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc(ident))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_top_k(catalog: DataFrame, ident: str, vector: str, queries: DataFrame, k: int,
                 max_queries: int = MAX_BROADCAST_QUERIES, threshold: float | None = None) -> DataFrame:
    """Exact cosine top-k for a batch of queries (``query_id``, ``vector``)."""
    d = channel_search(catalog, ident, {"only": (vector, queries)}, k, max_queries).drop("channel")
    return d if threshold is None else d.where(F.col("score") >= threshold)


def channel_search(catalog: DataFrame, ident: str, channels: dict[str, tuple[str, DataFrame]], k: int,
                   max_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Exact cosine top-k of several (vector column, query batch) channels.

    Checked, small batches travel to every task, which reads its part of the catalog
    once for all channels, scores it in matrix form and emits only k rows per query. A
    larger batch goes through ``pruned_top_k``; both ways give the same rows. A channel
    without queries adds nothing.
    """
    names = sorted({v for v, _ in channels.values()})
    cat = catalog.select(F.col(ident), *[F.col(v).cast("array<double>").alias(v) for v in names])
    query_type = next(iter(channels.values()))[1].schema["query_id"].dataType
    schema = T.StructType([T.StructField("channel", T.StringType()), T.StructField("query_id", query_type),
                           T.StructField(ident, catalog.schema[ident].dataType), T.StructField("score", T.DoubleType())])
    small, large = [], []
    for name, (vector, queries) in channels.items():
        q = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        rows = q.limit(max_queries + 1).collect()
        if len(rows) > max_queries:
            large.append((name, vector, q))
        elif rows:
            small.append((name, vector, [r["query_id"] for r in rows],
                          _unit_rows(np.array([r["vector"] for r in rows], dtype="float64"))))
    shared = cat.sparkSession.sparkContext.broadcast(small)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [_Best(q, k) for _, _, _, q in shared.value]
        for b in batches:
            for job, (_, vector, _, _) in zip(best, shared.value):
                have = b[b[vector].notna()]
                if len(have):
                    job.add(have[ident].to_numpy(dtype=object), np.stack(have[vector].to_numpy()).astype("float64"))
        for job, (name, _, ids, _) in zip(best, shared.value):
            yield job.frame(ids, ident).assign(channel=name)[["channel", "query_id", ident, "score"]]

    found = cat.mapInPandas(score, schema)
    for name, vector, q in large:
        part = pruned_top_k(cat, ident, vector, q, k, block=max_queries).drop("rank")
        found = found.unionByName(part.withColumn("channel", F.lit(name)))
    return top_per_query(found, k, ["channel", "query_id"], ident)


def _near_pivot(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add to rows with vector ``__v`` the number of the nearest pivot and the angle to it; a zero vector gets cell -1."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack(b["__v"].to_numpy()).astype("float64")
                s = _unit_rows(v) @ shared.value.T
                cell, zero = s.argmax(axis=1), ~v.any(axis=1)
                angle = np.arccos(np.clip(s[np.arange(len(s)), cell], -1.0, 1.0))
                yield b.assign(cell=np.where(zero, -1, cell).astype("int32"), angle=np.where(zero, 0.0, angle))

    return df.mapInPandas(near, schema)


def _wanted_cells(v: np.ndarray, floor: np.ndarray | None, pivots: np.ndarray, sizes: dict[int, tuple[int, float]], k: int) -> list[np.ndarray]:
    """The cells each query vector has to meet: the opening ones, or with ``floor`` those of the rest that can reach it."""
    cells = np.array(sorted(sizes), dtype="int32")
    n, reach = (np.array([sizes[c][i] for c in cells.tolist()], dtype="float64") for i in (0, 1))
    angle = np.arccos(np.clip(_unit_rows(v) @ pivots[np.maximum(cells, 0)].T, -1.0, 1.0))
    bound = np.where(cells == -1, 0.0, np.cos(np.maximum(0.0, angle - reach)))
    bound[~v.any(axis=1)] = 0.0
    order = np.argsort(-bound, axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    wanted = np.zeros(bound.shape, dtype=bool)
    np.put_along_axis(wanted, order, before < k, axis=1)
    if floor is not None:
        wanted = ~wanted & (bound >= floor[:, None] - BOUND_SLACK)
    return [cells[w] for w in wanted]


def _cells_to_ask(q: DataFrame, pivots: np.ndarray, sizes: dict[int, tuple[int, float]], k: int, first: bool) -> DataFrame:
    """Repeat each query once per catalog cell it has to meet.

    No row of a cell scores above cos(angle to the pivot - the cell's largest angle). At first a query meets its best
    cells until they hold k rows; later those of the rest whose bound reaches its k-th score (``floor``). A task returns
    one row per query with its list of cells; the vector is repeated by Spark, row by row, never in Python.
    """
    shared = q.sparkSession.sparkContext.broadcast((pivots, sizes))
    schema = T.StructType([q.schema["query_id"], q.schema["__v"], T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ASK_ROWS):
                part = b.iloc[at:at + ASK_ROWS]
                floor = None if first else part["floor"].to_numpy()
                cells = _wanted_cells(np.stack(part["__v"].to_numpy()).astype("float64"), floor, *shared.value, k)
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "__v": part["__v"].to_numpy(), "cells": cells})

    return q.mapInPandas(ask, schema).select("query_id", "__v", F.explode("cells").alias("cell"))


def _meet(cells: DataFrame, asked: DataFrame, ident: str, k: int, schema: T.StructType, block: int, rows: int) -> DataFrame:
    """Score the asked cells only: blocks of at most about ``rows`` products with blocks of at most about ``block`` queries."""
    per = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("__q")).join(
        F.broadcast(cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).alias("__c"))), "cell")  # a row per pivot
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = cells.join(F.broadcast(per), "cell").select(
        "cell", F.pmod(F.xxhash64(ident), F.col("__c")).alias("cb"), numbers("__q").alias("qb"), ident, "__v")
    right = asked.join(F.broadcast(per), "cell").select(
        "cell", numbers("__c").alias("cb"), F.pmod(F.xxhash64("query_id"), F.col("__q")).alias("qb"), "query_id", "__v")

    def score(c: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(qs):
            return pd.DataFrame({"query_id": [], ident: [], "score": []})
        best = _Best(_unit_rows(np.stack(qs["__v"].to_numpy()).astype("float64")), k)
        best.add(c[ident].to_numpy(dtype=object), np.stack(c["__v"].to_numpy()).astype("float64"))
        return best.frame(list(qs["query_id"]), ident)

    keys = ["cell", "cb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, schema)


def pruned_top_k(catalog: DataFrame, ident: str, vector: str, queries: DataFrame, k: int, pivots: int = PIVOTS,
                 block: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Exact cosine top-k for query batches (``query_id``, ``vector``) of any size: cells that cannot enter a list are skipped.

    Every product belongs to the nearest of ``pivots`` products drawn by hash; only a cell's size and largest angle reach
    the driver. A query first meets its best cells, then those whose bound reaches its k-th score. Which pivots are drawn
    changes the work, never the rows. Products or queries without a vector take no part; a zero vector scores zero.
    """
    cat = catalog.select(F.col(ident), F.col(vector).cast("array<double>").alias("__v")).where("__v IS NOT NULL")
    q = checkpointed(queries.select("query_id", F.col("vector").cast("array<double>").alias("__v")).where("__v IS NOT NULL"))
    schema = T.StructType([q.schema["query_id"], cat.schema[ident], T.StructField("score", T.DoubleType())])
    drawn = cat.where(F.exists("__v", lambda x: x != 0)).orderBy(F.xxhash64(ident), ident).limit(pivots).collect()
    if not drawn:
        drawn = cat.limit(1).collect()
    if not drawn:
        return cat.sparkSession.createDataFrame([], schema)
    points = _unit_rows(np.array([r["__v"] for r in drawn], dtype="float64"))
    cells = checkpointed(_near_pivot(cat, points))
    sizes = {r["cell"]: (r["n"], r["reach"]) for r in cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("angle").alias("reach")).collect()}
    rows = max(1, BLOCK_VALUES // points.shape[1])
    opening = checkpointed(_cells_to_ask(q, points, sizes, k, True))
    found = checkpointed(top_per_query(_meet(cells, opening, ident, k, schema, block, rows), k, ["query_id"], ident))
    floors = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("floor"))
    rest = checkpointed(_cells_to_ask(q.join(floors, "query_id"), points, sizes, k, False))
    both = found.drop("rank").unionByName(_meet(cells, rest, ident, k, schema, block, rows))
    return top_per_query(both, k, ["query_id"], ident)


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Unit mean vector per key, one aggregate row per (key, dimension)."""
    d = df.select(F.col(key).alias("query_id"), F.posexplode(vector).alias("i", "x"))
    m = d.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    arr = m.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("a"))  # one entry per dimension
    return arr.select("query_id", vx.unit(F.transform("a", lambda x: x["m"])).alias("vector"))


def more_like_this(catalog: DataFrame, ident: str, image: str, chosen: DataFrame, k: int) -> DataFrame:
    """Neighbours of stored products by image vector, never themselves; see ``fusion.similar_products`` for those without one."""
    q = catalog.join(F.broadcast(chosen.select(ident)) if fits(chosen, MAX_BROADCAST_QUERIES) else chosen.select(ident), ident)
    q = q.select(F.col(ident).alias("query_id"), F.col(image).alias("vector")).where("vector IS NOT NULL")
    hits = cosine_top_k(catalog, ident, image, q, k + 1).where(F.col(ident) != F.col("query_id"))
    return top_per_query(hits.drop("rank"), k, ["query_id"], ident)


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """``query_id`` and its distinct ``terms``; queries without a term are left out."""
    q = queries.select("query_id", F.array_distinct(tx.terms(F.col(text))).alias("terms"))
    return q.where(F.size("terms") > 0)


def _grams(text: Column) -> Column:
    """Distinct runs of two and of three characters."""
    def runs(width: int) -> Column:
        last = F.length(text) - (width - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(2), runs(3)))


def holding_substrings(d: DataFrame, ident: str, text: str, terms: DataFrame) -> DataFrame:
    """Distinct (row, term) pairs of terms (``term``, two characters or more) that a row's text holds as substrings.

    Rows are reduced to the asked runs of three characters (two, for terms of two); a term then looks rows up by the rarest of
    its runs alone, and what it finds is verified on the text.
    """
    want = F.when(F.length("term") > 2, F.filter(_grams(F.col("term")), lambda g: F.length(g) == 3)).otherwise(F.array("term"))
    asked = checkpointed(terms.select("term").distinct().select("term", F.explode(want).alias("gram")))
    held = d.select(ident, F.explode(_grams(F.col(text))).alias("gram")).join(small_side(asked.select("gram").distinct()), "gram", "left_semi")
    held = checkpointed(held)
    freq = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(freq, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = held.join(small_side(rarest), "gram").select(ident, "term").join(d.select(ident, text), ident)
    return found.where(F.contains(F.col(text), F.col("term"))).select(ident, "term").distinct()


def substring_scores(catalog: DataFrame, ident: str, queries: DataFrame, text: str, fields: Sequence[str],
                     candidate_fields: Sequence[str], name: str, k: int) -> DataFrame:
    """Share of query terms found as substrings; a hit in the name counts twice.

    Products are found through the runs of characters of the terms; only (query, product) rows with a match are scored.
    """
    hay = F.lower(F.concat_ws(" ", *[F.col(f) for f in fields]))
    near = F.lower(F.concat_ws("\n", *[F.col(f) for f in candidate_fields]))
    head = F.lower(F.coalesce(F.col(name), F.lit("")))
    d = catalog.select(F.col(ident), hay.alias("__hay"), near.alias("__near"), head.alias("__head"))
    q = checkpointed(query_terms(queries, text))
    wanted = q.select("query_id", F.explode("terms").alias("term"))
    pairs = holding_substrings(d, ident, "__near", wanted).join(small_side(wanted), "term").select("query_id", ident).distinct()

    def hits(c: str) -> Column:
        return F.aggregate("terms", F.lit(0), lambda n, t: n + F.contains(F.col(c), t).cast("int"))

    found = pairs.join(small_side(q), "query_id").join(d, ident)
    found = found.select("query_id", ident, ((hits("__hay") + hits("__head")) / (2.0 * F.size("terms"))).alias("score"))
    return top_per_query(found, k, ["query_id"], ident)


# Weight per field of the ranked keyword channel.
FIELD_WEIGHTS = {"name": 1.0, "brand": 0.4, "category": 0.4, "subcategory": 0.4, "description": 0.2}


def _holding(d: DataFrame, ident: str, queries: DataFrame, query_text: str) -> DataFrame:
    """(query, row) pairs where the row (``ident``, ``__terms``) holds every term of the query, with ``__need``.

    Rows are first reduced to the terms that some query names. A row is then looked up only by the rarest term of each
    query, so common words never multiply into pairs; the other terms are checked on the matched rows.
    """
    q = query_terms(queries, query_text).withColumnRenamed("terms", "__need")
    wanted = q.select("query_id", F.explode("__need").alias("term"))
    held = d.select(ident, F.explode("__terms").alias("term")).join(small_side(wanted.select("term").distinct()), "term", "left_semi")
    held = checkpointed(held)
    freq = held.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(freq, "term", "left").groupBy("query_id").agg(
        F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    probe = small_side(q.join(rarest, "query_id"))
    have = held.groupBy(ident).agg(F.collect_set("term").alias("__have"))  # at most the terms of the batch
    hits = held.join(probe, "term").join(have, ident)
    return hits.where(F.size(F.array_except("__need", "__have")) == 0).select("query_id", ident, "__need")


def all_terms_scores(catalog: DataFrame, ident: str, queries: DataFrame, text: str, k: int,
                     weights: dict[str, float] | None = None) -> DataFrame:
    """Products that hold every term of a query, ranked by summed field weights."""
    weights = weights or FIELD_WEIGHTS
    d = catalog.select(F.col(ident), *[tx.terms(F.coalesce(F.col(f), F.lit(""))).alias(f"__{f}") for f in weights])
    terms = d.select(ident, F.array_distinct(F.concat(*[F.col(f"__{f}") for f in weights])).alias("__terms"))

    def weight_of(t: Column) -> Column:
        return sum((F.size(F.filter(f"__{f}", lambda x: x == t)) * w for f, w in weights.items()), F.lit(0.0))

    score = F.aggregate("__need", F.lit(0.0), lambda s, t: s + weight_of(t))
    found = _holding(terms, ident, queries, text).join(d, ident).select("query_id", ident, score.alias("score"))
    return top_per_query(found, k, ["query_id"], ident)


def holding_every_term(docs: DataFrame, ident: str, text: str, queries: DataFrame, query_text: str) -> DataFrame:
    """(query, document) pairs where the document holds every term of the query."""
    d = docs.select(F.col(ident), F.array_distinct(tx.terms(F.col(text))).alias("__terms"))
    return _holding(d, ident, queries, query_text).select("query_id", ident)


def alignment(pairs: DataFrame, ident: str, a: str, b: str) -> DataFrame:
    """Mean similarity of matched pairs, mismatched pairs and pairs within each side.

    The mean over all pairs is the product of the summed vectors, so nothing is crossed.
    """
    d = pairs.select(F.col(ident), vx.unit(F.col(a)).alias("a"), vx.unit(F.col(b)).alias("b"))
    cells = F.posexplode(F.arrays_zip("a", "b")).alias("i", "x")
    sums = d.select(cells).groupBy("i").agg(F.sum("x.a").alias("sa"), F.sum("x.b").alias("sb"))
    whole = sums.agg(F.sum(F.col("sa") * F.col("sb")).alias("ab"), F.sum(F.col("sa") * F.col("sa")).alias("aa"),
                     F.sum(F.col("sb") * F.col("sb")).alias("bb"))
    own = d.agg(F.count(F.lit(1)).alias("pairs"), F.sum(vx.dot(F.col("a"), F.col("b"))).alias("m"),
                F.sum(vx.dot(F.col("a"), F.col("a"))).alias("na"), F.sum(vx.dot(F.col("b"), F.col("b"))).alias("nb"))
    n = F.col("pairs")
    off = n * (n - 1)
    return own.select(
        "pairs", (F.col("m") / n).alias("matched"),
        ((whole.select("ab").scalar() - F.col("m")) / off).alias("mismatched"),
        ((whole.select("aa").scalar() - F.col("na")) / off).alias("within_a"),
        ((whole.select("bb").scalar() - F.col("nb")) / off).alias("within_b"))


def own_match_rate(pairs: DataFrame, ident: str, a: str, b: str, chosen: Column | None = None) -> DataFrame:
    """Share of the chosen rows (default: all) whose best match among all rows of the other side is their own pair."""
    q = pairs.where(F.lit(True) if chosen is None else chosen).select(F.col(ident).alias("query_id"), F.col(a).alias("vector"))
    best = cosine_top_k(pairs, ident, b, q, 1)
    return best.agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("query_id") == F.col(ident)).cast("int")).alias("top1"))
