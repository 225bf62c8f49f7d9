"""Ranked lexical search, term at a time with a limited number of accumulators.

The query terms of an item are taken rarest first. A term's documents get accumulators (partial scores) as long as the terms
that remain, this one included, could still lift an untouched document to the k-th best partial score; from there on no
accumulator is created, and the remaining, frequent terms only update those that exist, exactly. Documents are reduced to
the asked terms first; each task goes through its share of them in batches, and the k-th best score of the batches before
bounds the next one from its first term on. The lists of all tasks are merged by one ranked window.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.common import written

TOP = 10
#: Query terms (bytes of text) that travel to the tasks at once; more items are searched in further rounds over the postings.
QUERY_BYTES = 8 << 20
BATCH_ROWS = 4096
_TERM_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: A-Z become lower case, every other byte that no term has becomes a space.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _TERM_BYTES else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, repeats included: runs of ASCII letters, digits and other characters beyond ASCII."""
    return (text or "").encode().translate(_TABLE).split()


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items with their distinct terms, in blocks of about QUERY_BYTES of text; rows that repeat an id are one item."""
    ident, text = F.col(f"`{item_col}`"), F.col(f"`{text_col}`").cast("string")
    total = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = 1 + int(total) // QUERY_BYTES
    slim = items.select(ident.alias("item"), text.alias("text"))
    for b in range(blocks):
        found: dict = {}
        for r in slim.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toLocalIterator():
            found.setdefault(r["item"], set()).update(terms_of(r["text"]))
        if found:
            yield [(i, sorted(t)) for i, t in found.items()]


def postings(docs: DataFrame, id_col: str, text_col: str, codes: dict[bytes, int]) -> DataFrame:
    """One row per document: ``id``, ``n`` (its terms with repeats), and of the asked terms ``codes`` and ``tfs``."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, many = codes.get, pa.list_(pa.int32())
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch, sizes, own, tfs = whole.slice(at, 512), [], [], []
                for t in batch.column(1):
                    terms = terms_of(t.as_py())
                    counts = Counter(map(get, terms))
                    counts.pop(None, None)
                    sizes.append(len(terms))
                    own.append(list(counts))
                    tfs.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(own, many), pa.array(tfs, many)], names=["id", "n", "codes", "tfs"])

    kind = slim.schema["id"].dataType.simpleString()
    return written(slim.mapInArrow(run, f"id {kind}, n long, codes array<int>, tfs array<int>"), "postings")


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Plan:
    """An item's terms, rarest first: code, weight, and what this term and all after it can add at most."""

    def __init__(self, codes: Sequence[int], weights: Sequence[int], best: Sequence[int]) -> None:
        self.codes, self.weights = list(codes), list(weights)
        bounds = np.array([w * b for w, b in zip(weights, best)], dtype=np.int64)
        self.remaining = np.cumsum(bounds[::-1])[::-1] if len(bounds) else bounds


def partial_scores(plan: Plan, lists: dict[int, tuple[np.ndarray, np.ndarray]], rows: int, known: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have an accumulator and their exact scores. ``known`` is a score that k documents of other batches reach."""
    score = np.zeros(rows, dtype=np.int64)
    has = np.zeros(rows, dtype=bool)
    least, open_, kept = known, True, None
    for code, w, remaining in zip(plan.codes, plan.weights, plan.remaining):
        if open_ and remaining < least:
            open_, kept = False, np.flatnonzero(has)
        found = lists.get(code)
        if found is None:
            continue
        at, part = found
        if open_:
            score[at] += w * part
            has[at] = True
            live = score[has]
            if len(live) >= k:
                least = max(least, int(np.partition(live, len(live) - k)[len(live) - k]))
        elif len(kept) < len(at):
            place = np.minimum(np.searchsorted(at, kept), len(at) - 1)
            hit = at[place] == kept
            score[kept[hit]] += w * part[place[hit]]
        else:
            hit = has[at]
            score[at[hit]] += w * part[hit]
    return np.flatnonzero(has), score[has]


def _order(row: tuple) -> tuple:
    return (-row[0], row[1] is None, row[1])


def block_top(found: DataFrame, items: Sequence, plans: Sequence[Plan], docs: int, length: int, k: int, item_type: str) -> DataFrame:
    """``item``, ``id`` and ``score``: the best k documents of every task for every item."""
    def lists_of(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        sizes, codes, tfs = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
        row = np.repeat(np.arange(len(batch)), np.diff(codes.offsets.to_numpy()))
        code, tf = codes.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        m = 10 + (90 * sizes * docs) // length
        part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        by = np.argsort(code, kind="stable")
        code, row, part = code[by], row[by], part[by]
        cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, dtype=np.int64)
        return {int(code[a]): (row[a:b], part[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(code)])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in plans]
        kind = None
        for whole in batches:
            kind = whole.schema.field(0).type
            for start in range(0, len(whole), BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                lists, ids = lists_of(batch), batch.column(0)
                for q, plan in enumerate(plans):
                    known = best[q][-1][0] if len(best[q]) == k else 1
                    at, score = partial_scores(plan, lists, len(batch), known, k)
                    near = score >= known
                    at, score = at[near], score[near]
                    if len(score) > k:
                        near = score >= np.partition(score, len(score) - k)[len(score) - k]
                        at, score = at[near], score[near]
                    if len(score):
                        rows = zip(score.tolist(), ids.take(pa.array(at)).to_pylist())
                        best[q] = heapq.nsmallest(k, [*best[q], *rows], key=_order)
        out = [(items[q], i, s) for q, rows in enumerate(best) for s, i in rows]
        if out:
            item, ident, score = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ident, kind), pa.array(score, pa.int64())], names=["item", "id", "score"])

    return found.mapInArrow(run, f"item {item_type}, id {found.schema['id'].dataType.simpleString()}, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every item with their ``rank``; first within slices of an item, then among their winners."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    cut = found.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["item", "slice"], ["item"]):
        cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return cut.select("item", F.col("rank").cast("int").alias("rank"), "id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", k: int = TOP) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score``: the k best documents of every item with a score above 0.

    Scores are integers: a term's weight times ``(1000000000 tf) div (1000 tf + 8 m)``, summed over the item's distinct terms.
    Null and empty texts, and those without terms, are not counted as documents and never found; an item without terms has no
    rows. Rows that repeat an item's id are one item; rows that repeat a document's id are documents of their own. Equal
    scores come by ascending id, null ids last. Texts of any length are read whole. Without documents or items the result is
    empty; other columns are not read.
    """
    spark, result = docs.sparkSession, None
    kinds = {"item": items.schema[item_col].dataType.simpleString(), "id": docs.schema[id_col].dataType.simpleString()}
    for block in item_blocks(items, item_col, item_text):
        codes = {t: c for c, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        found = postings(docs, id_col, text_col, codes)
        total = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("length")).first()
        if not total["docs"]:
            continue
        n, length = int(total["docs"]), int(total["length"])
        each = found.select(F.expr(f"10 + (90 * n * {n}L) div {length}L").alias("m"), F.explode(F.arrays_zip("codes", "tfs")).alias("t"))
        part = F.expr("(1000000000L * t.tfs) div (1000L * t.tfs + 8L * m)")
        seen = {r["code"]: r for r in each.groupBy(F.col("t.codes").alias("code")).agg(F.count(F.lit(1)).alias("df"), F.max(part).alias("best")).toLocalIterator()}
        plans = []
        for _, terms in block:
            own = sorted((seen[c]["df"], c) for c in map(codes.__getitem__, terms) if c in seen)
            plans.append(Plan([c for _, c in own], [weight(df, n) for df, _ in own], [seen[c]["best"] for _, c in own]))
        one = block_top(found, [i for i, _ in block], plans, n, length, k, kinds["item"])
        result = one if result is None else result.union(one)
    if result is None:
        result = spark.createDataFrame([], f"item {kinds['item']}, id {kinds['id']}, score long")
    return best_of(result, k).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
