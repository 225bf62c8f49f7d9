"""Ranking metrics over ranked lists, and relevance rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.plans.hotkeys import heavy_cut, partition_count
from quarrylane.plans.prefix import running_totals
from quarrylane.session import checkpointed

RULE_FIELDS = ("categories", "subcategories", "colours", "genders", "usages", "brands")


def ideal_gain(depth: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(depth.cast("int"), F.lit(1))), F.lit(0.0),
                       lambda s, i: s + 1 / F.log2(i + 1.0))


def query_scores(ranked: DataFrame, relevant_counts: DataFrame, cutoffs: Sequence[int],
                 keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """Precision, recall, nDCG per cutoff, AP, RR and first hit per query.

    ``ranked`` holds one row per retrieved item with ``rank`` and ``is_relevant``; a
    list is at most the retrieval depth. ``relevant_counts`` gives ``n_relevant``.
    """
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("is_relevant").cast("int")
    d = ranked.withColumn("__hits", F.sum(hit).over(w))
    deep = max(cutoffs)
    aggs = [F.count(F.lit(1)).alias("retrieved"),
            F.min(F.when(hit == 1, F.col("rank"))).alias("first_relevant_rank"),
            F.sum(F.when((hit == 1) & (F.col("rank") <= deep), F.col("__hits") / F.col("rank")).otherwise(0.0)).alias("__ap")]
    for k in cutoffs:
        inside = (F.col("rank") <= k) & (hit == 1)
        aggs += [F.count_if(inside).alias(f"__h{k}"),
                 F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"__g{k}")]
    on = [c for c in keys if c in relevant_counts.columns]
    g = d.groupBy(*keys).agg(*aggs).join(relevant_counts, on)
    n = F.col("n_relevant")
    cols = {"average_precision": F.coalesce(F.try_divide(F.col("__ap"), F.least(n, F.lit(deep))), F.lit(0.0)),
            "reciprocal_rank": F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0))}
    for k in cutoffs:
        cols |= {f"precision_{k}": F.col(f"__h{k}") / k, f"recall_{k}": F.coalesce(F.try_divide(F.col(f"__h{k}"), n), F.lit(0.0)),
                 f"ndcg_{k}": F.when(n > 0, F.col(f"__g{k}") / ideal_gain(F.least(n, F.lit(k)))).otherwise(0.0)}
    return g.withColumns(cols).drop("__ap", *[f"__{x}{k}" for k in cutoffs for x in "hg"])


def macro_summary(scores: DataFrame, cutoffs: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Each query counts once; queries without a defined score are left out before."""
    aggs = [F.count(F.lit(1)).alias("queries"), F.avg("reciprocal_rank").alias("mrr"), F.avg("average_precision").alias("map")]
    for k in cutoffs:
        aggs += [F.avg(f"{m}_{k}").alias(f"{m}_{k}") for m in ("precision", "recall", "ndcg")]
    return scores.groupBy(*keys).agg(*aggs)


def nearest_rank(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Nearest-rank percentile of a per-query number: the least value that the fraction of all rows does not exceed."""
    counts = checkpointed(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n").alias("t")).scalar()
    upto = running_totals(counts, value, ["__n"])
    return upto.where(F.col("cum___n") >= F.ceil(F.lit(float(fraction)) * total)).agg(F.min(value).alias("p"))


KEY = ["field", "value", "field2", "value2"]


def _cells(low: DataFrame, ident: str, fields: Sequence[str], hot: DataFrame) -> DataFrame:
    """One row per product and field; in a hot cell also one per second field, so that rules may name two values at once."""
    whole = F.struct(F.lit("").alias("field2"), F.lit("").alias("value2"))
    two = [F.when((F.col("field") != p) & F.col(p).isNotNull(), F.struct(F.lit(p).alias("field2"), F.col(p).alias("value2"))) for p in fields]
    d = low.select(ident, *fields, F.inline(F.array(*[F.struct(F.lit(p).alias("field"), F.col(p).alias("value")) for p in fields])))
    d = d.where("value IS NOT NULL").join(F.broadcast(hot), ["field", "value"], "left")
    return d.withColumn("x", F.explode(F.when(F.col("hot"), F.array_compact(F.array(whole, *two))).otherwise(F.array(whole)))).select(
        ident, *fields, "field", "value", "x.*")


def spread_pairs(cells: DataFrame, probe: DataFrame, ident: str, cut: int) -> DataFrame:
    """Products and rules of equal key; a key with over ``cut`` products is dealt out, and its rules are repeated per part."""
    size = cells.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    # Keys over the cut are few by its definition: at most the number of rows over it.
    parts = checkpointed(size.where(F.col("n") > cut).select(*KEY, F.ceil(F.col("n") / cut).cast("int").alias("parts")))
    many = F.coalesce("parts", F.lit(1))
    left = cells.join(F.broadcast(parts), KEY, "left").withColumn("part", F.pmod(F.xxhash64(ident), many)).drop("parts")
    right = probe.join(F.broadcast(parts), KEY, "left").withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).drop("parts")
    return left.join(right.withColumn("part", F.col("part").cast("long")), [*KEY, "part"])


def relevant_pairs(rules: DataFrame, products: DataFrame, ident: str, fields: dict[str, str], cut: int | None = None) -> DataFrame:
    """(query, product) pairs where a product satisfies every field of a rule.

    ``rules`` holds query_id, list columns named in ``fields`` and ``exclude_ids``. A product is looked up by the one field
    of a rule that admits the fewest products; the other fields are checked on the matched rows. Where that field's value is
    hot (over ``cut`` products; by default a small share of a partition's), the rule's next field is looked up with it, and
    what is still hot is dealt out over several tasks. NULL in a field of the product satisfies no list.
    """
    none = F.array().cast("array<string>")
    lists = {p: F.array_distinct(F.transform(F.coalesce(F.col(r), none), lambda v: F.lower(v))) for r, p in fields.items()}
    r = rules.select("query_id", "exclude_ids", *[c.alias(f"__r_{p}") for p, c in lists.items()])

    def rule_cell(p: str) -> Column:
        return F.transform(f"__r_{p}", lambda v: F.struct(F.lit(p).alias("field"), v.alias("value")))

    cells = r.select("query_id", F.explode(F.concat(*[rule_cell(p) for p in lists])).alias("x")).select("query_id", "x.*")
    low = products.select(ident, *[F.lower(F.col(p)).alias(p) for p in lists])
    cell = F.explode(F.array(*[F.struct(F.lit(p).alias("field"), F.col(p).alias("value")) for p in lists])).alias("x")
    size = checkpointed(low.select(cell).where("x.value IS NOT NULL").groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n")))
    total = size.agg(F.sum("n")).first()[0] or 0
    cut = cut or heavy_cut(int(total), partition_count(products.sparkSession))
    hot = size.where(F.col("n") > cut).select("field", "value", F.lit(True).alias("hot"))
    reach = cells.join(size, ["field", "value"], "left").groupBy("query_id", "field").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    # A rule has one row per field: two of them are taken.
    order = reach.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "field"))).alias("f"))
    narrow = order.select("query_id", F.get("f", F.lit(0))["field"].alias("field"), F.get("f", F.lit(1))["field"].alias("next"))
    probe = cells.join(narrow, ["query_id", "field"]).join(r, "query_id").join(F.broadcast(hot), ["field", "value"], "left")
    values = F.coalesce(*[F.when(F.col("hot") & (F.col("next") == p), F.col(f"__r_{p}")) for p in lists], F.array(F.lit("")))
    probe = probe.withColumn("value2", F.explode(values)).withColumn(
        "field2", F.when(F.col("hot"), F.coalesce("next", F.lit(""))).otherwise("")).drop("hot", "next")
    m = spread_pairs(_cells(low, ident, list(lists), hot), probe, ident, cut)
    for p in lists:
        m = m.where((F.size(f"__r_{p}") == 0) | F.coalesce(F.array_contains(f"__r_{p}", F.col(p)), F.lit(False)))
    return m.where(~F.array_contains(F.coalesce("exclude_ids", none), F.col(ident).cast("string"))).select("query_id", ident)


def runnable(rules: DataFrame, pairs: DataFrame, min_relevant: int = 2) -> DataFrame:
    """Relevant products per query and why a query is skipped."""
    n = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    d = rules.select("query_id").join(n, "query_id", "left")
    c = F.coalesce("n", F.lit(0))
    reason = F.when(c < min_relevant, F.concat(F.lit("only "), c.cast("string"), F.lit(" relevant product(s) in this catalogue")))
    return d.select("query_id", c.alias("n_relevant"), reason.alias("skip_reason"))
