"""Data audits: missing, ranges, domains, consistency, duplicates, leaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.operators.rounds import one_row_to_long
from quarrylane.plans.hotkeys import join_counted
from quarrylane.plans.prefix import running_totals


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pass the table on, or name the columns it lacks."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty when the key is unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass a join side on when its key is unique."""
    if not unique_key(df, keys).isEmpty():
        raise ValueError(f"key {list(keys)} is not unique")
    return df


def row_key(columns: Sequence[str]) -> Column:
    """Hash of a row's values that keeps NULL apart from text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def missing_or_blank(df: DataFrame) -> DataFrame:
    """NULL or whitespace-only cells per column, one pass."""
    aggs = [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"{c}__n")
            for c in df.columns]
    return one_row_to_long(df.agg(*aggs), df.columns, "column_name", ["n"])


def out_of_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values outside their allowed range, per column."""
    aggs = []
    for c, (lo, hi) in ranges.items():
        v = F.col(c).try_cast("double")
        aggs.append(F.count_if((v < F.lit(float(lo))) | (v > F.lit(float(hi)))).alias(f"{c}__n"))
    return one_row_to_long(df.agg(*aggs), list(ranges), "column_name", ["n"])


def unexpected_values(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values not in their column's domain; the allowed ones are dropped before the shuffle."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 F.when(~F.col(c).cast("string").isin(list(v)), F.col(c).cast("string")).alias("value"))
        for c, v in domains.items()]))
    return (df.select(cells.alias("x")).select("x.*").where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def inconsistencies(df: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Rows where two conditions that must agree do not, per rule."""
    names = list(rules)
    row = df.agg(*[F.count_if(~a.eqNullSafe(b)).alias(f"r{i}__n") for i, (a, b) in enumerate(rules.values())])
    long = one_row_to_long(row, [f"r{i}" for i in range(len(names))], "rule_no", ["n"])
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.substring("rule_no", 2, 9).cast("int") + 1)
    return long.select(label.alias("rule"), "n")


def duplicate_counts(df: DataFrame, ident: str, features: Sequence[str]) -> DataFrame:
    """Repeated rows, ids and feature vectors."""
    d = df.select(row_key(df.columns).alias("r"), F.col(ident).alias("i"), row_key(features).alias("f"))
    n = F.count(F.lit(1))
    return d.agg((n - F.countDistinct("r")).alias("exact"), (n - F.countDistinct("i")).alias("by_id"),
                 (n - F.countDistinct("f")).alias("by_features"))


def grouped_labels(df: DataFrame, features: Sequence[str], label: str, order: str) -> DataFrame:
    """Per distinct feature vector: rows, whether its labels conflict, and its first row."""
    return df.select(row_key(features).alias("group_id"), label, order).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), (F.min(label) != F.max(label)).alias("conflict"),
        F.min(order).alias("first_row"))


def deduplicate(df: DataFrame, features: Sequence[str], label: str, order: str) -> DataFrame:
    """Keep the first of equal rows; keep every row of a group whose labels conflict.

    Groups are reduced by a map-side aggregate, and the kept rows are found by their
    group and row order, or their conflicting group, so no group is ever gathered. Rows
    that share both a group and its first order value all stay.
    """
    groups = grouped_labels(df, features, label, order)
    d = df.withColumn("group_id", row_key(features))
    firsts = groups.where(~F.col("conflict")).select("group_id", F.col("first_row").alias(order))
    conflicts = groups.where("conflict").select("group_id", "n")
    keep_first = d.join(firsts, ["group_id", order], "left_semi").select(*d.columns)
    keep_all = join_counted(d, conflicts, "group_id", "n").select(*d.columns)
    return keep_first.withColumn("conflict", F.lit(False)).unionByName(
        keep_all.withColumn("conflict", F.lit(True)))


def dedup_report(df: DataFrame, features: Sequence[str], label: str, order: str) -> DataFrame:
    """Rows removed as harmless repeats, and rows and groups with conflicting labels."""
    g = grouped_labels(df, features, label, order)
    return g.agg(
        F.sum(F.when(~F.col("conflict"), F.col("n") - 1).otherwise(0)).alias("n_removed"),
        F.sum(F.when(F.col("conflict"), F.col("n")).otherwise(0)).alias("n_conflicting_rows"),
        F.count_if("conflict").alias("n_conflicting_groups"))


def redundancy(df: DataFrame, actual: Column, expected: Column) -> DataFrame:
    """R squared of a column against the value other columns imply."""
    d = df.select(actual.cast("double").alias("y"), expected.cast("double").alias("f")).where("y IS NOT NULL")
    return d.agg((1 - F.sum(F.pow(F.col("y") - F.col("f"), 2)) / (F.var_pop("y") * F.count("y"))).alias("r2"))


def contamination(train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
    """Test rows whose feature vector also occurs in training."""
    a = train.select(row_key(features).alias("k")).distinct()
    b = test.select(row_key(features).alias("k"))
    return b.join(a, "k", "left_semi").agg(F.count(F.lit(1)).alias("n_overlap"))


def single_feature_quality(df: DataFrame, label: str, numeric: Sequence[str],
                           categorical: Sequence[str], suspect: float = 0.95) -> DataFrame:
    """AUC of each column used alone, every column in one pass.

    Numbers are ranked as they are, in the better direction; categories are ranked
    by the positive rate of their level.
    """
    y = F.col(label).cast("long")
    cells = F.explode(F.array(
        *[F.struct(F.lit(c).alias("feature"), F.lit(None).cast("string").alias("level"),
                   F.col(c).cast("double").alias("v")) for c in numeric],
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level"),
                   F.lit(None).cast("double").alias("v")) for c in categorical]))
    counts = (df.select(y.alias("y"), cells.alias("x")).groupBy("x.feature", "x.level", "x.v")
              .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    score = F.coalesce("v", F.col("pos") / (F.col("pos") + F.col("neg")))
    q = ranking_quality_of_counts(counts.select("feature", score.alias("score"), "pos", "neg"), ["feature"])
    auc = F.greatest("roc_auc", 1 - F.col("roc_auc"))
    return q.select("feature", auc.alias("auc"), (auc >= suspect).alias("suspect"))


def ranking_quality_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC AUC from counts per (keys, score)."""
    c = counts.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    r = running_totals(c, "score", ["pos", "neg"], keys, descending=True)
    wins = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return r.groupBy(*keys).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def composite(checks: Mapping[str, DataFrame]) -> DataFrame:
    """Stack audit tables into (check, subject, value) rows.

    Each table gives its first column as the subject and its last as the value.
    """
    out = None
    for name, df in checks.items():
        part = df.select(F.lit(name).alias("check_name"), F.col(df.columns[0]).cast("string").alias("subject"),
                         F.col(df.columns[-1]).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def changed_columns(before: DataFrame, after: DataFrame, keys: Sequence[str],
                    columns: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Columns whose values differ between two builds of the same feature table."""
    b = after.select(*keys, *[F.col(c).alias(f"__b_{c}") for c in columns])
    d = before.select(*keys, *columns).join(b, list(keys))
    numeric = {f.name for f in before.schema.fields
               if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte")}

    def differs(c: str) -> Column:
        x, y = F.col(c), F.col(f"__b_{c}")
        if c not in numeric:
            return ~x.eqNullSafe(y)
        x, y = (F.coalesce(v.cast("double"), F.lit(-999.0)) for v in (x, y))
        return F.abs(x - y) > F.lit(atol) + F.lit(rtol) * F.abs(y)

    row = d.agg(*[F.count_if(differs(c)).alias(f"{c}__n") for c in columns])
    return one_row_to_long(row, list(columns), "feature", ["n"]).where("n > 0")

