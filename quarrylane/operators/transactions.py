"""Payment transactions: features, rule, class balance and factor codes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.functions.cleaning import is_close
from quarrylane.operators.rankstats import correlation
from quarrylane.plans.hotkeys import join_counted
from quarrylane.plans.prefix import running_totals
from quarrylane.session import checkpointed

FEATURES = ("hour", "amount", "amountLog", "oldbalanceOrg", "newbalanceOrg", "oldbalanceDest",
            "newbalanceDest", "errBalOrig", "errBalDest", "drainedOrig", "amtRatioOrig",
            "origZeroBefore", "destZeroBefore", "destZeroAfter", "destIsMerchant")
RULE_TYPES = ("TRANSFER", "CASH_OUT")


def flag(c: Column) -> Column:
    return c.cast("int")


def with_features(df: DataFrame) -> DataFrame:
    """Hour, balance residuals, drain and zero flags, ratios."""
    c = F.col
    return df.withColumns({
        "hour": F.pmod(c("step"), F.lit(24)),
        "errBalOrig": c("newbalanceOrg") + c("amount") - c("oldbalanceOrg"),
        "errBalDest": c("oldbalanceDest") + c("amount") - c("newbalanceDest"),
        "drainedOrig": flag((c("newbalanceOrg") == 0) & (c("oldbalanceOrg") > 0)),
        "amtRatioOrig": c("amount") / (c("oldbalanceOrg") + F.lit(1e-9)),
        "origZeroBefore": flag(c("oldbalanceOrg") == 0),
        "destZeroBefore": flag(c("oldbalanceDest") == 0),
        "destZeroAfter": flag(c("newbalanceDest") == 0),
        "amountLog": F.log1p("amount"),
        "destIsMerchant": flag(c("nameDest").startswith("M")),
    })


def indicators(column: str, levels: Sequence[str], drop_first: bool = True) -> list[Column]:
    """0/1 columns per level in alphabetical order."""
    kept = sorted(levels)[1:] if drop_first else sorted(levels)
    return [flag(F.col(column).eqNullSafe(v)).alias(f"{column}_{v}") for v in kept]


def design_matrix(df: DataFrame, levels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Model inputs: features plus type indicators; the raw step and ids stay out."""
    return with_features(df).select(*keep, *FEATURES, *indicators("type", levels), "isFraud")


def baseline_frame(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Uncorrected arm: raw columns, all type indicators, identifiers dropped."""
    raw = [c for c in df.columns if c not in ("type", "nameOrig", "nameDest")]
    return df.select(*raw, *indicators("type", levels, drop_first=False))


def drain_rule(df: DataFrame) -> Column:
    """The sender is emptied by a transfer of exactly the whole balance."""
    return ((F.col("newbalanceOrg") == 0) & (F.col("oldbalanceOrg") > 0)
            & F.col("type").isin(list(RULE_TYPES)) & is_close(F.col("amount"), F.col("oldbalanceOrg")))


def class_balance(df: DataFrame, label: str, order: str, ident: str) -> DataFrame:
    """Counts per class, rate, imbalance, NULLs, order range and distinct ids in one pass."""
    y = F.col(label).cast("long")
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(y).alias("positives"), F.sum(1 - y).alias("negatives"),
        F.avg(y).alias("rate"),
        (F.sum(1 - y) / F.greatest(F.sum(y), F.lit(1))).alias("imbalance"),
        nulls.alias("n_nulls"), F.min(order).alias("first_step"), F.max(order).alias("last_step"),
        F.countDistinct(ident).alias("distinct_ids"))


def rate_by(df: DataFrame, key: str | Column, label: str, name: str = "level") -> DataFrame:
    """Rows, positives and rate per level, most positives first."""
    k = F.col(key) if isinstance(key, str) else key
    y = F.col(label).cast("long")
    return (df.groupBy(k.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"),
                                          F.avg(y).alias("rate"))
            .orderBy(F.desc("positives"), name))


def contingency(df: DataFrame, condition: Column, label: str) -> DataFrame:
    """Two-by-two counts of a condition against the label, with both conditional rates."""
    d = df.select(condition.alias("f"), F.col(label).cast("long").alias("y"))
    hit, pos = F.col("f"), F.col("y") == 1
    return d.agg(
        F.count_if(~hit & ~pos).alias("n00"), F.count_if(~hit & pos).alias("n01"),
        F.count_if(hit & ~pos).alias("n10"), F.count_if(hit & pos).alias("n11"),
        F.avg(F.when(hit, F.col("y"))).alias("p_label_given_flag"),
        F.avg(F.when(pos, hit.cast("int"))).alias("p_flag_given_label"))


def confusion_of_rule(df: DataFrame, rule: Column, label: str) -> DataFrame:
    """TP, FP, FN, precision and recall of a boolean rule."""
    pos = F.col(label) == 1
    a = df.agg(F.count_if(rule & pos).alias("tp"), F.count_if(rule & ~pos).alias("fp"),
               F.count_if(~rule & pos).alias("fn"))
    one = F.lit(1)
    return a.withColumns({
        "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one),
        "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)})


def factor_codes(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """Integer code of each value in order of first appearance (NULL gets -1), and its ``rows``."""
    seen = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.min(row_id).alias("__first"), F.count(F.lit(1)).alias("rows"), F.lit(1).cast("long").alias("one"))
    ranked = running_totals(seen, "__first", ["one"])
    return ranked.select(column, (F.col("cum_one") - 1).alias(f"code_{column}"), "rows")


def factor_correlation(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Pearson correlation of first-appearance codes, one row per column pair."""
    d = df.select(row_id, *columns)
    for c in columns:
        d = join_counted(d, checkpointed(factor_codes(df, c, row_id)), c, "rows", "left")
    code = {c: F.coalesce(F.col(f"code_{c}"), F.lit(-1)).cast("double") for c in columns}
    pairs = list(combinations(columns, 2))
    row = d.agg(*[correlation(code[a], code[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    out = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)]))
    return row.select(out.alias("x")).select(
        F.col("x.a").alias("left_column"), F.col("x.b").alias("right_column"),
        F.col("x.r").alias("correlation"))
