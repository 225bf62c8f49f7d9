"""Funding rounds: cleaning, investor pairs, audited and uncorrected aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.functions import cleaning as cl
from quarrylane.functions import vocab
from quarrylane.plans.prefix import exact_quantiles, join_null_safe
from quarrylane.session import checkpointed

RAW_COLUMNS = ("sr_no", "date_raw", "startup", "industry_raw", "subvertical", "city_raw",
               "investors_raw", "stage_raw", "amount_raw", "remarks")


def clean(raw: DataFrame, rupee_rows: Sequence[int] = vocab.CONFIRMED_RUPEE_ROWS,
          threshold: float = vocab.REVIEW_THRESHOLD) -> DataFrame:
    """Raw text columns to one tidy row per round, in one projection."""
    d = raw.select(*[cl.to_null(cl.unescape(F.col(c))).alias(c) for c in raw.columns])
    name = cl.display_name(F.col("startup"))
    key, merged = cl.alias(cl.match_key(name), name, vocab.STARTUP_ALIASES)
    day = cl.repaired_date(F.col("date_raw"))
    d = d.select(
        F.col("sr_no").try_cast("long").alias("sr_no"), day.alias("date"), merged.alias("startup"),
        key.alias("startup_key"), cl.industry(F.col("industry_raw")).alias("industry"), "subvertical",
        cl.city(F.col("city_raw")).alias("city"), F.col("investors_raw").alias("investors"),
        cl.stage(F.col("stage_raw")).alias("stage"), cl.amount(F.col("amount_raw")).alias("amount_usd"),
        "remarks", F.year(day).alias("year"), F.date_format(day, "yyyy-MM").alias("month"))
    big = ((F.col("amount_usd") >= threshold) & ~F.col("startup_key").isin(list(vocab.KNOWN_LARGE)))
    in_rupees = F.col("sr_no").isin([int(r) for r in rupee_rows])
    d = d.withColumn("amount_flag", F.when(in_rupees, "confirmed_inr_not_usd")
                     .when(F.coalesce(big, F.lit(False)), "review_outlier"))
    rate = F.when(in_rupees, F.lit(vocab.RUPEES_PER_DOLLAR)).otherwise(F.lit(1.0))
    return d.withColumn("amount_usd_adj", F.col("amount_usd") / rate)


def money_safe(rounds: DataFrame) -> DataFrame:
    """Rows that may be summed: an amount is present and it is not under review."""
    return rounds.where(F.col("amount_usd_adj").isNotNull()
                        & ~F.col("amount_flag").eqNullSafe("review_outlier"))


def investor_pairs(rounds: DataFrame) -> DataFrame:
    """One row per investor and round; placeholders dropped before anything moves."""
    d = rounds.select("sr_no", "date", "year", "startup", "city", "industry", "stage", "amount_usd",
                      "amount_usd_adj", "amount_flag",
                      F.explode(cl.split_names(F.col("investors"))).alias("investor"))
    d = d.where(~cl.is_placeholder_name(F.col("investor")))
    key, name = cl.alias(cl.match_key(F.col("investor")), F.col("investor"), vocab.INVESTOR_ALIASES)
    return d.withColumns({"investor_key": key, "investor": name})


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def one_row_to_long(row: DataFrame, names: Sequence[str], key: str, values: Sequence[str]) -> DataFrame:
    """Turn one wide row ``<name>__<value>`` into one row per name."""
    out = F.explode(F.array(*[
        F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{v}").alias(v) for v in values]) for n in names]))
    return row.select(out.alias("x")).select(f"x.{key}", *[f"x.{v}" for v in values])


def placeholder_profile(df: DataFrame, tokens: Sequence[str] = vocab.PROFILE_PLACEHOLDERS) -> DataFrame:
    """NULLs and placeholder texts per column, all columns in one pass."""
    aggs = []
    for c in df.columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__n_null"),
                 F.count_if(F.lower(F.trim(F.col(c).cast("string"))).isin(list(tokens)))
                 .alias(f"{c}__n_placeholder")]
    return one_row_to_long(df.agg(*aggs), df.columns, "column_name", ["n_null", "n_placeholder"])


def pattern_counts(df: DataFrame, column: str, patterns: Mapping[str, str]) -> DataFrame:
    """Occurrences of each regular expression in a text column."""
    return df.agg(*[F.coalesce(F.sum(F.regexp_count(F.col(column), F.lit(p))), F.lit(0)).alias(n)
                    for n, p in patterns.items()])


def grouping_style(df: DataFrame, column: str, order: str, samples: int = 3) -> DataFrame:
    """How many values group digits in twos, and the first few of them."""
    hits = df.where(cl.lakh_grouped(F.col(column)))
    n = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    return hits.orderBy(order).limit(samples).select(order, column, n.alias("n_grouped"))


def parse_failures(raw: DataFrame) -> DataFrame:
    """Unparsed dates and amounts before and after repair."""
    date, amount = F.col("date_raw"), F.col("amount_raw")
    return raw.agg(
        F.count_if(cl.strict_day_first_date(date).isNull()).alias("dates_before"),
        F.count_if(cl.repaired_date(cl.unescape(date)).isNull()).alias("dates_after"),
        F.count_if(cl.naive_amount(amount).isNull()).alias("amounts_before"),
        F.count_if(cl.amount(cl.unescape(amount)).isNull()).alias("amounts_after"))


def label_fragmentation(raw: DataFrame, rounds: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Distinct labels per raw column and in its cleaned column."""
    a = raw.agg(*[F.countDistinct(r).alias(f"{r}__n") for r in pairs])
    b = rounds.agg(*[F.countDistinct(c).alias(f"{r}__n") for r, c in pairs.items()])
    before = one_row_to_long(a, list(pairs), "label", ["n"]).withColumnRenamed("n", "raw_labels")
    after = one_row_to_long(b, list(pairs), "label", ["n"]).withColumnRenamed("n", "clean_labels")
    return before.join(after, "label")


def published_and_corrected(rounds: DataFrame) -> DataFrame:
    """Total as published and corrected, and how much one fix moves."""
    safe = F.col("amount_usd_adj").isNotNull() & ~F.col("amount_flag").eqNullSafe("review_outlier")
    d = rounds.agg(F.sum("amount_usd").alias("published"), F.sum("amount_usd_adj").alias("corrected"),
                   F.sum(F.when(safe, F.col("amount_usd_adj"))).alias("money_safe"),
                   F.avg(F.col("amount_usd").isNull().cast("int")).alias("share_without_amount"))
    moved = F.col("published") - F.col("corrected")
    return d.withColumns({"moved": moved, "moved_share": F.try_divide(moved, F.col("published"))})


def disclosure(rounds: DataFrame, key: str, amount: str, min_rows: int = 20) -> DataFrame:
    """Share of rows that state an amount, per level with enough rows."""
    d = rounds.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rounds"), F.count(amount).alias("with_amount"))
    return d.where(F.col("n_rounds") >= min_rows).withColumn(
        "disclosure", F.col("with_amount") / F.col("n_rounds"))


def leaderboard(df: DataFrame, key: str, name: str, value: str, order: str, n: int = 10) -> DataFrame:
    """Top entities by total value; the name comes from the earliest row."""
    return (df.groupBy(key).agg(F.min_by(name, order).alias("name"), F.count(F.lit(1)).alias("n_rounds"),
                                F.sum(value).alias("total"))
            .orderBy(F.desc("total"), key).limit(n))


def investor_leaderboard(pairs: DataFrame, n: int = 10) -> DataFrame:
    """Most active investors by distinct rounds; ``pairs`` is read three times.

    Rounds and startups are counted one after the other, and names by their first round, so that every step is a hash
    aggregate of plain keys and numbers: no row is repeated per counted column and none is sorted by text.
    """
    key = "investor_key"
    deals = pairs.select(key, "sr_no").distinct().groupBy(key).agg(F.count("sr_no").alias("deals"))
    startups = pairs.select(key, "startup").distinct().groupBy(key).agg(F.count("startup").alias("startups"))
    first = pairs.groupBy(key, "investor").agg(F.min("sr_no").alias("sr_no"))
    top = checkpointed(deals.orderBy(F.desc("deals"), key).limit(n))
    # A row per spelling of at most n investors; a missing number comes last.
    names = join_null_safe(first, F.broadcast(top.select(key)), [key], "left_semi").groupBy(key).agg(
        F.min_by("investor", F.struct(F.col("sr_no").isNull(), "sr_no", "investor")).alias("name"))
    found = join_null_safe(join_null_safe(top, names, [key]), startups, [key])
    return found.select(key, "name", "deals", "startups").orderBy(F.desc("deals"), key)


def single_deal_share(pairs: DataFrame) -> DataFrame:
    """Share of investors seen in one round only."""
    per = pairs.groupBy("investor_key").agg(F.countDistinct("sr_no").alias("deals"))
    return per.agg(F.count(F.lit(1)).alias("investors"),
                   F.avg((F.col("deals") == 1).cast("int")).alias("single_deal_share"))


def concentration(rounds: DataFrame, n: int = 8) -> DataFrame:
    """Largest cities by rounds, with their summed amounts and the metro share."""
    safe = ~F.col("amount_flag").eqNullSafe("review_outlier")
    metro = rounds.agg(F.avg(F.coalesce(F.col("city").isin(list(vocab.METROS)), F.lit(False)).cast("int"))
                       .alias("s")).scalar()
    return (rounds.where(F.col("city").isNotNull()).groupBy("city").agg(
        F.count(F.lit(1)).alias("n_rounds"), F.sum(F.when(safe, F.col("amount_usd_adj"))).alias("capital"))
        .orderBy(F.desc("n_rounds"), "city").limit(n).withColumn("metro_share", metro))


def head_share(df: DataFrame, value: str, heads: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """Share of the total in the largest n values, with mean and exact median."""
    largest = max(heads)
    top = (df.where(F.col(value).isNotNull()).select(value).orderBy(F.desc(value)).limit(largest)
           .agg(F.sort_array(F.collect_list(value), asc=False).alias("v")))
    stats = df.agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    total = stats.select("total").scalar()
    median = exact_quantiles(df, value, {"m": 0.5}).scalar()
    mean = stats.select("mean").scalar()
    head = F.explode(F.array(*[F.lit(h) for h in heads])).alias("head")
    first = F.aggregate(F.slice("v", F.lit(1), F.col("head")), F.lit(0.0), lambda s, x: s + x)
    return (top.select("v", head).where(F.size("v") >= F.col("head"))
            .select("head", (first / total).alias("share"), mean.alias("mean"), median.alias("median"),
                    (mean / median).alias("mean_over_median")))


def debris_cells(df: DataFrame) -> DataFrame:
    """Cells that still hold a backslash, over every text column."""
    total = sum((F.count_if(F.coalesce(F.contains(F.col(c), F.lit("\\")), F.lit(False)))
                 for c in text_columns(df)), F.lit(0))
    return df.agg(total.alias("debris_cells"))


def naive_amounts(raw: DataFrame) -> DataFrame:
    return raw.withColumn("amount", cl.naive_amount(F.col("amount_raw")))


def naive_summary(raw: DataFrame) -> DataFrame:
    """Headline figures of the uncorrected arm, with the largest single round."""
    d = naive_amounts(raw)
    best = F.max_by(F.struct("startup", "date_raw"), F.struct("amount", -F.col("sr_no").cast("long")))
    return d.agg(F.count(F.lit(1)).alias("n_rounds"), F.count("amount").alias("amounts_parsed"),
                 F.sum("amount").alias("total"), F.countDistinct("city_raw").alias("distinct_cities"),
                 F.max("amount").alias("largest"), best.alias("b")).select(
        "n_rounds", "amounts_parsed", "total", "distinct_cities", "largest",
        F.col("b.startup").alias("largest_startup"), F.col("b.date_raw").alias("largest_date"))


def naive_years(raw: DataFrame) -> DataFrame:
    """Rounds per year as the uncorrected arm reads them: only well-formed day-first dates count."""
    formed = F.col("date_raw").rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$")
    day = F.try_to_timestamp(F.when(formed, F.col("date_raw")), F.lit("d/M/yyyy"))
    return raw.select(F.year(day).alias("year")).where("year IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Most frequent values of a column."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), column).limit(n))


def coverage_by_year(rounds: DataFrame, deals: Mapping[int, int], capital: Mapping[int, float],
                     first: int, last: int) -> DataFrame:
    """Yearly counts and sums next to published totals, with coverage ratios."""
    spark = rounds.sparkSession
    safe = ~F.col("amount_flag").eqNullSafe("review_outlier")
    here = rounds.groupBy("year").agg(
        F.count(F.lit(1)).alias("rounds_here"),
        F.sum(F.when(safe, F.col("amount_usd_adj"))).alias("capital_here"))
    years = sorted({*deals, *capital})
    actual = spark.createDataFrame(
        [(y, deals.get(y), capital.get(y)) for y in years],
        "year int, rounds_actual long, capital_actual double")
    return (here.join(F.broadcast(actual), "year", "full_outer")
            .where(F.col("year").between(first, last))
            .withColumns({
                "deal_coverage": F.try_divide(F.col("rounds_here"), F.col("rounds_actual")),
                "capital_coverage": F.try_divide(F.col("capital_here"), F.col("capital_actual"))}))


def yearly_median(rounds: DataFrame) -> DataFrame:
    """Median adjusted amount of summable rounds and disclosure rate, per year."""
    med = exact_quantiles(money_safe(rounds), "amount_usd_adj", {"median_amount": 0.5}, ["year"])
    rate = rounds.where(F.col("year").isNotNull()).groupBy("year").agg(
        F.avg(F.col("amount_usd").isNotNull().cast("int")).alias("disclosure"))
    return rate.join(med, "year", "left")


def with_money_text(df: DataFrame, column: str, to: str) -> DataFrame:
    return df.withColumn(to, cl.money_text(F.col(column)))
