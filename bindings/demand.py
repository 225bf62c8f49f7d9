"""Daily demand panel from line items: one series per brand and supplier region."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bindings.registry import Tables, hash_sql, query
from quarrylane.functions.calendar import us_holidays, with_calendar
from quarrylane.operators import audit, features, forecasts, inventory, panel, splits
from quarrylane.plans.bounded import small_side
from quarrylane.session import checkpointed

TEST_START, TEST_END = dt.date(2001, 5, 7), dt.date(2001, 6, 3)
FIRST = dt.date(1995, 1, 1)
TEST_ORIGIN = TEST_START - dt.timedelta(days=1)
FOLDS = splits.rolling_folds(TEST_START)
FOLD_ORIGINS = [f.origin for f in FOLDS]
H = list(range(1, 29))
TERMS = inventory.PolicyTerms()
ECON = inventory.StockEconomics()
# Weekly origins whose protection window ends before the test window.
ERROR_ORIGINS = [TEST_ORIGIN - dt.timedelta(days=14 + 7 * i) for i in range(10)]

PANEL = """
sales AS (SELECT p_brand || '|' || r_name AS series_id, l_shipdate::DATE AS date, p_brand AS sku_id, r_name AS store_id,
    sum(l_quantity) AS demand, avg(l_extendedprice / l_quantity) AS sell_price, (round(avg(l_discount), 9) >= 0.05)::BIGINT AS snap
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
spans AS (SELECT series_id, sku_id, store_id, min(date) AS f FROM sales GROUP BY ALL),
days AS (SELECT series_id, sku_id, store_id, unnest(generate_series(f, (SELECT max(date) FROM sales), INTERVAL 1 DAY))::DATE AS date FROM spans),
panel AS MATERIALIZED (SELECT d.series_id, d.date, coalesce(s.demand, 0) AS demand, s.sell_price, coalesce(s.snap, 0) AS snap, d.sku_id, d.store_id,
    'C' || length(d.sku_id) AS cat_id, d.sku_id[1:7] AS dept_id FROM days d LEFT JOIN sales s USING (series_id, date))"""


def sales(t: Tables):
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    places = (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name"))
    d = (li.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
         .join(places, F.col("l_suppkey") == F.col("s_suppkey")))
    return d.groupBy(F.concat_ws("|", "p_brand", "r_name").alias("series_id"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_quantity").alias("demand"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("sell_price"),
        (F.round(F.avg("l_discount"), 9) >= 0.05).cast("long").alias("snap"))


def attributes(df):
    sku, store = F.split_part("series_id", F.lit("|"), F.lit(1)), F.split_part("series_id", F.lit("|"), F.lit(2))
    return df.withColumns({"sku_id": sku, "store_id": store, "cat_id": F.concat(F.lit("C"), F.length(sku)),
                           "dept_id": F.substring(sku, 1, 7)})


def base(t: Tables):
    return panel.dense_panel(t.kept("sales", lambda: sales(t)), {"demand": 0.0, "snap": 0})


def full(t: Tables):
    return attributes(base(t))


def d(x: dt.date) -> str:
    return f"DATE '{x}'"


@query("panel_build", f"""WITH {PANEL} SELECT series_id, store_id, cat_id, year(date)::BIGINT AS year, count(*) AS n, round(sum(demand), 6) AS demand,
  round(avg(sell_price), 4) AS price, sum(snap)::BIGINT AS snap_days FROM panel GROUP BY ALL""", digits=4)
def panel_build(t: Tables):
    """Stacked targets joined with validated static and temporal tables, summed per year."""
    s = t.kept("sales", lambda: sales(t))
    cut = F.lit(TEST_START)
    static = attributes(s.select("series_id").distinct())
    target = panel.dense_panel(s.select("series_id", "date", "demand"), {"demand": 0.0})
    temporal = s.select("series_id", "date", "sell_price", "snap")
    p = panel.build_panel([target.where(F.col("date") < cut), target.where(F.col("date") >= cut)], static, temporal)
    return p.groupBy("series_id", "store_id", "cat_id", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("demand").alias("demand"), F.avg("sell_price").alias("price"),
        F.sum(F.coalesce("snap", F.lit(0))).alias("snap_days"))


CLASSED = f"""WITH {PANEL}, k0 AS (SELECT series_id, sku_id, store_id, cat_id, count(*) AS n_periods, count(*) / (count(*) FILTER (demand > 0))::DOUBLE AS adi,
  (stddev_samp(demand) FILTER (demand > 0) / avg(demand) FILTER (demand > 0)) ** 2 AS cv2 FROM panel GROUP BY ALL),
k AS (SELECT *, CASE WHEN coalesce(adi, 1e300) < 1.32 THEN CASE WHEN coalesce(cv2, 0) < 0.49 THEN 'Smooth' ELSE 'Erratic' END
   ELSE CASE WHEN coalesce(cv2, 0) < 0.49 THEN 'Intermittent' ELSE 'Lumpy' END END AS demand_class FROM k0)"""


@query("panel_selected_items", CLASSED + f""", c AS (SELECT sku_id, cat_id, demand_class, count(*) AS n FROM k WHERE n_periods >= 730 GROUP BY ALL),
i AS (SELECT sku_id, cat_id, sum(n)::BIGINT AS n_stores, arg_min(demand_class, (-n, demand_class)) AS demand_class FROM c GROUP BY 1, 2),
e AS (SELECT *, count(*) OVER (PARTITION BY cat_id, demand_class) AS size, count(*) OVER () AS total,
        row_number() OVER (PARTITION BY cat_id, demand_class ORDER BY {hash_sql('sku_id', 42)}, sku_id) AS rn
      FROM i WHERE n_stores = (SELECT count(DISTINCT store_id) FROM panel))
SELECT sku_id, cat_id, n_stores, demand_class FROM e WHERE rn <= greatest(round_even(size / total::DOUBLE * 12, 0), 1) ORDER BY sku_id LIMIT 12""")
def selected_items(t: Tables):
    """Items sampled per category and demand class."""
    return panel.select_series(full(t), 12, 730)


@query("panel_equal_class_sample", CLASSED + f""", o AS (SELECT series_id, demand_class,
  row_number() OVER (PARTITION BY demand_class ORDER BY {hash_sql('series_id', 42)}, series_id) AS rn FROM k)
SELECT series_id, demand_class FROM o WHERE rn <= 7 ORDER BY series_id LIMIT 30""")
def equal_class_sample(t: Tables):
    """The same number of series from every demand class."""
    s = panel.demand_stats(base(t))
    s = s.withColumn("demand_class", panel.demand_class(F.col("adi"), F.col("cv2")))
    return panel.equal_sample(s, "demand_class", "series_id", 30, 4).select("series_id", "demand_class")


STATS = f"""WITH {PANEL}, st0 AS (SELECT series_id, count(*) AS n_periods, count(*) FILTER (demand > 0) AS n_nonzero, sum(demand) AS total_demand,
  avg(demand) AS mean_demand, avg(demand) FILTER (demand > 0) AS nonzero_mean, stddev_samp(demand) FILTER (demand > 0) AS nonzero_std
  FROM panel WHERE date <= {d(TEST_ORIGIN)} GROUP BY 1),
st1 AS (SELECT *, 1 - n_nonzero / n_periods::DOUBLE AS zero_share, n_periods / n_nonzero::DOUBLE AS adi, (nonzero_std / nonzero_mean) ** 2 AS cv2 FROM st0),
st2 AS (SELECT *, CASE WHEN coalesce(adi, 1e300) < 1.32 THEN CASE WHEN coalesce(cv2, 0) < 0.49 THEN 'Smooth' ELSE 'Erratic' END
   ELSE CASE WHEN coalesce(cv2, 0) < 0.49 THEN 'Intermittent' ELSE 'Lumpy' END END AS demand_class,
   row_number() OVER (ORDER BY total_demand DESC, series_id) AS rank,
   sum(total_demand) OVER (ORDER BY total_demand DESC, series_id) / (SELECT greatest(sum(total_demand), 1e-9) FROM st0) AS cum_share FROM st1),
seg AS (SELECT *, CASE WHEN round(cum_share, 12) <= 0.70 THEN 'A' WHEN round(cum_share, 12) <= 0.90 THEN 'B' ELSE 'C' END AS volume_class FROM st2) """


def seg(t: Tables):
    return panel.segments(base(t), TEST_ORIGIN)


@query("panel_demand_stats", STATS + """SELECT series_id, n_periods, n_nonzero, round(total_demand, 6) AS total_demand, round(mean_demand, 6) AS mean_demand,
  round(nonzero_mean, 6) AS nonzero_mean, round(nonzero_std, 6) AS nonzero_std, round(zero_share, 6) AS zero_share, round(adi, 6) AS adi, round(cv2, 6) AS cv2,
  demand_class FROM seg""")
def demand_stats(t: Tables):
    """Intermittency statistics and demand class."""
    s = panel.demand_stats(base(t).where(F.col("date") <= F.lit(TEST_ORIGIN)))
    return s.withColumn("demand_class", panel.demand_class(F.col("adi"), F.col("cv2")))


@query("panel_segments", STATS + """SELECT series_id, rank, round(cum_share, 6) AS cum_share, volume_class, demand_class,
  volume_class || '-' || demand_class AS segment FROM seg""")
def segments(t: Tables):
    """Volume class by cumulative share, with the demand class."""
    return seg(t).select("series_id", "rank", "cum_share", "volume_class", "demand_class", "segment")


@query("panel_segment_summary", STATS + """SELECT demand_class, count(*) AS series, round(sum(total_demand), 6) AS total_demand,
  round(avg(mean_demand), 6) AS mean_daily_demand, round(avg(zero_share), 6) AS mean_zero_share, round(quantile_cont(adi, 0.5), 6) AS median_adi,
  round(quantile_cont(cv2, 0.5), 6) AS median_cv2, round(sum(total_demand) / (SELECT sum(total_demand) FROM seg), 6) AS demand_share,
  round(count(*) / (SELECT count(*) FROM seg)::DOUBLE, 6) AS series_share FROM seg GROUP BY 1""")
def segment_summary(t: Tables):
    """Size and character of each demand class."""
    return panel.segment_summary(seg(t))


@query("panel_volume_matrix", STATS + "SELECT volume_class, " + ", ".join(
    f"count(*) FILTER (demand_class = '{c}') AS \"{c}\"" for c in ("Erratic", "Intermittent", "Lumpy", "Smooth")) + " FROM seg GROUP BY 1")
def volume_matrix(t: Tables):
    """Series counts by volume and demand class."""
    return panel.volume_matrix(seg(t))


@query("panel_calendar_gaps", f"""WITH {PANEL} SELECT series_id, count(*) AS n, (max(date) - min(date) + 1)::BIGINT AS expected FROM sales
  GROUP BY 1 HAVING count(*) <> max(date) - min(date) + 1""")
def calendar_gaps(t: Tables):
    """Series whose selling days have holes."""
    return panel.calendar_gaps(sales(t))


@query("panel_dense_has_no_gaps", "SELECT 0::BIGINT AS n_series_with_gaps")
def dense_has_no_gaps(t: Tables):
    """The dense panel has none."""
    return panel.calendar_gaps(base(t)).agg(F.count(F.lit(1)).alias("n_series_with_gaps"))


@query("panel_zero_taxonomy", f"""WITH {PANEL}, b AS (SELECT series_id, min(date) FILTER (demand > 0) AS f, max(date) FILTER (demand > 0) AS l FROM panel GROUP BY 1),
z AS (SELECT demand = 0 AS z, demand = 0 AND date < f AS pre, demand = 0 AND date > l AS post FROM panel JOIN b USING (series_id))
SELECT count(*) FILTER (z) AS n_zero, round(avg(z::INT), 6) AS zero_share, count(*) FILTER (pre) AS n_pre_launch, count(*) FILTER (post) AS n_post_discontinuation,
  count(*) FILTER (z AND NOT pre AND NOT post) AS n_true_zero, round(count(*) FILTER (z AND NOT pre AND NOT post) / greatest(count(*) FILTER (z), 1)::DOUBLE, 6) AS true_zero_share FROM z""")
def zero_taxonomy(t: Tables):
    """Zeros before launch, after the end and in between."""
    return panel.zero_taxonomy(base(t))


@query("panel_lifecycle", f"""WITH {PANEL}, b AS (SELECT series_id, min(date) AS f, max(date) AS l, max(date) FILTER (demand > 0) AS ls FROM panel GROUP BY 1)
SELECT count(*) AS n_series, count(*) FILTER (f > (SELECT min(date) FROM panel)) AS n_launched_late, count(DISTINCT f) AS n_distinct_starts,
  count(*) FILTER ((SELECT max(date) FROM panel) - ls > 60) AS n_discontinued, min(l - f)::DOUBLE AS min_history_days,
  quantile_cont(l - f, 0.5)::DOUBLE AS median_history_days FROM b""")
def lifecycle(t: Tables):
    """Late launches, discontinued series and history length."""
    return panel.lifecycle(base(t))


@query("panel_spikes", f"""WITH {PANEL}, m AS (SELECT series_id, quantile_cont(demand, 0.5) AS med FROM panel WHERE demand > 0 GROUP BY 1)
SELECT count(*) AS n_spike_days, count(DISTINCT series_id) AS n_spike_series FROM panel JOIN m USING (series_id) WHERE demand > 3 * med""")
def spikes(t: Tables):
    """Days at more than three times the series' median sale."""
    return panel.spikes(base(t), 3.0)


@query("panel_coverage", f"""WITH {PANEL} SELECT count(DISTINCT series_id) AS n_series, count(DISTINCT sku_id) AS n_skus, count(DISTINCT store_id) AS n_stores,
  count(DISTINCT dept_id) AS n_departments, count(DISTINCT cat_id) AS n_categories,
  count(DISTINCT series_id) = count(DISTINCT sku_id) * count(DISTINCT store_id) AS complete_cross_product FROM panel""")
def coverage(t: Tables):
    """Series, items, stores and completeness."""
    return panel.coverage(full(t))


@query("panel_series_per_category", f"WITH {PANEL} SELECT cat_id, count(DISTINCT series_id) AS n_series FROM panel GROUP BY 1")
def series_per_category(t: Tables):
    """Series per category."""
    return panel.series_per(full(t), "cat_id")


@query("panel_audit", f"""WITH {PANEL} SELECT 'missing' AS check_name, 'sell_price' AS subject, count(*) FILTER (sell_price IS NULL)::DOUBLE AS value FROM panel
UNION ALL SELECT 'missing', 'demand', 0.0 UNION ALL SELECT 'range', 'demand', count(*) FILTER (demand > 100)::DOUBLE FROM panel
UNION ALL SELECT 'range', 'sell_price', count(*) FILTER (sell_price > 2000)::DOUBLE FROM panel UNION ALL SELECT 'gaps', 'all', 0.0""")
def panel_audit(t: Tables):
    """Missing, out-of-range and gap checks as one table."""
    p = base(t)
    return audit.composite({
        "missing": audit.missing_or_blank(p.select("sell_price", "demand")),
        "range": audit.out_of_range(p, {"demand": (0, 100), "sell_price": (0, 2000)}),
        "gaps": panel.calendar_gaps(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("subject"), "n")})


@query("panel_duplicate_days", f"""WITH {PANEL}, x AS (SELECT series_id, date FROM panel UNION ALL SELECT series_id, date FROM panel WHERE demand > 60 UNION ALL SELECT series_id, date FROM panel WHERE demand > 90),
n AS (SELECT count(*) AS n FROM x GROUP BY series_id, date) SELECT count(*) FILTER (n > 1) AS repeated_days, sum(n - 1)::BIGINT AS surplus_rows FROM n""")
def duplicate_days(t: Tables):
    """Repeated days of a series; days of large demand are planted twice or three times."""
    p = base(t)
    return panel.duplicate_days(p.unionByName(p.where("demand > 60")).unionByName(p.where("demand > 90")))


def _totals(name: str, sql: str, col):
    @query(f"panel_totals_by_{name}", f"WITH {PANEL} SELECT {sql} AS {name}, round(sum(demand), 6) AS total, round(avg(demand), 6) AS mean FROM panel GROUP BY 1")
    def totals(t: Tables):
        return panel.period_totals(base(t), col(), name)
    totals.__doc__ = f"Demand per {name}."


_totals("week", "date_trunc('week', date)::DATE", lambda: F.date_trunc("week", "date").cast("date"))
_totals("month", "month(date)::BIGINT", lambda: F.month("date"))
_totals("dow", "(isodow(date) - 1)::BIGINT", lambda: F.weekday("date"))
_totals("year", "year(date)::BIGINT", lambda: F.year("date"))


@query("panel_weekly_growth", f"""WITH {PANEL}, w AS (SELECT date_trunc('week', date) AS week, sum(demand) AS t FROM panel GROUP BY 1)
SELECT count(*) AS n_weeks, round((SELECT avg(t) FROM (SELECT t FROM w ORDER BY week DESC LIMIT 8)) / (SELECT avg(t) FROM (SELECT t FROM w ORDER BY week LIMIT 8)) - 1, 6) AS growth FROM w""")
def weekly_growth(t: Tables):
    """Last eight weeks over the first eight."""
    return panel.weekly_growth(base(t))


@query("panel_seasonality", f"""WITH {PANEL}, w AS (SELECT (isodow(date) - 1)::BIGINT AS dow, avg(demand) AS m FROM panel GROUP BY 1)
SELECT arg_max(dow, m) AS peak_dow, round(max(m) / min(m), 6) AS dow_ratio,
  round((SELECT 100 * (avg(demand) FILTER (snap = 1) / avg(demand) FILTER (snap = 0) - 1) FROM panel), 6) AS snap_lift_pct FROM w""")
def seasonality(t: Tables):
    """Busiest weekday and lift of flagged days."""
    return panel.seasonality(base(t))


PARETO = f"""WITH {PANEL}, q AS (SELECT series_id, sum(demand) AS total FROM panel GROUP BY 1),
c AS (SELECT series_id, total, row_number() OVER (ORDER BY total DESC, series_id) AS rank, sum(total) OVER (ORDER BY total DESC, series_id) / (SELECT sum(total) FROM q) AS cum_share FROM q) """


@query("panel_pareto", PARETO + "SELECT series_id, round(total, 6) AS total, rank, round(cum_share, 6) AS cum_share FROM c")
def pareto(t: Tables):
    """Cumulative share by ranked series."""
    return panel.pareto(base(t))


@query("panel_head_share", PARETO + "SELECT round(cum_share, 6) AS head_share FROM c WHERE rank = floor(0.2 * (SELECT count(*) FROM c)) + 1")
def head_share(t: Tables):
    """Share held by the top fifth of the series."""
    return panel.head_series_share(panel.pareto(base(t)))


@query("panel_price_bands", f"""WITH {PANEL}, p AS (SELECT * FROM panel WHERE demand > 0), m AS (SELECT series_id, quantile_cont(sell_price, 0.5) AS med FROM p GROUP BY 1),
r AS (SELECT demand, sell_price / med AS r FROM p JOIN m USING (series_id))
SELECT CASE WHEN r <= 0.85 THEN '<-15%' WHEN r <= 0.95 THEN '-15..-5%' WHEN r <= 1.05 THEN '±5%' WHEN r <= 1.15 THEN '+5..15%' ELSE '>+15%' END AS price_band,
  round(avg(demand), 6) AS mean_demand, count(*) AS n FROM r WHERE r > 0 AND r <= 10 GROUP BY 1""")
def price_bands(t: Tables):
    """Demand by price relative to the series' median."""
    return panel.price_bands(base(t))


@query("panel_volatility", f"""WITH {PANEL} SELECT series_id, round(avg(demand), 6) AS mean, round(stddev_samp(demand), 6) AS std,
  round(avg((demand > 0)::INT), 6) AS selling_day_share, round(stddev_samp(demand) / avg(demand), 6) AS cv FROM panel GROUP BY 1 HAVING avg(demand) > 0""")
def volatility(t: Tables):
    """Spread and selling-day share per series."""
    return panel.volatility(base(t))


@query("panel_unit_values", f"WITH {PANEL} SELECT series_id, round(avg(sell_price), 6) AS unit_value FROM panel WHERE date <= {d(TEST_ORIGIN)} GROUP BY 1")
def unit_values(t: Tables):
    """Mean price per series up to the origin."""
    return inventory.unit_values(base(t), TEST_ORIGIN)


@query("panel_last_rows", f"""WITH {PANEL} SELECT series_id, date, round(demand, 6) AS demand, snap FROM panel
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1""")
def last_rows(t: Tables):
    """Latest row per series."""
    return panel.keep_last(base(t).select("series_id", "date", "demand", "snap"), ["series_id"], "date")


@query("panel_future_rows", f"""WITH {PANEL}, l AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) = 1)
SELECT series_id, (DATE '2001-12-31' + h)::DATE AS date, NULL::DOUBLE AS demand, snap FROM l, unnest([1, 2, 3, 4, 5, 6, 7]) u(h)""")
def future_rows(t: Tables):
    """Last row carried over the horizon, demand unknown."""
    return panel.future_rows(base(t).select("series_id", "date", "demand", "snap"), dt.date(2001, 12, 31), 7)


@query("panel_folds", f"""WITH {PANEL}, f AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{f.name}', {d(f.origin)}, {d(f.start)}, {d(f.end)})" for f in FOLDS) + """) v(fold, origin, s, e))
SELECT fold, origin, count(*) FILTER (date <= origin) AS n_train, count(*) FILTER (date BETWEEN s AND e) AS n_eval,
  count(*) FILTER (date <= origin AND date > origin - 730) AS n_sliding FROM panel, f GROUP BY fold, origin""")
def folds(t: Tables):
    """Rolling-origin folds with expanding and sliding training rows."""
    p = base(t)
    parts = {}
    for f in FOLDS:
        day = F.col("date")
        parts[f.name] = splits.train_slice(p, splits.Fold(f.name, f.end, f.start, f.end)).agg(
            F.lit(f.origin).alias("origin"), F.count_if(day <= f.origin).alias("n_train"),
            F.count_if(day.between(f.start, f.end)).alias("n_eval"),
            F.count_if((day <= f.origin) & (day > f.origin - dt.timedelta(days=730))).alias("n_sliding"))
    return forecasts.stack_folds(parts)


def sup_sql(origins) -> str:
    """CTEs up to ``sup``: one row per series, origin and horizon with features and baselines."""
    vals = ", ".join(f"({d(o)})" for o in origins)
    roll = ", ".join(
        f"avg(demand) FILTER (origin - date < {w}) AS rolling_mean_{w}, stddev_samp(demand) FILTER (origin - date < {w}) AS rolling_std_{w}, "
        f"max(demand) FILTER (origin - date < {w}) AS rolling_max_{w}, count(*) FILTER (origin - date < {w} AND demand > 0) / {w}.0::DOUBLE AS nonzero_rate_{w}"
        for w in (7, 14, 28))
    lags = ", ".join(f"max(demand) FILTER (origin - date = {k - 1}) AS lag_{k}" for k in (1, 7, 14, 28))
    base_cols = ", ".join(
        (f"greatest(0, coalesce({c}, rolling_mean_7, lag_1, 0)) AS {n}" if c else f"0.0::DOUBLE AS {n}")
        for n, c in features.BASELINES.items())
    return f"""{PANEL}, org AS (SELECT * FROM (VALUES {vals}) v(origin)),
ph AS (SELECT p.*, origin FROM panel p JOIN org ON p.date <= origin),
f0 AS (SELECT series_id, origin, {lags}, {roll}, min(origin - date) FILTER (origin - date < 28 AND demand > 0) AS since,
  avg(demand) FILTER (origin - date < 28 AND demand > 0) AS mean_nonzero_size_28, avg(demand) AS hist_mean, stddev_samp(demand) AS hist_std,
  count(*) FILTER (demand > 0) / count(*)::DOUBLE AS hist_nonzero_rate, (origin - min(date))::BIGINT AS series_age_days,
  avg(sell_price) FILTER (origin - date < 28) AS price_mean_28_at_origin, max(sell_price) FILTER (origin = date) AS price_at_origin FROM ph GROUP BY series_id, origin),
sl AS (SELECT series_id, origin, date, demand, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id, origin) AS n,
  coalesce(date - lag(date) OVER w, date - greatest(origin - 364, {d(FIRST)}) + 1) AS gap FROM ph WHERE demand > 0 AND origin - date < 365
  WINDOW w AS (PARTITION BY series_id, origin ORDER BY date)),
cro AS (SELECT series_id, origin, sum(CASE WHEN i = 1 THEN 1 ELSE 0.1 END * pow(0.9::DOUBLE, n - i) * demand) / sum(CASE WHEN i = 1 THEN 1 ELSE 0.1 END * pow(0.9::DOUBLE, n - i) * gap) AS c FROM sl GROUP BY ALL),
f1 AS (SELECT f0.*, coalesce(since, 99)::BIGINT AS days_since_last_sale, rolling_mean_7 / nullif(rolling_mean_28, 0) AS trend_7_28,
  coalesce(c, 0) AS croston_at_origin, coalesce(c, 0) * 0.95 AS sba_at_origin FROM f0 LEFT JOIN cro USING (series_id, origin)),
s0 AS (SELECT f1.*, h AS horizon, (f1.origin + h::INT)::DATE AS target_date, (f1.origin + h::INT - 7 * ceil(h / 7.0)::INT)::DATE AS ref_date FROM f1, range(1, 29) r(h)),
sup AS (SELECT s0.*, a.demand AS y_true, a.sell_price, a.snap, b.demand AS snaive_lag, a.sell_price / nullif(price_at_origin, 0) AS price_ratio_vs_origin,
  1 - a.sell_price / nullif(price_mean_28_at_origin, 0) AS discount_vs_28d FROM s0 LEFT JOIN panel a ON a.series_id = s0.series_id AND a.date = target_date
  LEFT JOIN panel b ON b.series_id = s0.series_id AND b.date = ref_date WHERE a.demand IS NOT NULL),
pred AS (SELECT *, {base_cols} FROM sup)"""


ORIGIN_COLS = [*(f"lag_{k}" for k in (1, 7, 14, 28)), *(f"{s}_{w}" for w in (7, 14, 28) for s in (
    "rolling_mean", "rolling_std", "rolling_max", "nonzero_rate")), "mean_nonzero_size_28", "hist_mean", "hist_std", "hist_nonzero_rate",
    "price_mean_28_at_origin", "price_at_origin", "trend_7_28", "croston_at_origin", "sba_at_origin"]


@query("features_at_origins", f"WITH {sup_sql(FOLD_ORIGINS)} SELECT series_id, origin, series_age_days, days_since_last_sale, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in ORIGIN_COLS) + " FROM f1")
def features_at_origins(t: Tables):
    """Lags, rolling statistics, level, price state and Croston, per series and origin."""
    f = features.origin_features(base(t), FOLD_ORIGINS, FIRST)
    return f.select("series_id", "origin", "series_age_days", "days_since_last_sale", *ORIGIN_COLS)


@query("features_rolling_all_days", f"""WITH {PANEL}, r AS (SELECT series_id, date, avg(demand) OVER w AS m, max(demand) OVER w AS x,
  lag(demand, 6) OVER (PARTITION BY series_id ORDER BY date) AS l FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 6 PRECEDING))
SELECT series_id, round(sum(m), 6) AS mean_sum, round(sum(x), 6) AS max_sum, round(sum(l), 6) AS lag_sum FROM r GROUP BY 1""")
def rolling_all_days(t: Tables):
    """Rolling features ending at every day, summed per series."""
    r = features.rolling_for_all_days(base(t), (7,))
    return r.groupBy("series_id").agg(F.sum("rolling_mean_7").alias("mean_sum"), F.sum("rolling_max_7").alias("max_sum"),
                                      F.sum("lag_7").alias("lag_sum"))


HOLIDAYS = us_holidays(dt.date(1994, 1, 1), dt.date(2003, 1, 1))
HOL = "[" + ", ".join(d(h) for h in HOLIDAYS) + "]"


@query("features_calendar", f"""WITH q AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), h AS (SELECT unnest({HOL}) AS hd),
n AS (SELECT date, min(hd - date) FILTER (hd >= date) AS a, min(date - hd) FILTER (hd < date) AS b FROM q, h GROUP BY 1)
SELECT date, (isodow(date) - 1)::BIGINT AS dow, day(date)::BIGINT AS day_of_month, week(date)::BIGINT AS week_of_year, month(date)::BIGINT AS month,
  quarter(date)::BIGINT AS quarter, year(date)::BIGINT AS year, (isodow(date) >= 6)::BIGINT AS is_weekend, (day(date) = 1)::BIGINT AS is_month_start,
  (date = last_day(date))::BIGINT AS is_month_end, (a = 0)::BIGINT AS is_holiday,
  greatest(-30, least(30, CASE WHEN a <= b THEN a ELSE -b END))::BIGINT AS days_to_holiday,
  round(sin(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS dow_cos,
  round(sin(2 * pi() * dayofyear(date) / 365.25), 6) + 0.0 AS doy_sin, round(cos(2 * pi() * dayofyear(date) / 365.25), 6) + 0.0 AS doy_cos FROM n""")
def calendar(t: Tables):
    """Calendar, holidays and cyclical encodings of every order date."""
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return with_calendar(days, "date", HOLIDAYS)


@query("features_supervised", f"""WITH {sup_sql(FOLD_ORIGINS)} SELECT series_id, origin, horizon, target_date, y_true, round(sell_price, 6) AS sell_price, snap, snaive_lag,
  round(price_ratio_vs_origin, 6) AS price_ratio_vs_origin, round(discount_vs_28d, 6) + 0.0 AS discount_vs_28d, (series_age_days + horizon)::BIGINT AS product_age_days,
  (isodow(target_date) - 1)::BIGINT AS dow, round(rolling_mean_28, 6) AS rolling_mean_28, 'C' || length(split_part(series_id, '|', 1)) AS cat_id FROM sup""")
def supervised(t: Tables):
    """Series x origin x horizon rows with point-in-time lookups."""
    p = base(t)
    static = attributes(p.select("series_id").distinct())
    s = features.supervised(p, FOLD_ORIGINS, H, FIRST, small_side(static))
    return s.select("series_id", "origin", "horizon", "target_date", "y_true", "sell_price", "snap", "snaive_lag", "price_ratio_vs_origin",
                    "discount_vs_28d", "product_age_days", "dow", "rolling_mean_28", "cat_id")


@query("features_leak_probe", "SELECT 0::BIGINT AS n_changed_features")
def leak_probe(t: Tables):
    """Mutating every actual after the origin changes no feature."""
    p = base(t)
    o = FOLD_ORIGINS[-1]
    wrong = F.when(F.col("date") > F.lit(o), F.lit(500.0) + F.pmod(F.xxhash64("series_id", "date"), F.lit(500))).otherwise(F.col("demand"))
    a = features.supervised(p, [o], [1, 7, 28], FIRST)
    b = features.supervised(p.withColumn("demand", wrong), [o], [1, 7, 28], FIRST)
    skip = {"series_id", "origin", "horizon", "target_date", "ref_date", "y_true"}
    return audit.changed_columns(a, b, ["series_id", "target_date", "horizon"], [c for c in a.columns if c not in skip]).agg(
        F.count(F.lit(1)).alias("n_changed_features"))


def predictions(t: Tables, origins=FOLD_ORIGINS):
    s = features.with_baselines(features.supervised(base(t), origins, H, FIRST))
    return s.select("series_id", "origin", "target_date", "horizon", "y_true", "snap", *MODELS)


MODELS = list(features.BASELINES)


@query("forecast_baselines", f"WITH {sup_sql(FOLD_ORIGINS)} SELECT series_id, origin, horizon, y_true, " + ", ".join(
    f"round({m}, 6) AS {m}" for m in MODELS) + " FROM pred")
def baselines(t: Tables):
    """Seven baseline forecasts of every fold in one job."""
    return predictions(t).select("series_id", "origin", "horizon", "y_true", *MODELS)


@query("forecast_mase_scale", f"""WITH {PANEL}, org AS (SELECT * FROM (VALUES {", ".join(f"({d(o)})" for o in FOLD_ORIGINS)}) v(origin)),
df AS (SELECT series_id, date, abs(demand - lag(demand, 7) OVER (PARTITION BY series_id ORDER BY date)) AS x FROM panel)
SELECT series_id, origin, round(nullif(avg(x), 0), 6) AS mase_scale FROM df JOIN org ON date <= origin GROUP BY ALL""")
def mase_scale(t: Tables):
    """Seasonal-naive error of the history, per series and origin."""
    return features.seasonal_scale(base(t), FOLD_ORIGINS)


SCORE = """count(*) AS n, avg(abs(y_true - f)) AS mae, sqrt(avg((y_true - f) ** 2)) AS rmse,
  CASE WHEN sum(abs(y_true)) > 1e-9 THEN sum(abs(y_true - f)) / sum(abs(y_true)) END AS wape, avg(abs(y_true - f) / ms) FILTER (ms > 1e-9) AS mase,
  100 * avg(CASE WHEN abs(y_true) + abs(f) < 2e-9 THEN 0 ELSE abs(y_true - f) / ((abs(y_true) + abs(f)) / 2) END) AS smape, avg(f - y_true) AS bias,
  CASE WHEN sum(y_true) > 1e-9 THEN avg(f - y_true) * count(*) / sum(y_true) END AS bias_pct, avg((y_true = 0)::INT) AS zero_share_actual,
  avg((f < 0.5)::INT) AS pred_zero_share"""
LONG = f"""WITH {sup_sql(FOLD_ORIGINS)},
df AS (SELECT series_id, date, abs(demand - lag(demand, 7) OVER (PARTITION BY series_id ORDER BY date)) AS x FROM panel),
ms AS (SELECT series_id, origin, nullif(avg(x), 0) AS ms FROM df JOIN org ON date <= origin GROUP BY ALL),
lg AS (SELECT pred.series_id, pred.origin, horizon, y_true, snap, ms, m.model AS model, m.f AS f, 'fold_' || ((pred.origin - {d(FOLD_ORIGINS[0])}) // 28 + 1) AS fold
  FROM pred LEFT JOIN ms USING (series_id, origin), unnest([{", ".join(f"{{'model': '{m}', 'f': {m}::DOUBLE}}" for m in MODELS)}]) u(m))"""
ROUND = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in forecasts.SCORES)


def scored(t: Tables):
    p = base(t)
    pr = features.with_baselines(features.supervised(p, FOLD_ORIGINS, H, FIRST)).select(
        "series_id", "origin", "target_date", "horizon", "y_true", "snap", *MODELS)
    pr = pr.join(features.seasonal_scale(p, FOLD_ORIGINS), ["series_id", "origin"], "left")
    fold = F.concat(F.lit("fold_"), (F.floor(F.datediff("origin", F.lit(FOLD_ORIGINS[0])) / 28) + 1).cast("string"))
    return pr.withColumn("fold", fold)


@query("forecast_scores", f"{LONG}, g AS (SELECT model, {SCORE} FROM lg GROUP BY 1) SELECT model, n, {ROUND} FROM g")
def forecast_scores(t: Tables):
    """Full metric set per baseline over all folds."""
    return forecasts.scores(scored(t), MODELS, scale="mase_scale")


@query("forecast_scores_by_fold", f"{LONG}, g AS (SELECT model, fold, {SCORE} FROM lg GROUP BY ALL) SELECT model, fold, n, {ROUND} FROM g")
def scores_by_fold(t: Tables):
    """Scores per fold."""
    return forecasts.scores(scored(t), MODELS, ["fold"], scale="mase_scale")


@query("forecast_fold_summary", f"""{LONG}, g AS (SELECT model, fold, {SCORE} FROM lg GROUP BY ALL) SELECT model, count(DISTINCT fold) AS folds,
  {", ".join(f"round(avg({c}), 6) + 0.0 AS {c}" for c in ("mae", "rmse", "wape", "mase", "smape", "bias"))}, round(stddev_samp(wape), 6) AS wape_std FROM g GROUP BY 1""")
def fold_summary(t: Tables):
    """Mean and spread over the folds."""
    return forecasts.fold_summary(forecasts.scores(scored(t), MODELS, ["fold"], scale="mase_scale"))


@query("forecast_fold_pivot", f"""{LONG}, g AS (SELECT model, fold, {SCORE} FROM lg GROUP BY ALL) SELECT model,
  {", ".join(f"round(max(wape) FILTER (fold = 'fold_{i}'), 6) AS fold_{i}" for i in (1, 2, 3, 4))} FROM g GROUP BY 1""")
def fold_pivot(t: Tables):
    """Fold by fold table of one metric."""
    return forecasts.fold_pivot(forecasts.scores(scored(t), MODELS, ["fold"]), [f.name for f in FOLDS])


@query("forecast_paired_folds", f"""{LONG}, g AS (SELECT model, fold, {SCORE} FROM lg WHERE model IN ('sba', 'moving_average_28') GROUP BY ALL),
p AS (SELECT fold, max(wape) FILTER (model = 'sba') AS x, max(wape) FILTER (model = 'moving_average_28') AS y FROM g GROUP BY 1),
u AS (SELECT x AS v FROM p UNION ALL SELECT y FROM p)
SELECT count(*) AS folds, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b, round(avg(x) - avg(y), 6) + 0.0 AS difference,
  round((avg(x) - avg(y)) / (SELECT stddev_pop(v) FROM u), 3) AS difference_in_sd, round((avg(x) - avg(y)) / (stddev_samp(x - y) / sqrt(count(*))), 3) AS t_statistic FROM p""")
def paired_folds(t: Tables):
    """Paired comparison of two baselines over the folds."""
    r = forecasts.paired_folds(forecasts.scores(scored(t), ["sba", "moving_average_28"], ["fold"]), "sba", "moving_average_28", "wape")
    return r.withColumns({"difference_in_sd": F.round("difference_in_sd", 3), "t_statistic": F.round("t_statistic", 3)})


@query("forecast_skill", f"""{LONG}, g AS (SELECT model, {SCORE} FROM lg GROUP BY 1), r AS (SELECT wape AS w FROM g WHERE model = 'seasonal_naive')
SELECT model, round(wape, 6) AS wape, round(100 * (w - wape) / w, 6) + 0.0 AS skill_vs_seasonal_naive_pct FROM g, r""")
def skill(t: Tables):
    """Improvement over seasonal naive."""
    return forecasts.skill(forecasts.scores(scored(t), MODELS), "seasonal_naive").select("model", "wape", "skill_vs_seasonal_naive_pct")


@query("forecast_scores_by_horizon", f"{LONG}, g AS (SELECT model, horizon, {SCORE} FROM lg WHERE horizon IN (1, 7, 14, 28) GROUP BY ALL) SELECT model, horizon, n, {ROUND} FROM g")
def scores_by_horizon(t: Tables):
    """Accuracy at four horizons."""
    s = scored(t).where(F.col("horizon").isin(1, 7, 14, 28))
    return forecasts.scores(s, MODELS, ["horizon"], scale="mase_scale")


SEG_CTES = STATS.split(PANEL, 1)[1]
BYSEG = f"{LONG}{SEG_CTES}, g AS (SELECT model, demand_class, {SCORE} FROM lg JOIN seg USING (series_id) GROUP BY ALL)"


@query("forecast_scores_by_segment", f"{BYSEG} SELECT model, demand_class, n, {ROUND} FROM g")
def scores_by_segment(t: Tables):
    """Accuracy within each demand class."""
    s = scored(t).join(small_side(seg(t).select("series_id", "demand_class")), "series_id")
    return forecasts.scores(s, MODELS, ["demand_class"], scale="mase_scale")


@query("forecast_best_per_segment", f"""{BYSEG}, b AS (SELECT * FROM g WHERE wape IS NOT NULL QUALIFY row_number() OVER (PARTITION BY demand_class ORDER BY round(wape, 12), model) = 1)
SELECT demand_class, n, model AS best_model, round(wape, 6) AS best_wape, model AS best_baseline, round(wape, 6) AS baseline_wape, 0.0::DOUBLE AS improvement_pct FROM b""")
def best_per_segment(t: Tables):
    """Winner per demand class and its margin over the best baseline."""
    s = scored(t).join(small_side(seg(t).select("series_id", "demand_class")), "series_id")
    return forecasts.best_per_segment(forecasts.scores(s, MODELS, ["demand_class"]), "demand_class")


ERR = f"""WITH {sup_sql(FOLD_ORIGINS)}, e AS (SELECT series_id, count(*) AS n, sum(y_true) AS total_actual, sum(sba) AS total_pred, avg(abs(y_true - sba)) AS mae,
  sqrt(avg((y_true - sba) ** 2)) AS rmse, avg(sba - y_true) AS bias, sum(abs(y_true - sba)) / nullif(sum(y_true), 0) AS wape FROM pred GROUP BY 1),
hp AS (SELECT * FROM panel WHERE date <= {d(FOLD_ORIGINS[0])}), dm AS (SELECT series_id, isodow(date) AS w, avg(demand) AS m FROM hp GROUP BY ALL),
ws AS (SELECT hp.series_id, var_pop(m) / var_pop(demand) AS weekly_strength FROM hp JOIN dm ON dm.series_id = hp.series_id AND isodow(hp.date) = w GROUP BY hp.series_id),
ch AS (SELECT series_id, avg(demand) AS mean_demand, stddev_samp(demand) AS std_demand, sum(demand) AS total_demand, avg((demand = 0)::INT) AS zero_share, count(*) AS history_days,
  avg(sell_price) AS price_mean, stddev_samp(sell_price) / avg(sell_price) AS price_cv, avg(snap) AS snap_share, stddev_samp(demand) / avg(demand) AS cv_demand FROM hp GROUP BY 1)"""


def att(t: Tables):
    p = base(t)
    e = forecasts.series_errors(predictions(t), "sba")
    return forecasts.attribution(e, forecasts.series_characteristics(p.where(F.col("date") <= F.lit(FOLD_ORIGINS[0]))))


@query("forecast_series_errors", ERR + " SELECT series_id, n, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("total_actual", "total_pred", "mae", "rmse", "bias", "wape")) + " FROM e")
def series_errors(t: Tables):
    """Error of one model per series."""
    return forecasts.series_errors(predictions(t), "sba")


CH = ("mean_demand", "std_demand", "total_demand", "zero_share", "price_mean", "price_cv", "snap_share", "cv_demand", "weekly_strength")


@query("forecast_error_attribution", ERR + " SELECT series_id, history_days, round(wape, 6) AS wape, " + ", ".join(f"round({c}, 6) AS {c}" for c in CH) + " FROM e JOIN ch USING (series_id) JOIN ws USING (series_id)")
def error_attribution(t: Tables):
    """Error joined with the characteristics of each series."""
    return att(t).select("series_id", "history_days", "wape", *CH)


@query("forecast_worst_series", ERR + " SELECT series_id, round(total_actual, 6) AS total_actual, round(wape, 6) AS wape FROM e WHERE total_actual >= 10 ORDER BY e.wape DESC NULLS LAST, series_id LIMIT 15")
def worst_series(t: Tables):
    """Watch list by relative error."""
    return forecasts.worst_series(forecasts.series_errors(predictions(t), "sba")).select("series_id", "total_actual", "wape")


DRV = ("zero_share", "cv_demand", "mean_demand", "weekly_strength", "price_cv", "snap_share", "history_days")


@query("forecast_error_drivers", ERR + ", j AS (SELECT * FROM e JOIN ch USING (series_id) JOIN ws USING (series_id) WHERE total_actual >= 10), x AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS characteristic, {c}::DOUBLE AS x, wape AS y FROM j WHERE {c} IS NOT NULL" for c in DRV) + """),
r AS (SELECT characteristic, rank() OVER (PARTITION BY characteristic ORDER BY x) + (count(*) OVER (PARTITION BY characteristic, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY characteristic ORDER BY y) + (count(*) OVER (PARTITION BY characteristic, y) - 1) / 2.0 AS ry FROM x)
SELECT characteristic, round(corr(rx, ry), 4) + 0.0 AS spearman, count(*) AS n FROM r GROUP BY 1""", digits=4)
def error_drivers(t: Tables):
    """Rank correlation of series properties with error."""
    return forecasts.error_drivers(att(t), DRV)


@query("forecast_flagged_day_errors", f"""{LONG} SELECT CASE snap WHEN 1 THEN 'snap_day' ELSE 'non_snap_day' END AS condition, count(*) AS n,
  round(sum(abs(y_true - f)) / sum(abs(y_true)), 6) AS wape, round(avg(abs(y_true - f)), 6) AS mae, round(avg(f - y_true), 6) AS bias, round(avg(y_true), 6) AS mean_actual
  FROM lg WHERE model = 'sba' GROUP BY 1""")
def flagged_day_errors(t: Tables):
    """Accuracy on flagged days."""
    return forecasts.flagged_day_errors(predictions(t), "sba")


RESID = f"""WITH {sup_sql([*FOLD_ORIGINS, TEST_ORIGIN])}, rq AS (SELECT horizon, quantile_cont(y_true - sba, 0.1) AS a, quantile_cont(y_true - sba, 0.5) AS b,
  quantile_cont(y_true - sba, 0.9) AS c FROM pred WHERE origin < {d(TEST_ORIGIN)} GROUP BY 1),
iv AS (SELECT pred.*, greatest(0, sba + a) AS q10, greatest(0, sba + b) AS q50, greatest(0, sba + c) AS q90 FROM pred JOIN rq USING (horizon) WHERE origin = {d(TEST_ORIGIN)})"""


def intervals(t: Tables):
    p = base(t)
    every = checkpointed(features.with_baselines(features.supervised(p, [*FOLD_ORIGINS, TEST_ORIGIN], H, FIRST)).select(
        "series_id", "origin", "target_date", "horizon", "y_true", "sba"))
    resid = forecasts.residual_quantiles(every.where(F.col("origin") < F.lit(TEST_ORIGIN)), "sba")
    return resid, forecasts.with_intervals(every.where(F.col("origin") == F.lit(TEST_ORIGIN)), "sba", resid)


@query("forecast_residual_quantiles", RESID + " SELECT horizon, round(a, 6) AS resid_q10, round(b, 6) AS resid_q50, round(c, 6) AS resid_q90 FROM rq")
def residual_quantiles(t: Tables):
    """Validation error quantiles per horizon."""
    return intervals(t)[0]


@query("forecast_intervals", RESID + " SELECT series_id, horizon, y_true, round(sba, 6) AS sba, round(q10, 6) AS q10, round(q50, 6) AS q50, round(q90, 6) AS q90 FROM iv")
def residual_intervals(t: Tables):
    """Point forecasts with residual intervals on the test window."""
    return intervals(t)[1].select("series_id", "horizon", "y_true", "sba", "q10", "q50", "q90")


QS = {0.1: "q10", 0.5: "q50", 0.9: "q90"}
REPORT = """count(*) AS n, 0.8::DOUBLE AS nominal_coverage, round(avg((y_true BETWEEN q10 AND q90)::INT), 6) AS empirical_coverage, round(avg(q90 - q10), 6) AS mean_interval_width,
  round(quantile_cont(q90 - q10, 0.5), 6) AS median_interval_width, round(avg((y_true BETWEEN q10 AND q90)::INT) - 0.8, 6) AS coverage_gap, """ + ", ".join(
    f"round(avg(greatest({q} * (y_true - {c}), ({q} - 1) * (y_true - {c}))), 6) AS pinball_{c}, round(avg((y_true > {c})::INT), 6) AS exceedance_above_{c}" for q, c in QS.items())


@query("forecast_interval_report", RESID + f" SELECT {REPORT} FROM iv")
def interval_report(t: Tables):
    """Coverage, width, pinball loss and exceedance."""
    return forecasts.interval_report(intervals(t)[1], QS)


@query("forecast_interval_by_horizon", RESID + f" SELECT horizon, {REPORT} FROM iv GROUP BY 1")
def interval_by_horizon(t: Tables):
    """The same report per horizon."""
    return forecasts.interval_report(intervals(t)[1], QS, ["horizon"])


@query("forecast_lead_time_distribution", RESID + """ SELECT series_id, round(sum(sba), 6) AS lt_demand_point, round(sum(y_true), 6) AS lt_demand_actual,
  round(sqrt(sum(((q90 - q10) / 2) ** 2)), 6) AS lt_half_width, count(*) AS n_days, round(sqrt(sum(((q90 - q10) / 2) ** 2)) / 1.2816, 6) AS lt_sigma_implied FROM iv WHERE horizon <= 7 GROUP BY 1""")
def lead_time_distribution(t: Tables):
    """Lead-time demand with half widths in quadrature."""
    return forecasts.lead_time_distribution(intervals(t)[1], "q10", "q90", "sba", 7)


@query("forecast_monotone_quantiles", RESID + " SELECT series_id, horizon, round(q10, 6) AS x, round(q50, 6) AS y, round(q90, 6) AS z FROM iv")
def monotone_quantiles(t: Tables):
    """Crossed quantiles put back in order."""
    crossed = intervals(t)[1].select("series_id", "horizon", F.col("q90").alias("x"), F.col("q10").alias("y"), F.col("q50").alias("z"))
    return features.monotone_quantiles(crossed, ["x", "y", "z"])


# --- stock policy ---------------------------------------------------------------

POLICY = f"""WITH {sup_sql([*ERROR_ORIGINS, TEST_ORIGIN])},
le AS (SELECT series_id, origin, sum(y_true) AS lt_actual, sum(sba) AS lt_forecast, count(*) AS n_days, sum(y_true) - sum(sba) AS lt_error
  FROM pred WHERE horizon <= 14 AND origin < {d(TEST_ORIGIN)} GROUP BY ALL),
es0 AS (SELECT series_id, count(*) AS n_windows, avg(lt_error) AS error_mean, stddev_samp(lt_error) AS sd, quantile_cont(lt_error, 0.5) AS error_q50,
  quantile_cont(lt_error, 0.9) AS error_q90, quantile_cont(lt_error, 0.95) AS error_q95, quantile_cont(lt_error, 0.99) AS error_q99 FROM le GROUP BY 1),
es AS (SELECT * EXCLUDE (sd), coalesce(sd, (SELECT quantile_cont(sd, 0.5) FROM es0)) AS error_std FROM es0),
lv AS (SELECT * FROM (VALUES (0.90::DOUBLE, {inventory.normal_quantile(0.90)!r}::DOUBLE), (0.95, {inventory.normal_quantile(0.95)!r}), (0.99, {inventory.normal_quantile(0.99)!r})) v(service_level, z)),
ex AS (SELECT series_id, sum(sba) AS expected_lt_demand FROM pred WHERE horizon <= 14 AND origin = {d(TEST_ORIGIN)} GROUP BY 1),
po0 AS (SELECT es.*, service_level, z, expected_lt_demand, greatest(0, error_std * z) AS safety_stock_normal,
  greatest(0, CASE service_level WHEN 0.90 THEN error_q90 WHEN 0.95 THEN error_q95 ELSE error_q99 END) AS safety_stock_empirical FROM es LEFT JOIN ex USING (series_id), lv),
po AS (SELECT *, ceil(round(coalesce(expected_lt_demand, 0) + safety_stock_normal, 9)) AS reorder_point_normal, ceil(round(coalesce(expected_lt_demand, 0) + safety_stock_empirical, 9)) AS reorder_point_empirical,
  safety_stock_empirical / nullif(safety_stock_normal, 0) AS ratio, greatest(1.0, round(coalesce(expected_lt_demand, 1) / 14.0::DOUBLE * 7, 9)) AS q FROM po0),
hist AS (SELECT series_id, avg(demand) AS m, coalesce(stddev_samp(demand), 0) AS s FROM panel WHERE date <= {d(TEST_ORIGIN)} AND date > {d(TEST_ORIGIN - dt.timedelta(days=90))} GROUP BY 1),
bl AS (SELECT series_id, m AS daily_mean, s AS daily_std, m * 14 AS expected_lt_demand, greatest(0, s * sqrt(14.0::DOUBLE) * {inventory.normal_quantile(0.95)!r}) AS safety_stock_normal FROM hist),
bp AS (SELECT *, ceil(round(expected_lt_demand + safety_stock_normal, 9)) AS reorder_point_normal, greatest(1.0, round(expected_lt_demand / 14.0::DOUBLE * 7, 9)) AS q FROM bl)"""


def replay_sql(source: str) -> str:
    """Day-by-day recursion over the test window: ``source`` gives key, series, reorder point r and order size q."""
    return f""",
src AS ({source}),
dm AS (SELECT series_id, (date - {d(TEST_START)})::INT AS t, demand::DOUBLE AS dd FROM panel WHERE date BETWEEN {d(TEST_START)} AND {d(TEST_END)}),
sim AS (
  SELECT k, series_id, r, q, -1 AS t, r + q AS oh, [0.0, 0, 0, 0, 0, 0, 0]::DOUBLE[] AS due, 0.0::DOUBLE AS us, 0 AS sd, 0 AS cy, 0 AS bc, false AS cs, 0.0::DOUBLE AS ss, 0.0::DOUBLE AS mx, 0 AS od, 0.0::DOUBLE AS tt FROM src
  UNION ALL
  SELECT k, series_id, r, q, t, lft, list_append(nd[1:6], nd[7] + ord), us + sht, sd + (sht > 0)::INT, cy + rv::INT, bc + (rv AND (cs OR sht > 0) AND cy >= 1)::INT,
    (cs OR sht > 0) AND NOT rv, ss + lft, greatest(mx, lft), od + (ord > 0)::INT, tt + dd FROM (
    SELECT *, CASE WHEN rv AND lft + list_sum(nd) <= r THEN ceil((r + q - lft - list_sum(nd)) / greatest(q, 1e-9)) * q ELSE 0.0 END AS ord FROM (
      SELECT s.k, s.series_id, s.r, s.q, s.t + 1 AS t, us, sd, cy, bc, cs, ss, mx, od, tt, dd, greatest(oh + due[1] - dd, 0.0) AS lft, greatest(dd - oh - due[1], 0.0) AS sht,
        list_append(due[2:7], 0.0) AS nd, (s.t + 1) % 7 = 0 AS rv FROM sim s JOIN dm ON dm.series_id = s.series_id AND dm.t = s.t + 1))),
oc AS (SELECT k, series_id, r AS reorder_point, q AS order_quantity, 28::BIGINT AS days, tt AS total_demand, us AS units_short, 1 - us / greatest(tt, 1e-9) AS fill_rate, sd::BIGINT AS stockout_days,
  1 - (bc + cs::INT) / greatest(cy, 1)::DOUBLE AS cycle_service_level, ss / 28 AS avg_inventory, mx AS max_inventory, oh AS ending_inventory, od::BIGINT AS orders_placed FROM sim WHERE t = 27),
uv AS (SELECT series_id, avg(sell_price) AS v FROM panel WHERE date <= {d(TEST_ORIGIN)} GROUP BY 1),
cs0 AS (SELECT oc.*, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM uv)) AS unit_value FROM oc LEFT JOIN uv USING (series_id)),
co AS (SELECT *, unit_value * 0.25 / 365 * avg_inventory * 28 AS holding_cost, unit_value * 0.25 * 2 * units_short AS stockout_cost, 2.0::DOUBLE * orders_placed AS ordering_cost FROM cs0),
cc AS (SELECT *, holding_cost + stockout_cost + ordering_cost AS total_cost FROM co)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


LEVELS = [0.90, 0.95, 0.99]
ONE = POLICY + replay_sql("SELECT service_level AS k, series_id, reorder_point_normal AS r, q FROM po WHERE service_level = 0.95")
ALL_LEVELS = POLICY + replay_sql("SELECT service_level AS k, series_id, reorder_point_normal AS r, q FROM po")
BASE_REPLAY = POLICY + replay_sql("SELECT 0.95 AS k, series_id, reorder_point_normal AS r, q FROM bp")


def stock_inputs(t: Tables):
    """Panel, predictions at the test origin and lead-time errors of earlier origins."""
    p = base(t)
    every = checkpointed(features.with_baselines(features.supervised(p, [*ERROR_ORIGINS, TEST_ORIGIN], H, FIRST)).select(
        "series_id", "origin", "horizon", "y_true", "sba"))
    at_test = F.col("origin") == F.lit(TEST_ORIGIN)
    errors = inventory.lead_time_errors(every.where(~at_test), "sba", TERMS.protection_days)
    return p, every.where(at_test), errors


@query("stock_lead_time_errors", POLICY + " SELECT series_id, origin, round(lt_actual, 6) AS lt_actual, round(lt_forecast, 6) AS lt_forecast, n_days, round(lt_error, 6) + 0.0 AS lt_error FROM le")
def lead_time_errors(t: Tables):
    """Error summed over the protection window."""
    return stock_inputs(t)[2]


@query("stock_error_spread", POLICY + " SELECT series_id, n_windows, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in (
    "error_mean", "error_std", "error_q50", "error_q90", "error_q95", "error_q99")) + " FROM es")
def error_spread(t: Tables):
    """Spread of lead-time error."""
    return inventory.error_spread(stock_inputs(t)[2])


POL = ("error_std", "expected_lt_demand", "safety_stock_normal", "safety_stock_empirical", "reorder_point_normal", "reorder_point_empirical")


@query("stock_policy", POLICY + " SELECT series_id, service_level, " + ", ".join(f"round({c}, 6) AS {c}" for c in POL)
       + ", round(ratio, 6) AS ss_ratio_emp_over_normal FROM po")
def policy(t: Tables):
    """Safety stock and reorder points at three service levels in one job."""
    _, pr, er = stock_inputs(t)
    return inventory.build_policy(pr, "sba", er, TERMS, LEVELS).select("series_id", "service_level", *POL, "ss_ratio_emp_over_normal")


@query("stock_baseline_policy", POLICY + " SELECT series_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in (
    "daily_mean", "daily_std", "expected_lt_demand", "safety_stock_normal", "reorder_point_normal")) + " FROM bp")
def baseline_policy(t: Tables):
    """Stock sized by recent demand variability."""
    return inventory.baseline_policy(base(t), TERMS, TEST_ORIGIN).drop("service_level", "protection_days")


@query("stock_order_quantity", f"""WITH {PANEL}, a AS (SELECT series_id, avg(demand) * 365 AS annual, avg(sell_price) AS v FROM panel WHERE date <= {d(TEST_ORIGIN)} GROUP BY 1)
SELECT series_id, round(greatest(1, coalesce(sqrt(2 * annual * 2 / (v * 0.25)), 1)), 6) AS eoq FROM a""")
def order_quantity(t: Tables):
    """Economic order quantity."""
    p = base(t).where(F.col("date") <= F.lit(TEST_ORIGIN))
    a = p.groupBy("series_id").agg((F.avg("demand") * 365).alias("annual"), F.avg("sell_price").alias("v"))
    return a.select("series_id", inventory.order_quantity_eoq(
        F.col("annual"), ECON.ordering_cost_per_order, F.col("v") * ECON.holding_rate_annual).alias("eoq"))


OUT = ("reorder_point", "order_quantity", "total_demand", "units_short", "fill_rate", "cycle_service_level", "avg_inventory", "max_inventory", "ending_inventory")


def outcome(t: Tables, levels=None, keys=()):
    p, pr, er = stock_inputs(t)
    pol = inventory.build_policy(pr, "sba", er, TERMS, levels)
    return p, inventory.replay(p, pol, TEST_START, TEST_END, TERMS, keys=list(keys))


@query("stock_replay", recursive(ONE) + " SELECT series_id, days, stockout_days, orders_placed, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in OUT) + " FROM oc", digits=4)
def replay(t: Tables):
    """Periodic-review policy replayed over the stored demand of the test window."""
    return outcome(t)[1]


SUMMARY = """count(*) AS series, round(sum(total_demand), 4) AS total_demand, round(sum(units_short), 4) AS units_short,
  round(1 - sum(units_short) / greatest(sum(total_demand), 1e-9), 4) AS fill_rate, round(avg(cycle_service_level), 4) AS cycle_service_level,
  round(sum(stockout_days) / sum(days), 4) AS stockout_day_rate, round(sum(avg_inventory), 4) AS avg_inventory_units, sum(orders_placed)::BIGINT AS orders_placed,
  count(*) FILTER (units_short > 0) AS series_with_stockout"""


@query("stock_policy_summary", recursive(ONE) + f" SELECT 'forecast' AS policy, {SUMMARY} FROM oc", digits=4)
def policy_summary(t: Tables):
    """Fill rate, service level and stock of the forecast policy."""
    return inventory.policy_summary(outcome(t)[1], "forecast")


@query("stock_baseline_summary", recursive(BASE_REPLAY) + f" SELECT 'baseline' AS policy, {SUMMARY} FROM oc", digits=4)
def baseline_summary(t: Tables):
    """The same summary for the policy to beat."""
    p = base(t)
    pol = inventory.baseline_policy(p, TERMS, TEST_ORIGIN)
    return inventory.policy_summary(inventory.replay(p, pol, TEST_START, TEST_END, TERMS), "baseline")


@query("stock_watch_list", recursive(ONE) + """ SELECT series_id, round(units_short, 4) AS units_short, round(units_short / nullif(total_demand, 0), 4) AS shortfall_share, stockout_days
  FROM oc ORDER BY oc.units_short DESC, series_id LIMIT 20""", digits=4)
def watch_list(t: Tables):
    """Series that ran short by most units."""
    return inventory.watch_list(outcome(t)[1]).select("series_id", "units_short", "shortfall_share", "stockout_days")


@query("stock_coverage_days", recursive(ONE) + """ SELECT series_id, round(total_demand / days, 4) AS daily_demand, round(avg_inventory, 4) AS avg_inventory,
  round(avg_inventory / nullif(total_demand / days, 0), 4) AS coverage_days FROM oc""", digits=4)
def coverage_days(t: Tables):
    """Days of demand that the average stock covers."""
    return inventory.coverage_days(outcome(t)[1])


@query("stock_costs", recursive(ONE) + " SELECT series_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in (
    "unit_value", "holding_cost", "stockout_cost", "ordering_cost", "total_cost")) + " FROM cc", digits=4)
def costs(t: Tables):
    """Holding, stockout and ordering cost per series."""
    p, o = outcome(t)
    return inventory.costed(o, inventory.unit_values(p, TEST_ORIGIN), ECON, 28).select(
        "series_id", "unit_value", "holding_cost", "stockout_cost", "ordering_cost", "total_cost")


COSTSUM = """round(sum(holding_cost), 2) AS holding_cost, round(sum(stockout_cost), 2) AS stockout_cost, round(sum(ordering_cost), 2) AS ordering_cost, round(sum(total_cost), 2) AS total_cost,
  round(sum(units_short), 2) AS units_short, round(1 - sum(units_short) / greatest(sum(total_demand), 1e-9), 2) AS fill_rate, round(sum(avg_inventory), 2) AS avg_inventory_units"""


@query("stock_cost_summary", recursive(ONE) + f" SELECT {COSTSUM}, round(sum(total_cost) / greatest(sum(total_demand), 1e-9), 2) AS cost_per_unit_demand FROM cc", digits=2)
def cost_summary(t: Tables):
    """Cost breakdown of the policy."""
    p, o = outcome(t)
    return inventory.cost_summary(inventory.costed(o, inventory.unit_values(p, TEST_ORIGIN), ECON, 28))


SCEN = f""", sc AS (SELECT k AS service_level, {COSTSUM}, round(sum(total_cost) / greatest(sum(total_demand), 1e-9), 2) AS cost_per_unit_demand, round(avg(cycle_service_level), 2) AS achieved_cycle_sl, sum(total_cost) AS tc FROM cc GROUP BY 1),
sk AS (SELECT service_level, z, round(avg(safety_stock_normal), 2) AS mean_safety_stock, round(sum(safety_stock_normal), 2) AS total_safety_stock FROM po GROUP BY ALL)
SELECT sc.* EXCLUDE (tc), round(z, 2) AS z, mean_safety_stock, total_safety_stock, tc = (SELECT min(tc) FROM sc) AS is_cost_minimum FROM sc JOIN sk USING (service_level)"""


@query("stock_scenarios", recursive(ALL_LEVELS) + SCEN, digits=2)
def scenario_table(t: Tables):
    """Three service levels replayed and costed in one job."""
    p, pr, er = stock_inputs(t)
    pol = inventory.build_policy(pr, "sba", er, TERMS, LEVELS)
    return inventory.scenarios(p, pol, inventory.unit_values(p, TEST_ORIGIN), ECON, TERMS, TEST_START, TEST_END)


@query("stock_penalty_sensitivity", recursive(ALL_LEVELS) + """, mt AS (SELECT unnest([1.0, 2.0, 4.0]::DOUBLE[]) AS m),
sn AS (SELECT m, k, sum(holding_cost + ordering_cost + unit_value * 0.25 * m * units_short) AS tc, 1 - sum(units_short) / sum(total_demand) AS fr, sum(avg_inventory) AS ai FROM cc, mt GROUP BY ALL)
SELECT m AS stockout_penalty_multiplier, k AS cost_optimal_service_level, round(tc, 2) AS total_cost, round(fr, 2) AS achieved_fill_rate, round(ai, 2) AS avg_inventory_units
FROM sn QUALIFY row_number() OVER (PARTITION BY m ORDER BY round(sn.tc, 6), k) = 1""", digits=2)
def penalty_sensitivity(t: Tables):
    """Cheapest service level per stockout penalty."""
    p, pr, er = stock_inputs(t)
    pol = inventory.build_policy(pr, "sba", er, TERMS, LEVELS)
    table = inventory.scenarios(p, pol, inventory.unit_values(p, TEST_ORIGIN), ECON, TERMS, TEST_START, TEST_END, multipliers=[1.0, 2.0, 4.0])
    return inventory.cost_optimal_levels(table)


@query("stock_newsvendor", f"""WITH {PANEL}, uv AS (SELECT avg(sell_price) AS v FROM panel WHERE date <= {d(TEST_ORIGIN)} GROUP BY series_id),
x AS (SELECT v * 0.5 AS cu, v * 0.25 / 365 * 28 AS co FROM uv)
SELECT round(avg(cu / (cu + co)), 6) AS critical_ratio_mean, round(quantile_cont(cu / (cu + co), 0.5), 6) AS critical_ratio_median, round(avg(cu), 6) AS cu_mean, round(avg(co), 6) AS co_mean FROM x""")
def newsvendor(t: Tables):
    """Analytical service level from unit costs."""
    return inventory.newsvendor(inventory.unit_values(base(t), TEST_ORIGIN), ECON, 28)


@query("stock_recommendations", POLICY + """ SELECT series_id, round(expected_lt_demand, 4) AS expected_lt_demand, round(safety_stock_empirical, 4) AS safety_stock, reorder_point_empirical AS reorder_point, 0.95::DOUBLE AS service_level
  FROM po WHERE service_level = 0.95""", digits=4)
def recommendations(t: Tables):
    """Reorder point of every series at once (the risk itself is in the worklist query)."""
    return worklist(t).drop("stockout_risk")


@query("stock_worklist")
def worklist(t: Tables):
    """Recommendations with stockout risk, riskiest first (the normal CDF has no SQL twin)."""
    _, pr, er = stock_inputs(t)
    pol = inventory.build_policy(pr, "sba", er, TERMS)
    fc = pr.withColumnsRenamed({"sba": "forecast"}).withColumn("q90", F.col("forecast"))
    return inventory.recommend(fc, pol, TERMS).orderBy(F.desc("stockout_risk"), "series_id")
