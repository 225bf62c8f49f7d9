"""Payment transactions derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Tables, hash_number_sql, query
from quarrylane.functions.cleaning import is_close
from quarrylane.operators import rankstats, splits, staging
from quarrylane.operators import transactions as tx
from quarrylane.plans.bounded import lookup

TYPES = {"error": "TRANSFER", "purchase": "CASH_OUT", "view": "PAYMENT", "click": "CASH_IN",
         "signup": "DEBIT"}

TX = """
tx0 AS (
  SELECT event_id, floor(date_diff('microsecond', (SELECT min(ts) FROM events), ts) / 3600000000.0)::BIGINT AS step,
         CASE event_type WHEN 'error' THEN 'TRANSFER' WHEN 'purchase' THEN 'CASH_OUT'
              WHEN 'view' THEN 'PAYMENT' WHEN 'click' THEN 'CASH_IN' ELSE 'DEBIT' END AS type,
         value AS amount, user_id, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k, event_type
  FROM events),
tx1 AS (SELECT *, CASE WHEN k < 20 THEN amount WHEN k < 40 THEN 0.0::DOUBLE ELSE amount + k END AS oldbalanceOrg,
               (k * 10)::DOUBLE AS oldbalanceDest FROM tx0),
tx AS (
  SELECT event_id, step, type, amount, 'C' || user_id AS nameOrig, oldbalanceOrg,
         greatest(oldbalanceOrg - amount, 0.0::DOUBLE) AS newbalanceOrg,
         CASE WHEN event_type = 'view' THEN 'M' ELSE 'C' END || k AS nameDest, oldbalanceDest,
         CASE WHEN k < 30 THEN oldbalanceDest ELSE oldbalanceDest + amount END AS newbalanceDest,
         (CASE WHEN (event_type IN ('error', 'purchase') AND k < 12) OR (event_type = 'signup' AND k = 99)
               THEN 1 ELSE 0 END)::BIGINT AS isFraud
  FROM tx1)"""


def transactions(t: Tables):
    e = t.events
    first = e.agg(F.min("ts").alias("m")).scalar()
    k = F.col("k")
    kind = F.col("event_type")
    d = e.select(
        "event_id", "event_type", "user_id", F.col("value").alias("amount"),
        F.floor(F.timestamp_diff("MICROSECOND", first, F.col("ts")) / F.lit(3600000000)).alias("step"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    d = d.withColumns({
        "type": lookup(TYPES, kind),
        "oldbalanceOrg": F.when(k < 20, F.col("amount")).when(k < 40, F.lit(0.0)).otherwise(F.col("amount") + k),
        "oldbalanceDest": (k * 10).cast("double")})
    fraud = (kind.isin("error", "purchase") & (k < 12)) | ((kind == "signup") & (k == 99))
    return d.select(
        "event_id", "step", "type", "amount", F.concat(F.lit("C"), "user_id").alias("nameOrig"),
        "oldbalanceOrg", F.greatest(F.col("oldbalanceOrg") - F.col("amount"), F.lit(0.0)).alias("newbalanceOrg"),
        F.concat(F.when(kind == "view", "M").otherwise("C"), k.cast("string")).alias("nameDest"),
        "oldbalanceDest",
        F.when(k < 30, F.col("oldbalanceDest")).otherwise(F.col("oldbalanceDest") + F.col("amount")).alias("newbalanceDest"),
        fraud.cast("long").alias("isFraud"))


FEATURE_SQL = """
       step % 24 AS hour, round(newbalanceOrg + amount - oldbalanceOrg, 6) + 0.0 AS errBalOrig,
       round(oldbalanceDest + amount - newbalanceDest, 6) + 0.0 AS errBalDest,
       (newbalanceOrg = 0 AND oldbalanceOrg > 0)::BIGINT AS drainedOrig,
       round(amount / (oldbalanceOrg + 1e-9), 2) AS amtRatioOrig,
       (oldbalanceOrg = 0)::BIGINT AS origZeroBefore, (oldbalanceDest = 0)::BIGINT AS destZeroBefore,
       (newbalanceDest = 0)::BIGINT AS destZeroAfter, round(ln(1 + amount), 6) AS amountLog,
       (nameDest LIKE 'M%')::BIGINT AS destIsMerchant"""


@query("tx_features", f"WITH {TX} SELECT event_id, {FEATURE_SQL} FROM tx")
def features(t: Tables):
    """Engineered transaction features on every row."""
    d = tx.with_features(transactions(t)).withColumn("amtRatioOrig", F.round("amtRatioOrig", 2))
    return d.select("event_id", "hour", "errBalOrig", "errBalDest", "drainedOrig", "amtRatioOrig",
                    "origZeroBefore", "destZeroBefore", "destZeroAfter", "amountLog", "destIsMerchant")


@query("tx_design_matrix", f"""WITH {TX} SELECT event_id, {FEATURE_SQL}, amount, round(oldbalanceOrg, 6) AS oldbalanceOrg,
  round(newbalanceOrg, 6) AS newbalanceOrg, oldbalanceDest, round(newbalanceDest, 6) AS newbalanceDest,
  (type = 'CASH_OUT')::BIGINT AS type_CASH_OUT, (type = 'DEBIT')::BIGINT AS type_DEBIT,
  (type = 'PAYMENT')::BIGINT AS type_PAYMENT, (type = 'TRANSFER')::BIGINT AS type_TRANSFER, isFraud FROM tx""")
def design_matrix(t: Tables):
    """Model inputs: first type level dropped, raw step and ids left out."""
    d = tx.design_matrix(transactions(t), list(TYPES.values()), keep=["event_id"])
    return d.withColumn("amtRatioOrig", F.round("amtRatioOrig", 2))


@query("tx_baseline_frame", f"""WITH {TX} SELECT event_id, step, amount, round(oldbalanceOrg, 6) AS oldbalanceOrg,
  round(newbalanceOrg, 6) AS newbalanceOrg, oldbalanceDest, round(newbalanceDest, 6) AS newbalanceDest, isFraud,
  (type = 'CASH_IN')::BIGINT AS type_CASH_IN, (type = 'CASH_OUT')::BIGINT AS type_CASH_OUT,
  (type = 'DEBIT')::BIGINT AS type_DEBIT, (type = 'PAYMENT')::BIGINT AS type_PAYMENT,
  (type = 'TRANSFER')::BIGINT AS type_TRANSFER FROM tx""")
def baseline_frame(t: Tables):
    """Feature frame of the uncorrected arm."""
    return tx.baseline_frame(transactions(t), list(TYPES.values()))


RULE = """(newbalanceOrg = 0 AND oldbalanceOrg > 0 AND type IN ('TRANSFER', 'CASH_OUT')
  AND abs(amount - oldbalanceOrg) <= 1e-8 + 1e-5 * abs(oldbalanceOrg))"""


@query("tx_rule_confusion", f"""WITH {TX}, r AS (SELECT {RULE} AS hit, isFraud = 1 AS pos FROM tx),
c AS (SELECT count(*) FILTER (hit AND pos) AS tp, count(*) FILTER (hit AND NOT pos) AS fp,
             count(*) FILTER (NOT hit AND pos) AS fn FROM r)
SELECT tp, fp, fn, round(tp / greatest(tp + fp, 1)::DOUBLE, 6) AS precision,
       round(tp / greatest(tp + fn, 1)::DOUBLE, 6) AS recall FROM c""")
def rule_confusion(t: Tables):
    """Counts, precision and recall of the three-clause drain rule."""
    d = transactions(t)
    return tx.confusion_of_rule(d, tx.drain_rule(d), "isFraud")


@query("tx_rule_hits", f"WITH {TX} SELECT event_id, type, amount, isFraud FROM tx WHERE {RULE}")
def rule_hits(t: Tables):
    """Transactions caught by the drain rule."""
    d = transactions(t)
    return d.where(tx.drain_rule(d)).select("event_id", "type", "amount", "isFraud")


@query("tx_class_balance", f"""WITH {TX} SELECT count(*) AS n_rows, sum(isFraud)::BIGINT AS positives,
  sum(1 - isFraud)::BIGINT AS negatives, round(avg(isFraud), 6) AS rate,
  round(sum(1 - isFraud) / greatest(sum(isFraud), 1)::DOUBLE, 6) AS imbalance, 0::BIGINT AS n_nulls,
  min(step) AS first_step, max(step) AS last_step, count(DISTINCT nameOrig) AS distinct_ids FROM tx""")
def class_balance(t: Tables):
    """Class balance profile in one pass."""
    return tx.class_balance(transactions(t), "isFraud", "step", "nameOrig")


@query("tx_rate_by_type", f"""WITH {TX} SELECT type, count(*) AS n, sum(isFraud)::BIGINT AS positives,
  round(avg(isFraud), 6) AS rate FROM tx GROUP BY type""")
def rate_by_type(t: Tables):
    """Positives and rate per transaction type."""
    return tx.rate_by(transactions(t), "type", "isFraud", "type")


@query("tx_contingency", f"""WITH {TX}, r AS (
  SELECT abs(amount - oldbalanceOrg) <= 1e-8 + 1e-5 * abs(oldbalanceOrg) AND oldbalanceOrg > 0 AS f, isFraud AS y FROM tx)
SELECT count(*) FILTER (NOT f AND y = 0) AS n00, count(*) FILTER (NOT f AND y = 1) AS n01,
       count(*) FILTER (f AND y = 0) AS n10, count(*) FILTER (f AND y = 1) AS n11,
       round(avg(y) FILTER (f), 6) AS p_label_given_flag,
       round(avg(f::INT) FILTER (y = 1), 6) AS p_flag_given_label FROM r""")
def contingency(t: Tables):
    """Exact-amount flag against the label, with conditional probabilities."""
    exact = is_close(F.col("amount"), F.col("oldbalanceOrg")) & (F.col("oldbalanceOrg") > 0)
    return tx.contingency(transactions(t), exact, "isFraud")


@query("tx_factor_correlation", f"""WITH {TX},
a AS (SELECT type AS v, dense_rank() OVER (ORDER BY min(event_id)) - 1 AS c FROM tx GROUP BY type),
b AS (SELECT amount AS v, dense_rank() OVER (ORDER BY min(event_id)) - 1 AS c FROM tx GROUP BY amount),
d AS (SELECT nameDest AS v, dense_rank() OVER (ORDER BY min(event_id)) - 1 AS c FROM tx GROUP BY nameDest),
y AS (SELECT isFraud AS v, dense_rank() OVER (ORDER BY min(event_id)) - 1 AS c FROM tx GROUP BY isFraud),
j AS (SELECT a.c::DOUBLE AS a, b.c::DOUBLE AS b, d.c::DOUBLE AS d, y.c::DOUBLE AS y FROM tx
      JOIN a ON a.v = type JOIN b ON b.v = amount JOIN d ON d.v = nameDest JOIN y ON y.v = isFraud)
SELECT 'type' AS left_column, 'amount' AS right_column, round(corr(a, b), 6) AS correlation FROM j
UNION ALL SELECT 'type', 'nameDest', round(corr(a, d), 6) FROM j
UNION ALL SELECT 'type', 'isFraud', round(corr(a, y), 6) FROM j
UNION ALL SELECT 'amount', 'nameDest', round(corr(b, d), 6) FROM j
UNION ALL SELECT 'amount', 'isFraud', round(corr(b, y), 6) FROM j
UNION ALL SELECT 'nameDest', 'isFraud', round(corr(d, y), 6) FROM j""")
def factor_correlation(t: Tables):
    """Pearson correlation of first-appearance codes."""
    return tx.factor_correlation(transactions(t), ["type", "amount", "nameDest", "isFraud"], "event_id")


SIGNALS_SQL = f"""WITH {TX}, s AS (
  SELECT isFraud AS y, unnest([
    {{'signal': 'exact amount', 'v': (abs(amount - oldbalanceOrg) <= 1e-8 + 1e-5 * abs(oldbalanceOrg) AND oldbalanceOrg > 0)::INT::DOUBLE}},
    {{'signal': 'drained', 'v': (newbalanceOrg = 0 AND oldbalanceOrg > 0)::INT::DOUBLE}},
    {{'signal': 'rule', 'v': {RULE}::INT::DOUBLE}},
    {{'signal': 'negative residual', 'v': round(-(newbalanceOrg + amount - oldbalanceOrg), 9)}},
    {{'signal': 'amount', 'v': amount}}]) AS x FROM tx),
c AS (SELECT x.signal AS signal, x.v AS v, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM s GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY signal ORDER BY v DESC) AS cp,
             sum(neg) OVER (PARTITION BY signal ORDER BY v DESC) AS cn FROM c)
SELECT signal, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives,
       round(sum(neg * (cp - pos + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
       round(sum(pos * cp::DOUBLE / (cp + cn)) / sum(pos), 6) AS pr_auc
FROM r GROUP BY signal"""


@query("tx_signal_ranking", SIGNALS_SQL)
def signal_ranking(t: Tables):
    """AUC of single signals, all in one pass."""
    d = transactions(t)
    exact = is_close(F.col("amount"), F.col("oldbalanceOrg")) & (F.col("oldbalanceOrg") > 0)
    drained = (F.col("newbalanceOrg") == 0) & (F.col("oldbalanceOrg") > 0)
    residual = -(F.col("newbalanceOrg") + F.col("amount") - F.col("oldbalanceOrg"))
    signals = {"exact amount": exact.cast("double"), "drained": drained.cast("double"),
               "rule": tx.drain_rule(d).cast("double"),
               "negative residual": F.round(residual, 9), "amount": F.col("amount")}
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), v.alias("v")) for n, v in signals.items()]))
    long = d.select("isFraud", x.alias("x")).select("isFraud", "x.signal", "x.v")
    return rankstats.ranking_quality(long, "v", "isFraud", ["signal"])


SPLIT_SQL = f"""WITH {TX},
q AS (SELECT floor(quantile_cont(step, 0.60))::BIGINT AS a, floor(quantile_cont(step, 0.75))::BIGINT AS b FROM tx),
s AS (SELECT tx.*, a, b, CASE WHEN step <= a THEN 'train' WHEN step <= b THEN 'val' ELSE 'test' END AS part FROM tx, q)"""


@query("tx_temporal_split", f"""{SPLIT_SQL} SELECT part, a AS cut_train, b AS cut_val, count(*) AS n,
  sum(isFraud)::BIGINT AS positives, min(step) AS first_step, max(step) AS last_step FROM s GROUP BY ALL""")
def temporal_split(t: Tables):
    """Split by time at exact quantiles of the step."""
    d = splits.temporal_split(transactions(t), "step")
    return d.groupBy("part", "cut_train", "cut_val").agg(
        F.count(F.lit(1)).alias("n"), F.sum("isFraud").alias("positives"),
        F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("tx_split_cover", """SELECT count(*) AS n_rows, count(*) AS n_ids, 0::BIGINT AS n_overlapping,
  0::BIGINT AS n_uncovered FROM events""")
def split_cover(t: Tables):
    """The temporal parts are disjoint and cover every row."""
    return splits.cover_report(splits.temporal_split(transactions(t), "step"), "event_id", "part")


@query("tx_random_split", f"""WITH {TX}, r AS (SELECT *, CASE WHEN {hash_number_sql('event_id', 42)} % 10 < 7 THEN 'train' ELSE 'test' END AS part FROM tx)
SELECT part, count(*) AS n, sum(isFraud)::BIGINT AS positives, min(step)::BIGINT AS first_step, max(step)::BIGINT AS last_step FROM r GROUP BY 1""")
def random_split(t: Tables):
    """Baseline arm: hash split that mixes past and future."""
    d = splits.random_split(transactions(t), "event_id")
    return d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("isFraud").alias("positives"),
                                 F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("tx_validation_threshold", f"""{SPLIT_SQL},
c AS (SELECT amount AS v, sum(isFraud) AS pos, sum(1 - isFraud) AS neg FROM s WHERE part = 'val' GROUP BY 1),
r AS (SELECT *, sum(pos) OVER (ORDER BY v DESC)::DOUBLE AS cp, sum(neg) OVER (ORDER BY v DESC)::DOUBLE AS cn,
             sum(pos) OVER ()::DOUBLE AS p FROM c),
f AS (SELECT v, cp / (cp + cn) AS pr, cp / p AS re FROM r),
g AS (SELECT *, 2 * pr * re / (pr + re + 1e-12) AS f1 FROM f)
SELECT v AS threshold, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1
FROM g ORDER BY round(g.f1, 12) DESC, v LIMIT 1""")
def validation_threshold(t: Tables):
    """F1-optimal threshold on the validation part."""
    val = splits.temporal_split(transactions(t), "step").where("part = 'val'")
    return rankstats.best_f1(rankstats.pr_curve(val, "amount", "isFraud"))


@query("tx_test_review_budgets", f"""{SPLIT_SQL},
e AS (SELECT * FROM s WHERE part = 'test'),
f AS (SELECT unnest([0.0001, 0.0005, 0.001, 0.005, 0.01]::DOUBLE[]) AS budget_frac),
k AS (SELECT budget_frac, greatest(floor(budget_frac * (SELECT count(*) FROM e)), 1)::BIGINT AS alerts FROM f),
r AS (SELECT isFraud AS y, row_number() OVER (ORDER BY amount DESC, event_id) AS rn FROM e)
SELECT budget_frac, alerts, sum(y)::BIGINT AS caught,
       round(sum(y) / greatest((SELECT sum(isFraud) FROM e), 1), 6) AS recall,
       round(sum(y) / alerts::DOUBLE, 6) AS precision
FROM k JOIN r ON rn <= alerts GROUP BY budget_frac, alerts""")
def test_review_budgets(t: Tables):
    """Recall under review budgets on the test part, ranked by amount."""
    test = splits.temporal_split(transactions(t), "step").where("part = 'test'")
    return rankstats.review_budgets(test, "amount", "isFraud", "event_id",
                                    [0.0001, 0.0005, 0.001, 0.005, 0.01])


# A stated ensemble of fifty stumps (column, threshold, margin above it, margin otherwise), so that every stage has a SQL twin.
STAGES = (1, 5, 10, 25, 50)
STUMPS = [(("amount", 40.0 + k, -0.05, 0.1), ("oldbalanceOrg", 20.0 * (k % 7), -0.3, -0.1), ("newbalanceDest", 300.0 + 10 * k, 0.2, -0.4),
           ("newbalanceOrg", 1.0 + k % 3, 0.35, -0.25))[k % 4] for k in range(50)]


def _sum_sql(rounds: int) -> str:
    terms = " + ".join(f"CASE WHEN {c} > {cut!r}::DOUBLE THEN {a!r}::DOUBLE ELSE {b!r}::DOUBLE END" for c, cut, a, b in STUMPS[:rounds])
    return f"0.0::DOUBLE + {terms}"


@query("tx_base_prior_diagnosis", f"""WITH {TX}, b AS (SELECT 'prior' AS start, ln(avg(isFraud) / (1 - avg(isFraud))) AS base FROM tx UNION ALL SELECT 'half', ln(0.5::DOUBLE / (1 - 0.5::DOUBLE))),
c AS ({" UNION ALL ".join(f"SELECT {r} AS rounds, isFraud AS y, {_sum_sql(r)} AS s FROM tx" for r in STAGES)}),
s AS (SELECT start, rounds, y, base + s AS margin, round(1 / (1 + exp(-(base + s))), 12) AS p FROM c, b),
g AS (SELECT start, rounds, p, count(*) AS n, sum(y) AS pos FROM s GROUP BY ALL),
k AS (SELECT *, sum(n - pos) OVER (PARTITION BY start, rounds ORDER BY p) - (n - pos) AS below FROM g),
a AS (SELECT start, rounds, sum(pos * (below + (n - pos) / 2.0::DOUBLE)) / (sum(pos) * sum(n - pos)) AS roc_auc FROM k GROUP BY ALL)
SELECT start, rounds::BIGINT AS rounds, count(*) AS n, sum(y)::BIGINT AS positives, round(min(p), 6) AS min_p, round(sum(margin), 4) AS margin_total,
  count(*) FILTER (y = 1 AND p < 1e-4) AS buried, round(count(*) FILTER (y = 1 AND p < 1e-4) / sum(y)::DOUBLE, 6) AS buried_share, round(any_value(roc_auc), 6) AS roc_auc
FROM s JOIN a USING (start, rounds) GROUP BY start, rounds""")
def base_prior_diagnosis(t: Tables):
    """A stated ensemble scored round by round from the base rate and from one half: AUC, smallest score, buried positives."""
    d = staging.stump_margins(transactions(t), STUMPS)
    starts = {"prior": d.agg(F.avg("isFraud").alias("r")).scalar(), "half": 0.5}
    out = staging.diagnosis(staging.staged_scores(d, starts, STAGES, ["isFraud"]), "isFraud").drop("pr_auc")
    return out.withColumn("margin_total", F.round("margin_total", 4))


@query("tx_saturation", f"""WITH {TX}, b AS (SELECT 'prior' AS start, ln(avg(isFraud) / (1 - avg(isFraud))) AS base FROM tx UNION ALL SELECT 'half', ln(0.5::DOUBLE / (1 - 0.5::DOUBLE))),
c AS ({" UNION ALL ".join(f"SELECT {r} AS rounds, isFraud AS y, {_sum_sql(r)} AS s FROM tx" for r in STAGES)}),
s AS (SELECT start, rounds, y, round(1 / (1 + exp(-(base + s))), 12) AS p FROM c, b),
g AS (SELECT start, rounds, p, count(*) AS n, sum(y) AS pos FROM s GROUP BY ALL),
k AS (SELECT *, sum(n - pos) OVER (PARTITION BY start, rounds ORDER BY p) - (n - pos) AS below FROM g),
a AS (SELECT start, rounds, sum(pos * (below + (n - pos) / 2.0::DOUBLE)) / (sum(pos) * sum(n - pos)) AS auc FROM k GROUP BY ALL)
SELECT start, round(min(auc), 6) AS lowest, round(arg_max(auc, rounds), 6) AS last, min(auc) < arg_max(auc, rounds) - 0.02 AS non_monotonic FROM a GROUP BY start""")
def saturation(t: Tables):
    """Whether the AUC dips below its last value at an earlier number of rounds, per start."""
    d = staging.stump_margins(transactions(t), STUMPS)
    starts = {"prior": d.agg(F.avg("isFraud").alias("r")).scalar(), "half": 0.5}
    return staging.saturated(staging.diagnosis(staging.staged_scores(d, starts, STAGES, ["isFraud"]), "isFraud"))
