"""Subscribers derived from customers and their orders; recency as the churn score."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Tables, query
from quarrylane.operators import audit, decisions, rankstats, scoring, splits
from quarrylane.operators import subscribers as sb
from quarrylane.plans.prefix import exact_quantiles

ADDONS = sb.ADDONS
COLUMNS = ["customerID", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService", *ADDONS,
           "Contract", "PaymentMethod", "tenure", "MonthlyCharges", "TotalCharges", "Churn"]
ADDON_SQL = ", ".join(
    f"CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'No internet service' WHEN c_nationkey >= {4 * i} THEN 'Yes' ELSE 'No' END AS {a}"
    for i, a in enumerate(ADDONS))

SUBS = f"""
h AS (SELECT o_custkey, count(*) AS n_orders, min(o_orderdate)::DATE AS f, max(o_orderdate)::DATE AS l FROM orders GROUP BY 1),
top AS (SELECT max(o_orderdate)::DATE AS m FROM orders),
b AS (SELECT c.*, coalesce(n_orders, 0) AS n_orders, coalesce(least(72, (l - f) // 30), 0)::BIGINT AS tenure,
             coalesce(m - l, 1000)::BIGINT AS recency, n_orders IS NULL AS never, floor(abs(c_acctbal)) / 100 + 20 AS monthly
      FROM customer c LEFT JOIN h ON o_custkey = c_custkey CROSS JOIN top),
subs AS (
  SELECT c_custkey AS customerID,
    CASE WHEN c_acctbal > 5000 THEN 'Yes' ELSE 'No' END AS Partner, CASE WHEN c_acctbal > 8000 THEN 'Yes' ELSE 'No' END AS Dependents,
    CASE WHEN c_nationkey = 3 THEN 'No' ELSE 'Yes' END AS PhoneService,
    CASE WHEN c_nationkey = 3 THEN 'No phone service' WHEN c_acctbal > 3000 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'No' WHEN 'BUILDING' THEN 'DSL' ELSE 'Fiber optic' END AS InternetService,
    {ADDON_SQL},
    CASE WHEN n_orders < 8 THEN 'Month-to-month' WHEN n_orders < 12 THEN 'One year' ELSE 'Two year' END AS Contract,
    CASE WHEN c_nationkey < 6 THEN 'Electronic check' WHEN c_nationkey < 12 THEN 'Mailed check'
         WHEN c_nationkey < 18 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
    tenure, monthly AS MonthlyCharges, CASE WHEN tenure > 1 THEN (tenure * floor(monthly) + n_orders)::DOUBLE END AS TotalCharges,
    CASE WHEN recency > 400 OR (c_acctbal < 2000 AND recency > 60) THEN 'Yes' ELSE 'No' END AS Churn,
    least(0.999, recency / 600.0::DOUBLE)::DOUBLE AS p, n_orders, c_mktsegment
  FROM b),
s AS (SELECT *, (Churn = 'Yes')::BIGINT AS y, MonthlyCharges * 12 AS value, coalesce(TotalCharges, 0) AS total0,
        CASE WHEN tenure <= 6 THEN '0-6m' WHEN tenure <= 12 THEN '7-12m' WHEN tenure <= 24 THEN '13-24m'
             WHEN tenure <= 48 THEN '25-48m' WHEN tenure <= 72 THEN '49-72m' END AS tenure_band,
        CASE WHEN p >= 0.65 THEN 'Critical Risk' WHEN p >= 0.35 THEN 'High Risk' WHEN p >= 0.10 THEN 'Medium Risk'
             ELSE 'Low Risk' END AS risk_segment,
        CASE WHEN p >= 0.3 AND Churn = 'Yes' THEN 'true_positive' WHEN p < 0.3 AND Churn = 'No' THEN 'true_negative'
             WHEN p >= 0.3 THEN 'false_positive' ELSE 'false_negative' END AS error_kind FROM subs)"""


def raw(t: Tables):
    """Totals are text here, blank for customers that were never billed."""
    o = t.orders
    h = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").cast("date").alias("f"),
                                   F.max("o_orderdate").cast("date").alias("l"))
    top = o.agg(F.max("o_orderdate").cast("date").alias("m")).scalar()
    b = t.customer.join(h, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = F.lit(0)
    b = b.withColumns({
        "n_orders": F.coalesce("n", zero), "tenure": F.coalesce(F.least(F.lit(72), F.floor(F.datediff("l", "f") / 30)), zero),
        "recency": F.coalesce(F.datediff(top, "l"), F.lit(1000)), "monthly": F.floor(F.abs("c_acctbal")) / 100 + 20})
    bal, nk, seg = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment")

    def yn(c):
        return F.when(c, "Yes").otherwise("No")

    churned = (F.col("recency") > 400) | ((bal < 2000) & (F.col("recency") > 60))
    total = F.format_string("%.2f", (F.col("tenure") * F.floor("monthly") + F.col("n_orders")).cast("double"))
    return b.select(
        F.col("c_custkey").alias("customerID"), yn(bal > 5000).alias("Partner"), yn(bal > 8000).alias("Dependents"),
        yn(nk != 3).alias("PhoneService"),
        F.when(nk == 3, "No phone service").otherwise(yn(bal > 3000)).alias("MultipleLines"),
        F.when(seg == "AUTOMOBILE", "No").when(seg == "BUILDING", "DSL").otherwise("Fiber optic").alias("InternetService"),
        *[F.when(seg == "AUTOMOBILE", "No internet service").otherwise(yn(nk >= 4 * i)).alias(a) for i, a in enumerate(ADDONS)],
        F.when(F.col("n_orders") < 8, "Month-to-month").when(F.col("n_orders") < 12, "One year").otherwise("Two year").alias("Contract"),
        F.when(nk < 6, "Electronic check").when(nk < 12, "Mailed check").when(nk < 18, "Bank transfer (automatic)")
        .otherwise("Credit card (automatic)").alias("PaymentMethod"),
        "tenure", F.col("monthly").alias("MonthlyCharges"),
        F.when(F.col("tenure") > 1, total).otherwise(" ").alias("TotalCharges"), yn(churned).alias("Churn"),
        F.least(F.lit(0.999), F.col("recency") / 600.0).alias("p"), "n_orders", "c_mktsegment")


def subs(t: Tables):
    d = sb.structural_fill(sb.typed(raw(t), [*COLUMNS, "p", "n_orders", "c_mktsegment"]))
    return d.withColumns({"y": (F.col("Churn") == "Yes").cast("long"), "value": F.col("MonthlyCharges") * 12})


@query("subs_typed", f"WITH {SUBS} SELECT customerID, tenure, round(MonthlyCharges, 6) AS MonthlyCharges, TotalCharges, Churn FROM s")
def typed(t: Tables):
    """Declared types and order; unparsable totals become NULL."""
    return sb.typed(raw(t), ["customerID", "tenure", "MonthlyCharges", "TotalCharges", "Churn"])


@query("subs_missing", f"WITH {SUBS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n FROM s" for c in COLUMNS))
def missing(t: Tables):
    """NULL and blank cells per column."""
    return audit.missing_or_blank(raw(t).select(*COLUMNS))


@query("subs_out_of_range", f"""WITH {SUBS} SELECT 'tenure' AS column_name, count(*) FILTER (tenure > 40) AS n FROM s
UNION ALL SELECT 'MonthlyCharges', count(*) FILTER (MonthlyCharges < 0 OR MonthlyCharges > 100) FROM s
UNION ALL SELECT 'TotalCharges', count(*) FILTER (TotalCharges < 0 OR TotalCharges > 5000) FROM s""")
def out_of_range(t: Tables):
    """Values outside tightened ranges, so that some are found."""
    return audit.out_of_range(raw(t), {"tenure": (0, 40), "MonthlyCharges": (0, 100), "TotalCharges": (0, 5000)})


@query("subs_unexpected_values", f"""WITH {SUBS} SELECT 'Contract' AS column_name, Contract AS value, count(*) AS n FROM s
WHERE Contract = 'Two year' GROUP BY ALL UNION ALL SELECT 'PaymentMethod', PaymentMethod, count(*) FROM s
WHERE PaymentMethod LIKE '%(automatic)' GROUP BY ALL""")
def unexpected_values(t: Tables):
    """Values outside a shortened domain."""
    return audit.unexpected_values(raw(t), {"Contract": ["Month-to-month", "One year"],
                                            "PaymentMethod": ["Electronic check", "Mailed check"],
                                            "InternetService": ["DSL", "Fiber optic", "No"]})


_DECLARED = f"""WITH {SUBS}, f AS (SELECT * REPLACE (CASE WHEN tenure % 10 = 3 THEN 'Cash' ELSE PaymentMethod END AS PaymentMethod,
  CASE WHEN tenure % 7 = 2 THEN -1 ELSE MonthlyCharges END AS MonthlyCharges, CASE WHEN tenure % 11 = 4 THEN 'Maybe' ELSE TechSupport END AS TechSupport) FROM s)"""


@query("subs_declared_faults", _DECLARED + " UNION ALL ".join(
    [""] + [f"SELECT 'domain' AS \"check\", '{c}' AS name, {c} AS value, count(*) AS n FROM f WHERE {c} NOT IN ({', '.join(repr(x) for x in v)}) GROUP BY {c}" for c, v in sb.DOMAINS.items()]
    + [f"SELECT * FROM (SELECT 'range', '{c}', NULL, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS n FROM f) WHERE n > 0" for c, (lo, hi) in sb.RANGES.items()]).removeprefix(" UNION ALL"))
def declared_faults(t: Tables):
    """What the declared ranges and domains find where a price, a payment method and an add-on were spoilt."""
    tenure = F.col("tenure").cast("long")
    d = subs(t).withColumns({
        "PaymentMethod": F.when(tenure % 10 == 3, "Cash").otherwise(F.col("PaymentMethod")),
        "MonthlyCharges": F.when(tenure % 7 == 2, -1).otherwise(F.col("MonthlyCharges")),
        "TechSupport": F.when(tenure % 11 == 4, "Maybe").otherwise(F.col("TechSupport"))})
    return sb.declared_faults(d)


@query("subs_consistency", f"WITH {SUBS} " + " UNION ALL ".join(
    f"SELECT '{a} vs InternetService' AS rule, count(*) FILTER (({a} = 'No internet service') <> (InternetService = 'No')) AS n FROM s"
    for a in ADDONS) + """ UNION ALL SELECT 'MultipleLines vs PhoneService',
  count(*) FILTER ((MultipleLines = 'No phone service') <> (PhoneService = 'No')) FROM s
 UNION ALL SELECT 'Partner vs Dependents', count(*) FILTER (Partner <> Dependents) FROM s""")
def consistency(t: Tables):
    """Child categories agree with their parent; one rule that fails is added."""
    rules = sb.consistency_rules()
    rules["Partner vs Dependents"] = (F.col("Partner") == "Yes", F.col("Dependents") == "Yes")
    return audit.inconsistencies(raw(t), rules)


FEATS = ["Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService", *ADDONS, "Contract", "PaymentMethod"]
FEATS_SQL = ", ".join(FEATS)


@query("subs_duplicates", f"""WITH {SUBS} SELECT 0::BIGINT AS exact, 0::BIGINT AS by_id,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {FEATS_SQL} FROM s)) AS by_features FROM s""")
def duplicates(t: Tables):
    """Repeated rows, ids and feature vectors."""
    return audit.duplicate_counts(raw(t).select(*COLUMNS), "customerID", FEATS)


@query("subs_dedup_report", f"""WITH {SUBS}, g AS (SELECT count(*) AS n, min(y) <> max(y) AS c FROM s GROUP BY {FEATS_SQL})
SELECT coalesce(sum(n - 1) FILTER (NOT c), 0)::BIGINT AS n_removed, coalesce(sum(n) FILTER (c), 0)::BIGINT AS n_conflicting_rows,
  count(*) FILTER (c) AS n_conflicting_groups FROM g""")
def dedup_report(t: Tables):
    """Harmless repeats and conflicting groups."""
    return audit.dedup_report(subs(t), FEATS, "y", "customerID")


@query("subs_deduplicated", f"""WITH {SUBS}, g AS (SELECT *, min(y) OVER w <> max(y) OVER w AS conflict,
  row_number() OVER (PARTITION BY {FEATS_SQL} ORDER BY customerID) AS rn FROM s WINDOW w AS (PARTITION BY {FEATS_SQL}))
SELECT customerID, Churn, conflict FROM g WHERE conflict OR rn = 1""")
def deduplicated(t: Tables):
    """First of equal rows kept; conflicting groups kept whole."""
    return audit.deduplicate(subs(t), FEATS, "y", "customerID").select("customerID", "Churn", "conflict")


@query("subs_redundancy", f"""WITH {SUBS}, d AS (SELECT total0 AS y, tenure * MonthlyCharges AS f FROM s)
SELECT round(1 - sum((y - f) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM d""")
def redundancy(t: Tables):
    """How much of the total is tenure times monthly charge."""
    return audit.redundancy(subs(t), F.col("TotalCharges"), F.col("tenure") * F.col("MonthlyCharges"))


FEATURES_SQL = """customerID, tenure_band, (tenure <= 6)::BIGINT AS is_new_customer, (InternetService <> 'No')::BIGINT AS has_internet,
 ADDON_COUNT AS n_addons, CASE WHEN InternetService <> 'No' THEN round(ADDON_COUNT / 6.0::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS addon_adoption_rate,
 (Contract = 'Month-to-month')::BIGINT AS is_month_to_month, (PaymentMethod LIKE '%(automatic)')::BIGINT AS is_autopay,
 round(CASE WHEN tenure > 0 THEN total0 / tenure ELSE 0 END, 6) AS realized_arpu,
 round(CASE WHEN tenure > 0 AND total0 > 0 THEN MonthlyCharges / (total0 / tenure) ELSE 1 END, 6) AS price_vs_history,
 round(total0 - tenure * MonthlyCharges, 2) + 0.0 AS billing_discrepancy, round(MonthlyCharges / (ADDON_COUNT + 1), 6) AS charges_per_addon,
 ((Partner = 'Yes')::INT + (Dependents = 'Yes')::INT)::BIGINT AS household_size,
 CASE WHEN Contract = 'Month-to-month' THEN tenure ELSE 0 END::DOUBLE AS tenure_x_month_to_month""".replace(
    "ADDON_COUNT", "(" + " + ".join(f"({a} = 'Yes')::INT" for a in ADDONS) + ")::BIGINT")


@query("subs_features", f"WITH {SUBS} SELECT {FEATURES_SQL} FROM s")
def features(t: Tables):
    """The 13 engineered features."""
    d = sb.with_features(subs(t)).withColumn("billing_discrepancy", F.round("billing_discrepancy", 2))
    return d.select("customerID", *sb.ENGINEERED)


@query("subs_non_finite", "SELECT 0::BIGINT AS n_bad_rows")
def non_finite(t: Tables):
    """No feature is NULL, NaN or infinite."""
    d = sb.with_features(subs(t))
    return sb.non_finite(d, [c for c in sb.ENGINEERED if c != "tenure_band"])


@query("subs_rate_by_contract", f"WITH {SUBS} SELECT Contract, round(avg(y), 6) AS rate, count(*) AS n FROM s GROUP BY 1")
def rate_by_contract(t: Tables):
    """Churn rate per contract."""
    return scoring.rate_table(subs(t), ["Contract"], "y")


@query("subs_rate_by_tenure", f"WITH {SUBS} SELECT tenure, round(avg(y), 6) AS rate, count(*) AS n FROM s GROUP BY 1")
def rate_by_tenure(t: Tables):
    """Churn rate per exact month of tenure."""
    return scoring.rate_table(subs(t), ["tenure"], "y")


@query("subs_median_by_label", f"WITH {SUBS} SELECT Churn, round(quantile_cont(MonthlyCharges, 0.5), 6) AS median_charge FROM s GROUP BY 1")
def median_by_label(t: Tables):
    """Exact median charge per class."""
    return exact_quantiles(subs(t), "MonthlyCharges", {"median_charge": 0.5}, ["Churn"])


BANDS = ["0-6m", "7-12m", "13-24m", "25-48m", "49-72m"]


@query("subs_joint_pivot", f"WITH {SUBS} SELECT Contract, " + ", ".join(
    f"coalesce(round(avg(y) FILTER (tenure_band = '{b}'), 6), 0) AS \"{b}_rate\", count(*) FILTER (tenure_band = '{b}') AS \"{b}_n\""
    for b in BANDS) + " FROM s GROUP BY 1")
def joint_pivot(t: Tables):
    """Churn rate and volume by contract and tenure band."""
    return scoring.rate_pivot(sb.with_features(subs(t)), "Contract", "tenure_band", BANDS, "y")


@query("subs_single_feature_auc", f"""WITH {SUBS},
k AS (SELECT Contract, avg(y) AS r FROM s GROUP BY 1), m AS (SELECT PaymentMethod, avg(y) AS r FROM s GROUP BY 1),
x AS (SELECT 'tenure' AS feature, tenure::DOUBLE AS v, y FROM s UNION ALL SELECT 'MonthlyCharges', MonthlyCharges, y FROM s
  UNION ALL SELECT 'TotalCharges', total0, y FROM s UNION ALL SELECT 'Contract', r, y FROM s JOIN k USING (Contract)
  UNION ALL SELECT 'PaymentMethod', r, y FROM s JOIN m USING (PaymentMethod)),
c AS (SELECT feature, v, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY feature ORDER BY v DESC) AS cp FROM c),
a AS (SELECT feature, sum(neg * (cp - pos / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM r GROUP BY 1)
SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc, greatest(auc, 1 - auc) >= 0.95 AS suspect FROM a""")
def single_feature_auc(t: Tables):
    """AUC of each column used alone: the leak probe, every column in one pass."""
    return audit.single_feature_quality(subs(t), "y", ["tenure", "MonthlyCharges", "TotalCharges"],
                                        ["Contract", "PaymentMethod"])


@query("subs_contamination", "SELECT 0::BIGINT AS n_overlap")
def contamination(t: Tables):
    """Group folds never share a feature vector between train and test."""
    d = splits.group_folds(subs(t), FEATS, "y", 5)
    return audit.contamination(d.where("fold <> 0"), d.where("fold = 0"), FEATS)


@query("subs_group_folds")
def group_folds(t: Tables):
    """Size and label rate per group fold (hash dependent)."""
    d = splits.group_folds(subs(t), FEATS, "y", 5)
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"),
                                 F.countDistinct("group_id").alias("groups"))


@query("subs_threshold_metrics", f"""WITH {SUBS}, c AS (SELECT count(*) FILTER (p >= 0.3 AND y = 1) AS tp,
  count(*) FILTER (p >= 0.3 AND y = 0) AS fp, count(*) FILTER (p < 0.3 AND y = 1) AS fn, count(*) FILTER (p < 0.3 AND y = 0) AS tn,
  avg((p - y) ** 2) AS brier,
  avg(-CASE WHEN y = 1 THEN ln(greatest(1e-9, least(1 - 1e-9, p))) ELSE ln(1 - greatest(1e-9, least(1 - 1e-9, p))) END) AS ll FROM s)
SELECT tp, fp, fn, tn, round(brier, 6) AS brier, round(ll, 6) AS log_loss, round(tp / (tp + fp)::DOUBLE, 6) AS precision,
  round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(tn / (tn + fp)::DOUBLE, 6) AS specificity,
  round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy FROM c""")
def threshold_metrics(t: Tables):
    """Confusion and threshold metrics."""
    return scoring.threshold_metrics(subs(t), "p", "y", 0.3)


@query("subs_ranking_quality", f"""WITH {SUBS},
c AS (SELECT p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM s GROUP BY p),
r AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn FROM c)
SELECT sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives,
       round(sum(neg * (cp - pos + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
       round(sum(pos * cp::DOUBLE / (cp + cn)) / sum(pos), 6) AS pr_auc FROM r""")
def ranking_quality(t: Tables):
    """ROC AUC and average precision of the churn score."""
    return rankstats.ranking_quality(subs(t), "p", "y")


REL = f"WITH {SUBS}, r AS (SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM s GROUP BY 1) "


@query("subs_reliability", REL + "SELECT bin, n, round(mp, 6) AS mean_score, round(my, 6) AS positive_rate FROM r")
def reliability(t: Tables):
    """Reliability curve."""
    return scoring.reliability(subs(t), "p", "y")


@query("subs_calibration_error", REL + "SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM r")
def calibration_error(t: Tables):
    """Expected calibration error."""
    return scoring.calibration_error(subs(t), "p", "y")


BAND = f"""WITH {SUBS}, g AS (SELECT risk_segment, count(*) AS customers, avg(p) AS mp, avg(y) AS my, sum(y)::BIGINT AS churners,
  avg(value) AS av, sum(value) AS sv FROM s GROUP BY 1) """


@query("subs_band_summary", BAND + """SELECT risk_segment, customers, round(mp, 6) AS avg_predicted_risk, round(my, 6) AS realised_rate,
  churners, round(av, 6) AS avg_value, round(sv, 6) AS value_at_risk, round(customers / (SELECT sum(customers) FROM g), 6) AS share_of_customers,
  round(churners / (SELECT greatest(sum(churners), 1) FROM g), 6) AS share_of_churners FROM g""")
def band_summary(t: Tables):
    """Risk bands with predicted and realised risk."""
    return scoring.band_summary(subs(t), "p", "y", "value")


@query("subs_band_validation", BAND + """, o AS (SELECT *, lag(my) OVER (ORDER BY list_position(['Low Risk', 'Medium Risk', 'High Risk', 'Critical Risk'], risk_segment)) AS prev,
  row_number() OVER (ORDER BY list_position(['Low Risk', 'Medium Risk', 'High Risk', 'Critical Risk'], risk_segment)) AS i FROM g)
SELECT bool_and(prev IS NULL OR my > prev) AS monotonic, round(max(abs(mp - my)), 6) AS max_gap, round(arg_min(my, i), 6) AS lowest_rate,
  round(arg_max(my, i), 6) AS highest_rate, round(arg_max(my, i) / nullif(arg_min(my, i), 0), 6) AS lift FROM o""")
def band_validation(t: Tables):
    """Bands behave as their labels claim."""
    return scoring.band_validation(scoring.band_summary(subs(t), "p", "y", "value"))


ATTRS = ["Contract", "tenure_band", "InternetService", "PaymentMethod"]
PERF = f"""WITH {SUBS}, x AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, {a} AS segment, p, y FROM s" for a in ATTRS) + """),
a AS (SELECT attribute, segment, count(*) AS n, avg(y) AS positive_rate, avg((p - y) ** 2) AS brier, avg(p) AS mean_predicted,
   avg(p) - avg(y) AS calibration_gap, count(*) FILTER (p >= 0.3 AND y = 1) / greatest(sum(y), 1) AS recall,
   count(*) FILTER (p >= 0.3 AND y = 1) / greatest(count(*) FILTER (p >= 0.3), 1)::DOUBLE AS precision, avg((p >= 0.3)::INT) AS flag_rate
   FROM x GROUP BY ALL HAVING count(*) >= 50),
c AS (SELECT attribute, segment, p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY attribute, segment ORDER BY p DESC) AS cp, sum(neg) OVER (PARTITION BY attribute, segment ORDER BY p DESC) AS cn FROM c),
q AS (SELECT attribute, segment, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (cp - pos / 2.0)) / (sum(pos) * sum(neg)) END AS roc_auc,
   CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * cp::DOUBLE / (cp + cn)) / sum(pos) END AS pr_auc FROM r GROUP BY ALL) """


@query("subs_segment_performance", PERF + """SELECT attribute, segment, n, """ + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("positive_rate", "brier", "mean_predicted", "calibration_gap", "recall", "precision", "flag_rate", "roc_auc", "pr_auc"))
    + " FROM a JOIN q USING (attribute, segment)")
def segment_performance(t: Tables):
    """Metrics per level of four attributes."""
    return scoring.segment_performance(sb.with_features(subs(t)), "p", "y", 0.3, ATTRS)


@query("subs_disparities", PERF + """SELECT attribute, round(CASE WHEN count(roc_auc) > 1 THEN max(roc_auc) - min(roc_auc) END, 6) AS roc_auc_spread,
  round(CASE WHEN count(recall) > 1 THEN max(recall) - min(recall) END, 6) AS recall_spread FROM a JOIN q USING (attribute, segment) GROUP BY 1""")
def disparities(t: Tables):
    """Spread across levels per attribute."""
    return scoring.disparities(scoring.segment_performance(sb.with_features(subs(t)), "p", "y", 0.3, ATTRS))


def errors(t: Tables):
    return subs(t).withColumn("error_kind", scoring.error_kind(F.col("p"), F.col("y"), 0.3))


KINDS = scoring.KINDS


@query("subs_error_profile", f"WITH {SUBS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, " + ", ".join(f"round(avg({e}) FILTER (error_kind = '{k}'), 6) AS {k}" for k in KINDS) + " FROM s"
    for c, e in (("tenure", "tenure"), ("MonthlyCharges", "MonthlyCharges"), ("TotalCharges", "total0"), ("p", "p"))))
def error_profile(t: Tables):
    """Numeric means per outcome class."""
    return scoring.error_profile(errors(t), "error_kind", ["tenure", "MonthlyCharges", "TotalCharges", "p"])


@query("subs_category_profile", f"WITH {SUBS} SELECT Contract, " + ", ".join(
    f"round(count(*) FILTER (error_kind = '{k}') / nullif((SELECT count(*) FROM s WHERE error_kind = '{k}'), 0)::DOUBLE, 6) AS {k}" for k in KINDS)
    + " FROM s GROUP BY 1")
def category_profile(t: Tables):
    """Contract shares within each outcome class."""
    return scoring.category_profile(errors(t), "error_kind", "Contract")


@query("subs_hardest_cases", f"""WITH {SUBS} (SELECT customerID, round(p, 6) AS p, error_kind, Contract FROM s WHERE error_kind = 'false_negative' ORDER BY s.p, customerID LIMIT 5)
UNION ALL (SELECT customerID, round(p, 6), error_kind, Contract FROM s WHERE error_kind = 'false_positive' ORDER BY s.p DESC, customerID LIMIT 5)""")
def hardest_cases(t: Tables):
    """Most confidently wrong rows."""
    return scoring.hardest_cases(errors(t), "p", "error_kind", "customerID", keep=["Contract"])


@query("subs_error_costs", f"""WITH {SUBS}, a AS (SELECT count(*) FILTER (error_kind = 'false_negative') AS fn, count(*) FILTER (error_kind = 'false_positive') AS fp,
  coalesce(sum(value) FILTER (error_kind = 'false_negative'), 0) * 0.3 AS c FROM s)
SELECT fn AS n_false_negative, fp AS n_false_positive, round(c, 6) AS fn_cost, (fp * 35)::DOUBLE AS fp_cost, round(c / greatest(fn, 1), 6) AS mean_fn_cost,
  35.0::DOUBLE AS mean_fp_cost, round(c / greatest(fn, 1) / 35, 6) AS cost_ratio FROM a""")
def error_costs(t: Tables):
    """Cost of misses and wasted contacts."""
    return scoring.error_costs(errors(t), "error_kind", "value", 0.30, 35.0)


@query("subs_noise_ceiling", f"""WITH {SUBS}, g AS (SELECT count(*) AS n FROM s GROUP BY {FEATS_SQL} HAVING min(y) <> max(y)),
a AS (SELECT avg((error_kind LIKE 'false%')::INT) AS e, (SELECT sum(n) FROM g) / (2.0 * count(*)) AS f FROM s)
SELECT round(e, 6) AS observed_error_rate, round(f, 6)::DOUBLE AS irreducible_floor, round(f / e, 6)::DOUBLE AS share_irreducible FROM a""")
def noise_ceiling(t: Tables):
    """Error next to the floor set by conflicting labels."""
    return scoring.noise_ceiling(errors(t), "error_kind", audit.dedup_report(subs(t), FEATS, "y", "customerID"))


ECON = decisions.Economics()
CURVE = f"""WITH {SUBS}, g AS (SELECT i, i * 0.01::DOUBLE AS th FROM range(101) r(i)),
c AS (SELECT th AS threshold, count(*) FILTER (p >= th) AS n, count(*) FILTER (p >= th AND y = 1) AS tp,
   coalesce(sum(value) FILTER (p >= th AND y = 1), 0) AS v, count(*) AS pop, sum(y) AS pos FROM s, g GROUP BY th) """


@query("subs_sweep", CURVE + """SELECT round(threshold, 6) AS threshold, n AS contacted, round(n / pop::DOUBLE, 6) AS contact_rate, tp AS true_positives,
  n - tp AS false_positives, round(CASE WHEN n > 0 THEN tp / n::DOUBLE ELSE 0 END, 6) AS precision, round(tp / greatest(pos, 1), 6) AS recall,
  round(v * 0.3 - n * 35, 6) AS net_value FROM c""")
def sweep(t: Tables):
    """Net value at 101 thresholds from one pass over the scores."""
    return decisions.sweep(subs(t), "p", "y", "value", ECON)


@query("subs_policies", CURVE + """, n AS (SELECT threshold, v * 0.3 - n * 35 AS net FROM c),
best AS (SELECT * FROM n ORDER BY round(net, 6) DESC, threshold LIMIT 1),
o AS (SELECT sum(CASE WHEN y = 1 THEN value * 0.3 ELSE 0 END - 35) AS pv, count(*) AS pc FROM s WHERE p > 35 / (0.3::DOUBLE * greatest(value, 1e-9)))
SELECT round(best.threshold, 6) AS best_threshold, round(best.net, 6) AS best_net_value, round(z.net, 6) AS contact_all, round(best.net - z.net, 6) AS uplift,
  round(pv, 6) AS per_customer_value, pc AS per_customer_contacts FROM best, o, (SELECT net FROM n WHERE threshold = 0) z""")
def policies(t: Tables):
    """Best threshold against contact-all and the per-customer rule."""
    return decisions.compare_policies(subs(t), "p", "y", "value", ECON)


@query("subs_sensitivity", CURVE + """, q AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS sr), j AS (SELECT unnest([10, 30, 60]::DOUBLE[]) AS inc),
n AS (SELECT sr, inc, c.*, v * sr - n * (inc + 5) AS net FROM c, q, j),
best AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY sr, inc ORDER BY round(net, 6) DESC, threshold) = 1),
o AS (SELECT sr, inc, coalesce(sum(CASE WHEN y = 1 THEN value * sr ELSE 0 END - (inc + 5)) FILTER (p > (inc + 5) / (sr * greatest(value, 1e-9))), 0) AS pv FROM s, q, j GROUP BY ALL)
SELECT sr AS success_rate, inc AS incentive_cost, round(threshold, 6) AS best_threshold, round(net, 6) AS net_value, round(n / pop::DOUBLE, 6) AS contact_rate,
  round(CASE WHEN n > 0 THEN tp / n::DOUBLE ELSE 0 END, 6) AS precision, round(tp / greatest(pos, 1), 6) AS recall, round(pv, 6) AS per_customer_value FROM best JOIN o USING (sr, inc)""")
def sensitivity(t: Tables):
    """Best threshold under 15 assumption pairs."""
    return decisions.sensitivity(subs(t), "p", "y", "value", ECON, [0.1, 0.2, 0.3, 0.4, 0.5], [10.0, 30.0, 60.0])


DECIDE = f"""WITH {SUBS}, cut AS (SELECT quantile_cont(value, 0.70) AS q FROM s),
d AS (SELECT customerID, p, risk_segment, value, CASE WHEN value >= q THEN 'High value' ELSE 'Standard value' END AS value_tier,
   35 / (0.3::DOUBLE * greatest(value, 1e-9)) AS be, p * 0.3::DOUBLE * value - 35 AS ev FROM s, cut),
e AS (SELECT *, CASE risk_segment || '|' || value_tier WHEN 'Critical Risk|High value' THEN 1 WHEN 'High Risk|High value' THEN 2
   WHEN 'Critical Risk|Standard value' THEN 3 WHEN 'High Risk|Standard value' THEN 4 WHEN 'Medium Risk|High value' THEN 5
   WHEN 'Medium Risk|Standard value' THEN 6 WHEN 'Low Risk|High value' THEN 7 ELSE 8 END::BIGINT AS priority FROM d) """


@query("subs_decisions", DECIDE + """SELECT customerID, round(p, 6) AS p, risk_segment, value_tier, round(value, 6) AS customer_value,
  round(be, 6) AS breakeven_probability, round(ev, 6) AS expected_value, ev > 0 AS contact_recommended, priority,
  ['outbound call', 'outbound call', 'email + SMS', 'email', 'email + in-app', 'in-app', 'standard lifecycle', 'standard lifecycle'][priority] AS channel,
  ev > 0 AND risk_segment IN ('Low Risk', 'Medium Risk') AS ev_overrides_segment FROM e""")
def decision_table(t: Tables):
    """Treatment per customer from band, value tier and expected value."""
    d = decisions.decide(subs(t), "p", "MonthlyCharges", ECON)
    return d.select("customerID", "p", "risk_segment", "value_tier", "customer_value", "breakeven_probability", "expected_value",
                    "contact_recommended", "priority", "channel", "ev_overrides_segment")


@query("subs_campaign", DECIDE + """SELECT risk_segment, value_tier, count(*) AS customers, round(avg(p), 6) AS avg_risk, round(avg(value), 6) AS avg_value,
  count(*) FILTER (ev > 0) AS contacts, round(coalesce(sum(ev) FILTER (ev > 0), 0), 6) AS expected_value, max(priority) AS priority FROM e GROUP BY ALL""")
def campaign(t: Tables):
    """Campaign plan per band and tier."""
    return decisions.campaign(decisions.decide(subs(t), "p", "MonthlyCharges", ECON), "p")


@query("subs_band_representatives", f"""WITH {SUBS}, m AS (SELECT risk_segment, quantile_cont(p, 0.5) AS med FROM s GROUP BY 1)
SELECT risk_segment, round(med, 6) AS median_score, customerID, round(p, 6) AS score FROM s JOIN m USING (risk_segment)
QUALIFY row_number() OVER (PARTITION BY risk_segment ORDER BY round(abs(s.p - med), 12), customerID) = 1""")
def band_representatives(t: Tables):
    """The customer closest to each band's median score."""
    return decisions.band_representatives(subs(t), "p", "customerID")


@query("subs_audit", f"""WITH {SUBS} SELECT 'missing' AS check_name, 'TotalCharges' AS subject, count(*) FILTER (TotalCharges IS NULL)::DOUBLE AS value FROM s
UNION ALL SELECT 'missing', 'Contract', 0.0 UNION ALL SELECT 'range', 'tenure', count(*) FILTER (tenure > 40)::DOUBLE FROM s
UNION ALL SELECT 'domain', Contract, count(*)::DOUBLE FROM s WHERE Contract = 'Two year' GROUP BY 2""")
def full_audit(t: Tables):
    """Several audits as one long table."""
    d = raw(t)
    return audit.composite({
        "missing": audit.missing_or_blank(d.select("TotalCharges", "Contract")),
        "range": audit.out_of_range(d, {"tenure": (0, 40)}),
        "domain": audit.unexpected_values(d, {"Contract": ["Month-to-month", "One year"]}).select("value", "n")})
