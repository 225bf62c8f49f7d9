"""Model jobs on the subscriber, payment and demand tables. Fitted models have no SQL twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bindings import demand, payments, subscribers
from bindings.registry import Tables, query
from quarrylane.operators import features, forecasts, inventory, models, panel, scoring, splits, staging, walk
from quarrylane.operators import subscribers as sb
from quarrylane.operators import transactions as tx
from quarrylane.plans.prefix import exact_quantiles
from quarrylane.session import checkpointed
from quarrylane.sources import sinks

NUMERIC = ["tenure", "MonthlyCharges", "n_addons", "household_size", "billing_discrepancy", "charges_per_addon"]
CATEGORICAL = ["Contract", "InternetService", "PaymentMethod", "tenure_band"]


def people(t: Tables):
    """Subscribers with features and leak-free folds, written once for all fits and uses of a query."""
    def build():
        d = sb.with_features(subscribers.subs(t)).drop("p").withColumn("y", F.col("y").cast("double"))
        return splits.group_folds(d, subscribers.FEATS, "y", 5)

    return t.kept("people", build)


@query("model_search")
def search(t: Tables):
    """Cross-validated comparison of prior, logistic, forest and boosted candidates."""
    spaces = {"prior": [{}], "logistic_regression": [{"regParam": 0.01}], "random_forest": [{"numTrees": 10, "maxDepth": 5}],
              "boosted_trees": [{"maxIter": 5, "maxDepth": 3}]}
    return models.search(people(t), "y", NUMERIC, CATEGORICAL, spaces)


@query("model_best_candidate")
def best_candidate(t: Tables):
    """The selected candidate."""
    spaces = {"prior": [{}], "logistic_regression": [{"regParam": 0.01}, {"regParam": 0.1}]}
    return models.select_best(models.search(people(t), "y", NUMERIC, CATEGORICAL, spaces))


@query("model_split_stability")
def split_stability(t: Tables):
    """Each fold as the test set in turn."""
    return models.fold_metrics(models.cross_validate(people(t), "y", "logistic_regression", {"regParam": 0.01}, NUMERIC, CATEGORICAL), "y")


@query("model_calibration")
def calibration(t: Tables):
    """Sigmoid and isotonic calibration against none."""
    d = people(t)
    oof = checkpointed(models.cross_validate(d, "y", "logistic_regression", {"regParam": 0.01}, NUMERIC, CATEGORICAL))
    return models.calibration_table(oof.where("fold <> 0"), oof.where("fold = 0"), "y")


def linear(t: Tables):
    d = models.balanced_weights(people(t), "y")
    return models.fit(d, "logistic_regression", NUMERIC, CATEGORICAL, regParam=0.01), d


CONCEPTS = {"tenure": "tenure", "tenure_band": "tenure", "MonthlyCharges": "price", "charges_per_addon": "price"}


def contributions(t: Tables):
    m, d = linear(t)
    c = models.linear_contributions(m, d, "customerID")
    return models.grouped_contributions(c, "customerID", [*NUMERIC, *CATEGORICAL], CONCEPTS, {"No internet service": "InternetService"})


@query("model_global_importance")
def global_importance(t: Tables):
    """Mean absolute contribution per concept."""
    return models.global_importance(contributions(t), "customerID", "concept")


@query("model_top_factors")
def top_factors(t: Tables):
    """Strongest reasons per customer as JSON."""
    return models.top_factors(contributions(t), "customerID", people(t), [*NUMERIC, *CATEGORICAL])


# A stated scorer: log-odds per unit, so that attribution can be checked without a fitted model.
STATED = {"tenure": -0.03, "MonthlyCharges": 0.02}
STATED_SQL = f"""WITH {subscribers.SUBS}, m AS (SELECT avg(tenure) AS a, avg(MonthlyCharges) AS b FROM s),
c AS (SELECT customerID, 'tenure' AS feature, 'tenure' AS concept, -0.03 * (tenure - m.a) AS v, tenure::VARCHAR AS x FROM s, m
  UNION ALL SELECT customerID, 'MonthlyCharges', 'price', 0.02 * (MonthlyCharges - m.b), NULL FROM s, m)"""


def stated(t: Tables):
    d = subscribers.subs(t)
    c = models.stated_contributions(d, "customerID", STATED)
    return models.grouped_contributions(c, "customerID", ["tenure", "MonthlyCharges"], CONCEPTS, {})


@query("model_stated_importance", STATED_SQL + " SELECT concept, round(sum(abs(v)) / count(DISTINCT customerID), 6) AS importance FROM c GROUP BY 1")
def stated_importance(t: Tables):
    """Mean absolute contribution per concept of a stated linear scorer."""
    return models.global_importance(stated(t), "customerID", "concept")


@query("model_stated_factors", STATED_SQL + """ SELECT customerID, CASE WHEN v > 0 THEN 'raises' ELSE 'lowers' END AS direction, 'tenure = ' || x || CASE WHEN v > 0 THEN ' raises' ELSE ' lowers' END || ' the risk' AS reason
FROM c WHERE feature = 'tenure' AND abs(v) >= 0.02""")
def stated_factors(t: Tables):
    """What a stated scorer says of each customer's tenure, in a phrase from the row's own value."""
    f = models.top_factors(stated(t), "customerID", subscribers.subs(t).withColumn("tenure", F.col("tenure").cast("long")), ["tenure", "MonthlyCharges"])
    reasons = F.explode(F.from_json("factors", "array<struct<concept:string,reason:string>>"))
    return f.select("customerID", "direction", reasons.alias("x")).where("x.concept = 'tenure'").select("customerID", "direction", "x.reason")


@query("model_bundle_round_trip")
def bundle_round_trip(t: Tables):
    """Model saved with its contract, loaded and applied to new rows."""
    m, d = linear(t)
    path = sinks.shared_folder(t.spark, "bundle")
    models.save_bundle(m, path, {"columns": [*NUMERIC, *CATEGORICAL], "threshold": 0.5})
    m2, contract = models.load_bundle(path)
    s = models.score_with_contract(m2, d.drop("label", "weight"), contract)
    return scoring.threshold_metrics(s, "p", "y", contract["threshold"])


@query("model_scored_decisions")
def scored_decisions(t: Tables):
    """New customers scored under a saved contract, with band, value tier, action and priority."""
    m, d = linear(t)
    path = sinks.shared_folder(t.spark, "bundle")
    cut = exact_quantiles(d, "MonthlyCharges", {"q": 0.7}).first()["q"] * subscribers.ECON.horizon_months
    models.save_bundle(m, path, {"columns": [*NUMERIC, *CATEGORICAL], "threshold": 0.5, "monthly": "MonthlyCharges", "value_cut": cut})
    m2, contract = models.load_bundle(path)
    s = models.score_and_decide(m2, d.drop("label", "weight", "y"), contract, subscribers.ECON)
    return s.select("customerID", "p", "positive_at_threshold", "risk_segment", "value_tier", "expected_value", "contact_recommended", "priority")


@query("model_payment_classifiers")
def payment_classifiers(t: Tables):
    """Balanced classifiers on the temporal split, scored on the later part."""
    d = splits.temporal_split(payments.transactions(t), "step")
    d = checkpointed(tx.design_matrix(d, list(payments.TYPES.values()), keep=["event_id", "part"]).withColumn("y", F.col("isFraud").cast("double")))
    train, test = models.balanced_weights(d.where("part = 'train'"), "y"), d.where("part = 'test'")
    numeric = [c for c in d.columns if c not in ("event_id", "part", "isFraud", "y")]
    medians, out = models.fitted_imputer(train, numeric), None
    for family, s in (("logistic_regression", {}), ("random_forest", {"numTrees": 10, "maxDepth": 5}), ("boosted_trees", {"maxIter": 5, "maxDepth": 3})):
        scored = models.score(models.fit(train, family, numeric, [], medians, **s), test)
        row = models.ranking_quality(scored, "p", "y").select(F.lit(family).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("model_base_prior")
def base_prior(t: Tables):
    """A fitted boosted classifier scored round by round from its base rate and from one half."""
    d = splits.temporal_split(payments.transactions(t), "step")
    d = checkpointed(tx.design_matrix(d, list(payments.TYPES.values()), keep=["event_id", "part"]).withColumn("y", F.col("isFraud").cast("double")))
    train, test = models.balanced_weights(d.where("part = 'train'"), "y").withColumn("weight", F.lit(1.0)), d.where("part = 'test'")
    numeric = [c for c in d.columns if c not in ("event_id", "part", "isFraud", "y")]
    fitted = models.fit(train, "boosted_trees", numeric, [], maxIter=10, maxDepth=3)
    starts = {"prior": train.agg(F.avg("y").alias("r")).scalar(), "half": 0.5}
    return staging.diagnosis(staging.staged_scores(staging.tree_margins(fitted, test), starts, (1, 2, 5, 10), ["y"]), "y")


# Smaller than models.DEMAND_SETTINGS, so that the queries end in seconds on one machine.
LIGHT = {"tweedie": {"maxIter": 15}, "boosted_trees": {"maxIter": 10, "maxDepth": 5, "stepSize": 0.1}, "random_forest": {"numTrees": 20, "maxDepth": 8, "minInstancesPerNode": 20}}
DEM = ["lag_1", "lag_7", "rolling_mean_7", "rolling_mean_28", "rolling_std_28", "nonzero_rate_28", "hist_mean", "croston_at_origin", "horizon", "dow"]


def supervised(t: Tables):
    """Training rows whose labels end before the test origin, and the test rows."""
    p = demand.base(t)
    origins = splits.training_origins(demand.FIRST, demand.TEST_ORIGIN, 28, 28, count=8)
    cols = ["series_id", "origin", "horizon", "target_date", "y_true", "store_id", *[c for c in DEM if c != "horizon"]]
    d = demand.attributes(features.supervised(p, [*origins, demand.TEST_ORIGIN], demand.H, demand.FIRST)).select(*cols)
    d = checkpointed(d.withColumns({c: F.col(c).cast("double") for c in DEM}))
    return d.where(F.col("origin") < F.lit(demand.TEST_ORIGIN)), d.where(F.col("origin") == F.lit(demand.TEST_ORIGIN))


@query("model_demand")
def demand_models(t: Tables):
    """Global demand models scored on the held-out window."""
    train, test = supervised(t)
    d = test.withColumn("moving_average_28", F.col("rolling_mean_28"))
    out = forecasts.scores(d, ["moving_average_28"])
    for f in ("tweedie", "boosted_trees", "random_forest"):
        m = models.fit_demand(train, f, DEM, ["store_id"], **LIGHT[f])
        s = models.predict_demand(m, test, DEM, f, 0.0 if f == "tweedie" else -999.0).select("y_true", f)
        out = out.unionByName(forecasts.scores(s, [f]))
    return out


@query("model_demand_importance")
def demand_importance(t: Tables):
    """Feature importance of the forest."""
    train, _ = supervised(t)
    return models.importance(models.fit_demand(train, "random_forest", DEM, ["store_id"], **LIGHT["random_forest"]), [*DEM, "store_id"])


@query("model_forecast_job")
def forecast_job(t: Tables):
    """Forecast of every series beyond the last day, exogenous values carried forward."""
    train, _ = supervised(t)
    m = models.fit_demand(train, "boosted_trees", DEM, ["store_id"], **LIGHT["boosted_trees"])
    last = dt.date(2001, 10, 1)
    p = demand.base(t).where(F.col("date") <= F.lit(last))
    future = panel.with_future(p, last, 14)
    rows = demand.attributes(features.supervised(future, [last], list(range(1, 15)), demand.FIRST, require_actuals=False))
    rows = rows.withColumns({c: F.col(c).cast("double") for c in DEM})
    return models.predict_demand(m, rows, DEM, "forecast").select("series_id", "target_date", "horizon", "forecast")


WALK = {"tweedie": models.DEMAND_SETTINGS["tweedie"], "random_forest": LIGHT["random_forest"]}
PROTECTION, ERROR_STEP = 14, 7


def known_origins(last: dt.date) -> list[dt.date]:
    """Training origins of a fold whose last known day is given."""
    return splits.training_origins(demand.FIRST, last, 28, 28, count=8, step=28)


@query("model_walk_forward")
def walk_forward(t: Tables):
    """Two models refitted in each of four folds, scored on the fold's window and on origins stepped through it."""
    origins = walk.origins_needed(demand.FOLDS, known_origins, PROTECTION, ERROR_STEP)
    cols = ["series_id", "origin", "target_date", "y_true", "store_id", *DEM]
    d = demand.attributes(features.supervised(demand.base(t), origins, demand.H, demand.FIRST)).select(*cols)
    d = checkpointed(d.withColumns({c: F.col(c).cast("double") for c in DEM}))
    f = walk.walk_forward(d, demand.FOLDS, known_origins, WALK, DEM, ["store_id"], PROTECTION, ERROR_STEP)
    return walk.fold_scores(f)


@query("model_forecast_bundle")
def forecast_bundle(t: Tables):
    """A forecast bundle saved, loaded and applied: the held-out window with intervals and reorder points."""
    train, test = supervised(t)
    m = models.fit_demand(train, "tweedie", DEM, ["store_id"], **LIGHT["tweedie"])
    known = models.predict_demand(m, train, DEM, "forecast", 0.0)
    residuals = forecasts.residual_quantiles(known, "forecast")
    policy = inventory.baseline_policy(demand.base(t), demand.TERMS, demand.TEST_ORIGIN)
    path = sinks.shared_folder(t.spark, "forecaster")
    models.save_forecast_bundle(m, path, {"numeric": DEM, "categorical": ["store_id"], "origin": str(demand.TEST_ORIGIN)}, policy, residuals)
    m2, contract, tables = models.load_forecast_bundle(path)
    p = models.predict_demand(m2, test, contract["numeric"], "forecast", 0.0)
    p = forecasts.with_intervals(p, "forecast", tables["residuals"])
    return p.join(tables["policy"], "series_id", "left").select(
        "series_id", "target_date", "horizon", "forecast", "q10", "q90", "reorder_point_normal")


@query("model_holt_winters")
def holt_winters(t: Tables):
    """Weekly smoothing of a class-balanced sample of series, scored beside a baseline on the same sample."""
    p = demand.base(t)
    s = panel.demand_stats(p.where(F.col("date") <= F.lit(demand.TEST_ORIGIN)))
    s = s.withColumn("demand_class", panel.demand_class(F.col("adi"), F.col("cv2")))
    sample = panel.equal_sample(s, "demand_class", "series_id", 20, 4).select("series_id")
    kept = p.join(F.broadcast(sample), "series_id", "left_semi")
    hist = kept.where(F.col("date") <= F.lit(demand.TEST_ORIGIN))
    ets = models.holt_winters(hist, 28)
    pr = demand.predictions(t, [demand.TEST_ORIGIN]).join(sample, "series_id", "left_semi")
    return forecasts.scores(pr.join(ets, ["series_id", "horizon"]), ["ets", "sba", "moving_average_28"])
