"""Model jobs on MLlib: preprocessing, candidates, folds, calibration, attribution."""

from __future__ import annotations

import json
import math
import platform
import random
import warnings
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyspark
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, ImputerModel, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.operators import scoring
from quarrylane.operators.audit import require_columns
from quarrylane.operators.decisions import Economics, decide
from quarrylane.operators.panel import DATE, DEMAND, SERIES
from quarrylane.operators.rankstats import ranking_quality
from quarrylane.operators.scoring import checked_score

LABEL, WEIGHT, FEATURES, SCORE = "label", "weight", "features", "p"


def preprocessor(numeric: Sequence[str], categorical: Sequence[str], scale: bool) -> list:
    """Median impute, optional scaling, one-hot with unknown levels as zeros."""
    stages: list = [
        Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}__i" for c in numeric]),
        VectorAssembler(inputCols=[f"{c}__i" for c in numeric], outputCol="__num")]
    number = "__num"
    if scale:
        stages.append(StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True, withStd=True))
        number = "__scaled"
    parts = [number]
    if categorical:
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__x" for c in categorical],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            # The "keep" index of unknown levels is the last one, and dropLast makes it all zeros.
            OneHotEncoder(inputCols=[f"{c}__x" for c in categorical], outputCols=[f"{c}__h" for c in categorical], dropLast=True)]
        parts += [f"{c}__h" for c in categorical]
    return [*stages, VectorAssembler(inputCols=parts, outputCol=FEATURES)]


def feature_names(df: DataFrame) -> list[str]:
    """Names of the assembled vector's positions, from its metadata; scaling forgets names, so they come from its input."""
    def names(column: str) -> list[str]:
        attrs = df.schema[column].metadata["ml_attr"]["attrs"]
        every = sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"])
        return [a.get("name", str(a["idx"])) for a in every]

    scaled = {f"__scaled_{i}": n for i, n in enumerate(names("__num"))} if "__scaled" in df.columns else {}
    return [scaled.get(n, n) for n in names(FEATURES)]


def balanced_weights(df: DataFrame, y: str) -> DataFrame:
    """Weight each class by n / (2 * n_class). The two weights are counted once here, not again by every job of a fit."""
    pos = F.sum(F.col(y).cast("long"))
    every = F.count(F.lit(1))
    s = df.agg(F.try_divide(every, 2 * pos).alias("w1"), F.try_divide(every, 2 * (every - pos)).alias("w0")).first()
    w = F.when(F.col(y) == 1, F.lit(s["w1"]).cast("double")).otherwise(F.lit(s["w0"]).cast("double"))
    return df.withColumns({LABEL: F.col(y).cast("double"), WEIGHT: w})


def candidates(seed: int = 42) -> dict[str, Callable]:
    """Model families; each builds an estimator from its settings."""
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "weightCol": WEIGHT}
    return {
        "logistic_regression": lambda **k: LogisticRegression(**common, maxIter=k.pop("maxIter", 50), **k),
        "random_forest": lambda **k: RandomForestClassifier(**common, seed=seed, **k),
        "boosted_trees": lambda **k: GBTClassifier(**common, seed=seed, **k)}


# The settings each family is searched over. "C" is the inverse of the summed penalty.
SPACES = {"logistic_regression": {"C": (0.01, 0.1, 0.5, 1.0, 2.0, 5.0)},
          "random_forest": {"numTrees": (300, 500), "maxDepth": (6, 10, 16), "minInstancesPerNode": (1, 5, 15, 30), "featureSubsetStrategy": ("sqrt", "0.3", "0.6")},
          "boosted_trees": {"maxIter": (300, 600), "maxDepth": (3, 4, 6, 8), "stepSize": (0.02, 0.05, 0.1), "subsamplingRate": (0.7, 0.85, 1.0),
                            "featureSubsetStrategy": ("0.6", "0.8", "all"), "minInstancesPerNode": (1, 5, 10)}}
SEARCHED = 30


def sampled_settings(space: Mapping[str, Sequence], n: int = SEARCHED, seed: int = 42) -> list[dict]:
    """At most ``n`` different settings of a space, drawn repeatably without replacement."""
    size = math.prod(len(v) for v in space.values())
    picked = random.Random(seed).sample(range(size), min(n, size))
    out = []
    for i in picked:
        row = {}
        for name, values in space.items():
            i, k = divmod(i, len(values))
            row[name] = values[k]
        out.append(row)
    return out


def fitted_imputer(df: DataFrame, numeric: Sequence[str]) -> ImputerModel:
    """The medians of the numbers, for several fits on the same rows."""
    return preprocessor(numeric, [], False)[0].fit(df)


def fit(df: DataFrame, family: str, numeric: Sequence[str], categorical: Sequence[str], imputer: ImputerModel | None = None, **settings) -> PipelineModel:
    if "C" in settings:
        settings["regParam"] = 1.0 / (settings.pop("C") * max(1, df.count()))
    stages = preprocessor(numeric, categorical, scale=family == "logistic_regression")
    if imputer is not None:
        stages[0] = imputer
    return Pipeline(stages=[*stages, candidates()[family](**settings)]).fit(df)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Positive-class probability; everything else stays out."""
    return model.transform(df).select(*df.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(SCORE))


def prior_scores(train: DataFrame, df: DataFrame, y: str) -> DataFrame:
    """Baseline that always predicts the base rate."""
    return df.withColumn(SCORE, train.agg(F.avg(y).alias("r")).scalar())


def cross_validate(df: DataFrame, y: str, family: str, settings: Mapping, numeric: Sequence[str],
                   categorical: Sequence[str], fold: str = "fold") -> DataFrame:
    """Out-of-fold scores; a row is always scored by a model that never saw its group."""
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        train = balanced_weights(df.where(F.col(fold) != k), y)
        part = (prior_scores(train, df.where(F.col(fold) == k), y) if family == "prior"
                else score(fit(train, family, numeric, categorical, **settings), df.where(F.col(fold) == k)))
        out = part if out is None else out.unionByName(part)
    return out


def fold_metrics(scored: DataFrame, y: str, fold: str = "fold") -> DataFrame:
    """PR AUC, ROC AUC, Brier, and precision, recall and F1 at one half, of every fold used in turn as the test."""
    q = ranking_quality(scored, SCORE, y, [fold]).select(fold, "roc_auc", "pr_auc")
    hit, pos = F.col(SCORE) >= 0.5, F.col(y) == 1
    b = scored.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("positive_rate"), F.avg(F.pow(F.col(SCORE) - F.col(y), 2)).alias("brier"),
                                 F.count_if(hit & pos).alias("__tp"), F.count_if(hit).alias("__hit"), F.count_if(pos).alias("__pos"))
    zero = F.lit(0.0)
    b = b.withColumns({"precision": F.coalesce(F.try_divide("__tp", F.col("__hit")), zero), "recall": F.coalesce(F.try_divide("__tp", F.col("__pos")), zero),
                       "f1": F.coalesce(F.try_divide(2 * F.col("__tp"), F.col("__hit") + F.col("__pos")), zero)}).drop("__tp", "__hit", "__pos")
    return b.join(q, fold)


def search(df: DataFrame, y: str, numeric: Sequence[str], categorical: Sequence[str],
           spaces: Mapping[str, Sequence[Mapping]] | None = None) -> DataFrame:
    """Cross-validated quality of every candidate setting, best first; by default of settings drawn from SPACES."""
    out = None
    for family, settings in (spaces or {"prior": [{}], **{f: sampled_settings(s) for f, s in SPACES.items()}}).items():
        for s in settings:
            m = fold_metrics(cross_validate(df, y, family, s, numeric, categorical), y)
            row = m.agg(F.avg("pr_auc").alias("pr_auc"), F.stddev_pop("pr_auc").alias("pr_auc_std"),
                        *[F.avg(c).alias(c) for c in ("roc_auc", "brier", "precision", "recall", "f1")]).select(
                F.lit(family).alias("model"), F.lit(json.dumps(dict(s))).alias("settings"), "*")
            out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc_nulls_last("pr_auc"), "model")


def select_best(table: DataFrame) -> DataFrame:
    """Highest cross-validated PR AUC among real candidates."""
    best = F.max_by(F.struct("model", "settings", "pr_auc"), F.col("pr_auc"))
    return table.where(F.col("model") != "prior").agg(best.alias("b")).select("b.*")


def calibrated(train: DataFrame, test: DataFrame, y: str, method: str) -> DataFrame:
    """Test scores mapped by a calibrator fitted on out-of-fold training scores."""
    t = train.select(F.col(SCORE).cast("double"), F.col(y).cast("double").alias(LABEL))
    if method == "none":
        return test
    if method == "isotonic":
        m = IsotonicRegression(featuresCol=SCORE, labelCol=LABEL).fit(t)
        return m.transform(test.withColumnRenamed(SCORE, "__raw").withColumn(SCORE, F.col("__raw"))).drop(
            SCORE, "__raw").withColumnRenamed("prediction", SCORE)
    va = VectorAssembler(inputCols=[SCORE], outputCol="__v")
    m = LogisticRegression(featuresCol="__v", labelCol=LABEL).fit(va.transform(t))
    new = m.transform(va.transform(test))
    return new.withColumn("__p", F.get(vector_to_array("probability"), F.lit(1))).select(
        *[c for c in test.columns if c != SCORE], F.col("__p").alias(SCORE))


def calibration_table(train: DataFrame, test: DataFrame, y: str, min_gain: float = 0.001,
                      methods: Sequence[str] = ("none", "sigmoid", "isotonic")) -> DataFrame:
    """Brier score and ECE per method; another method is adopted only for a clear gain."""
    out = None
    for m in methods:
        c = calibrated(train, test, y, m)
        brier = c.agg(F.avg(F.pow(F.col(SCORE) - F.col(y), 2)).alias("b")).scalar()
        row = scoring.calibration_error(c, SCORE, y).select(F.lit(m).alias("method"), brier.alias("brier"), "ece")
        out = row if out is None else out.unionByName(row)
    every = Window.partitionBy()  # one row per method
    base = F.max(F.when(F.col("method") == "none", F.col("brier"))).over(every)
    best = F.min(F.when(F.col("method") != "none", F.col("brier"))).over(every)
    adopt = F.when(base - best >= min_gain, (F.col("method") != "none") & (F.col("brier") == best)).otherwise(F.col("method") == "none")
    return out.withColumn("adopted", adopt)


def linear_contributions(model: PipelineModel, df: DataFrame, ident: str) -> DataFrame:
    """Exact attribution of a linear model: coefficient times distance from the mean, one row per feature."""
    t = df
    for stage in model.stages[:-1]:
        t = stage.transform(t)
    names = feature_names(t)
    coef = model.stages[-1].coefficients.toArray().tolist()
    d = t.select(ident, F.posexplode(vector_to_array(FEATURES)).alias("i", "x"))
    means = d.groupBy("i").agg(F.avg("x").alias("m"))
    weight = F.get(F.array(*[F.lit(c) for c in coef]), F.col("i"))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("i"))
    return d.join(F.broadcast(means), "i").select(ident, name.alias("encoded"), (weight * (F.col("x") - F.col("m"))).alias("contribution"))


def stated_contributions(df: DataFrame, ident: str, weights: Mapping[str, float]) -> DataFrame:
    """Exact attribution of a linear scorer with given weights, one row per feature; a missing value adds nothing."""
    means = {c: df.agg(F.avg(F.col(c).cast("double")).alias("m")).scalar() for c in weights}
    parts = [F.struct(F.lit(c).alias("encoded"), (F.lit(float(w)) * F.coalesce(F.col(c).cast("double") - means[c], F.lit(0.0))).alias("contribution"))
             for c, w in weights.items()]
    return df.select(ident, F.explode(F.array(*parts)).alias("c")).select(ident, "c.encoded", "c.contribution")


def base_feature(encoded: Column, features: Sequence[str]) -> Column:
    """Source column of an encoded one: the longest column name it starts with."""
    out = encoded
    for f in sorted(features, key=len):
        out = F.when(encoded.startswith(f), F.lit(f)).otherwise(out)
    return out


def concept_of(feature: Column, level: Column, concepts: Mapping[str, str], structural: Mapping[str, str]) -> Column:
    """Business concept of a feature; a structural level belongs to its parent's concept."""
    out = feature
    for k, v in concepts.items():
        out = F.when(feature == k, F.lit(v)).otherwise(out)
    for text, parent in structural.items():
        out = F.when(F.contains(level, F.lit(text)), F.lit(parent)).otherwise(out)
    return out


def grouped_contributions(c: DataFrame, ident: str, features: Sequence[str], concepts: Mapping[str, str],
                          structural: Mapping[str, str]) -> DataFrame:
    f = base_feature(F.col("encoded"), features)
    return c.withColumn("feature", f).withColumn("concept", concept_of(F.col("feature"), F.col("encoded"), concepts, structural))


def global_importance(c: DataFrame, ident: str, key: str) -> DataFrame:
    """Mean absolute contribution, summed to a feature or a concept."""
    n = c.agg(F.countDistinct(ident).alias("n")).scalar()
    return c.groupBy(key).agg(F.sum(F.abs("contribution")).alias("__s")).select(key, (F.col("__s") / n).alias("importance"))


def top_factors(c: DataFrame, ident: str, rows: DataFrame, features: Sequence[str], n: int = 4, floor: float = 0.02) -> DataFrame:
    """Strongest concepts in each direction per row, packed as JSON; each names its strongest feature and the row's own value."""
    g = c.groupBy(ident, "concept").agg(F.sum("contribution").alias("contribution"), F.max_by("feature", F.struct(F.abs("contribution"), "feature")).alias("feature"))
    pairs = F.flatten(F.array(*[F.array(F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("missing"))) for f in features]))
    values = rows.select(ident, F.map_from_arrays(F.filter(pairs, lambda _, i: i % 2 == 0), F.filter(pairs, lambda _, i: i % 2 == 1)).alias("__values"))
    g = g.where(F.abs("contribution") >= floor).join(values, ident)
    g = g.withColumn("direction", F.when(F.col("contribution") > 0, "raises").otherwise("lowers"))
    w = Window.partitionBy(ident, "direction").orderBy(F.desc(F.abs("contribution")), "concept")  # one row per concept
    k = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    phrase = F.concat(F.col("feature"), F.lit(" = "), F.try_element_at("__values", F.col("feature")), F.lit(" "), F.col("direction"), F.lit(" the risk"))
    item = F.struct(F.col("rank"), F.col("concept"), phrase.alias("reason"), F.round("contribution", 6).alias("contribution"))
    return k.groupBy(ident, "direction").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("factors"))


# Settings of the global demand models.
DEMAND_SETTINGS = {"tweedie": {"variancePower": 1.1, "maxIter": 25, "regParam": 0.1},
                   "boosted_trees": {"maxIter": 600, "stepSize": 0.05, "maxDepth": 6},
                   "random_forest": {"numTrees": 120, "maxDepth": 12, "minInstancesPerNode": 50}}


def demand_models(family: str, seed: int = 42, **settings):
    """Global demand models: Tweedie GLM, boosted trees and random forest; settings replace those of DEMAND_SETTINGS."""
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    return {
        "tweedie": lambda **k: GeneralizedLinearRegression(**common, family="tweedie", linkPower=0.0, **k),
        "boosted_trees": lambda **k: GBTRegressor(**common, seed=seed, **k),
        "random_forest": lambda **k: RandomForestRegressor(**common, seed=seed, **k)}[family](**{**DEMAND_SETTINGS[family], **settings})


def fit_demand(train: DataFrame, family: str, numeric: Sequence[str], categorical: Sequence[str], **settings) -> PipelineModel:
    """Fit one model over all series, origins and horizons; levels are indexed once, at fit time."""
    d = train.withColumn(LABEL, F.col("y_true").cast("double"))
    filled = d.fillna(-999.0 if family != "tweedie" else 0.0, list(numeric))
    stages: list = []
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"{c}__x" for c in categorical], handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*numeric, *[f"{c}__x" for c in categorical]], outputCol=FEATURES))
    if family == "tweedie":
        stages[-1].setOutputCol("__raw")
        stages.append(StandardScaler(inputCol="__raw", outputCol=FEATURES, withMean=True, withStd=True))
    return Pipeline(stages=[*stages, demand_models(family, **settings)]).fit(filled)


def predict_demand(model: PipelineModel, df: DataFrame, numeric: Sequence[str], to: str, fill: float = -999.0) -> DataFrame:
    """Point forecasts, never negative."""
    keep = df.columns
    kept = df.select(*[F.col(c) for c in keep], *[F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(f"__f_{c}") for c in numeric])
    d = kept.select(*[c for c in keep if c not in numeric], *[F.col(f"__f_{c}").alias(c) for c in numeric])
    return model.transform(d).withColumn(to, F.greatest(F.lit(0.0), F.col("prediction")))


def importance(model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Feature importance of a fitted tree model."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_bundle(model: PipelineModel, path: str, contract: dict, tables: Mapping[str, DataFrame] | None = None) -> None:
    """Model, its input contract and companion tables under one folder."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(contract),)], "contract string").coalesce(1).write.mode("overwrite").json(f"{path}/contract")
    for name, d in (tables or {}).items():
        d.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(path: str) -> tuple[PipelineModel, dict]:
    row = SparkSession.getActiveSession().read.json(f"{path}/contract", schema="contract string").first()
    return PipelineModel.load(f"{path}/model"), json.loads(row["contract"])


def score_with_contract(model: PipelineModel, df: DataFrame, contract: dict) -> DataFrame:
    """Score new rows; the input must hold the contract's columns."""
    return score(model, require_columns(df, contract["columns"]))


def score_and_decide(model: PipelineModel, df: DataFrame, contract: dict, econ: Economics) -> DataFrame:
    """Score new rows under a contract of columns, threshold, monthly value column and value cut, and say what to do with each.

    A probability that is missing or outside 0 to 1 stops the job; the value cut comes from training, not from the batch.
    """
    d = score_with_contract(model, df, contract).withColumn(SCORE, checked_score(SCORE))
    d = decide(d, SCORE, contract["monthly"], econ, value_cut=contract["value_cut"])
    return d.withColumn("positive_at_threshold", F.col(SCORE) >= contract["threshold"])


FORECAST_BUNDLE = 1  # format of a forecast bundle
FORECAST_TABLES = ("policy", "residuals")


def save_forecast_bundle(model: PipelineModel, path: str, contract: dict, policy: DataFrame, residuals: DataFrame) -> None:
    """A point model with its stock policy and the residual quantiles that make its intervals."""
    versions = {"python": platform.python_version(), "pyspark": pyspark.__version__}
    save_bundle(model, path, {**contract, "format": FORECAST_BUNDLE, "versions": versions}, {"policy": policy, "residuals": residuals})


def load_forecast_bundle(path: str) -> tuple[PipelineModel, dict, dict[str, DataFrame]]:
    """The bundle's model, contract and tables; another format is refused, other library versions are warned of."""
    model, contract = load_bundle(path)
    if contract.get("format") != FORECAST_BUNDLE:
        raise ValueError(f"{path} holds no forecast bundle of format {FORECAST_BUNDLE}")
    now = {"python": platform.python_version(), "pyspark": pyspark.__version__}
    for name, was in contract["versions"].items():
        if now.get(name) != was:
            warnings.warn(f"{name} was {was} at training and is {now.get(name)} now; forecasts may differ", stacklevel=2)
    spark = SparkSession.getActiveSession()
    return model, contract, {t: spark.read.parquet(f"{path}/{t}") for t in FORECAST_TABLES}


def holt_winters(history: DataFrame, horizon: int, season: int = 7) -> DataFrame:
    """Additive weekly smoothing of each (sampled) series, one row per day ahead.

    A series is one row per day; smoothing weights are chosen on a small grid by
    one-step error. Series too short or too sparse for a season use the level only.
    """
    grid = [(a, g) for a in (0.05, 0.1, 0.2, 0.4) for g in (0.05, 0.1, 0.3)]

    def run(y: np.ndarray, a: float, g: float, seasonal: bool) -> tuple[float, np.ndarray]:
        level = float(y[:season].mean()) if seasonal else float(y[0])
        s = (y[:season] - level) if seasonal else np.zeros(season)
        s, sse = s.astype("float64").copy(), 0.0
        for i, v in enumerate(y):
            k = i % season
            sse += (v - level - s[k]) ** 2
            before = level
            level = a * (v - s[k]) + (1 - a) * level
            if seasonal:
                s[k] = g * (v - before) + (1 - g) * s[k]
        return sse, np.array([level + s[(len(y) + h) % season] for h in range(horizon)])

    def fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        y = pdf[DEMAND].to_numpy(dtype="float64")
        seasonal = len(y) >= 2 * season and (y > 0).sum() >= 2 * season
        best = min((run(y, a, g, seasonal) for a, g in (grid if seasonal else [(a, 0.0) for a in (0.05, 0.1, 0.2, 0.4)])), key=lambda r: r[0])
        return pd.DataFrame({SERIES: pdf[SERIES].iloc[0], "horizon": np.arange(1, horizon + 1), "ets": np.clip(best[1], 0, None)})

    schema = T.StructType([T.StructField(SERIES, T.StringType()), T.StructField("horizon", T.LongType()), T.StructField("ets", T.DoubleType())])
    return history.select(SERIES, DATE, DEMAND).groupBy(SERIES).applyInPandas(fit_one, schema)
