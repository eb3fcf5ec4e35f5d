"""Regression models, ensembles and forecasts on ``pyspark.ml``.

A trained model is one ``PipelineModel`` (assemble, standardise, one or more regressors with
their own prediction columns) plus a small record of what was frozen at training time.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weatherloom.functions.climate import clamp
from weatherloom.operators.features import (
    LAG_FEATURES,
    SEASON_FEATURES,
    TIME_FEATURES,
    block_folds,
    chronological_split,
    expanding_folds,
    time_features,
)
from weatherloom.operators.joining import stored
from weatherloom.operators.series import Series

MODEL_NAMES = ["linear", "ridge", "lasso", "random_forest", "gradient_boosting"]
Z_95 = 1.96


def regressor(
    name: str, penalty: float, features: str, label: str, prediction: str, seed: int = 42, **options
):
    """One of the five regressors; ``penalty`` is the ridge scale of :func:`ridge_scale`."""
    common = {"featuresCol": features, "labelCol": label, "predictionCol": prediction}
    if name == "linear":
        return LinearRegression(standardization=False, **common)
    if name == "ridge":
        alpha = options.pop("alpha", 1.0)
        return LinearRegression(
            regParam=alpha * penalty, elasticNetParam=0.0, standardization=False, **common
        )
    if name == "lasso":
        alpha = options.pop("alpha", 1.0)
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, **common)
    if name == "random_forest":
        return RandomForestRegressor(**common, seed=seed, **{"numTrees": 100, "maxDepth": 10, **options})
    if name == "gradient_boosting":
        return GBTRegressor(**common, seed=seed, **{"maxIter": 100, "maxDepth": 3, **options})
    raise ValueError(f"Unsupported model type: {name}")


def ridge_scale(df: DataFrame, label: str) -> float:
    """Factor from a squared penalty per data set to Spark's ``regParam``.

    Spark divides the squared error by twice the rows and standardises the label inside, which
    divides the squared penalty once more by the label's deviation. The absolute penalty of
    the lasso is per row on both sides and needs no factor.
    """
    row = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("std")).head()
    return (row.std or 1.0) / max(row.n, 1)


def as_rows(metrics: DataFrame) -> DataFrame:
    """A metrics table computed now: one row per model, fold or part, whatever the data size."""
    return metrics.sparkSession.createDataFrame(metrics.collect(), metrics.schema)


def regression_metrics(df: DataFrame, label: str, predictions: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R squared of several prediction columns in one pass."""
    y = F.col(label)
    wide = [F.var_pop(y).alias("_var"), F.count(y).alias("n")]
    for name, column in predictions.items():
        e = y - F.col(column)
        wide += [F.avg(e * e).alias(f"{name}__mse"), F.avg(F.abs(e)).alias(f"{name}__mae")]
    one = df.groupBy(*keys).agg(*wide)
    rows = [
        F.struct(
            F.lit(name).alias("model"),
            F.sqrt(F.col(f"{name}__mse")).alias("rmse"),
            F.col(f"{name}__mae").alias("mae"),
            (1 - F.try_divide(F.col(f"{name}__mse"), F.col("_var"))).alias("r2"),
        )
        for name in predictions
    ]
    return one.select(*keys, "n", F.inline(F.array(*rows)))


def combine(predictions: Sequence[str]) -> dict[str, Column]:
    """Mean, population spread and 95 % band across prediction columns."""
    values = F.array(*predictions)
    n = len(predictions)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(
        F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("prediction")) ** 2) / n
    )
    return {
        "prediction": mean,
        "uncertainty_std": spread,
        "confidence_95_lower": F.col("prediction") - Z_95 * F.col("uncertainty_std"),
        "confidence_95_upper": F.col("prediction") + Z_95 * F.col("uncertainty_std"),
    }


@dataclass
class Trained:
    """A fitted pipeline with the feature list and year range of its training data."""

    pipeline: PipelineModel
    models: list[str]
    features: list[str]
    label: str
    year_range: tuple[int, int] | None = None
    clip: tuple[float, float] | None = None
    extra: dict = field(default_factory=dict)

    def columns(self) -> dict[str, str]:
        return {m: f"{m}_prediction" for m in self.models}

    def transform(self, df: DataFrame, keep_individual: bool = True) -> DataFrame:
        """Adds one column per model and the ensemble columns; features must be present."""
        if self.year_range is not None and "year_normalized" not in df.columns:
            df = time_features(df, self.year_range)
        out = self.pipeline.transform(df).drop("_raw", "_features")
        columns = list(self.columns().values())
        if self.clip is not None:
            out = out.withColumns({c: clamp(F.col(c), *self.clip) for c in columns})
        for name, expression in combine(columns).items():
            out = out.withColumn(name, expression)
        return out if keep_individual else out.drop(*columns)

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Metrics of every model and of their mean on a feature table."""
        return regression_metrics(self.transform(df), self.label, {**self.columns(), "ensemble": "prediction"})

    def importance(self, spark: SparkSession) -> DataFrame:
        """Feature importance per tree model, largest first, with the mean over those models."""
        members = {m: s for m, s in zip(self.models, self.pipeline.stages[2:])}
        trees = {m: s.featureImportances.toArray() for m, s in members.items() if hasattr(s, "featureImportances")}
        rows = [(m, f, float(v)) for m, values in trees.items() for f, v in zip(self.features, values)]
        table = spark.createDataFrame(rows, "model string, feature string, importance double")
        mean = table.groupBy("feature").agg(F.avg("importance").alias("importance"))
        both = table.unionByName(mean.withColumn("model", F.lit("mean")))
        return both.orderBy("model", F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        record = {k: getattr(self, k) for k in ("models", "features", "label", "year_range", "clip", "extra")}
        spark = SparkSession.getActiveSession()
        text = spark.createDataFrame([(json.dumps(record),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/record")

    @classmethod
    def load(cls, path: str) -> "Trained":
        spark = SparkSession.getActiveSession()
        record = json.loads(spark.read.text(f"{path}/record").head().value)
        for k in ("year_range", "clip"):
            record[k] = tuple(record[k]) if record[k] is not None else None
        return cls(PipelineModel.load(f"{path}/pipeline"), **record)


def _front(features: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
    ]


def fit(
    train: DataFrame,
    models: Sequence[str],
    features: Sequence[str],
    label: str,
    year_range: tuple[int, int] | None = None,
    clip: tuple[float, float] | None = None,
    seed: int = 42,
    options: Mapping[str, Mapping] | None = None,
    keep: bool = True,
) -> Trained:
    """Fits all named models on the same standardised features, as one pipeline.

    ``keep`` writes the training rows to the shared folder first, so that the passes of the
    models read a plain table; switch it off when ``train`` already comes from one. Where the normalised year is
    a feature and no ``year_range`` is given, the range of the training rows is kept for later tables.
    """
    options = options or {}
    unknown = [m for m in models if m not in MODEL_NAMES]
    if unknown:
        raise ValueError(f"Unsupported model type: {unknown[0]}")
    known = train.filter(F.col(label).isNotNull()).select(*dict.fromkeys([*features, label]))
    known = stored(known, "training") if keep else known
    if year_range is None and {"year", "year_normalized"} <= set(features):
        year_range = year_span(known)
    penalty = ridge_scale(known, label)
    stages = _front(features) + [
        regressor(m, penalty, "_features", label, f"{m}_prediction", seed, **dict(options.get(m, {})))
        for m in models
    ]
    pipeline = Pipeline(stages=stages).fit(known)
    return Trained(pipeline, list(models), list(features), label, year_range, clip)


def year_span(df: DataFrame) -> tuple[int, int] | None:
    """First and last year; None for an empty table."""
    row = df.agg(F.min("year").alias("low"), F.max("year").alias("high")).head()
    return None if row.low is None else (int(row.low), int(row.high))


def monthly_features(models_use_lags: bool = True) -> list[str]:
    return TIME_FEATURES + (LAG_FEATURES if models_use_lags else [])


def train_split(
    marked: DataFrame,
    models: Sequence[str],
    features: Sequence[str],
    label: str = "temperature",
    flag: str = "is_test",
    **fit_options,
) -> tuple[Trained, DataFrame]:
    """Fits on the rows that are not test rows; metrics of both parts as rows."""
    used = marked.select(*dict.fromkeys([*features, label]), flag)
    used = stored(used, "training")
    trained = fit(used.filter(~F.col(flag)), models, features, label, keep=False, **fit_options)
    columns = {**trained.columns(), "ensemble": "prediction"}
    part = F.when(F.col(flag), "test").otherwise("train").alias("part")
    scored = trained.transform(used).select(part, label, *columns.values())
    return trained, as_rows(regression_metrics(scored, label, columns, ["part"]))


def fold_metrics(
    folded: DataFrame,
    models: Sequence[str],
    features: Sequence[str],
    label: str,
    splits: int,
    fold: str = "fold",
    **fit_options,
) -> DataFrame:
    """Expanding-window validation: one row per fold and model."""
    parts = []
    used = folded.select(*dict.fromkeys([*features, label]), fold)
    used = stored(used, "training")
    for i in range(1, splits + 1):
        early, now = used.filter(F.col(fold) < i), used.filter(F.col(fold) == i)
        trained = fit(early, models, features, label, keep=False, **fit_options)
        parts.append(as_rows(trained.evaluate(now).withColumn("fold", F.lit(i))))
    return reduce(DataFrame.unionByName, parts)


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean and population std over the folds."""
    return metrics.groupBy("model").agg(
        *[F.avg(m).alias(f"cv_{m}_mean") for m in ("rmse", "mae", "r2")],
        *[F.stddev_pop(m).alias(f"cv_{m}_std") for m in ("rmse", "mae", "r2")],
    )


def time_series_validation(
    df: DataFrame,
    order: Series | Sequence[str],
    models: Sequence[str],
    features: Sequence[str],
    label: str,
    splits: int = 5,
    **fit_options,
) -> DataFrame:
    folded = expanding_folds(df, order, splits)
    return fold_summary(fold_metrics(folded, models, features, label, splits, **fit_options))


def training_folds(
    df: DataFrame, order: Series | Sequence[str], folds: int = 5, test_size: float = 0.2, flag: str = "is_test", fold: str = "fold"
) -> DataFrame:
    """Marks the last part of the order as test rows and cuts the rest into contiguous folds; test rows have no fold."""
    marked = chronological_split(df, order, test_size, flag)
    marked = stored(marked, "marked")
    early = block_folds(marked.filter(~F.col(flag)), order, folds, fold)
    return early.unionByName(marked.filter(F.col(flag)).withColumn(fold, F.lit(None).cast("int")))


def k_fold_rmse(
    folded: DataFrame,
    models: Sequence[str],
    features: Sequence[str],
    label: str,
    folds: int = 5,
    fold: str = "fold",
    **fit_options,
) -> DataFrame:
    """Per model and for the ensemble: root of the mean and of the spread of the folds' squared errors.

    The folds should be those of the training part, see :func:`training_folds`; rows without a fold are left out.
    """
    parts = []
    used = folded.filter(F.col(fold).isNotNull()).select(*dict.fromkeys([*features, label]), fold)
    used = stored(used, "training")
    for i in range(folds):
        others, now = used.filter(F.col(fold) != i), used.filter(F.col(fold) == i)
        trained = fit(others, models, features, label, keep=False, **fit_options)
        parts.append(as_rows(trained.evaluate(now)))
    errors = reduce(DataFrame.unionByName, parts).withColumn("_mse", F.col("rmse") ** 2)
    return errors.groupBy("model").agg(
        F.sqrt(F.avg("_mse")).alias("cv_rmse_mean"), F.sqrt(F.stddev_pop("_mse")).alias("cv_rmse_std")
    )


def train_ensemble(
    df: DataFrame,
    order: Series | Sequence[str],
    features: Sequence[str],
    label: str = "temperature",
    models: Sequence[str] = ("linear", "ridge", "random_forest"),
    splits: int = 5,
    **fit_options,
) -> tuple[Trained, DataFrame]:
    """Ensemble fitted on everything, with the metrics of three stages as rows.

    ``stage`` is train or test (models of the early four fifths), fold_mean and fold_std
    (expanding validation) or final (the returned ensemble on its own data).
    """
    table = chronological_split(expanding_folds(df, order, splits), order)
    table = table.select(*dict.fromkeys([*features, label]), "fold", "is_test")
    names = ["stage", "model", "rmse", "mae", "r2"]
    table = stored(table, "training")
    _, early = train_split(table, models, features, label, **fit_options)
    folds = fold_summary(fold_metrics(table, models, features, label, splits, **fit_options))
    final = fit(table, models, features, label, keep=False, **fit_options)
    whole = as_rows(final.evaluate(table)).withColumn("stage", F.lit("final"))
    parts = [early.withColumnRenamed("part", "stage").select(*names), whole.select(*names)]
    for stat in ("mean", "std"):
        columns = [F.col(f"cv_{m}_{stat}").alias(m) for m in names[2:]]
        parts.append(folds.select(F.lit(f"fold_{stat}").alias("stage"), "model", *columns))
    return final, reduce(DataFrame.unionByName, parts)


# Default search grids (names as in Spark ML; alpha is the penalty strength).
DEFAULT_GRIDS = {
    "ridge": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [0.1, 1.0, 10.0, 100.0]},
    "random_forest": {
        "numTrees": [50, 100, 200],
        "maxDepth": [30, 10, 20],
        "minInstancesPerNode": [1, 2, 5],
    },
    "gradient_boosting": {
        "maxIter": [50, 100, 200],
        "stepSize": [0.01, 0.1, 0.2],
        "maxDepth": [3, 5, 7],
    },
}


@dataclass
class Search:
    """``table``: every point of the grid with its error, best first. ``best``: the best point, fitted on all given
    rows, None for an empty grid. ``folds``: errors of every point by fold."""

    table: DataFrame
    best: Trained | None
    parameters: dict[str, float]
    folds: DataFrame


def search(
    df: DataFrame,
    model: str,
    features: Sequence[str],
    label: str,
    grid: Mapping[str, Sequence] | None = None,
    fold: str = "fold",
    seed: int = 42,
    parallelism: int = 4,
    options: Mapping | None = None,
) -> Search:
    """Cross-validation over the folds that the column ``fold`` names (0, 1, ...), and the best model.

    Give chronological folds of the training part (:func:`training_folds`): rows without a fold take no part, so the test
    rows stay unseen. The error is the mean of the folds' RMSE; of equal points the first is taken. An empty
    grid (or a model without a default one) gives an empty table and no model.
    """
    grid = DEFAULT_GRIDS.get(model, {}) if grid is None else grid
    spark, kinds = df.sparkSession, "parameters map<string,double>, cv_rmse double"
    if not grid:
        nothing = spark.createDataFrame([], kinds)
        return Search(nothing, None, {}, spark.createDataFrame([], "parameters map<string,double>, fold int, rmse double"))
    usable = F.col(label).isNotNull() & F.col(fold).isNotNull()
    known = df.filter(usable).select(*dict.fromkeys([*features, label]), F.col(fold).cast("int").alias("_fold"))
    known = stored(known, "training")
    count = int(known.agg(F.max("_fold")).first()[0] or 0) + 1
    if count < 2:
        raise ValueError("a search needs two folds or more")
    penalty = ridge_scale(known, label)
    estimator = regressor(model, penalty, "_features", label, f"{model}_prediction", seed, **dict(options or {}))
    builder = ParamGridBuilder()
    for name, values in grid.items():
        if name == "alpha":
            scale = penalty if model == "ridge" else 1.0
            builder.addGrid(estimator.regParam, [v * scale for v in values])
        else:
            builder.addGrid(estimator.getParam(name), list(values))
    given = [dict(zip(grid, values)) for values in product(*grid.values())]
    points = builder.build()
    found = CrossValidator(
        estimator=Pipeline(stages=_front(features) + [estimator]),
        estimatorParamMaps=points,
        evaluator=RegressionEvaluator(labelCol=label, predictionCol=f"{model}_prediction", metricName="rmse"),
        numFolds=count,
        foldCol="_fold",
        seed=seed,
        parallelism=parallelism,
        collectSubModels=True,
    ).fit(known)
    named = [{k: float(v) for k, v in point.items()} for point in given]
    scores = [float(x) for x in found.avgMetrics]
    best = min(range(len(scores)), key=scores.__getitem__)
    # every fold's own errors, all points in one pass over the fold
    rows = []
    for i, models in enumerate(found.subModels):
        scored = known.filter(F.col("_fold") == i).select(*dict.fromkeys([*features, label]))
        for nth, one in enumerate(models):
            scored = one.transform(scored).drop("_raw", "_features").withColumnRenamed(f"{model}_prediction", f"_p{nth}")
        e = [F.sqrt(F.avg((F.col(label) - F.col(f"_p{nth}")) ** 2)) for nth in range(len(models))]
        rows += [(named[nth], i, None if x is None else float(x)) for nth, x in enumerate(scored.agg(*e).first())]
    years = year_span(known) if {"year", "year_normalized"} <= set(features) else None
    return Search(
        spark.createDataFrame(list(zip(named, scores)), kinds).orderBy("cv_rmse"),
        Trained(found.bestModel, [model], list(features), label, years),
        named[best],
        spark.createDataFrame(rows, "parameters map<string,double>, fold int, rmse double"),
    )


def grid_search(
    df: DataFrame,
    model: str,
    features: Sequence[str],
    label: str,
    grid: Mapping[str, Sequence] | None = None,
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 4,
) -> DataFrame:
    """Every point of the grid with its cross-validated RMSE over folds drawn at random, best first."""
    dealt = df.withColumn("fold", F.floor(F.rand(seed) * folds).cast("int"))
    return search(dealt, model, features, label, grid, seed=seed, parallelism=parallelism).table


def chronological_search(
    df: DataFrame, model: str, features: Sequence[str], label: str, order: Series | Sequence[str], folds: int = 5, test_size: float = 0.2, **options
) -> Search:
    """:func:`search` over contiguous folds of the part before the last ``test_size`` of the order."""
    return search(training_folds(df, order, folds, test_size), model, features, label, **options)


def last_year_block(history: DataFrame, keys: Sequence[str], year: int, value: str) -> DataFrame:
    """Twelve months per station for ``year``; a missing month takes the station's month mean."""
    keys = list(keys)
    normal = history.groupBy(*keys, "month").agg(F.avg(value).alias("_normal"))
    stations = history.select(*keys).distinct() if keys else history.sparkSession.range(1).drop("id")
    grid = stations.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    known = history.filter(F.col("year") == year).groupBy(*keys, "month").agg(F.avg(value).alias("_known"))
    on = [*keys, "month"]
    joined = grid.join(normal, on, "left").join(known, on, "left")
    return joined.select(*keys, "month", F.coalesce("_known", "_normal").alias("_value"))


def forecast(
    trained: Trained,
    history: DataFrame,
    keys: Sequence[str],
    start_year: int,
    end_year: int,
    value: str = "temperature",
    checkpoint_every: int = 1,
) -> DataFrame:
    """Future months with the ensemble columns; each year feeds the next.

    The model must be trained on ``TIME_FEATURES + SEASON_FEATURES`` or some of them. A block is one year of
    all stations: its features come from the block before it, which is stored, so every year costs the same whatever
    lies before it and the history is read for the first one only. ``checkpoint_every`` stores every so many years only.
    """
    keys = list(keys)
    block = last_year_block(history, keys, start_year - 1, value)
    station = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    years = []
    for step, year in enumerate(range(start_year, end_year + 1), start=1):
        rows = block.select(
            *keys,
            F.lit(year).alias("year"),
            "month",
            F.col("_value").alias("temp_lag_12"),
            F.avg("_value").over(station).alias("temp_prev_year"),
        )
        scored = trained.transform(rows).drop(*SEASON_FEATURES, *[f for f in TIME_FEATURES if f not in ("year", "month")])
        if step % checkpoint_every == 0:
            scored = stored(scored, "forecast-year")
        years.append(scored)
        block = scored.select(*keys, "month", F.col("prediction").alias("_value"))
    out = years[0]
    for more in years[1:]:
        out = out.unionByName(more)
    return out


def with_history(history: DataFrame, future: DataFrame, value: str = "temperature") -> DataFrame:
    """Observed and predicted months stacked by column name."""
    predicted = future.withColumn(value, F.col("prediction")).withColumn("is_forecast", F.lit(True))
    return history.withColumn("is_forecast", F.lit(False)).unionByName(predicted, allowMissingColumns=True)


def forecast_without_history(trained: Trained, grid: DataFrame) -> DataFrame:
    """Future months for a model of ``TIME_FEATURES`` only."""
    return trained.transform(grid)
