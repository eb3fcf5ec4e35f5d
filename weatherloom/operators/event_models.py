"""Event intensity regression and event type classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherloom.functions.geo import parse_coordinate
from weatherloom.functions.rules import intensity_class
from weatherloom.operators.joining import stored, with_scalars
from weatherloom.operators.models import (
    Trained,
    as_rows,
    fit,
    grid_search,
    k_fold_rmse,
    regression_metrics,
)
from weatherloom.operators.quality import DOMAINS

NUMERIC_FEATURES = [
    "temperature_hourly", "rain_mm", "wind_speed_kmh", "humidity_pct",
    "pressure_hpa", "month", "hour", "latitude_numeric",
]
EVENT_FEATURES = [
    "hour", "month", "lat_decimal", "lon_decimal", "temperature_hourly",
    "humidity_pct", "pressure_hpa", "wind_speed_kmh", "rain_mm", "anomaly_score",
]
ONE_HOT_ZONES = DOMAINS["climate_zone"]
ONE_HOT_EVENTS = [e for e in DOMAINS["event_type"] if e != "none"]

TREES = {
    "random_forest": {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 2},
    "gradient_boosting": {"maxIter": 100, "maxDepth": 8, "stepSize": 0.1},
}
MODEL_SETS = {
    "random_forest": ["random_forest"],
    "gradient_boosting": ["gradient_boosting"],
    "ensemble": ["random_forest", "gradient_boosting"],
}


def one_hot(df: DataFrame, column: str, prefix: str, vocabulary: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns over a fixed vocabulary; other values and null give all zeros."""
    flags = {f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in vocabulary}
    return df.withColumns(flags), list(flags)


def intensity_features(
    df: DataFrame,
    zones: Sequence[str] = ONE_HOT_ZONES,
    events: Sequence[str] = ONE_HOT_EVENTS,
) -> tuple[DataFrame, list[str]]:
    """Numeric columns that exist plus one-hot zone and event; missing numbers become 0."""
    if "latitude_numeric" not in df.columns and "latitude" in df.columns:
        df = df.withColumn("latitude_numeric", parse_coordinate(F.col("latitude").cast("string")))
    names = [c for c in NUMERIC_FEATURES if c in df.columns]
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    if "climate_zone" in df.columns:
        df, flags = one_hot(df, "climate_zone", "climate_zone", zones)
        names = names + flags
    if "event_type" in df.columns:
        df, flags = one_hot(df, "event_type", "event", events)
        names = names + flags
    return df, names


def train_intensity(
    df: DataFrame,
    kind: str = "random_forest",
    label: str = "event_intensity",
    folds: int = 5,
    tune: bool = False,
    options: Mapping[str, Mapping] | None = None,
    vocabularies: Mapping[str, Sequence[str]] | None = None,
    seed: int = 42,
) -> tuple[Trained, DataFrame]:
    """Trains on rows with positive intensity; metrics on the same rows plus the CV error.

    ``tune`` searches a grid of forests first; it applies to ``random_forest`` only.
    """
    if kind not in MODEL_SETS:
        raise ValueError(f"Unknown model type: {kind}")
    if label not in df.columns:
        raise ValueError(f"No {label} column found in training data")
    table, names = intensity_features(df.filter(F.col(label) > 0), **dict(vocabularies or {}))
    table = table.select(*names, label)
    table = stored(table, "training")
    settings = {m: dict(TREES[m], **dict((options or {}).get(m, {}))) for m in MODEL_SETS[kind]}
    cv = None
    if tune and kind == "random_forest":
        grid = {"numTrees": [50, 100, 200], "maxDepth": [10, 15, 20], "minInstancesPerNode": [1, 2, 5]}
        best = grid_search(table, kind, names, label, grid, folds, seed).head()
        settings[kind].update({k: int(v) for k, v in best.parameters.items()})
        cv = best.cv_rmse
    elif folds >= 2:
        # rows of an event table carry no order here, so a row hash makes the folds
        folded = table.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *names, label), F.lit(folds)))
        errors = k_fold_rmse(folded, MODEL_SETS[kind], names, label, folds, seed=seed, options=settings)
        cv = errors.filter(F.col("model") == "ensemble").head().cv_rmse_mean
    trained = fit(table, MODEL_SETS[kind], names, label, clip=(0.0, 10.0), seed=seed, options=settings, keep=False)
    trained.extra["vocabularies"] = {k: list(v) for k, v in (vocabularies or {}).items()}
    metrics = as_rows(trained.evaluate(table))
    more = {"n_features": F.lit(len(names)), "cv_rmse": F.lit(cv).cast("double")}
    return trained, metrics.withColumns(more)


def predict_intensity(trained: Trained, df: DataFrame) -> DataFrame:
    """Adds ``predicted_intensity`` in 0 to 10 and its class to the rows of an event table."""
    # the features overwrite columns of the same names, so the rows travel beside them
    table, _ = intensity_features(df.withColumn("_row", F.struct(*df.columns)), **trained.extra.get("vocabularies", {}))
    scored = trained.transform(table, keep_individual=False)
    return scored.select("_row.*", F.col("prediction").alias("predicted_intensity")).withColumn(
        "intensity_category", intensity_class(F.col("predicted_intensity"))
    )


def train_event_intensity(
    df: DataFrame,
    features: Sequence[str] = EVENT_FEATURES,
    label: str = "event_intensity",
    test_share: float = 0.2,
    seed: int = 42,
    options: Mapping | None = None,
) -> tuple[Trained, DataFrame]:
    """Forest on event rows with a seeded random split; metrics of the test part.

    Rows with a missing feature or label are left out; ``trained.extra["incomplete_rows"]`` counts them.
    """
    names = [c for c in features if c in df.columns]
    events = stored(df.filter(F.col("event_type") != "NORMAL").select(*names, label), "training")
    known = events.dropna()
    forest = {"random_forest": {"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 5, **dict(options or {})}}
    train, test = known.randomSplit([1 - test_share, test_share], seed)
    trained = fit(train, ["random_forest"], names, label, seed=seed, options=forest, keep=False)
    trained.extra["incomplete_rows"] = events.count() - known.count()
    metrics = as_rows(regression_metrics(trained.transform(test), label, trained.columns()))
    return trained, metrics


#: Classes that a classifier may have; a label column with more is taken for a mistake.
MOST_CLASSES = 1000


def balanced_weights(df: DataFrame, label: str, weight: str = "weight", most: int = MOST_CLASSES) -> DataFrame:
    """Weight n / (classes * rows of the class), written as one expression over the classes.

    Only for labels with at most ``most`` classes: the classifier needs their list anyway. ``df`` is read for the
    counts, so it should be a stored table.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"{label} has more than {most} classes")
    total, classes = sum(r.n for r in counts), len(counts)
    pairs = [F.lit(x) for r in counts for x in (r[label], total / (classes * r.n))]
    return df.withColumn(weight, F.try_element_at(F.create_map(*pairs), F.col(label)))


def train_event_classifier(
    df: DataFrame,
    features: Sequence[str] = EVENT_FEATURES,
    label: str = "event_type",
    trees: int = 200,
    depth: int = 12,
    least_rows: int = 5,
    seed: int = 42,
    bootstrap: bool = True,
) -> PipelineModel:
    """Balanced forest; the model predicts the class name into ``predicted_<label>``."""
    names = [c for c in features if c in df.columns]
    known = balanced_weights(stored(df.select(*names, label).dropna(), "training"), label)
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep")
    labels = index.fit(known)
    stages = [
        labels,
        VectorAssembler(inputCols=names, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True),
        RandomForestClassifier(
            featuresCol="_features", labelCol="_label", weightCol="weight", predictionCol="_class",
            numTrees=trees, maxDepth=depth, minInstancesPerNode=least_rows, seed=seed, bootstrap=bootstrap,
        ),
        IndexToString(inputCol="_class", outputCol=f"predicted_{label}", labels=labels.labels + ["?"]),
    ]
    return Pipeline(stages=stages).fit(known)


def class_scores(scored: DataFrame, label: str = "event_type") -> DataFrame:
    """Precision, recall and F1 per true class, with their plain mean as ``macro_f1``.

    Works on the confusion table, which has one row per pair of classes.
    """
    guess = f"predicted_{label}"
    pairs = scored.groupBy(label, guess).agg(F.count("*").alias("n"))
    actual = pairs.groupBy(F.col(label).alias("class")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col(label) == F.col(guess), F.col("n")).otherwise(0)).alias("hits"),
    )
    said = pairs.groupBy(F.col(guess).alias("class")).agg(F.sum("n").alias("said"))
    scores = actual.join(said, "class", "left").select(
        "class",
        "support",
        F.coalesce(F.try_divide("hits", "said"), F.lit(0.0)).alias("precision"),
        F.try_divide("hits", "support").alias("recall"),
    )
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
    )
    scores = scores.withColumn("f1", f1)
    return with_scalars(scores, scores.agg(F.avg("f1").alias("macro_f1")))
