"""Tree tables, gram fits and searches against the models of the library itself."""

import math

import pytest
from pyspark.sql import functions as F

from weatherloom.operators import event_models, features, gram, joining, models, tree_tables


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return joining.stored(
        spark.range(400).select(
            n, (2000 + n % 20).cast("int").alias("year"), (F.floor(n / 20) % 12 + 1).cast("int").alias("month"), (n * 37 % 101 / 7.0).alias("a"),
            F.sin(n).alias("b"), F.lit(3.0).alias("same"),
            (n % 20 * 0.5 + F.sin(n * 1.7) * 3 + n * 37 % 101 / 20.0 + F.rand(1)).alias("temperature"),
        ),
        "rows",
    )


NAMES = ["year", "month", "a", "b"]


@pytest.mark.parametrize("name", ["random_forest", "gradient_boosting"])
def test_walk_equals_transform_row_by_row(spark, rows, name):
    options = {name: {"numTrees": 7, "maxDepth": 5} if name == "random_forest" else {"maxIter": 6, "maxDepth": 4}}
    trained = models.fit(rows, [name], NAMES, "temperature", options=options)
    stage = trained.pipeline.stages[2]
    placed = tree_tables.prepared(trained.pipeline, rows, ["id"])
    leaves = tree_tables.walk(placed, tree_tables.tree_nodes(stage, spark), stage.getMaxDepth())
    got = {r.id: r.prediction for r in tree_tables.regression(leaves, ["id"], name == "gradient_boosting").collect()}
    want = {r.id: r.prediction for r in trained.transform(rows).select("id", "prediction").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_walk_of_a_classifier_and_without_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(tree_tables, "broadcast_if_small", lambda df: None)
    labelled = rows.withColumn("event_type", F.when(F.col("a") > 9, "STORM").when(F.col("temperature") > 8, "HEATWAVE").otherwise("NORMAL"))
    model = event_models.train_event_classifier(labelled, NAMES, trees=9, depth=4, least_rows=1)
    labels, forest = model.stages[0].labels, model.stages[3]
    placed = model.stages[1].transform(labelled)
    placed = model.stages[2].transform(placed).select("id", tree_tables.vector_to_array("_features").alias("x"))
    leaves = tree_tables.walk(placed, tree_tables.tree_nodes(forest, spark), forest.getMaxDepth())
    got = {r.id: r.prediction for r in tree_tables.classes(leaves, ["id"], labels + ["?"]).collect()}
    want = {r.id: r.predicted_event_type for r in model.transform(labelled).collect()}
    assert got == want and len(set(want.values())) == 3


def test_intensity_model_walks_to_its_predictions(spark, rows):
    table = rows.select("id", F.col("a").alias("rain_mm"), (F.col("year") % 24).alias("hour"), F.abs("temperature").alias("event_intensity"))
    trained, _ = event_models.train_intensity(table.drop("id"), folds=0, options={"random_forest": {"numTrees": 5, "maxDepth": 4}})
    ready, names = event_models.intensity_features(table)
    stage = trained.pipeline.stages[2]
    assert names == trained.features
    leaves = tree_tables.walk(tree_tables.prepared(trained.pipeline, ready, ["id"]), tree_tables.tree_nodes(stage, spark), stage.getMaxDepth())
    got = {r.id: min(max(r.prediction, 0.0), 10.0) for r in tree_tables.regression(leaves, ["id"], False).collect()}
    want = {r.id: r.predicted_intensity for r in event_models.predict_intensity(trained, table).collect()}
    assert got == pytest.approx(want)


def test_gram_fits_equal_the_regressors(spark, rows):
    names = [*NAMES, "same"]
    g = gram.gram(rows, names, "temperature")
    for line, model, options in (
        (gram.ridge(g, 20.0), "ridge", {"alpha": 20.0}), (gram.lasso(g, 0.1), "lasso", {"alpha": 0.1}), (gram.ridge(g, 0.0), "linear", {}),
    ):
        trained = models.fit(rows, [model], names, "temperature", options={model: options})
        both = line.transform(trained.transform(rows).withColumnRenamed("prediction", "of_model"), "of_gram")
        assert both.agg(F.max(F.abs(F.col("of_model") - F.col("of_gram")))).first()[0] < (5e-3 if model == "lasso" else 1e-6)
        assert line.coefficients[-1] == 0
    assert (gram.lasso(g, 100.0).coefficients == 0).all() and gram.lasso(g, 100.0).intercept == pytest.approx(g.label_mean)


def test_gram_leaves_out_missing_values_and_needs_two_rows(spark, rows):
    holes = rows.withColumn("a", F.when(F.col("id") % 3 != 0, F.col("a")))
    assert gram.gram(holes, ["a"], "temperature").n == holes.filter("a is not null").count()
    with pytest.raises(ValueError):
        gram.gram(rows.limit(1), ["a"], "temperature")


def test_search_sees_training_rows_only_and_gives_the_best_model(spark, rows):
    spoiled = rows.withColumn("temperature", F.when(F.col("year") >= 2016, 1e6).otherwise(F.col("temperature")))
    order = ["year", "month", "id"]
    found = models.chronological_search(spoiled, "ridge", ["month", "a"], "temperature", order, 4, 0.2, grid={"alpha": [1e9, 0.1]})
    assert found.table.count() == 2 and found.parameters == {"alpha": 0.1} == found.table.first().parameters
    per_fold = found.folds.filter(F.col("parameters")["alpha"] == 0.1).collect()
    assert sorted(r.fold for r in per_fold) == [0, 1, 2, 3]
    assert sum(r.rmse for r in per_fold) / 4 == pytest.approx(found.table.first().cv_rmse) and found.table.first().cv_rmse < 100
    early = spoiled.filter("year < 2016")
    plain = models.fit(early, ["ridge"], ["month", "a"], "temperature", options={"ridge": {"alpha": 0.1}})
    a, b = found.best.transform(early), plain.transform(early)
    assert a.agg(F.sum("prediction")).first()[0] == pytest.approx(b.agg(F.sum("prediction")).first()[0])


def test_search_without_grid_or_folds(spark, rows):
    dealt = rows.withColumn("fold", F.lit(0))
    assert models.search(dealt, "linear", ["a"], "temperature").best is None
    with pytest.raises(ValueError):
        models.search(dealt, "ridge", ["a"], "temperature")


def test_folds_lie_inside_the_training_part(spark, rows):
    marked = models.training_folds(rows, ["year", "month", "id"], 3, 0.25)
    found = {(r.is_test, r.fold): (r.n, r.low, r.high) for r in marked.groupBy("is_test", "fold").agg(
        F.count("*").alias("n"), F.min("year").alias("low"), F.max("year").alias("high")).collect()}
    assert found.keys() == {(True, None), (False, 0), (False, 1), (False, 2)} and found[True, None][0] == 100
    assert [found[False, i][0] for i in range(3)] == [100, 100, 100] and found[True, None][1] >= found[False, 2][2]


def test_year_range_is_frozen_at_training(spark, rows):
    early = features.time_features(rows.filter("year < 2010"))
    trained = models.fit(early, ["linear"], features.TIME_FEATURES, "temperature")
    assert trained.year_range == (2000, 2009)
    later = trained.transform(rows.filter("year = 2018").drop("temperature")).select("year_normalized").distinct().collect()
    assert [r.year_normalized for r in later] == [2.0]


def test_every_year_of_a_forecast_reads_only_the_year_before(spark, rows, monkeypatch):
    sizes = []
    store = models.stored

    def counted(df, name):
        if name == "forecast-year":
            sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return store(df, name)

    history = rows.groupBy("year", "month").agg(F.avg("temperature").alias("temperature"))
    trained = models.fit(features.seasonal_features(history, []).dropna(), ["linear"], ["temp_lag_12"], "temperature")
    monkeypatch.setattr(models, "stored", counted)
    future = models.forecast(trained, history, [], 2020, 2027)
    assert sizes[1:] == [1] * 7 and future.count() == 96
    assert all(math.isfinite(r.prediction) for r in future.collect())


def test_too_many_classes_are_an_error(spark, rows):
    with pytest.raises(ValueError, match="more than 10 classes"):
        event_models.balanced_weights(rows.withColumn("k", F.col("id").cast("string")), "k", most=10)
