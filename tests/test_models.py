"""Models on a season-plus-trend series and on synthetic event rows."""

import math

import pytest
from pyspark.sql import functions as F

from weatherloom.operators import event_models, features, models
from weatherloom.operators.hourly import month_grid

ALL = models.monthly_features()


@pytest.fixture(scope="module")
def series(spark):
    """240 months of one station: season, slow trend, pseudo-random noise."""
    angle = 2 * math.pi * F.col("month") / 12
    rows = month_grid(spark, 2000, 2019).withColumn("station", F.lit("s"))
    noise = F.randn(42) * 2
    out = rows.withColumn("temperature", 15 + 10 * F.sin(angle) + 0.02 * (F.col("year") - 2000) + noise)
    return spark.createDataFrame(out.collect(), out.schema)


@pytest.fixture(scope="module")
def marked(series):
    split = features.chronological_split(series, features.global_month_order(["station"]))
    return features.feature_table(split, ["station"]).cache()


SMALL = {"random_forest": {"numTrees": 20, "maxDepth": 5}, "gradient_boosting": {"maxIter": 10}}


def test_split_is_the_last_fifth(marked):
    test = marked.filter("is_test")
    assert test.count() == 48 and test.agg(F.min("year")).head()[0] == 2016


def test_features_hold_no_nulls_and_no_target(marked):
    for c in ALL:
        assert marked.filter(F.col(c).isNull()).count() == 0
    second = marked.orderBy("year", "month").limit(3).collect()
    assert second[0].temp_lag_1 == second[1].temp_lag_1 == second[0].temperature
    assert second[2].temp_ma_3 == pytest.approx((second[0].temperature + second[1].temperature) / 2)


def test_every_regressor_learns_the_season(marked):
    trained, metrics = models.train_split(marked, models.MODEL_NAMES, ALL, options=SMALL)
    scores = {(r.model, r.part): r.r2 for r in metrics.collect()}
    for name in models.MODEL_NAMES + ["ensemble"]:
        assert scores[name, "train"] > 0.5 and scores[name, "test"] > 0.5
    one = trained.transform(marked).select("prediction", "uncertainty_std", "confidence_95_lower", "confidence_95_upper").head()
    assert one.confidence_95_upper - one.confidence_95_lower == pytest.approx(2 * 1.96 * one.uncertainty_std)


def test_unknown_model_is_refused(marked):
    with pytest.raises(ValueError, match="Unsupported model type"):
        models.fit(marked, ["perceptron"], ALL, "temperature")
    with pytest.raises(ValueError, match="Unknown model type"):
        event_models.train_intensity(marked, "perceptron")


def test_spread_of_two_models(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "a_prediction double, b_prediction double")
    for name, expression in models.combine(["a_prediction", "b_prediction"]).items():
        df = df.withColumn(name, expression)
    row = df.head()
    assert (row.prediction, row.uncertainty_std) == (2.0, 1.0)
    assert (row.confidence_95_lower, row.confidence_95_upper) == pytest.approx((0.04, 3.96))


def test_save_and_load(marked, tmp_path, spark):
    trained = models.fit(marked, ["linear", "random_forest"], ALL, "temperature", (2000, 2019), options=SMALL)
    trained.save(str(tmp_path / "model"))
    again = models.Trained.load(str(tmp_path / "model"))
    assert again.features == ALL and again.year_range == (2000, 2019)
    a = trained.transform(marked).agg(F.sum("prediction")).head()[0]
    assert again.transform(marked).agg(F.sum("prediction")).head()[0] == pytest.approx(a)
    rows = trained.importance(spark).collect()
    forest = [r for r in rows if r.model == "random_forest"]
    assert sum(r.importance for r in forest) == pytest.approx(1.0)
    assert [r.importance for r in forest] == sorted((r.importance for r in forest), reverse=True)


def test_forecast_keeps_the_season(spark, series):
    table = features.time_features(features.seasonal_features(series, ["station"])).dropna()
    names = features.TIME_FEATURES + features.SEASON_FEATURES
    trained = models.fit(table, ["linear", "ridge"], names, "temperature", models.year_span(series))
    future = models.forecast(trained, series, ["station"], 2020, 2021)
    rows = future.orderBy("year", "month").collect()
    assert [(r.year, r.month) for r in rows] == [(y, m) for y in (2020, 2021) for m in range(1, 13)]
    assert all(abs(r.prediction - (15 + 10 * math.sin(2 * math.pi * r.month / 12))) < 4 for r in rows)
    both = models.with_history(series, future)
    assert both.count() == 264 and both.filter("is_forecast and temperature is null").count() == 0


def test_forecast_checkpoints_long_horizons(spark, series):
    names = features.TIME_FEATURES + features.SEASON_FEATURES
    table = features.time_features(features.seasonal_features(series, ["station"])).dropna()
    trained = models.fit(table, ["linear"], names, "temperature", models.year_span(series))
    plain = models.forecast(trained, series, ["station"], 2020, 2023, checkpoint_every=100)
    cut = models.forecast(trained, series, ["station"], 2020, 2023, checkpoint_every=2)
    assert cut.agg(F.sum("prediction")).head()[0] == pytest.approx(plain.agg(F.sum("prediction")).head()[0])


def test_forecast_without_history(spark, series):
    trained = models.fit(
        features.time_features(series), ["linear"], features.TIME_FEATURES, "temperature", models.year_span(series)
    )
    out = models.forecast_without_history(trained, month_grid(spark, 2020, 2021))
    assert out.count() == 24 and out.filter("prediction is null").count() == 0


def test_missing_months_of_the_last_year_use_the_month_mean(series):
    block = models.last_year_block(series.filter("not (year = 2019 and month = 7)"), ["station"], 2019, "temperature")
    july = block.filter("month = 7").head()._value
    want = series.filter("month = 7 and year < 2019").agg(F.avg("temperature")).head()[0]
    assert block.count() == 12 and july == pytest.approx(want)


def test_grid_search(marked):
    found = models.grid_search(marked, "ridge", ALL, "temperature", {"alpha": [0.1, 100.0]}, folds=3).collect()
    assert len(found) == 2 and found[0].cv_rmse <= found[1].cv_rmse
    assert models.grid_search(marked, "linear", ALL, "temperature").count() == 0


def test_ridge_penalty_matches_the_closed_form(spark):
    """One centred feature: slope = sum xy / (sum xx + alpha)."""
    rows = [(float(i), 3.0 * i + (-1) ** i) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, temperature double")
    trained = models.fit(df, ["ridge"], ["x"], "temperature", options={"ridge": {"alpha": 5.0}})
    mean_x, mean_y = sum(r[0] for r in rows) / 20, sum(r[1] for r in rows) / 20
    std = math.sqrt(sum((r[0] - mean_x) ** 2 for r in rows) / 19)
    z = [((x - mean_x) / std, y - mean_y) for x, y in rows]
    slope = sum(a * b for a, b in z) / (sum(a * a for a, _ in z) + 5.0)
    assert trained.pipeline.stages[2].coefficients[0] == pytest.approx(slope, rel=1e-6)


def test_lasso_penalty_matches_the_closed_form(spark):
    """One centred feature: sum xy / n shrunk by alpha, over sum xx / n."""
    rows = [(float(i), 3.0 * i + (-1) ** i) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, temperature double")
    trained = models.fit(df, ["lasso"], ["x"], "temperature", options={"lasso": {"alpha": 2.0}})
    mean_x, mean_y = sum(r[0] for r in rows) / 20, sum(r[1] for r in rows) / 20
    std = math.sqrt(sum((r[0] - mean_x) ** 2 for r in rows) / 19)
    z = [((x - mean_x) / std, y - mean_y) for x, y in rows]
    slope = (sum(a * b for a, b in z) / 20 - 2.0) / (sum(a * a for a, _ in z) / 20)
    assert trained.pipeline.stages[2].coefficients[0] == pytest.approx(slope, rel=1e-6)


@pytest.fixture(scope="module")
def event_rows(spark):
    n = F.col("id")
    kind = F.when(n % 10 < 6, "none").when(n % 10 < 8, "heatwave").otherwise("hurricane")
    wind = (n * 37 % 200).cast("double")
    return spark.range(600).select(
        (n % 45).cast("double").alias("temperature_hourly"), (n % 30).cast("double").alias("rain_mm"), wind.alias("wind_speed_kmh"),
        F.lit(50.0).alias("humidity_pct"), F.when(n % 9 != 0, 1000.0).alias("pressure_hpa"), (n % 12 + 1).cast("int").alias("month"),
        (n % 24).cast("int").alias("hour"), F.when(n % 2 == 0, "51.5N").otherwise("33.9S").alias("latitude"),
        F.lit("Temperate").alias("climate_zone"), kind.alias("event_type"),
        F.when(kind == "none", 0.0).otherwise(wind / 20).alias("event_intensity"),
    )


def test_intensity_features(event_rows):
    table, names = event_models.intensity_features(event_rows)
    assert len(names) == 8 + 6 + 6
    assert table.filter(F.col("pressure_hpa") == 0).count() == 67
    assert table.agg(F.sum("event_hurricane"), F.sum("climate_zone_Temperate")).head() == (120, 600)
    assert {r[0] for r in table.select("latitude_numeric").distinct().collect()} == {51.5, -33.9}


def test_intensity_model(event_rows):
    trained, metrics = event_models.train_intensity(event_rows, "ensemble", folds=2, options=SMALL)
    rows = {r.model: r for r in metrics.collect()}
    assert rows["ensemble"].n == 240 and rows["ensemble"].r2 > 0.5 and rows["ensemble"].cv_rmse > 0
    scored = event_models.predict_intensity(trained, event_rows)
    assert scored.count() == 600 and scored.filter("predicted_intensity < 0 or predicted_intensity > 10").count() == 0
    with pytest.raises(ValueError, match="event_intensity"):
        event_models.train_intensity(event_rows.drop("event_intensity"))


def test_classifier_scores(event_rows):
    model = event_models.train_event_classifier(
        event_rows, ["temperature_hourly", "wind_speed_kmh", "event_intensity"], trees=10, depth=5
    )
    scores = {r["class"]: r for r in event_models.class_scores(model.transform(event_rows)).collect()}
    assert scores["none"].f1 > 0.9 and scores["none"].support == 360
    mean = sum(r.f1 for r in scores.values()) / 3
    assert scores["none"].macro_f1 == pytest.approx(mean)


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "k string")
    got = {r.k: r.weight for r in event_models.balanced_weights(df, "k").collect()}
    assert got == pytest.approx({"a": 4 / 6, "b": 2.0})


def test_a_short_station_does_not_stop_a_fit(spark, series):
    """A station of six months has no lags of its own: it gets its mean and every row is kept."""
    short = series.filter("year = 2019 and month <= 6").withColumn("station", F.lit("short"))
    one = series.filter("year = 2019 and month = 1").withColumn("station", F.lit("one"))
    table = features.feature_table(series.unionByName(short).unionByName(one), ["station"])
    assert table.count() == 247
    for c in ALL:
        assert table.filter(F.col(c).isNull() | F.isnan(c)).count() == 0
    mean = short.agg(F.avg("temperature")).head()[0]
    assert table.filter("station = 'short'").agg(F.min("temp_lag_12"), F.max("temp_lag_12")).head() == (mean, mean)
    trained = models.fit(table, ["linear", "ridge", "random_forest"], ALL, "temperature", options=SMALL)
    assert trained.transform(table).filter("prediction is null or isnan(prediction)").count() == 0


def test_predictions_leave_the_rows_as_they_were(event_rows):
    trained, _ = event_models.train_intensity(event_rows, folds=0, options=SMALL)
    rows = event_rows.withColumn("pressure_hpa", F.when(F.col("pressure_hpa") > 0, F.lit(None).cast("double")))
    out = event_models.predict_intensity(trained, rows)
    assert out.columns == [*rows.columns, "predicted_intensity", "intensity_category"]
    assert dict(out.dtypes).items() >= dict(rows.dtypes).items()
    assert out.filter("pressure_hpa is not null").count() == rows.filter("pressure_hpa is not null").count()


def test_event_training_uses_events_only_and_counts_incomplete_rows(spark):
    rows = [("NORMAL" if i % 2 else "STORM", float(i % 7) if i % 10 else None, float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_type string, rain_mm double, event_intensity double")
    trained, _ = event_models.train_event_intensity(df, options={"numTrees": 5})
    assert trained.extra["incomplete_rows"] == 6
