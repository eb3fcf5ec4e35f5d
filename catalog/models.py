"""Feature tables and models; SQL wherever the fit has a closed form, rows only for the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.events import STORMY, TIES
from catalog.mapping import SENSORS, STATION_MONTH, r, rounded, sensors
from catalog.climate import station_month
from weatherloom.functions.rules import intensity_class
from weatherloom.operators import event_models, features, gram, models, tree_tables
from weatherloom.operators.hourly import month_grid
from weatherloom.operators.joining import stored
from weatherloom.plans import jobs
from weatherloom.sources.writers import scratch_dir

#: Smaller than the operators' defaults (100 trees of depth 10, 100 rounds), which take minutes on one machine.
TREES = {"random_forest": {"numTrees": 20, "maxDepth": 6}, "gradient_boosting": {"maxIter": 10}}


def station_series(spark, sf_dir):
    """Monthly means per station in the shape the models expect."""
    return station_month(spark, sf_dir).select(
        "station", "year", "month", F.col("avg_temperature").alias("temperature")
    )


def time_features(spark, sf_dir):
    out = features.time_features(station_series(spark, sf_dir))
    return rounded(out, "temperature", "year_normalized", "month_sin", "month_cos")


def lag_features(spark, sf_dir):
    rows = station_series(spark, sf_dir)
    out = features.lag_features(rows, features.month_series(["station"]))
    return rounded(out, "temperature", *features.LAG_FEATURES)


def seasonal_features(spark, sf_dir):
    out = features.seasonal_features(station_series(spark, sf_dir), ["station"])
    return rounded(out, "temperature", *features.SEASON_FEATURES)


def _order() -> list[str]:
    """The plain order over all stations."""
    return features.global_month_order(["station"])


def chrono_split(spark, sf_dir):
    out = features.chronological_split(station_series(spark, sf_dir), _order())
    return out.select("station", "year", "month", "is_test")


def ts_folds(spark, sf_dir):
    return features.expanding_folds(station_series(spark, sf_dir), _order(), 5).select("station", "year", "month", "fold")


def block_folds(spark, sf_dir):
    return features.block_folds(station_series(spark, sf_dir), _order(), 5).select("station", "year", "month", "fold")


def future_grid(spark, sf_dir):
    stations = station_series(spark, sf_dir).select("station").distinct()
    return month_grid(spark, 2002, 2004, stations)


def _features(spark, sf_dir):
    return features.feature_table(station_series(spark, sf_dir), ["station"])


def model_metrics(spark, sf_dir):
    """All five regressors, last fifth of the record as test part."""
    marked = features.chronological_split(station_series(spark, sf_dir), features.global_month_order(["station"]))
    marked = features.feature_table(marked, ["station"])
    _, metrics = models.train_split(
        marked, models.MODEL_NAMES, models.monthly_features(), options=TREES
    )
    return metrics


def model_importance(spark, sf_dir):
    trained = models.fit(
        _features(spark, sf_dir), ["random_forest", "gradient_boosting"], models.monthly_features(), "temperature",
        options=TREES,
    )
    return trained.importance(spark)


def time_series_validation(spark, sf_dir):
    return models.time_series_validation(
        _features(spark, sf_dir), features.global_month_order(["station"]), ["linear", "ridge", "random_forest"],
        models.monthly_features(), "temperature", splits=3, options=TREES,
    )


def k_fold_errors(spark, sf_dir):
    """Five contiguous folds inside the training part, RMSE per model over the folds."""
    folded = models.training_folds(station_series(spark, sf_dir), features.global_month_order(["station"]), 5)
    folded = features.feature_table(folded, ["station"])
    return models.k_fold_rmse(folded, ["linear", "lasso"], models.monthly_features(), "temperature", 5)


def ensemble_training(spark, sf_dir):
    """Base models on the early part, expanding validation, final fit on everything."""
    _, metrics = models.train_ensemble(
        _features(spark, sf_dir), features.global_month_order(["station"]), models.monthly_features(),
        "temperature", ["linear", "ridge"], splits=2,
    )
    return metrics


def ridge_search(spark, sf_dir):
    return models.grid_search(
        _features(spark, sf_dir), "ridge", models.monthly_features(), "temperature", folds=3
    )


def _seasonal_model(history):
    table = features.time_features(features.seasonal_features(history, ["station"])).dropna()
    return models.fit(
        table, ["linear", "ridge", "random_forest"], features.TIME_FEATURES + features.SEASON_FEATURES,
        "temperature", year_range=models.year_span(history), options=TREES,
    )


def ensemble_forecast(spark, sf_dir):
    """Three years ahead for every station, each year fed by the one before."""
    history = station_series(spark, sf_dir)
    return models.forecast(_seasonal_model(history), history, ["station"], 2002, 2004)


def forecast_without_history(spark, sf_dir):
    history = station_series(spark, sf_dir)
    trained = models.fit(
        features.time_features(history), ["linear", "ridge"], features.TIME_FEATURES, "temperature",
        year_range=models.year_span(history),
    )
    stations = history.select("station").distinct()
    return models.forecast_without_history(trained, month_grid(spark, 2002, 2003, stations))


def history_and_forecast(spark, sf_dir):
    history = station_series(spark, sf_dir)
    future = models.forecast(_seasonal_model(history), history, ["station"], 2002, 2002)
    return models.with_history(history, future).select("station", "year", "month", "temperature", "is_forecast")


def _event_rows(spark, sf_dir):
    table = jobs.event_table(sensors(spark, sf_dir), ["city"], **TIES)
    return table.withColumns({"hour": F.hour("timestamp"), "month": F.month("timestamp")})


VOCABULARIES = {"zones": ["TROPICAL", "TEMPERATE", "POLAR"], "events": ["HEATWAVE", "COLDSNAP", "STORM", "FLOOD"]}


def intensity_model(spark, sf_dir):
    rows = _event_rows(spark, sf_dir).withColumn("latitude_numeric", F.col("lat_decimal"))
    _, metrics = event_models.train_intensity(
        rows, "ensemble", folds=3, options=TREES, vocabularies=VOCABULARIES
    )
    return metrics


def intensity_predictions(spark, sf_dir):
    rows = _event_rows(spark, sf_dir).withColumn("latitude_numeric", F.col("lat_decimal"))
    trained, _ = event_models.train_intensity(rows, folds=0, options=TREES, vocabularies=VOCABULARIES)
    scored = event_models.predict_intensity(trained, rows)
    return scored.groupBy("event_type", "intensity_category").agg(
        F.count("*").alias("rows"), F.avg("predicted_intensity").alias("mean_intensity")
    )


def event_intensity_model(spark, sf_dir):
    """Events only, ten features, random split."""
    _, metrics = event_models.train_event_intensity(_event_rows(spark, sf_dir), options=TREES["random_forest"])
    return metrics


def event_classifier(spark, sf_dir):
    rows = _event_rows(spark, sf_dir)
    model = event_models.train_event_classifier(rows, trees=20, depth=8)
    return event_models.class_scores(model.transform(rows))


def linear_predictions(spark, sf_dir):
    """One feature, so that the fit is a regression line: every row's prediction."""
    rows = station_series(spark, sf_dir)
    out = models.fit(rows, ["linear"], ["year"], "temperature").transform(rows)
    return rounded(out.select("station", "year", "month", F.col("linear_prediction").alias("prediction")), "prediction")


def linear_split_metrics(spark, sf_dir):
    """A line fitted on the early part: errors of both parts."""
    marked = features.chronological_split(station_series(spark, sf_dir), _order())
    _, metrics = models.train_split(marked, ["linear"], ["year"])
    return rounded(metrics.filter("model = 'linear'").select("part", "n", "rmse", "mae", "r2"), "rmse", "mae", "r2")


def linear_fold_metrics(spark, sf_dir):
    """Expanding folds: each validated by a line fitted on the folds before it."""
    folded = features.expanding_folds(station_series(spark, sf_dir), _order(), 5)
    metrics = models.fold_metrics(folded, ["linear"], ["year"], "temperature", 5)
    return rounded(metrics.filter("model = 'linear'").select("fold", "n", "rmse", "mae"), "rmse", "mae")


def linear_k_fold(spark, sf_dir):
    """Contiguous folds: each validated by a line fitted on the others."""
    folded = features.block_folds(station_series(spark, sf_dir), _order(), 5)
    errors = models.k_fold_rmse(folded, ["linear"], ["year"], "temperature", 5)
    return rounded(errors.filter("model = 'linear'"), "cv_rmse_mean", "cv_rmse_std")


def linear_forecast(spark, sf_dir):
    """Future months of every station by a line over the years."""
    history = station_series(spark, sf_dir)
    trained = models.fit(history, ["linear"], ["year"], "temperature")
    out = models.forecast_without_history(trained, month_grid(spark, 2002, 2003, history.select("station").distinct()))
    band = ["prediction", "uncertainty_std", "confidence_95_lower", "confidence_95_upper"]
    return rounded(out.select("station", "year", "month", *band), *band)


def tree_importance_totals(spark, sf_dir):
    """Importances of each tree model: none negative, sum 1."""
    table = model_importance(spark, sf_dir)
    return table.groupBy("model").agg(
        F.count("*").alias("features"), (F.min("importance") >= 0).alias("none_negative"), F.round(F.sum("importance"), 6).alias("total")
    )


def _lag_model(history, names):
    """Models of the same month a year before alone, so that their fits and the recursion have a closed form."""
    return models.fit(features.seasonal_features(history, ["station"]).dropna(), names, ["temp_lag_12"], "temperature")


def lag_forecast(spark, sf_dir):
    """Three years ahead, each fed by the year before; the band is that of a line and a ridge line."""
    history = station_series(spark, sf_dir)
    out = models.forecast(_lag_model(history, ["linear", "ridge"]), history, ["station"], 2002, 2004)
    band = ["prediction", "uncertainty_std", "confidence_95_lower", "confidence_95_upper"]
    return rounded(out.select("station", "year", "month", *band), *band)


def lag_history_and_forecast(spark, sf_dir):
    """Observed months and the first year of the forecast in one table."""
    history = station_series(spark, sf_dir)
    future = models.forecast(_lag_model(history, ["linear"]), history, ["station"], 2002, 2002)
    return rounded(models.with_history(history, future).select("station", "year", "month", "temperature", "is_forecast"), "temperature")


ALPHAS = [0.1, 100.0, 10_000.0]


def _ridge_of_year(spark, sf_dir):
    return models.chronological_search(
        station_series(spark, sf_dir), "ridge", ["year"], "temperature", _order(), 3, grid={"alpha": ALPHAS}
    )


def ridge_search_folds(spark, sf_dir):
    """Errors of every penalty on chronological folds of the training part."""
    found = _ridge_of_year(spark, sf_dir).folds
    return rounded(found.select(F.col("parameters")["alpha"].alias("alpha"), "fold", "rmse"), "rmse")


def ridge_search_best(spark, sf_dir):
    """The best model of the search scores the whole table."""
    best = _ridge_of_year(spark, sf_dir).best
    out = best.transform(station_series(spark, sf_dir))
    return rounded(out.select("station", "year", "month", "prediction"), "prediction")


def training_fold_rows(spark, sf_dir):
    """Folds inside the training part; test rows have none."""
    out = models.training_folds(station_series(spark, sf_dir), _order(), 3)
    return out.select("station", "year", "month", "is_test", "fold")


PENALTIES = {"ridge": {"alpha": 50.0}, "lasso": {"alpha": 0.02}}


def penalised_predictions(spark, sf_dir):
    """Ridge and lasso of the regressors, one feature."""
    rows = station_series(spark, sf_dir)
    out = models.fit(rows, ["ridge", "lasso"], ["year"], "temperature", options=PENALTIES).transform(rows)
    return rounded(out.select("station", "year", "month", "ridge_prediction", "lasso_prediction"), "ridge_prediction", "lasso_prediction", digits=4)


def penalised_lines(spark, sf_dir):
    """The same two fits from one gram aggregate."""
    g = gram.gram(station_series(spark, sf_dir), ["year"], "temperature")
    lines = {"ridge": gram.ridge(g, 50.0), "lasso": gram.lasso(g, 0.02), "least_squares": gram.ridge(g, 0.0)}
    found = [(n, float(line.coefficients[0]), float(line.intercept)) for n, line in lines.items()]
    return rounded(spark.createDataFrame(found, "model string, slope double, intercept double"), "slope", "intercept")


def saved_line_predictions(spark, sf_dir):
    """A fitted line, saved and loaded again, scores the table."""
    rows, path = station_series(spark, sf_dir), scratch_dir(spark, "model")
    models.fit(rows, ["linear"], ["year"], "temperature").save(path)
    out = models.Trained.load(path).transform(rows)
    return rounded(out.select("station", "year", "month", "prediction"), "prediction")


#: One split on all rows, no drawing: the fit can be followed in SQL.
STUMP = {"random_forest": {"numTrees": 1, "maxDepth": 1, "bootstrap": False}, "gradient_boosting": {"maxIter": 1, "maxDepth": 1}}
STUMPS = ["random_forest", "gradient_boosting"]


def stump_predictions(spark, sf_dir):
    """Both tree ensembles as node tables: every row walks to its leaf."""
    rows = station_series(spark, sf_dir)
    trained, keys = models.fit(rows, STUMPS, ["year"], "temperature", options=STUMP), ["station", "year", "month"]
    placed, out = tree_tables.prepared(trained.pipeline, rows, keys), rows.select(*keys)
    for name, stage in zip(STUMPS, trained.pipeline.stages[2:]):
        leaves = tree_tables.walk(placed, tree_tables.tree_nodes(stage, spark), stage.getMaxDepth())
        found = tree_tables.regression(leaves, keys, boosted=name == "gradient_boosting")
        out = out.join(found.withColumnRenamed("prediction", name), keys)
    return rounded(out, *STUMPS)


def stump_importance(spark, sf_dir):
    """Sorted importance of two features where one split is made."""
    return models.fit(station_series(spark, sf_dir), STUMPS, ["year", "month"], "temperature", options=STUMP).importance(spark)


def stump_evaluation(spark, sf_dir):
    """Errors of all fitted models and of their mean on one table."""
    rows = station_series(spark, sf_dir)
    trained = models.fit(rows, ["linear", *STUMPS], ["year"], "temperature", options=STUMP)
    return rounded(trained.evaluate(rows), "rmse", "mae", "r2")


def _hours(spark, sf_dir):
    table = jobs.event_table(sensors(spark, sf_dir), ["city"], **TIES)
    return table.select(F.hour("timestamp").alias("hour"), "event_type", "event_intensity")


def stump_intensity(spark, sf_dir):
    """Predicted intensity and its class by hour of the day."""
    rows = stored(_hours(spark, sf_dir), "hours")
    settings = {"random_forest": {**STUMP["random_forest"], "minInstancesPerNode": 1}}
    trained, _ = event_models.train_intensity(rows.drop("event_type"), folds=0, options=settings)
    scored = event_models.predict_intensity(trained, rows.select("hour"))
    out = scored.groupBy("hour", "predicted_intensity", "intensity_category").agg(F.count("*").alias("rows"))
    return rounded(out, "predicted_intensity")


def stump_classes(spark, sf_dir):
    """Predicted event class by hour of the day, balanced classes."""
    rows = stored(_hours(spark, sf_dir), "hours")
    model = event_models.train_event_classifier(rows, ["hour"], trees=1, depth=1, least_rows=1, bootstrap=False)
    return model.transform(rows).groupBy("hour", "predicted_event_type").agg(F.count("*").alias("rows"))


def intensity_feature_sums(spark, sf_dir):
    """Numeric and one-hot features of the intensity models, summed by event type."""
    rows = sensors(spark, sf_dir).withColumn("event_type", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 4 + 1).cast("int")))
    table, names = event_models.intensity_features(rows.select("event_type", F.col("event_id").alias("key"), "temperature_hourly", "wind_speed_kmh"), **VOCABULARIES)
    return rounded(table.groupBy("event_type").agg(F.count("*").alias("rows"), *[F.sum(n).alias(n) for n in names]), "temperature_hourly", "wind_speed_kmh")


def intensity_classes(spark, sf_dir):
    """Classes of intensities 0 to 10 made from the key, nulls included."""
    value = F.when(F.col("event_id") % 101 != 100, F.col("event_id") % 101 / 10.0)
    return sensors(spark, sf_dir).select(intensity_class(value).alias("intensity_category")).groupBy("intensity_category").agg(F.count("*").alias("rows"))


def class_scores_by_rule(spark, sf_dir):
    """Scores of predictions that a key rule makes."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 4 + 1).cast("int"))
    guess = F.when(F.col("event_id") % 7 == 0, F.lit(KINDS[0])).otherwise(kind)
    scored = sensors(spark, sf_dir).select(kind.alias("event_type"), guess.alias("predicted_event_type"))
    out = event_models.class_scores(scored)
    return rounded(out.select("class", "support", "precision", "recall", "f1", "macro_f1"), "precision", "recall", "f1", "macro_f1")


KINDS = ["HEATWAVE", "COLDSNAP", "STORM", "NORMAL"]

QUERIES = {
    f.__name__: f
    for f in (
        linear_predictions, linear_split_metrics, linear_fold_metrics, linear_k_fold, linear_forecast, tree_importance_totals,
        lag_forecast, lag_history_and_forecast, ridge_search_folds, ridge_search_best, training_fold_rows, penalised_predictions,
        penalised_lines, saved_line_predictions, stump_predictions, stump_importance, stump_evaluation, stump_intensity, stump_classes,
        intensity_feature_sums, intensity_classes, class_scores_by_rule,
        time_features, lag_features, seasonal_features, chrono_split, ts_folds, block_folds, future_grid,
        model_metrics, model_importance, time_series_validation, k_fold_errors,
        ensemble_training, ridge_search, ensemble_forecast,
        forecast_without_history, history_and_forecast, intensity_model, intensity_predictions,
        event_intensity_model, event_classifier,
    )
}

_MONTHS = STATION_MONTH + ", s AS (SELECT station, year, month, avg_temperature AS temperature FROM station_month)"
_FORWARD = "ORDER BY year, month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def _filled(name: str) -> str:
    forward = f"first({name} IGNORE NULLS) OVER (PARTITION BY station {_FORWARD})"
    backward = f"last({name} IGNORE NULLS) OVER (PARTITION BY station ORDER BY year, month)"
    return f"{r(f'coalesce({forward}, {backward}, avg(temperature) OVER (PARTITION BY station))')} AS {name}"


_PLACE = "row_number() OVER (ORDER BY year, month, station) - 1 AS pos, count(*) OVER () AS n"

_LINE = "regr_slope(temperature, year) AS s, regr_intercept(temperature, year) AS i"
_ERRORS = "sqrt(avg(power(e, 2)))"
_FOLDED = f"p AS (SELECT *, {_PLACE} FROM s)"
_KIND = "(['HEATWAVE', 'COLDSNAP', 'STORM', 'NORMAL'])[event_id % 4 + 1]"

SQL = {
    "linear_predictions": f"""WITH {_MONTHS}, f AS (SELECT {_LINE} FROM s)
      SELECT station, year, month, {r('s.year * f.s + f.i')} AS prediction FROM s, f""",
    "linear_split_metrics": f"""WITH {_MONTHS}, {_FOLDED}, q AS (SELECT *, CASE WHEN pos >= n - ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM p),
      f AS (SELECT {_LINE} FROM q WHERE part = 'train'), d AS (SELECT part, temperature, temperature - (year * f.s + f.i) AS e FROM q, f)
      SELECT part, count(*) AS n, {r(_ERRORS)} AS rmse, {r('avg(abs(e))')} AS mae,
        {r('1 - avg(power(e, 2)) / var_pop(temperature)')} AS r2 FROM d GROUP BY part""",
    "linear_fold_metrics": f"""WITH {_MONTHS}, {_FOLDED}, z AS (SELECT *, n // 6 AS size, n - 5 * (n // 6) AS f0 FROM p),
      q AS (SELECT *, CAST(CASE WHEN pos < f0 THEN 0 ELSE (pos - f0) // size + 1 END AS INTEGER) AS fold FROM z),
      f AS (SELECT k.fold, {_LINE} FROM (SELECT DISTINCT fold FROM q WHERE fold > 0) k JOIN q ON q.fold < k.fold GROUP BY k.fold),
      d AS (SELECT fold, temperature - (year * f.s + f.i) AS e FROM q JOIN f USING (fold))
      SELECT fold, count(*) AS n, {r(_ERRORS)} AS rmse, {r('avg(abs(e))')} AS mae FROM d GROUP BY fold""",
    "linear_k_fold": f"""WITH {_MONTHS}, {_FOLDED}, z AS (SELECT *, n // 5 AS size, n % 5 AS more FROM p),
      q AS (SELECT *, CASE WHEN pos < more * (size + 1) THEN pos // (size + 1) ELSE more + (pos - more * (size + 1)) // size END AS fold FROM z),
      f AS (SELECT k.fold, {_LINE} FROM (SELECT DISTINCT fold FROM q) k JOIN q ON q.fold <> k.fold GROUP BY k.fold),
      d AS (SELECT fold, avg(power(temperature - (year * f.s + f.i), 2)) AS mse FROM q JOIN f USING (fold) GROUP BY fold)
      SELECT 'linear' AS model, {r('sqrt(avg(mse))')} AS cv_rmse_mean, {r('sqrt(stddev_pop(mse))')} AS cv_rmse_std FROM d""",
    "linear_forecast": f"""WITH {_MONTHS}, f AS (SELECT {_LINE} FROM s)
      SELECT station, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, {r('y * f.s + f.i')} AS prediction, 0.0::DOUBLE AS uncertainty_std,
        {r('y * f.s + f.i')} AS confidence_95_lower, {r('y * f.s + f.i')} AS confidence_95_upper
      FROM (SELECT DISTINCT station FROM s), f, range(2002, 2004) AS a(y), range(1, 13) AS b(m)""",
    "intensity_feature_sums": f"""WITH {SENSORS}, k AS (SELECT *, {_KIND} AS kind FROM sensors)
      SELECT kind AS event_type, count(*) AS rows, {r('sum(temperature_hourly)')} AS temperature_hourly, {r('sum(wind_speed_kmh)')} AS wind_speed_kmh,
        count(*) FILTER (kind = 'HEATWAVE') AS event_HEATWAVE, count(*) FILTER (kind = 'COLDSNAP') AS event_COLDSNAP,
        count(*) FILTER (kind = 'STORM') AS event_STORM, count(*) FILTER (kind = 'FLOOD') AS event_FLOOD FROM k GROUP BY kind""",
    "intensity_classes": f"""WITH {SENSORS}, v AS (SELECT CASE WHEN event_id % 101 <> 100 THEN (event_id % 101) / 10.0::DOUBLE END AS v FROM sensors)
      SELECT CASE WHEN v < 2 THEN 'Minor' WHEN v < 4 THEN 'Moderate' WHEN v < 6 THEN 'Significant' WHEN v < 8 THEN 'Severe'
        WHEN v IS NOT NULL THEN 'Extreme' END AS intensity_category, count(*) AS rows FROM v GROUP BY 1""",
    "class_scores_by_rule": f"""WITH {SENSORS}, k AS (SELECT {_KIND} AS t, CASE WHEN event_id % 7 = 0 THEN 'HEATWAVE' ELSE {_KIND} END AS g FROM sensors),
      c AS (SELECT t AS class, count(*) AS support, count(*) FILTER (t = g) AS hits FROM k GROUP BY t),
      m AS (SELECT class, support, hits / said AS precision, hits / support AS recall
            FROM c JOIN (SELECT g AS class, count(*) AS said FROM k GROUP BY g) USING (class)),
      f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM m)
      SELECT class, support, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, {r('avg(f1) OVER ()')} AS macro_f1 FROM f""",
    "time_features": f"""WITH {_MONTHS} SELECT station, year, month, {r('temperature')} AS temperature,
      {r('(year - min(year) OVER ()) / (max(year) OVER () - min(year) OVER ())::DOUBLE')} AS year_normalized,
      {r('sin(2 * pi() * month / 12)')} AS month_sin, {r('cos(2 * pi() * month / 12)')} AS month_cos,
      CAST(month IN (12, 1, 2) AS INTEGER) AS is_winter, CAST(month IN (3, 4, 5) AS INTEGER) AS is_spring,
      CAST(month IN (6, 7, 8) AS INTEGER) AS is_summer, CAST(month IN (9, 10, 11) AS INTEGER) AS is_fall FROM s""",
    "lag_features": f"""WITH {_MONTHS}, l AS (SELECT *, lag(temperature, 1) OVER o AS temp_lag_1, lag(temperature, 12) OVER o AS temp_lag_12,
        avg(temperature) OVER (PARTITION BY station ORDER BY year, month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS temp_ma_3,
        avg(temperature) OVER (PARTITION BY station ORDER BY year, month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS temp_ma_12
        FROM s WINDOW o AS (PARTITION BY station ORDER BY year, month))
      SELECT station, year, month, {r('temperature')} AS temperature, {', '.join(_filled(c) for c in features.LAG_FEATURES)} FROM l""",
    "seasonal_features": f"""WITH {_MONTHS} SELECT a.station, a.year, a.month, {r('a.temperature')} AS temperature,
      {r('b.temperature')} AS temp_lag_12, CASE WHEN b.temperature IS NOT NULL THEN {r('c.t')} END AS temp_prev_year
      FROM s a LEFT JOIN s b ON b.station = a.station AND b.year = a.year - 1 AND b.month = a.month
      LEFT JOIN (SELECT station, year, avg(temperature) AS t FROM s GROUP BY station, year) c
        ON c.station = a.station AND c.year = a.year - 1""",
    "chrono_split": f"""WITH {_MONTHS}, p AS (SELECT *, {_PLACE} FROM s)
      SELECT station, year, month, pos >= n - ceil(n * 0.2) AS is_test FROM p""",
    "ts_folds": f"""WITH {_MONTHS}, p AS (SELECT *, {_PLACE} FROM s), q AS (SELECT *, n // 6 AS size, n - 5 * (n // 6) AS f0 FROM p)
      SELECT station, year, month, CAST(CASE WHEN pos < f0 THEN 0 ELSE (pos - f0) // size + 1 END AS INTEGER) AS fold FROM q""",
    "block_folds": f"""WITH {_MONTHS}, p AS (SELECT *, {_PLACE} FROM s), q AS (SELECT *, n // 5 AS size, n % 5 AS more FROM p)
      SELECT station, year, month, CAST(CASE WHEN pos < more * (size + 1) THEN pos // (size + 1)
        ELSE more + (pos - more * (size + 1)) // size END AS INTEGER) AS fold FROM q""",
    "future_grid": f"""WITH {_MONTHS} SELECT station, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month
      FROM (SELECT DISTINCT station FROM s), range(2002, 2005) AS a(y), range(1, 13) AS b(m)""",
}

# the month a year before, both fits of it, and the block of twelve months that the forecast starts from
_LAGGED = f"""{_MONTHS}, f AS (SELECT a.temperature AS y, b.temperature AS x FROM s a JOIN s b ON b.station = a.station AND b.year = a.year - 1 AND b.month = a.month),
  fit AS (SELECT avg(x) AS mx, avg(y) AS my, covar_samp(x, y) / var_samp(x) AS b, count(*) - 1 AS d FROM f),
  start AS (SELECT station, month, coalesce(any_value(temperature) FILTER (year = 2001), avg(temperature)) AS v FROM s GROUP BY station, month)"""
_STEP = "my + b * ({x} - mx)"
_SOFT = "my + b * d / (d + 1) * ({x} - mx)"
_BOTH = f"(({_STEP}) + ({_SOFT})) / 2"
_SPREAD = f"abs(({_STEP}) - ({_SOFT})) / 2"

# a ridge line on the rows of q with k <> fold: the label's deviation enters as the regressors define the penalty
_PART = f"{_FOLDED}, m AS (SELECT *, pos >= n - ceil(n * 0.2) AS is_test, n - CAST(ceil(n * 0.2) AS BIGINT) AS early FROM p)"
_CUT = """z AS (SELECT *, early // 3 AS size, early % 3 AS more FROM m),
  q AS (SELECT *, CASE WHEN is_test THEN NULL WHEN pos < more * (size + 1) THEN pos // (size + 1)
    ELSE more + (pos - more * (size + 1)) // size END AS fold FROM z)"""
_RIDGES = f"""whole AS (SELECT stddev_pop(temperature) / count(*) AS unit FROM q WHERE NOT is_test),
  fits AS (SELECT a.alpha, k.fold, avg(year) AS mx, avg(temperature) AS my,
      covar_samp(year, temperature) / var_samp(year) * (count(*) - 1) / (count(*) - 1 + count(*) * a.alpha * any_value(unit) / stddev_pop(temperature)) AS b
    FROM (SELECT unnest([0, 1, 2]) AS fold) k, (SELECT unnest([0.1::DOUBLE, 100.0, 10000.0]) AS alpha) a, whole, q
    WHERE NOT q.is_test AND q.fold <> k.fold GROUP BY a.alpha, k.fold),
  errors AS (SELECT alpha, fold, sqrt(avg(power(temperature - (my + b * (year - mx)), 2))) AS rmse FROM q JOIN fits USING (fold) GROUP BY alpha, fold)"""

def _split(rows: str, name: str = "best") -> str:
    """The best single split of rows (v, y): sums left of each value, the split with the least squared error."""
    score = "lt * lt / lc + (tt - lt) * (tt - lt) / (tc - lc)"
    return f"""{name}_n AS (SELECT v, count(*) AS c, sum(y) AS t FROM {rows} GROUP BY v),
      {name}_l AS (SELECT v, sum(c) OVER o AS lc, sum(t) OVER o AS lt, sum(c) OVER () AS tc, sum(t) OVER () AS tt FROM {name}_n WINDOW o AS (ORDER BY v)),
      {name} AS (SELECT arg_max(v, {score}) AS cut, arg_max(lt / lc, {score}) AS low, arg_max((tt - lt) / (tc - lc), {score}) AS high,
        max({score}) AS score FROM {name}_l WHERE tc > lc)"""


_YEARS = f"{_MONTHS}, d AS (SELECT year AS v, temperature AS y FROM s), {_split('d')}"
_LEAF = "CASE WHEN year <= cut THEN low ELSE high END"


def _metrics(name: str, prediction: str) -> str:
    e = f"temperature - ({prediction})"
    return f"""SELECT '{name}' AS model, count(*) AS n, {r(f'sqrt(avg(power({e}, 2)))')} AS rmse, {r(f'avg(abs({e}))')} AS mae,
      {r(f'1 - avg(power({e}, 2)) / var_pop(temperature)')} AS r2 FROM s, best, line"""


SQL |= {
    "lag_forecast": f"""WITH RECURSIVE {_LAGGED}, w AS (
        SELECT station, 2002 AS year, month, {_BOTH.format(x='v')} AS p, {_SPREAD.format(x='v')} AS u FROM start, fit
        UNION ALL SELECT station, year + 1, month, {_BOTH.format(x='p')}, {_SPREAD.format(x='p')} FROM w, fit WHERE year < 2004)
      SELECT station, CAST(year AS INTEGER) AS year, month, {r('p')} AS prediction, {r('u')} AS uncertainty_std,
        {r('p - 1.96 * u')} AS confidence_95_lower, {r('p + 1.96 * u')} AS confidence_95_upper FROM w""",
    "lag_history_and_forecast": f"""WITH {_LAGGED} SELECT station, year, month, {r('temperature')} AS temperature, false AS is_forecast FROM s
      UNION ALL SELECT station, CAST(2002 AS INTEGER), month, {r(_STEP.format(x='v'))}, true FROM start, fit""",
    "ridge_search_folds": f"WITH {_MONTHS}, {_PART}, {_CUT}, {_RIDGES} SELECT alpha, CAST(fold AS INTEGER) AS fold, {r('rmse')} AS rmse FROM errors",
    "ridge_search_best": f"""WITH {_MONTHS}, {_PART}, {_CUT}, {_RIDGES}, best AS (SELECT arg_min(alpha, e) AS alpha FROM (SELECT alpha, avg(rmse) AS e FROM errors GROUP BY alpha)),
      f AS (SELECT avg(year) AS mx, avg(temperature) AS my, covar_samp(year, temperature) / var_samp(year) * (count(*) - 1) / (count(*) - 1 + any_value(alpha)) AS b
        FROM q, best WHERE NOT is_test)
      SELECT station, year, month, {r('my + b * (year - mx)')} AS prediction FROM s, f""",
    "training_fold_rows": f"WITH {_MONTHS}, {_PART}, {_CUT} SELECT station, year, month, is_test, CAST(fold AS INTEGER) AS fold FROM q",
    "penalised_predictions": f"""WITH {_MONTHS}, f AS (SELECT avg(year) AS mx, stddev_samp(year) AS sx, avg(temperature) AS my,
        covar_pop(year, temperature) / stddev_samp(year) AS zy, count(*) AS n FROM s)
      SELECT station, year, month, {r('my + zy * n / (n - 1 + 50.0) * (year - mx) / sx', 4)} AS ridge_prediction,
        {r('my + sign(zy) * greatest(abs(zy) - 0.02, 0) / ((n - 1) / n) * (year - mx) / sx', 4)} AS lasso_prediction FROM s, f""",
    "penalised_lines": f"""WITH {_MONTHS}, f AS (SELECT avg(year) AS mx, stddev_samp(year) AS sx, avg(temperature) AS my,
        covar_pop(year, temperature) / stddev_samp(year) AS zy, count(*) AS n FROM s),
      b AS (SELECT 'ridge' AS model, zy * n / (n - 1 + 50.0) / sx AS b, mx, my FROM f
        UNION ALL SELECT 'lasso', sign(zy) * greatest(abs(zy) - 0.02, 0) / ((n - 1) / n) / sx, mx, my FROM f
        UNION ALL SELECT 'least_squares', zy * n / (n - 1) / sx, mx, my FROM f)
      SELECT model, {r('b')} AS slope, {r('my - b * mx')} AS intercept FROM b""",
    "saved_line_predictions": SQL["linear_predictions"],
    "stump_predictions": f"WITH {_YEARS} SELECT station, year, month, {r(_LEAF)} AS random_forest, {r(_LEAF)} AS gradient_boosting FROM s, best",
    "stump_importance": f"""WITH {_YEARS}, e AS (SELECT month AS v, temperature AS y FROM s), {_split('e', 'other')},
      two AS (SELECT 'year' AS feature, CASE WHEN best.score >= other.score THEN 1.0 ELSE 0.0 END::DOUBLE AS importance FROM best, other
        UNION ALL SELECT 'month', CASE WHEN best.score >= other.score THEN 0.0 ELSE 1.0 END::DOUBLE FROM best, other)
      SELECT model, feature, importance FROM two, (SELECT unnest(['random_forest', 'gradient_boosting', 'mean']) AS model) m""",
    "stump_evaluation": f"""WITH {_YEARS}, line AS (SELECT {_LINE} FROM s)
      {_metrics('linear', 'year * s + i').replace('FROM s, best', 'FROM s t, best')} UNION ALL {_metrics('random_forest', _LEAF)}
      UNION ALL {_metrics('gradient_boosting', _LEAF)} UNION ALL {_metrics('ensemble', f'(line.s * year + line.i + 2 * ({_LEAF})) / 3')}""",
    "stump_intensity": f"""WITH {STORMY}, d AS (SELECT hour(timestamp) AS v, event_intensity AS y FROM stormy WHERE event_intensity > 0), {_split('d')},
      p AS (SELECT CAST(hour(timestamp) AS INTEGER) AS hour, least(greatest(CASE WHEN hour(timestamp) <= cut THEN low ELSE high END, 0), 10) AS x FROM stormy, best)
      SELECT hour, {r('x')} AS predicted_intensity, CASE WHEN x < 2 THEN 'Minor' WHEN x < 4 THEN 'Moderate' WHEN x < 6 THEN 'Significant' WHEN x < 8 THEN 'Severe'
        WHEN x IS NOT NULL THEN 'Extreme' END AS intensity_category, count(*) AS rows FROM p GROUP BY hour, x""",
    "stump_classes": f"""WITH {STORMY}, e AS (SELECT CAST(hour(timestamp) AS INTEGER) AS v, event_type AS k FROM stormy),
      w AS (SELECT k, (SELECT count(*) FROM e) / ((SELECT count(DISTINCT k) FROM e) * count(*)) AS u FROM e GROUP BY k),
      g AS (SELECT h.v, w.k, u * (SELECT count(*) FROM e WHERE e.v <= h.v AND e.k = w.k) AS l, u * (SELECT count(*) FROM e WHERE e.v > h.v AND e.k = w.k) AS r
        FROM (SELECT DISTINCT v FROM e) h, w),
      c AS (SELECT v, sum(l * l) / sum(l) + sum(r * r) / sum(r) AS score FROM g GROUP BY v HAVING sum(r) > 0),
      cut AS (SELECT arg_max(v, score) AS v FROM c),
      leaf AS (SELECT arg_max(k, (l, -rank)) AS low, arg_max(k, (r, -rank)) AS high FROM (SELECT *, row_number() OVER (ORDER BY k) AS rank FROM g WHERE v = (SELECT v FROM cut)))
      SELECT e.v AS hour, CASE WHEN e.v <= cut.v THEN low ELSE high END AS predicted_event_type, count(*) AS rows FROM e, cut, leaf GROUP BY 1, 2""",
}
