"""Extreme events, storms and alerts on hourly rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherloom.functions import rules
from weatherloom.functions.climate import zscore
from weatherloom.operators.joining import join_statistics
from weatherloom.operators.quantiles import exact_quantiles
from weatherloom.operators.series import CELL, Series, cell_unit_for, look_back

EARTH_RADIUS_KM = 6371.0


def classify_events(
    df: DataFrame,
    station: Sequence[str] = ("city",),
    ties: Sequence[str] = (),
    unit: str | None = None,
    window: int = 24,
) -> DataFrame:
    """Add ``anomaly_score, event_type, event_intensity, trend_direction``.

    The score compares with mean and std of the station's calendar month, the trend with
    the trailing mean of ``window`` earlier rows and the current one. Both are attached to
    the cells of the series, so the rows are shuffled once. ``unit`` is month, day or hour;
    None counts the fullest month and day first and takes the coarsest that is small enough.
    """
    keys = list(station)
    if unit is None:
        unit = cell_unit_for(df, keys, "timestamp", units=("month", "day", "hour"))
    value = F.col("temperature_hourly")
    normal = df.groupBy(*keys, F.month("timestamp").alias("_month")).agg(
        F.avg(value).alias("_mean"), F.stddev(value).alias("_std")
    )

    def with_normal(cells: DataFrame) -> DataFrame:
        return cells.withColumn("_month", F.month(CELL)).join(normal, [*keys, "_month"], "left")

    series = Series.by_time(keys, "timestamp", ties, unit)
    rolling = {"_rolling": ("temperature_hourly", window, True)}
    out = look_back(df, series, means=rolling, annotate=with_normal)
    rain, wind = F.col("rain_mm"), F.col("wind_speed_kmh")
    score, kind = F.col("anomaly_score"), F.col("event_type")
    return (
        out.withColumn("anomaly_score", zscore(value, F.col("_mean"), F.col("_std")))
        .withColumn("event_type", rules.event_type(score, rain, wind))
        .withColumn("event_intensity", rules.event_intensity(kind, score, rain, wind))
        .withColumn("trend_direction", rules.trend_direction(value, F.col("_rolling")))
        .drop("_mean", "_std", "_month", "_rolling")
    )


def with_storms(df: DataFrame, names: Sequence[str] = rules.STORM_NAMES) -> DataFrame:
    """Storm id, name and category in place: one system per day and one-degree cell.

    Other rows get nulls and category 0, so a table without storms needs no special case
    and no row is ever matched by (timestamp, city).
    """
    storm = F.col("event_type") == "STORM"
    ident = F.when(
        storm, rules.storm_id(F.col("timestamp"), F.col("lat_decimal"), F.col("lon_decimal"))
    )
    pool = F.array(*[F.lit(n) for n in names])
    index = rules.hash_index(F.col("storm_id"), len(names))
    category = F.when(storm, rules.storm_category(F.col("wind_speed_kmh"))).otherwise(0)
    return df.withColumn("storm_id", ident).withColumns(
        {"storm_name": F.try_element_at(pool, index + 1), "storm_category": category.cast("int")}
    )


def without_storms(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "storm_id": F.lit(None).cast("string"),
            "storm_name": F.lit(None).cast("string"),
            "storm_category": F.lit(0),
        }
    )


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2)
    )
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    angle = F.degrees(
        F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))
    )
    return F.when(angle < 0, angle + 360.0).otherwise(angle)


def storm_tracks(df: DataFrame, unit: str = "hour") -> DataFrame:
    """Distinct track points with the movement since the previous point of the storm.

    ``radius_km`` is half the diagonal of the box around the storm's points. A storm with
    one point has no speed and no direction.
    """
    points = (
        df.filter(F.col("storm_id").isNotNull())
        .select(
            "storm_id",
            "storm_name",
            "timestamp",
            F.col("lat_decimal").alias("latitude"),
            F.col("lon_decimal").alias("longitude"),
            F.col("storm_category").alias("category"),
            F.col("wind_speed_kmh").alias("max_wind_kmh"),
            F.col("pressure_hpa").alias("central_pressure_hpa"),
        )
        .distinct()
    )
    lat, lon = F.col("latitude"), F.col("longitude")
    extent = (
        points.groupBy("storm_id")
        .agg(
            F.min(lat).alias("s"), F.max(lat).alias("n"), F.min(lon).alias("w"), F.max(lon).alias("e")
        )
        .select(
            "storm_id",
            (great_circle_km(F.col("s"), F.col("w"), F.col("n"), F.col("e")) / 2).alias("radius_km"),
        )
    )
    order = ["latitude", "longitude", "max_wind_kmh", "central_pressure_hpa"]
    series = Series.by_time(["storm_id"], "timestamp", order, unit)
    lags = {"_t": ("timestamp", 1), "_lat": ("latitude", 1), "_lon": ("longitude", 1)}
    moved = look_back(points, series, lags, annotate=lambda c: c.join(extent, "storm_id", "left"))
    micros = F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(
        F.col("_t").cast("timestamp")
    )
    km = great_circle_km(F.col("_lat"), F.col("_lon"), lat, lon)
    return moved.select(
        "storm_id",
        "storm_name",
        "timestamp",
        "latitude",
        "longitude",
        "category",
        "max_wind_kmh",
        "central_pressure_hpa",
        F.try_divide(km, micros / 3.6e9).alias("movement_speed_kmh"),
        bearing_deg(F.col("_lat"), F.col("_lon"), lat, lon).alias("movement_direction_deg"),
        "radius_km",
        rules.lifecycle_stage(F.col("category")).alias("lifecycle_stage"),
    )


def storm_footprint(df: DataFrame) -> DataFrame:
    """Per storm: places touched, time span, peak wind.

    Names are made distinct before they are collected, so the arrays are bounded by the
    number of places, not by the number of rows.
    """
    rows = df.filter(F.col("storm_id").isNotNull())
    span = rows.groupBy("storm_id").agg(
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.max("wind_speed_kmh").alias("peak_wind_kmh"),
        F.max("storm_category").alias("peak_category"),
        F.count("*").alias("points"),
    )
    names = rows.select("storm_id", "city", "country").distinct()
    touched = names.groupBy("storm_id").agg(
        F.sort_array(F.collect_set("city")).alias("affected_cities"),
        F.sort_array(F.collect_set("country")).alias("affected_countries"),
    )
    return span.join(touched, "storm_id")


def with_alerts(df: DataFrame) -> DataFrame:
    """Rule alerts: ``alert_active, alert_level, alert_type, alert_issued_at``."""
    kind, wind, rain = F.col("event_type"), F.col("wind_speed_kmh"), F.col("rain_mm")
    active, category = F.col("alert_active"), F.col("storm_category")
    return df.withColumn("alert_active", rules.alert_active(kind, wind, rain)).withColumns(
        {
            "alert_level": rules.alert_level(active, F.col("event_intensity"), category, wind),
            "alert_type": rules.alert_type(active, kind, category, wind),
            "alert_issued_at": F.when(active, F.col("timestamp")),
        }
    )


def adaptive_alerts(
    df: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    value: str = "temperature_hourly",
    wind: str | None = "wind_speed_kmh",
    category: str | None = "storm_category",
    watch_offset: float = 2.0,
    emergency_offset: float = 3.0,
    history: DataFrame | None = None,
) -> DataFrame:
    """Levels against each key's own percentiles; the strongest satisfied rule wins.

    The percentiles are those of ``history`` (``keys`` and ``value``), by default of ``df`` itself. They take
    several passes, so give the plain rows where ``df`` is the end of a long plan.

    Heat: p95 + offset, p99, p99 + offset. Cold mirrors it at p5 and p1.
    """
    cuts = exact_quantiles(df if history is None else history, value, {"_p1": 0.01, "_p5": 0.05, "_p95": 0.95, "_p99": 0.99}, keys)
    t = F.col(value)

    def level(emergency: Column, warning: Column, watch: Column) -> Column:
        return F.when(emergency, "EMERGENCY").when(warning, "WARNING").when(watch, "WATCH").otherwise("NONE")

    levels = {
        "heat_level": level(
            t >= F.col("_p99") + emergency_offset, t >= F.col("_p99"), t >= F.col("_p95") + watch_offset
        ),
        "cold_level": level(
            t <= F.col("_p1") - emergency_offset, t <= F.col("_p1"), t <= F.col("_p5") - watch_offset
        ),
    }
    if category is not None and category in df.columns:
        c = F.col(category)
        levels["storm_level"] = level(c >= 4, c >= 3, c >= 1)
    if wind is not None and wind in df.columns:
        w = F.col(wind)
        levels["wind_level"] = level(w >= 120, w >= 90, w >= 60)
    joined = join_statistics(df, cuts, keys, spread_by)
    return joined.withColumns(levels).drop("_p1", "_p5", "_p95", "_p99")


def run_counts(df: DataFrame) -> DataFrame:
    """Records, active alerts, events and storm points of a finished event table."""
    return df.agg(
        F.count("*").alias("records"),
        F.count_if("alert_active").alias("active_alerts"),
        F.count_if(F.col("event_type") != "NORMAL").alias("events"),
        F.count_if(F.col("storm_id").isNotNull()).alias("storm_points"),
        F.count_distinct("storm_id").alias("storms"),
    )


def state_transitions(df: DataFrame, series: Series, state: str) -> DataFrame:
    """Count and share of every observed change between consecutive states of a series."""
    steps = look_back(df, series, lags={"from_state": (state, 1)}).filter(
        F.col("from_state").isNotNull() & F.col(state).isNotNull()
    )
    counts = steps.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("changes"))
    share = F.col("changes") / F.sum("changes").over(Window.partitionBy("from_state"))
    return counts.withColumn("share", share)


