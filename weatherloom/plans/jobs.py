"""Read, compute, write: the batch jobs.

A job reads its input once per result table that needs the raw rows, writes every table in
one pass and returns the paths. Sorting is left to the reader of a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weatherloom.functions.climate import season_north, temperature_category
from weatherloom.functions.dates import time_period
from weatherloom.operators import aggregates, anomalies, places, statistics
from weatherloom.operators.cleaning import clean, project
from weatherloom.operators.extremes import classify_events, storm_tracks, with_alerts, with_storms, without_storms
from weatherloom.operators.hourly import expand_hours, prepare_base
from weatherloom.operators.joining import with_scalars
from weatherloom.sources import readers, versions
from weatherloom.sources.writers import write_storm_tracks, write_table, write_text_results

STATION = ("city", "country", "latitude", "longitude")

EVENT_TABLE = [
    "timestamp", "date", "year", "month", "day", "hour", "day_of_week",
    "city", "country", "lat_decimal", "lon_decimal",
    "climate_zone", "season",
    "avg_temperature", "temp_uncertainty", "temperature_hourly", "diurnal_amplitude",
    "rain_mm", "wind_speed_kmh", "wind_direction_deg", "humidity_pct", "pressure_hpa", "cloud_cover_pct",
    "event_type", "event_intensity", "anomaly_score", "trend_direction",
    "storm_id", "storm_name", "storm_category",
    "alert_active", "alert_level", "alert_type", "alert_issued_at",
]


def series_tables(rows: DataFrame, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Monthly, yearly and anomaly tables of series text, per source file when ``by`` names it."""
    good = clean(rows)
    return {
        "monthly": aggregates.monthly(good, by),
        "yearly": aggregates.yearly(good, by),
        "anomalies": anomalies.flag_anomalies(good, keys=by, spread_by=["year", "month", "temperature"]),
    }


def process_directory(spark: SparkSession, path: str, output: str) -> dict[str, str]:
    """All series files of a folder or glob in one read; tables partitioned by source file."""
    rows = readers.read_series_text(spark, path, with_source=True)
    tables = series_tables(rows, ["source"])
    return {n: write_table(t, f"{output}/{n}", ["source"]) for n, t in tables.items()}


def process_file(spark: SparkSession, path: str, output: str) -> dict[str, str]:
    """One series file to CSV tables and a JSON trend record."""
    rows = clean(readers.read_series_text(spark, path, keep_unparsed=False))
    year_table = aggregates.yearly(rows)
    tables = {
        "monthly": aggregates.monthly(rows),
        "yearly": year_table,
        "anomalies": anomalies.flag_anomalies(rows, ddof=1),
    }
    written = {n: write_text_results(t, f"{output}/{n}", "csv") for n, t in tables.items()}
    trends = statistics.trend_summary(year_table)
    written["trends"] = write_text_results(trends, f"{output}/trends", "json")
    return written


def country_tables(rows: DataFrame, countries: DataFrame) -> dict[str, DataFrame]:
    """Country, continent and region by year; the region comes from the coordinates."""
    named = places.with_country(clean(rows), countries)
    coded = places.with_coordinates(named)
    area = places.with_area(coded.withColumnRenamed("continent", "_of_country"))
    return {
        "country": aggregates.by_country(named),
        "continental": aggregates.by_continent(named),
        "regional": aggregates.by_region(area),
    }


def process_countries(spark: SparkSession, path: str, countries: DataFrame, output: str) -> dict[str, str]:
    tables = country_tables(readers.read_city_csv(spark, path), countries)
    return {n: write_table(t, f"{output}/{n}") for n, t in tables.items()}


def station_tables(month_table: DataFrame, keys: Sequence[str] = STATION) -> dict[str, DataFrame]:
    """The tables that follow from the station month table."""
    year_table = aggregates.yearly_from_monthly(month_table, keys)
    placed = places.with_area(places.with_coordinates(year_table))
    return {
        "yearly": year_table,
        "anomalies": anomalies.station_anomalies(year_table, keys),
        "climatology": aggregates.station_climatology(month_table, keys),
        "seasonal": aggregates.station_seasonal(month_table, keys),
        "extreme_thresholds": aggregates.station_thresholds(month_table, keys),
        "regional": aggregates.area_yearly(placed, ["region", "continent"]),
        "continental": aggregates.area_yearly(placed, ["continent"]),
    }


def with_test_categories(month_table: DataFrame, midpoint: float | None = None) -> DataFrame:
    """Season, temperature category, period and continent of every station month."""
    placed = places.with_area(places.with_coordinates(month_table))
    if midpoint is None:
        span = month_table.agg(((F.min("year") + F.max("year")) / 2).alias("_cut"))
        placed, cut = with_scalars(placed, span), F.col("_cut")
    else:
        cut = F.lit(midpoint)
    return placed.withColumns(
        {
            "season": season_north(F.col("month")),
            "temp_category": temperature_category(F.col("avg_temperature")),
            "time_period": time_period(F.col("year"), cut),
        }
    ).drop("_cut")


INDEPENDENCE_TESTS = {
    "Continent vs Temperature Category": ("continent", "temp_category"),
    "Season vs Temperature Category": ("season", "temp_category"),
    "Time Period vs Temperature Category": ("time_period", "temp_category"),
}


def exploratory_tables(month_table: DataFrame, year_table: DataFrame) -> dict[str, DataFrame]:
    variables = ["year", "avg_temperature", "min_temperature", "max_temperature", "temperature_range"]
    described = ["avg_temperature", "min_temperature", "max_temperature", "avg_uncertainty"]
    return {
        "correlation_matrix": statistics.correlation_matrix(year_table, variables),
        "descriptive_stats": statistics.descriptive_statistics(month_table, described),
        "chi_square_tests": statistics.chi_square_tests(with_test_categories(month_table), INDEPENDENCE_TESTS),
    }


def process_city_data(spark: SparkSession, path: str, output: str) -> dict[str, str]:
    """City CSV to the eleven result tables.

    The month table is written first and read back, so the CSV is parsed once and the other
    ten tables start from a small columnar one.
    """
    rows = clean(readers.read_city_csv(spark, path))
    month_path = write_table(aggregates.monthly(rows, STATION), f"{output}/monthly")
    month_table = readers.read_table(spark, month_path)
    tables = station_tables(month_table)
    year_path = write_table(tables.pop("yearly"), f"{output}/yearly")
    tables.update(exploratory_tables(month_table, readers.read_table(spark, year_path)))
    written = {n: write_table(t, f"{output}/{n}") for n, t in tables.items()}
    return {"monthly": month_path, "yearly": year_path, **written}


def event_table(
    rows: DataFrame,
    station: Sequence[str] = ("city", "country"),
    ties: Sequence[str] = (),
    unit: str | None = None,
    hourly: bool = True,
    storms: bool = True,
) -> DataFrame:
    """Station rows with weather columns to the classified event table.

    Weather (``rain_mm``, ``wind_speed_kmh``, ...) is input. Rows that already carry
    ``temperature_hourly`` and ``timestamp`` are taken as hourly.
    """
    if "temperature_hourly" not in rows.columns:
        rows = expand_hours(prepare_base(rows), hourly)
    events = classify_events(rows, station, ties, unit)
    stormy = with_storms(events) if storms else without_storms(events)
    return project(with_alerts(stormy), EVENT_TABLE)


def process_events(
    spark: SparkSession, rows: DataFrame, output: str, options: Mapping | None = None
) -> dict[str, str | None]:
    """Event table, storm tracks, active alerts and events, each partitioned.

    The event table is written once; the other three are read from it, so the windows and the
    24-fold expansion are not computed again.
    """
    main = write_table(event_table(rows, **dict(options or {})), f"{output}/events", ["year", "month"])
    table = readers.read_table(spark, main)
    alerts = table.filter(F.col("alert_active"))
    extremes = table.filter(F.col("event_type") != "NORMAL")
    return {
        "events": main,
        "storm_tracks": write_storm_tracks(storm_tracks(table), f"{output}/storm_tracks"),
        "alerts": write_table(alerts, f"{output}/alerts", ["year", "month"]),
        "extremes": write_table(extremes, f"{output}/extremes", ["year", "event_type"]),
    }


def publish_events(spark: SparkSession, rows: DataFrame, output: str, options: Mapping | None = None) -> str:
    """The tables of :func:`process_events` as one new version: all four change together for readers of
    :func:`~weatherloom.sources.versions.read_published`, and a run without storms gives an empty track table."""
    version = versions.new_version(output)
    main = write_table(event_table(rows, **dict(options or {})), f"{version}/events", ["year", "month"])
    table = readers.read_table(spark, main)
    write_table(table.filter(F.col("alert_active")), f"{version}/alerts", ["year", "month"])
    write_table(table.filter(F.col("event_type") != "NORMAL"), f"{version}/extremes", ["year", "event_type"])
    # not partitioned by year: an empty folder of partitions has no schema
    write_table(storm_tracks(table).withColumn("year", F.year("timestamp")), f"{version}/storm_tracks")
    versions.switch(spark, output, version)
    return version


def publish_countries(spark: SparkSession, path: str, countries: DataFrame, output: str) -> str:
    """The tables of :func:`process_countries` as one new version."""
    version = versions.new_version(output)
    for name, table in country_tables(readers.read_city_csv(spark, path), countries).items():
        write_table(table, f"{version}/{name}")
    versions.switch(spark, output, version)
    return version
