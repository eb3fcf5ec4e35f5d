"""Base preparation and expansion of daily rows to hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherloom.functions.climate import (
    diurnal_amplitude,
    diurnal_temperature,
    season_hemisphere,
)
from weatherloom.functions.dates import hour_timestamp, with_date_parts
from weatherloom.operators.places import with_coordinates, with_zone


def prepare_base(df: DataFrame) -> DataFrame:
    """Canonical station rows plus decimals, date parts, zone and season."""
    placed = with_zone(with_coordinates(with_date_parts(df, "dt")))
    return placed.withColumn(
        "season", season_hemisphere(F.col("month"), F.col("lat_decimal"))
    ).withColumnsRenamed({"temperature": "avg_temperature", "uncertainty": "temp_uncertainty"})


def expand_hours(df: DataFrame, hourly: bool = True, phase_hour: float = 14.0) -> DataFrame:
    """Twenty-four rows per input row; ``hourly=False`` returns the input."""
    if not hourly:
        return df
    amplitude = diurnal_amplitude(F.col("climate_zone"), F.col("season"))
    hours = df.withColumn("diurnal_amplitude", amplitude).withColumn(
        "hour", F.explode(F.sequence(F.lit(0), F.lit(23)))
    )
    curve = diurnal_temperature(
        F.col("avg_temperature"), F.col("diurnal_amplitude"), F.col("hour"), phase_hour
    )
    return hours.withColumns(
        {"temperature_hourly": curve, "timestamp": hour_timestamp(F.col("date"), F.col("hour"))}
    )


def month_grid(spark, start_year: int, end_year: int, keys: DataFrame | None = None) -> DataFrame:
    """Every (year, month) of the inclusive range, per row of ``keys`` when given."""
    base = spark.range(1).drop("id") if keys is None else keys
    return base.withColumn(
        "year", F.explode(F.sequence(F.lit(start_year), F.lit(end_year)))
    ).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
