"""Event, storm and alert rules as ``when`` chains (batch and stream alike)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wind speed in km/h below which a storm has category 0, 1, 2, 3, 4.
STORM_WIND_CUTS = [63, 118, 154, 178, 209]

# Storm names, in list order.
STORM_NAMES = [
    "Alberto", "Beryl", "Chris", "Debby", "Ernesto", "Florence", "Gordon",
    "Helene", "Isaac", "Joyce", "Kirk", "Leslie", "Michael", "Nadine",
    "Oscar", "Patty", "Rafael", "Sara", "Tony", "Valerie", "William",
]

# Yellow, orange and red cuts of the per-variable traffic light.
LIGHT_CUTS = {"heat": (35, 40, 45), "wind": (60, 90, 120), "rain": (25, 50, 100)}


def event_type(z: Column, rain: Column, wind: Column, z_cut: float = 2.5) -> Column:
    return (
        F.when(z >= z_cut, "HEATWAVE")
        .when(z <= -z_cut, "COLDSNAP")
        .when((rain > 30) & (wind > 50), "STORM")
        .when(rain > 50, "FLOOD")
        .otherwise("NORMAL")
    )


def event_type_quiet(z: Column, quiet: float = 1.5, z_cut: float = 2.5) -> Column:
    """Temperature-only class with a quiet band; between the bands there is no class."""
    return (
        F.when(F.abs(z) < quiet, "NORMAL")
        .when(z >= z_cut, "HEATWAVE")
        .when(z <= -z_cut, "COLDSNAP")
    )


def event_intensity(kind: Column, z: Column, rain: Column, wind: Column) -> Column:
    def capped(x: Column) -> Column:
        return F.least(F.lit(1.0), x)

    return (
        F.when(kind == "HEATWAVE", capped((z - 2.5) / 2.5))
        .when(kind == "COLDSNAP", capped((-z - 2.5) / 2.5))
        .when(kind == "STORM", capped(wind / 150.0))
        .when(kind == "FLOOD", capped(rain / 100.0))
        .otherwise(0.0)
    )


def trend_direction(value: Column, rolling_mean: Column, band: float = 1.0) -> Column:
    return (
        F.when(value > rolling_mean + band, "UP")
        .when(value < rolling_mean - band, "DOWN")
        .otherwise("STABLE")
    )


def storm_category(wind: Column, cuts: Sequence[float] = STORM_WIND_CUTS) -> Column:
    out = F.when(wind < cuts[0], 0)
    for category, cut in enumerate(cuts[1:], start=1):
        out = out.when(wind < cut, category)
    return out.otherwise(len(cuts))


def lifecycle_stage(category: Column) -> Column:
    return F.when(category <= 1, "FORMING").when(category <= 3, "MATURE").otherwise("INTENSE")


def storm_id(timestamp: Column, lat: Column, lon: Column) -> Column:
    """One id per day and one-degree cell, stable across runs."""
    cell = F.concat_ws(
        "_",
        F.date_format(timestamp, "yyyyMMdd"),
        F.round(lat, 0).cast("string"),
        F.round(lon, 0).cast("string"),
    )
    return F.concat(F.lit("STM-"), F.md5(cell))


def hash_index(text: Column, size: int) -> Column:
    """Index below ``size`` from the first 32 bits of the md5 of ``text``."""
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(size)).cast("int")


def alert_active(kind: Column, wind: Column, rain: Column) -> Column:
    return (kind != "NORMAL") | (wind > 60) | (rain > 30)


def alert_level(active: Column, intensity: Column, category: Column, wind: Column) -> Column:
    return (
        F.when(~active, "NONE")
        .when((intensity > 0.7) | (category >= 4) | (wind > 120), "EMERGENCY")
        .when((intensity > 0.4) | (category >= 2) | (wind > 90), "WARNING")
        .otherwise("WATCH")
    )


def alert_type(active: Column, kind: Column, category: Column, wind: Column) -> Column:
    return (
        F.when(~active, "NONE")
        .when(kind == "HEATWAVE", "HEAT")
        .when(kind == "COLDSNAP", "COLD")
        .when((kind == "STORM") | (category > 0), "STORM")
        .when(kind == "FLOOD", "FLOOD")
        .when(wind > 60, "WIND")
        .otherwise("WEATHER")
    )


def traffic_light(value: Column, variable: str, cuts=LIGHT_CUTS) -> Column:
    yellow, orange, red = cuts[variable]
    return (
        F.when(value >= red, "red")
        .when(value >= orange, "orange")
        .when(value >= yellow, "yellow")
        .otherwise("green")
    )


def combined_light(
    temperature: Column,
    wind: Column,
    rain: Column,
    heat_watch: float = 35.0,
    wind_watch: float = 60.0,
) -> Column:
    """Struct ``alert_level, alert_type, alert_message`` of the strongest rule.

    Heat is set first; wind replaces a weaker or equal level except that orange wind
    leaves red heat and yellow wind leaves any heat; rain has no yellow step and
    replaces everything but red at 50 mm and everything at 100 mm.
    """

    def alert(level: str, kind: str, text: str, unit: str, value: Column) -> Column:
        return F.struct(
            F.lit(level).alias("alert_level"),
            F.lit(kind).alias("alert_type"),
            F.format_string(f"{text}: %.1f{unit}", value.cast("double")).alias("alert_message"),
        )

    red_heat = temperature >= 45
    no_heat = (temperature < heat_watch) | temperature.isNull()
    red_before_rain = (red_heat & temperature.isNotNull()) | (wind >= 120)
    nothing = F.struct(
        F.lit("green").alias("alert_level"),
        F.lit("none").alias("alert_type"),
        F.lit("").alias("alert_message"),
    )
    return (
        F.when(rain >= 100, alert("red", "flood", "Flood warning", " mm", rain))
        .when(
            (rain >= 50) & ~F.coalesce(red_before_rain, F.lit(False)),
            alert("orange", "flood", "Heavy rain warning", " mm", rain),
        )
        .when(wind >= 120, alert("red", "wind", "Extreme wind warning", " km/h", wind))
        .when(red_heat, alert("red", "heat", "Extreme heat warning", "°C", temperature))
        .when(wind >= 90, alert("orange", "wind", "Wind warning", " km/h", wind))
        .when(temperature >= 40, alert("orange", "heat", "Heat warning", "°C", temperature))
        .when(temperature >= heat_watch, alert("yellow", "heat", "Heat advisory", "°C", temperature))
        .when((wind >= wind_watch) & no_heat, alert("yellow", "wind", "Wind advisory", " km/h", wind))
        .otherwise(nothing)
    )


def intensity_class(intensity: Column) -> Column:
    return (
        F.when(intensity < 2, "Minor")
        .when(intensity < 4, "Moderate")
        .when(intensity < 6, "Significant")
        .when(intensity < 8, "Severe")
        .when(intensity.isNotNull(), "Extreme")
    )
