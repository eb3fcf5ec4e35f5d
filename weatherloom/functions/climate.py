"""Seasons, diurnal cycle and small numeric rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Diurnal amplitude by zone and its seasonal factor.
ZONE_AMPLITUDE = {
    "TROPICAL": 10.0,
    "SUBTROPICAL": 12.0,
    "TEMPERATE": 14.0,
    "CONTINENTAL": 16.0,
    "POLAR": 8.0,
}
SEASON_FACTOR = {"SUMMER": 1.2, "WINTER": 0.8, "SPRING": 1.0, "AUTUMN": 1.0}
DEFAULT_AMPLITUDE = 12.0
DEFAULT_FACTOR = 1.0


def _by_quarter(month: Column, names: tuple[str, str, str, str]) -> Column:
    """Names for Dec-Feb, Mar-May, Jun-Aug and the rest."""
    djf, mam, jja, son = names
    return (
        F.when(month.isin(12, 1, 2), djf)
        .when(month.between(3, 5), mam)
        .when(month.between(6, 8), jja)
        .otherwise(son)
    )


def season_north(month: Column) -> Column:
    """Winter/Spring/Summer/Fall by northern months, whatever the latitude."""
    return _by_quarter(month, ("Winter", "Spring", "Summer", "Fall"))


def season_hemisphere(month: Column, lat: Column) -> Column:
    """WINTER/SPRING/SUMMER/AUTUMN, turned round south of the equator."""
    north = _by_quarter(month, ("WINTER", "SPRING", "SUMMER", "AUTUMN"))
    south = _by_quarter(month, ("SUMMER", "AUTUMN", "WINTER", "SPRING"))
    return F.when(month.isNull(), "UNKNOWN").when(lat < 0, south).otherwise(north)


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def diurnal_amplitude(zone: Column, season: Column) -> Column:
    return lookup(zone, ZONE_AMPLITUDE, DEFAULT_AMPLITUDE) * lookup(
        season, SEASON_FACTOR, DEFAULT_FACTOR
    )


def diurnal_temperature(
    mean: Column, amplitude: Column, hour: Column, phase_hour: float = 14.0
) -> Column:
    """Mean plus a sine that crosses zero upwards at ``phase_hour``.

    With 14 the warmest hour is 20:00. Pass 8 for a maximum at 14:00.
    """
    return mean + amplitude * F.sin(2 * math.pi * (hour - phase_hour) / 24.0)


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null (``greatest``/``least`` alone would swallow it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def temperature_category(t: Column) -> Column:
    return F.when(t < 10, "Cold").when(t < 20, "Moderate").otherwise("Hot")


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """A missing std (one-row group) counts as 1; a zero std gives null."""
    return F.try_divide(x - mean, F.coalesce(std, F.lit(1.0)))


def anomaly_class(z: Column) -> Column:
    """normal below one sigma, moderate below two, extreme from there on."""
    return (
        F.when(F.abs(z) < 1, "normal")
        .when(F.abs(z) < 2, "moderate")
        .when(z.isNotNull(), "extreme")
    )


def month_cycle(month: Column) -> tuple[Column, Column]:
    angle = 2 * math.pi * month / 12
    return F.sin(angle), F.cos(angle)


def size_to_mb(text: Column) -> Column:
    """``1.5GiB``, ``300kB`` -> megabytes; an unknown unit is taken as megabytes."""
    number = F.regexp_extract(text, r"^([\d.]+)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([A-Za-z]+)$", 1)
    return (
        F.when(unit.isin("kB", "KB", "KiB"), number / 1024)
        .when(unit.isin("GB", "GiB"), number * 1024)
        .when(unit == "B", number / 1048576)
        .otherwise(number)
    )
