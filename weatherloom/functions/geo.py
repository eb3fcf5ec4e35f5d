"""Coordinates, climate zones, continents and regions.

All of these are projections: no join and no shuffle is needed to place a point,
because the boxes are a short fixed list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone name and the largest absolute latitude that belongs to it.
ZONE_CUTS = [("TROPICAL", 23.5), ("SUBTROPICAL", 35.0), ("TEMPERATE", 55.0), ("CONTINENTAL", 66.5)]
ZONE_BEYOND = "POLAR"

# Continent boxes (name, south, north, west, east), edges inclusive.
# The boxes overlap; the first that holds the point wins.
CONTINENT_BOXES = [
    ("Europe", 36, 72, -10, 40),
    ("Asia", -10, 81, 26, 180),
    ("Africa", -35, 37, -18, 52),
    ("North America", 15, 72, -169, -52),
    ("South America", -56, 13, -82, -34),
    ("Oceania", -47, -10, 110, 180),
    ("Antarctica", -90, -60, -180, 180),
]

# Our own region boxes inside the continents (name, continent, south, north, west, east).
# No published borders exist for these nineteen names, so the cuts are an assumption.
REGION_BOXES = [
    ("Northern Europe", "Europe", 55, 72, -10, 40),
    ("Central Europe", "Europe", 45, 55, -10, 40),
    ("Southern Europe", "Europe", 36, 45, -10, 40),
    ("Northern Asia", "Asia", 50, 81, 26, 180),
    ("Central Asia", "Asia", 35, 50, 26, 90),
    ("East Asia", "Asia", 20, 50, 90, 180),
    ("South Asia", "Asia", -10, 35, 26, 180),
    ("Northern Africa", "Africa", 15, 37, -18, 52),
    ("Central Africa", "Africa", -10, 15, -18, 52),
    ("Southern Africa", "Africa", -35, -10, -18, 52),
    ("Northern North America", "North America", 50, 72, -169, -52),
    ("Central North America", "North America", 25, 50, -169, -52),
    ("Caribbean & Central America", "North America", 15, 25, -169, -52),
    ("Northern South America", "South America", -5, 13, -82, -34),
    ("Central South America", "South America", -25, -5, -82, -34),
    ("Southern South America", "South America", -56, -25, -82, -34),
    ("Northern Oceania", "Oceania", -28, -10, 110, 180),
    ("Southern Oceania", "Oceania", -47, -28, 110, 180),
    ("Antarctica", "Antarctica", -90, -60, -180, 180),
]


def parse_coordinate(text: Column) -> Column:
    """``57.05N`` -> 57.05, ``10.33W`` -> -10.33; a plain number passes, junk is null."""
    number = F.regexp_extract(text, r"([\d.]+)", 1).try_cast("double")
    return (
        F.when(text.endswith("N") | text.endswith("E"), number)
        .when(text.endswith("S") | text.endswith("W"), -number)
        .otherwise(text.try_cast("double"))
    )


def climate_zone(lat: Column, cuts: Sequence[tuple[str, float]] = ZONE_CUTS) -> Column:
    size = F.abs(lat)
    out = F.when(lat.isNull(), "UNKNOWN")
    for name, limit in cuts:
        out = out.when(size <= limit, name)
    return out.otherwise(ZONE_BEYOND)


def _inside(lat: Column, lon: Column, box: Sequence[float]) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lon.between(west, east)


def continent_of(lat: Column, lon: Column, boxes=CONTINENT_BOXES) -> Column:
    """First box in list order that holds the point, null when none does."""
    return F.coalesce(*[F.when(_inside(lat, lon, b[1:]), F.lit(b[0])) for b in boxes])


def region_of(lat: Column, lon: Column, continent: Column, boxes=REGION_BOXES) -> Column:
    """First region box of the given continent that holds the point."""
    return F.coalesce(
        *[
            F.when((continent == owner) & _inside(lat, lon, box), F.lit(name))
            for name, owner, *box in boxes
        ]
    )
