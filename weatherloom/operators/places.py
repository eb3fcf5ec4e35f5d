"""Country lookup and placement of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weatherloom.functions.geo import climate_zone, continent_of, parse_coordinate, region_of
from weatherloom.operators.joining import join_statistics

#: Degrees of the cells by which points and boxes meet.
CELL_DEGREES = 5


def with_country(df: DataFrame, countries: DataFrame, name: str = "country") -> DataFrame:
    """Add ``country_code`` and ``continent`` from a lookup table; unknown names give null.

    ``countries`` has columns ``name``, ``country_code``, ``continent``, one row per country.
    It is stored once and its size checked before it is broadcast; a larger one is joined by shuffle, with the rows of
    frequent countries (and of unknown ones) dealt over several tasks by a hash of the whole row.
    """
    table = countries.select(F.col("name").alias(name), "country_code", "continent")
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    return join_statistics(df, table, [name], plain)


def with_coordinates(df: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    return df.withColumns(
        {
            "lat_decimal": parse_coordinate(F.col(latitude)),
            "lon_decimal": parse_coordinate(F.col(longitude)),
        }
    )


def with_area(df: DataFrame, lat: str = "lat_decimal", lon: str = "lon_decimal") -> DataFrame:
    """Add ``continent`` and ``region`` from the boxes: a projection, no join."""
    placed = df.withColumn("continent", continent_of(F.col(lat), F.col(lon)))
    return placed.withColumn("region", region_of(F.col(lat), F.col(lon), F.col("continent")))


def with_area_table(
    df: DataFrame, boxes: DataFrame, row_key: list[str], lat: str = "lat_decimal", lon: str = "lon_decimal"
) -> DataFrame:
    """The same from a box *table* (``area, south, north, west, east, priority``).

    Points are reduced to distinct coordinates and joined back. Boxes are cut into cells of
    ``CELL_DEGREES``, points and boxes meet by cell, and only then the edges are compared. Smallest
    priority wins. ``row_key`` spreads the rows of a crowded place over tasks.
    """
    points = df.select(lat, lon).distinct()
    hit = F.col(lat).between(F.col("south"), F.col("north")) & F.col(lon).between(F.col("west"), F.col("east"))

    def cell(degrees):
        return F.floor(degrees / CELL_DEGREES)

    pieces = boxes.filter("south <= north and west <= east").withColumn(
        "_x", F.explode(F.sequence(cell(F.col("west")), cell(F.col("east"))))
    ).withColumn("_y", F.explode(F.sequence(cell(F.col("south")), cell(F.col("north")))))
    placed = (
        points.withColumns({"_x": cell(F.col(lon)), "_y": cell(F.col(lat))})
        .join(pieces, ["_x", "_y"])
        .filter(hit)
        .groupBy(lat, lon)
        .agg(F.min_by("area", "priority").alias("area"))
    )
    return join_statistics(df, placed, [lat, lon], row_key)


def with_zone(df: DataFrame, lat: str = "lat_decimal") -> DataFrame:
    return df.withColumn("climate_zone", climate_zone(F.col(lat)))
