"""Column functions checked row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.mapping import (
    CITIES, CITY_ORDERS, PLACED_ORDERS, READINGS, cities, city_orders, placed_orders, r, readings, rounded,
    sql_time, table, text_time,
)
from weatherloom.functions import climate, dates, geo
from weatherloom.operators import hourly, places, statistics


def parse_coordinates(spark, sf_dir):
    out = places.with_coordinates(cities(spark, sf_dir))
    return out.select("city", "latitude", "longitude", "lat_decimal", "lon_decimal")


def mixed_dates(spark, sf_dir):
    """Order dates written in four ways by order key, parsed back with their parts."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    text = (
        F.when(key % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(key % 4 == 1, F.date_format(d, "M/d/yyyy"))
        .when(key % 4 == 2, F.date_format(d, "dd/MM/yyyy"))
        .otherwise("unknown")
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("dt"))
    return dates.with_date_parts(rows, "dt").withColumn("date", F.col("date").cast("string"))


def climate_zones(spark, sf_dir):
    base = hourly.prepare_base(placed_orders(spark, sf_dir))
    amplitude = climate.diurnal_amplitude(F.col("climate_zone"), F.col("season"))
    return rounded(
        base.select(
            "o_orderkey", "climate_zone", "season", amplitude.alias("amplitude"), "day", "day_of_week",
            climate.season_north(F.col("month")).alias("season_north"),
            geo.continent_of(F.col("lat_decimal"), F.col("lon_decimal")).alias("continent"),
        ),
        "amplitude",
    )


def value_categories(spark, sf_dir):
    rows = readings(spark, sf_dir)
    return rounded(
        rows.select(
            "station", "l_orderkey", "l_linenumber",
            climate.temperature_category(F.col("temperature")).alias("temp_category"),
            dates.time_period(F.col("year"), F.lit(1998)).alias("time_period"),
            dates.decade(F.col("year")).alias("decade"),
            climate.clamp(F.col("temperature"), 0.0, 40.0).alias("clamped"),
        ),
        "clamped",
    )


def size_text(spark, sf_dir):
    """Part retail sizes written with units and read back as megabytes."""
    key = F.col("o_orderkey")
    number = (key % 1000).cast("string")
    units = F.array(*[F.lit(u) for u in ("B", "kB", "KiB", "MB", "MiB", "GB", "GiB", "")])
    text = F.concat(number, F.lit(".5"), F.element_at(units, (key % 8 + 1).cast("int")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("size"))
    return rounded(rows.withColumn("megabytes", climate.size_to_mb(F.col("size"))), "megabytes", digits=9)


def hourly_expand(spark, sf_dir):
    out = hourly.expand_hours(hourly.prepare_base(placed_orders(spark, sf_dir)))
    return rounded(
        out.select("o_orderkey", "hour", text_time("timestamp").alias("timestamp"), "temperature_hourly"),
        "temperature_hourly",
    )


def hourly_daily_agreement(spark, sf_dir):
    out = hourly.expand_hours(hourly.prepare_base(placed_orders(spark, sf_dir)))
    return rounded(
        statistics.daily_agreement(out, ["o_orderkey"], "temperature_hourly", "avg_temperature"), "correlation"
    )


ZONE = """CASE WHEN abs(lat) <= 23.5 THEN 'TROPICAL' WHEN abs(lat) <= 35 THEN 'SUBTROPICAL'
  WHEN abs(lat) <= 55 THEN 'TEMPERATE' WHEN abs(lat) <= 66.5 THEN 'CONTINENTAL' ELSE 'POLAR' END"""
# months shifted by half a year south of the equator
SEASON = """['WINTER', 'SPRING', 'SUMMER', 'AUTUMN'][
  CAST(floor(((month + CASE WHEN lat < 0 THEN 6 ELSE 0 END) % 12) / 3) AS INTEGER) + 1]"""
AMPLITUDE = """(CASE zone WHEN 'TROPICAL' THEN 10 WHEN 'SUBTROPICAL' THEN 12 WHEN 'TEMPERATE' THEN 14
  WHEN 'CONTINENTAL' THEN 16 ELSE 8 END * CASE season WHEN 'SUMMER' THEN 1.2 WHEN 'WINTER' THEN 0.8 ELSE 1.0 END)"""
ZONED = f"""{PLACED_ORDERS},
seasoned AS (SELECT *, {ZONE} AS zone, {SEASON} AS season FROM placed_orders)"""
HOURS = f"""{ZONED}, hours AS (
  SELECT o_orderkey, date, temperature, CAST(h AS INTEGER) AS hour,
         temperature + {AMPLITUDE} * sin(2 * pi() * (h - 14) / 24) AS temperature_hourly
  FROM seasoned, range(24) AS t(h))"""
BOX = """CASE WHEN lat BETWEEN 36 AND 72 AND lon BETWEEN -10 AND 40 THEN 'Europe'
  WHEN lat BETWEEN -10 AND 81 AND lon BETWEEN 26 AND 180 THEN 'Asia'
  WHEN lat BETWEEN -35 AND 37 AND lon BETWEEN -18 AND 52 THEN 'Africa'
  WHEN lat BETWEEN 15 AND 72 AND lon BETWEEN -169 AND -52 THEN 'North America'
  WHEN lat BETWEEN -56 AND 13 AND lon BETWEEN -82 AND -34 THEN 'South America'
  WHEN lat BETWEEN -47 AND -10 AND lon BETWEEN 110 AND 180 THEN 'Oceania'
  WHEN lat <= -60 THEN 'Antarctica' END"""

QUERIES = {
    f.__name__: f
    for f in (
        parse_coordinates, mixed_dates, climate_zones, value_categories, size_text, hourly_expand,
        hourly_daily_agreement,
    )
}

SQL = {
    "parse_coordinates": f"""WITH {CITIES} SELECT city, latitude, longitude, lat AS lat_decimal, lon AS lon_decimal
      FROM cities""",
    "mixed_dates": f"""WITH {CITY_ORDERS}, t AS (
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(date, '%Y-%m-%d')
            WHEN 1 THEN strftime(date, '%-m/%-d/%Y') WHEN 2 THEN strftime(date, '%d/%m/%Y') ELSE 'unknown' END AS dt,
          CASE o_orderkey % 4 WHEN 3 THEN NULL
            WHEN 2 THEN CASE WHEN day(date) <= 12 THEN make_date(year(date), day(date), month(date)) ELSE date END
            ELSE date END AS d
        FROM city_orders)
      SELECT o_orderkey, dt, CAST(d AS VARCHAR) AS date, CAST(year(d) AS INTEGER) AS year,
        CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day,
        CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week FROM t""",
    "climate_zones": f"""WITH {ZONED} SELECT o_orderkey, zone AS climate_zone, season, {r(AMPLITUDE + '::DOUBLE')} AS amplitude,
      CAST(day(date) AS INTEGER) AS day, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week,
      ['Winter', 'Spring', 'Summer', 'Fall'][CAST(floor((month % 12) / 3) AS INTEGER) + 1] AS season_north,
      {BOX} AS continent FROM seasoned""",
    "value_categories": f"""WITH {READINGS} SELECT station, l_orderkey, l_linenumber,
      CASE WHEN temperature < 10 THEN 'Cold' WHEN temperature < 20 THEN 'Moderate' ELSE 'Hot' END AS temp_category,
      CASE WHEN year < 1998 THEN 'Early' ELSE 'Late' END AS time_period, CAST(year - year % 10 AS INTEGER) AS decade,
      {r('least(greatest(temperature, 0), 40)')} AS clamped FROM readings""",
    "size_text": f"""WITH t AS (SELECT o_orderkey, o_orderkey % 1000 + 0.5::DOUBLE AS v, o_orderkey % 8 AS u FROM orders)
      SELECT o_orderkey, CAST(v AS VARCHAR) || ['B', 'kB', 'KiB', 'MB', 'MiB', 'GB', 'GiB', ''][u + 1] AS size,
        {r('v * [1.0 / 1048576, 1.0 / 1024, 1.0 / 1024, 1, 1, 1024, 1024, 1][u + 1]::DOUBLE', 9)} AS megabytes FROM t""",
    "hourly_expand": f"""WITH {HOURS} SELECT o_orderkey, hour, {sql_time('date + to_hours(hour)')} AS timestamp,
      {r('temperature_hourly')} AS temperature_hourly FROM hours""",
    "hourly_daily_agreement": f"""WITH {HOURS}, d AS (
        SELECT o_orderkey, avg(temperature_hourly) AS h, any_value(temperature) AS t FROM hours GROUP BY o_orderkey)
      SELECT {r('corr(h, t)')} AS correlation, count(*) AS days FROM d""",
}
