"""How the shared tables play the part of climate data, in Spark and in SQL.

Measured values are scaled by powers of two: their sums are then exact in floating point, so
results do not depend on the order in which rows are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
FINE = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nearest(column: Column, digits: int = DIGITS) -> Column:
    """Half away from zero on the scaled double, which is what the SQL side does.

    Unlike ``round`` it needs no decimal arithmetic, and negative zero becomes zero.
    """
    scale = float(10**digits)
    return F.signum(column) * F.floor(F.abs(column) * scale + 0.5) / scale + 0.0


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: nearest(F.col(c), digits) for c in columns})


def r(expression: str, digits: int = DIGITS) -> str:
    """The same rounding in SQL; adding zero turns a negative zero into zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def rs(names: Sequence[str], digits: int = DIGITS) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def text_time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sql_time(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


# --- lineitem: dense station series -------------------------------------------------------

def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station readings; about one in eight is too hot to pass the cleaning rule."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("station"),
        "l_orderkey",
        "l_linenumber",
        F.to_date("l_shipdate").alias("date"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        (F.rint(F.col("l_extendedprice") * 100) / 131072.0 - 10).alias("temperature"),
        ((F.rint(F.col("l_tax") * 100) * FINE + F.col("l_orderkey") * 2654435 % FINE) / (64.0 * FINE)).alias(
            "uncertainty"
        ),
    )


READINGS = """readings AS (
  SELECT l_suppkey AS station, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
         round(l_extendedprice * 100) / 131072.0 - 10 AS temperature,
         (round(l_tax * 100) * 16777216 + l_orderkey * 2654435 % 16777216) / (64.0::DOUBLE * 16777216) AS uncertainty
  FROM lineitem)"""

CLEAN = READINGS + """,
clean AS (
  SELECT * FROM readings
  WHERE temperature IS NOT NULL AND year > 1750 AND year <= 2030 AND month BETWEEN 1 AND 12
    AND temperature BETWEEN -100 AND 60)"""

STATION_MONTH = CLEAN + """,
station_month AS (
  SELECT station, year, month, avg(temperature) AS avg_temperature, min(temperature) AS min_temperature,
         max(temperature) AS max_temperature, stddev(temperature) AS std_temperature,
         count(temperature) AS record_count, avg(uncertainty) AS avg_uncertainty
  FROM clean GROUP BY station, year, month)"""

STATION_YEAR = STATION_MONTH + """,
station_year AS (
  SELECT station, year, avg(avg_temperature) AS avg_temperature, min(min_temperature) AS min_temperature,
         max(max_temperature) AS max_temperature,
         max(max_temperature) - min(min_temperature) AS temperature_range,
         CAST(sum(record_count) AS BIGINT) AS record_count
  FROM station_month GROUP BY station, year)"""


# --- orders: one value per city and day, with country and coordinates ----------------------

def city_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders alone, for the questions that need no place."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("city"),
        F.to_date("o_orderdate").alias("date"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        (F.rint(F.col("o_totalprice") * 100) / 1048576.0).alias("temperature"),
        (F.pmod("o_orderkey", F.lit(32)) / 64.0).alias("uncertainty"),
    )


CITY_ORDERS = """city_orders AS (
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS city, o_custkey, CAST(o_orderdate AS DATE) AS date,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
         round(o_totalprice * 100) / 1048576.0 AS temperature, (o_orderkey % 32) / 64.0::DOUBLE AS uncertainty
  FROM orders)"""


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country lookup: name, code, continent."""
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("name"),
            F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("country_code"),
            F.col("r_name").alias("continent"),
        )
    )


COUNTRIES = """countries AS (
  SELECT n_name AS name, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS country_code,
         r_name AS continent
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities with country and coordinate text such as ``45.25N`` and ``12.5W``."""
    lat, lon = F.col("c_custkey") % 179 - 89, F.col("c_custkey") * 7 % 359 - 179
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").cast("string").alias("city"),
            F.col("n_name").alias("country"),
            F.concat(F.abs(lat).cast("string"), F.lit(".25"), F.when(lat < 0, "S").otherwise("N")).alias("latitude"),
            F.concat(F.abs(lon).cast("string"), F.lit(".5"), F.when(lon < 0, "W").otherwise("E")).alias("longitude"),
        )
    )


CITIES = """cities AS (
  SELECT CAST(c_custkey AS VARCHAR) AS city, n_name AS country,
         abs(c_custkey % 179 - 89) || '.25' || CASE WHEN c_custkey % 179 - 89 < 0 THEN 'S' ELSE 'N' END AS latitude,
         abs(c_custkey * 7 % 359 - 179) || '.5' || CASE WHEN c_custkey * 7 % 359 - 179 < 0 THEN 'W' ELSE 'E' END AS longitude,
         (abs(c_custkey % 179 - 89) + 0.25) * CASE WHEN c_custkey % 179 - 89 < 0 THEN -1 ELSE 1 END::DOUBLE AS lat,
         (abs(c_custkey * 7 % 359 - 179) + 0.5) * CASE WHEN c_custkey * 7 % 359 - 179 < 0 THEN -1 ELSE 1 END::DOUBLE AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with city, country and coordinates in the canonical station schema."""
    rows = city_orders(spark, sf_dir).withColumn("dt", F.date_format("date", "yyyy-MM-dd"))
    return rows.join(cities(spark, sf_dir), "city")


PLACED_ORDERS = f"""{CITY_ORDERS},
{CITIES},
placed_orders AS (
  SELECT o.*, country, latitude, longitude, lat, lon FROM city_orders o JOIN cities USING (city))"""


# --- events: irregular sensor rows ---------------------------------------------------------

def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly-style weather rows: city = user, twelve places shared by many cities."""
    key, user = F.col("event_id"), F.col("user_id")
    sign = F.when(key % 2 == 0, 1.0).otherwise(-1.0)
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("state"),
        user.cast("string").alias("city"),
        F.concat(F.lit("NATION_"), (user % 25).cast("string")).alias("country"),
        ((user % 12) * 10 - 55.75 + (user % 3) * 0.0625).alias("lat_decimal"),
        ((user % 12) * 25 - 140.25 + (user % 5) * 0.03125).alias("lon_decimal"),
        (sign * F.rint(F.col("value") * 100) / 512.0).alias("temperature_hourly"),
        (F.greatest(k - 60, F.lit(0)) * 3.0).alias("rain_mm"),
        (key * 7919 % 4801 / 16.0).alias("wind_speed_kmh"),
        (key * 31 % 97 + 20).cast("double").alias("humidity_pct"),
        (key * 17 % 240 + 860).cast("double").alias("pressure_hpa"),
    )


SENSORS = """sensors AS (
  SELECT event_id, ts AS timestamp, event_type AS state, CAST(user_id AS VARCHAR) AS city,
         'NATION_' || (user_id % 25) AS country,
         ((user_id % 12) * 10 - 55.75 + (user_id % 3) * 0.0625)::DOUBLE AS lat_decimal,
         ((user_id % 12) * 25 - 140.25 + (user_id % 5) * 0.03125)::DOUBLE AS lon_decimal,
         CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * round(value * 100) / 512.0 AS temperature_hourly,
         (greatest(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) - 60, 0) * 3.0)::DOUBLE AS rain_mm,
         (event_id * 7919 % 4801)::DOUBLE / 16.0::DOUBLE AS wind_speed_kmh,
         (event_id * 31 % 97 + 20)::DOUBLE AS humidity_pct,
         (event_id * 17 % 240 + 860)::DOUBLE AS pressure_hpa
  FROM events)"""
