"""Time and place aggregates, baselines, heatmap tables, country pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.mapping import (
    CITY_ORDERS,
    CLEAN,
    COUNTRIES,
    PLACED_ORDERS,
    READINGS,
    STATION_MONTH,
    STATION_YEAR,
    city_orders,
    countries,
    placed_orders,
    r,
    readings,
    rounded,
    rs,
)
from weatherloom.functions.geo import CONTINENT_BOXES, REGION_BOXES
from weatherloom.operators import aggregates, anomalies, cleaning, places
from weatherloom.plans import jobs

MEASURES = ["avg_temperature", "min_temperature", "max_temperature", "std_temperature", "avg_uncertainty"]
PLAIN = ["avg_temperature", "min_temperature", "max_temperature"]
SQL_MEASURES = f"""{r('avg(temperature)')} AS avg_temperature, {r('min(temperature)')} AS min_temperature,
  {r('max(temperature)')} AS max_temperature, {r('stddev(temperature)')} AS std_temperature,
  count(temperature) AS record_count, {r('avg(uncertainty)')} AS avg_uncertainty"""
SEASON = """CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month BETWEEN 3 AND 5 THEN 'Spring'
  WHEN month BETWEEN 6 AND 8 THEN 'Summer' ELSE 'Fall' END"""
BASELINE = (1995, 1997)
YEAR = 1999


def _clean(spark, sf_dir):
    return cleaning.clean(readings(spark, sf_dir))


def monthly_summary(spark, sf_dir):
    return rounded(aggregates.monthly(_clean(spark, sf_dir)), *MEASURES)


def yearly_summary(spark, sf_dir):
    return rounded(aggregates.yearly(_clean(spark, sf_dir)), *MEASURES)


def climatology(spark, sf_dir):
    out = aggregates.climatology(_clean(spark, sf_dir))
    return rounded(out, *[f"climatology_{m}" for m in ("mean", "std", "min", "max")])


def seasonal_summary(spark, sf_dir):
    return rounded(aggregates.seasonal(_clean(spark, sf_dir)), *MEASURES[:4])


def cleaning_audit(spark, sf_dir):
    return rounded(cleaning.cleaning_audit(readings(spark, sf_dir)), "removed_percent")


def station_month(spark, sf_dir):
    return aggregates.monthly(_clean(spark, sf_dir), ["station"])


def station_year(spark, sf_dir):
    return aggregates.yearly_from_monthly(station_month(spark, sf_dir), ["station"])


def station_monthly(spark, sf_dir):
    return rounded(station_month(spark, sf_dir), *MEASURES)


def station_yearly(spark, sf_dir):
    return rounded(station_year(spark, sf_dir), *PLAIN, "temperature_range")


def station_climatology(spark, sf_dir):
    out = aggregates.station_climatology(station_month(spark, sf_dir), ["station"])
    return rounded(out, "climatology")


def station_seasonal(spark, sf_dir):
    return rounded(aggregates.station_seasonal(station_month(spark, sf_dir), ["station"]), *PLAIN)


def station_extremes(spark, sf_dir):
    out = aggregates.station_thresholds(station_month(spark, sf_dir), ["station"])
    return rounded(out, "p10_temperature", "p90_temperature")


def yearly_anomaly(spark, sf_dir):
    out = anomalies.station_anomalies(station_year(spark, sf_dir), ["station"])
    return rounded(out, "avg_temperature", "climatology", "anomaly")


def month_distribution(spark, sf_dir):
    out = aggregates.month_distribution(_clean(spark, sf_dir))
    return rounded(out, "mean", "std", "low", "q1", "median", "q3", "high")


def table_summary(spark, sf_dir):
    out = aggregates.table_summary(readings(spark, sf_dir))
    return rounded(out, "mean", "std", "min", "max", "q1", "median", "q3")


def city_month(spark, sf_dir):
    return aggregates.monthly(cleaning.clean(city_orders(spark, sf_dir)))


CITY_MONTH = CITY_ORDERS + """,
city_month AS (
  SELECT year, month, avg(temperature) AS avg_temperature FROM city_orders
  WHERE temperature BETWEEN -100 AND 60 GROUP BY year, month)"""


def baseline_anomaly(spark, sf_dir):
    """Month means of all cities against the monthly baseline of three early years."""
    out = anomalies.baseline_anomalies(city_month(spark, sf_dir), "avg_temperature", BASELINE)
    out = out.select("year", "month", "avg_temperature", "record_count", "baseline", "anomaly")
    return rounded(out, "avg_temperature", "baseline", "anomaly").orderBy("year", "month")


def city_baseline_anomaly(spark, sf_dir):
    """The same per city and row: the baseline grows with the cities and is joined spread out."""
    rows = cleaning.clean(city_orders(spark, sf_dir))
    out = anomalies.baseline_anomalies(rows, "temperature", BASELINE, ["city"])
    out = out.select("o_orderkey", "city", "year", "month", "temperature", "baseline", "anomaly")
    return rounded(out, "temperature", "baseline", "anomaly")


MONTH_COLUMNS = [f"m{m}" for m in range(1, 13)]


def heatmap_year_month(spark, sf_dir):
    rows = cleaning.clean(city_orders(spark, sf_dir))
    return rounded(aggregates.year_month_pivot(rows, "temperature"), *MONTH_COLUMNS)


def heatmap_decade_season(spark, sf_dir):
    rows = cleaning.clean(city_orders(spark, sf_dir))
    out = None
    for season in ("Winter", "Spring", "Summer", "Fall"):
        part = aggregates.decade_season_pivot(rows, "temperature", season).withColumn("season", F.lit(season))
        out = part if out is None else out.unionByName(part)
    return rounded(out, *MONTH_COLUMNS)


def baseline_anomaly_pivot(spark, sf_dir):
    rows = cleaning.clean(city_orders(spark, sf_dir))
    return rounded(anomalies.baseline_anomaly_pivot(rows, "temperature", BASELINE), *MONTH_COLUMNS)


def _pivot(index: str, value: str, where: str = "") -> str:
    cells = ", ".join(
        r(f"avg(CASE WHEN month = {m} THEN {value} END)") + f" AS m{m}" for m in range(1, 13)
    )
    return f"SELECT {index}, {cells} FROM {{source}} {where} GROUP BY {index.rsplit(' AS ', 1)[0]}"


def _tables(spark, sf_dir):
    return jobs.country_tables(placed_orders(spark, sf_dir), countries(spark, sf_dir))


def country_year(spark, sf_dir):
    return rounded(_tables(spark, sf_dir)["country"], "avg_temperature")


def continent_year(spark, sf_dir):
    return rounded(_tables(spark, sf_dir)["continental"], "avg_temperature")


def region_year(spark, sf_dir):
    return rounded(_tables(spark, sf_dir)["regional"], "avg_temperature")


def _placed_tables(spark, sf_dir):
    rows = cleaning.clean(placed_orders(spark, sf_dir))
    return jobs.station_tables(aggregates.monthly(rows, jobs.STATION))


def region_box_year(spark, sf_dir):
    return rounded(_placed_tables(spark, sf_dir)["regional"], *PLAIN)


def continent_box_year(spark, sf_dir):
    return rounded(_placed_tables(spark, sf_dir)["continental"], *PLAIN)


def box_table_area(spark, sf_dir):
    """Continents from a box *table* by range join, counted per area."""
    boxes = spark.createDataFrame(
        [(n, float(s), float(t), float(w), float(e), i) for i, (n, s, t, w, e) in enumerate(CONTINENT_BOXES)],
        "area string, south double, north double, west double, east double, priority int",
    )
    rows = places.with_coordinates(placed_orders(spark, sf_dir))
    placed = places.with_area_table(rows, boxes, ["o_orderkey"])
    return rounded(
        placed.groupBy("area").agg(F.count("*").alias("rows"), F.avg("temperature").alias("avg_temperature")),
        "avg_temperature",
    )


def country_metrics(spark, sf_dir):
    out = aggregates.country_metrics(_tables(spark, sf_dir)["country"], YEAR)
    return rounded(out, "global_avg")


def hottest_countries(spark, sf_dir):
    out = aggregates.hottest_countries(_tables(spark, sf_dir)["country"], YEAR, 10)
    return rounded(out.select("year", "country", "avg_temperature"), "avg_temperature")


def country_stats(spark, sf_dir):
    table = _tables(spark, sf_dir)["country"]
    out = aggregates.country_statistics(table, ["NATION_1", "NATION_3", "NATION_8"], digits=4)
    return out


def _case(boxes, lat="lat", lon="lon"):
    whens = " ".join(
        f"WHEN {lat} BETWEEN {s} AND {n} AND {lon} BETWEEN {w} AND {e} THEN '{name}'"
        for name, s, n, w, e in boxes
    )
    return f"CASE {whens} END"


def _region_case(continent="continent"):
    whens = " ".join(
        f"WHEN {continent} = '{owner}' AND lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e} THEN '{name}'"
        for name, owner, s, n, w, e in REGION_BOXES
    )
    return f"CASE {whens} END"


PLACED = f"""{PLACED_ORDERS}, {COUNTRIES},
boxed AS (SELECT *, {_case(CONTINENT_BOXES)} AS continent FROM placed_orders
          WHERE temperature BETWEEN -100 AND 60),
area AS (SELECT *, {_region_case()} AS region FROM boxed)"""
CITY_YEAR = PLACED + """,
city_months AS (
  SELECT city, country, latitude, longitude, region, continent, year, month, avg(temperature) AS avg_temperature,
         min(temperature) AS min_temperature, max(temperature) AS max_temperature, count(temperature) AS record_count
  FROM area GROUP BY ALL),
city_year AS (
  SELECT city, country, latitude, longitude, region, continent, year, avg(avg_temperature) AS avg_temperature,
         min(min_temperature) AS min_temperature, max(max_temperature) AS max_temperature,
         sum(record_count) AS record_count
  FROM city_months GROUP BY city, country, latitude, longitude, region, continent, year)"""
AREA_MEASURES = f"""{r('avg(avg_temperature)')} AS avg_temperature, {r('min(min_temperature)')} AS min_temperature,
  {r('max(max_temperature)')} AS max_temperature, CAST(sum(record_count) AS BIGINT) AS record_count"""
COUNTRY_YEAR = f"""{PLACED_ORDERS}, {COUNTRIES},
country_year AS (
  SELECT year, country, avg(temperature) AS avg_temperature, any_value(country_code) AS country_code,
         any_value(continent) AS continent
  FROM placed_orders LEFT JOIN countries ON country = name WHERE temperature BETWEEN -100 AND 60
  GROUP BY year, country)"""
BASE = f"""(SELECT month, avg(avg_temperature) AS baseline FROM city_month
  WHERE year BETWEEN {BASELINE[0]} AND {BASELINE[1]} GROUP BY month)"""
ROW_BASE = f"""(SELECT month, avg(temperature) AS baseline FROM good
  WHERE year BETWEEN {BASELINE[0]} AND {BASELINE[1]} GROUP BY month)"""
GOOD = CITY_ORDERS + ", good AS (SELECT * FROM city_orders WHERE temperature BETWEEN -100 AND 60)"

QUERIES = {
    f.__name__: f
    for f in (
        baseline_anomaly, monthly_summary, yearly_summary, climatology, seasonal_summary, cleaning_audit,
        station_monthly, station_yearly, station_climatology, station_seasonal, station_extremes,
        yearly_anomaly, month_distribution, table_summary, city_baseline_anomaly,
        heatmap_year_month, heatmap_decade_season, baseline_anomaly_pivot,
        country_year, continent_year, region_year, region_box_year, continent_box_year, box_table_area,
        country_metrics, hottest_countries, country_stats,
    )
}

SQL = {
    "baseline_anomaly": f"""WITH {CITY_ORDERS}, city_month AS (
        SELECT year, month, avg(temperature) AS avg_temperature, count(temperature) AS record_count FROM city_orders
        WHERE temperature BETWEEN -100 AND 60 GROUP BY year, month)
      SELECT year, month, {r('avg_temperature')} AS avg_temperature, record_count, {r('baseline')} AS baseline,
        {r('avg_temperature - baseline')} AS anomaly FROM city_month LEFT JOIN {BASE} USING (month)""",
    "monthly_summary": f"WITH {CLEAN} SELECT year, month, {SQL_MEASURES} FROM clean GROUP BY year, month",
    "yearly_summary": f"WITH {CLEAN} SELECT year, {SQL_MEASURES} FROM clean GROUP BY year",
    "climatology": f"""WITH {CLEAN} SELECT month, {r('avg(temperature)')} AS climatology_mean,
      {r('stddev(temperature)')} AS climatology_std, {r('min(temperature)')} AS climatology_min,
      {r('max(temperature)')} AS climatology_max, count(temperature) AS climatology_count FROM clean GROUP BY month""",
    "seasonal_summary": f"""WITH {CLEAN} SELECT {SEASON} AS season, {r('avg(temperature)')} AS avg_temperature,
      {r('min(temperature)')} AS min_temperature, {r('max(temperature)')} AS max_temperature,
      {r('stddev(temperature)')} AS std_temperature, count(temperature) AS record_count
      FROM clean GROUP BY 1""",
    "cleaning_audit": f"""WITH {CLEAN}, n AS (SELECT (SELECT count(*) FROM readings) AS a, (SELECT count(*) FROM clean) AS b)
      SELECT a AS rows_in, b AS rows_kept, a - b AS rows_removed, {r('(a - b) * 100.0::DOUBLE / a')} AS removed_percent FROM n""",
    "station_monthly": f"WITH {CLEAN} SELECT station, year, month, {SQL_MEASURES} FROM clean GROUP BY station, year, month",
    "station_yearly": f"""WITH {STATION_YEAR} SELECT station, year, {rs(PLAIN + ['temperature_range'])}, record_count
      FROM station_year""",
    "station_climatology": f"""WITH {STATION_MONTH} SELECT station, month, {r('avg(avg_temperature)')} AS climatology,
      count(*) AS record_count FROM station_month GROUP BY station, month""",
    "station_seasonal": f"""WITH {STATION_MONTH} SELECT station, year, {SEASON} AS season, {AREA_MEASURES}
      FROM station_month GROUP BY station, year, 3""",
    "station_extremes": f"""WITH {STATION_MONTH} SELECT station, month,
      {r('quantile_cont(avg_temperature, 0.1)')} AS p10_temperature,
      {r('quantile_cont(avg_temperature, 0.9)')} AS p90_temperature FROM station_month GROUP BY station, month""",
    "yearly_anomaly": f"""WITH {STATION_YEAR}, c AS (
        SELECT station, avg(avg_temperature) AS climatology FROM station_year GROUP BY station)
      SELECT station, year, {r('avg_temperature')} AS avg_temperature, {r('climatology')} AS climatology,
        record_count, {r('avg_temperature - climatology')} AS anomaly FROM station_year JOIN c USING (station)""",
    "month_distribution": f"""WITH {CLEAN} SELECT month, {r('avg(temperature)')} AS mean, {r('stddev(temperature)')} AS std,
      {r('min(temperature)')} AS low, {r('quantile_cont(temperature, 0.25)')} AS q1,
      {r('quantile_cont(temperature, 0.5)')} AS median, {r('quantile_cont(temperature, 0.75)')} AS q3,
      {r('max(temperature)')} AS high FROM clean GROUP BY month""",
    "table_summary": f"""WITH {READINGS} SELECT count(*) AS total_records, 8 AS total_columns,
      count(temperature) AS count, {r('avg(temperature)')} AS mean, {r('stddev(temperature)')} AS std,
      {r('min(temperature)')} AS min, {r('max(temperature)')} AS max, {r('quantile_cont(temperature, 0.25)')} AS q1,
      {r('quantile_cont(temperature, 0.5)')} AS median, {r('quantile_cont(temperature, 0.75)')} AS q3 FROM readings""",
    "city_baseline_anomaly": f"""WITH {GOOD}, b AS (
        SELECT city, month, avg(temperature) AS baseline FROM good
        WHERE year BETWEEN {BASELINE[0]} AND {BASELINE[1]} GROUP BY city, month)
      SELECT o_orderkey, city, year, month, {r('temperature')} AS temperature, {r('baseline')} AS baseline,
        {r('temperature - baseline')} AS anomaly FROM good LEFT JOIN b USING (city, month)""",
    "heatmap_year_month": f"WITH {GOOD} " + _pivot("year", "temperature").format(source="good"),
    "heatmap_decade_season": f"WITH {GOOD} " + " UNION ALL ".join(
        "SELECT *, '" + s + "' AS season FROM ("
        + _pivot(
            "CAST(floor(year / 10) * 10 AS INTEGER) AS decade", "temperature", f"WHERE {SEASON} = '{s}'"
        ).format(source="good") + ")"
        for s in ("Winter", "Spring", "Summer", "Fall")
    ),
    "baseline_anomaly_pivot": f"""WITH {GOOD}, a AS (
        SELECT year, month, temperature - baseline AS anomaly FROM good LEFT JOIN {ROW_BASE} USING (month)) """
    + _pivot("year", "anomaly").format(source="a"),
    "country_year": f"""WITH {COUNTRY_YEAR} SELECT year, country, {r('avg_temperature')} AS avg_temperature,
      country_code, continent FROM country_year""",
    "continent_year": f"""WITH {PLACED_ORDERS}, {COUNTRIES} SELECT year, continent, {r('avg(temperature)')} AS avg_temperature
      FROM placed_orders LEFT JOIN countries ON country = name WHERE temperature BETWEEN -100 AND 60 GROUP BY year, continent""",
    "region_year": f"""WITH {PLACED} SELECT year, region, continent, {r('avg(temperature)')} AS avg_temperature
      FROM area GROUP BY year, region, continent""",
    "region_box_year": f"WITH {CITY_YEAR} SELECT region, continent, year, {AREA_MEASURES} FROM city_year GROUP BY region, continent, year",
    "continent_box_year": f"WITH {CITY_YEAR} SELECT continent, year, {AREA_MEASURES} FROM city_year GROUP BY continent, year",
    "box_table_area": f"""WITH {PLACED_ORDERS} SELECT {_case(CONTINENT_BOXES)} AS area, count(*) AS rows,
      {r('avg(temperature)')} AS avg_temperature FROM placed_orders GROUP BY 1""",
    "country_metrics": f"""WITH {COUNTRY_YEAR} SELECT count(DISTINCT country) AS countries,
      {r('avg(avg_temperature)')} AS global_avg, arg_max(country, avg_temperature) AS hottest_country,
      arg_min(country, avg_temperature) AS coldest_country FROM country_year WHERE year = {YEAR}""",
    "hottest_countries": f"""WITH {COUNTRY_YEAR} SELECT year, country, {r('avg_temperature')} AS avg_temperature
      FROM country_year WHERE year = {YEAR} ORDER BY country_year.avg_temperature DESC, country LIMIT 10""",
    "country_stats": f"""WITH {COUNTRY_YEAR} SELECT country, {r('avg(avg_temperature)', 4)} AS mean,
      {r('stddev(avg_temperature)', 4)} AS std_dev, {r('min(avg_temperature)', 4)} AS min,
      {r('max(avg_temperature)', 4)} AS max FROM country_year
      WHERE country IN ('NATION_1', 'NATION_3', 'NATION_8') GROUP BY country""",
}
