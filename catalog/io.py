"""Round trips through every file format: written from the shared tables, read back, summarised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.climate import CITY_YEAR, GOOD
from catalog.events import TIES, STORMY, _alerts
from catalog.mapping import (
    CITY_ORDERS, PLACED_ORDERS, SENSORS, city_orders, placed_orders, r, rounded, sensors, sql_time, table, text_time,
)
from weatherloom.operators import aggregates, cleaning
from weatherloom.plans import jobs
from weatherloom.sources import readers, versions, writers


def _series_lines(spark, sf_dir):
    """Order values as series text with comments, blank lines and broken lines among them."""
    key = F.col("o_orderkey") % 10
    numbers = F.format_string("  %d \t %d   %s  ", "year", "month", F.col("temperature").cast("string"))
    text = (
        F.when(key == 0, F.lit("% station remark"))
        .when(key == 1, F.lit("   "))
        .when(key == 2, F.lit("no numbers in here"))
        .when(key == 3, numbers)
        .otherwise(F.concat(numbers, F.col("uncertainty").cast("string")))
    )
    return city_orders(spark, sf_dir).select(text.alias("value"))


def _written_series(spark, sf_dir):
    path = writers.scratch_dir(spark, "series")
    _series_lines(spark, sf_dir).write.text(path)
    return path


def series_text(spark, sf_dir):
    rows = readers.read_series_text(spark, _written_series(spark, sf_dir))
    out = rows.groupBy("year", "month").agg(
        F.count("*").alias("rows"), F.avg("temperature").alias("avg_temperature"), F.count("uncertainty").alias("known")
    )
    return rounded(out, "avg_temperature")


def series_text_strict(spark, sf_dir):
    rows = readers.read_series_text(spark, _written_series(spark, sf_dir), keep_unparsed=False)
    return rounded(aggregates.monthly(rows).drop("std_temperature"), "avg_temperature", "min_temperature", "max_temperature", "avg_uncertainty")


def series_directory(spark, sf_dir):
    """All files of a folder in one read; the written month tables, summed over the files."""
    out = jobs.process_directory(spark, _written_series(spark, sf_dir), writers.scratch_dir(spark, "tables"))
    months = readers.read_table(spark, out["monthly"])
    return months.groupBy("year", "month").agg(F.sum("record_count").alias("record_count"))


def series_file_results(spark, sf_dir):
    """CSV and JSON results of one series, read back."""
    out = jobs.process_file(spark, _written_series(spark, sf_dir), writers.scratch_dir(spark, "results"))
    trends = spark.read.schema("slope_per_year double, r_squared double, start_year int, end_year int").json(out["trends"])
    flagged = spark.read.option("header", True).csv(out["anomalies"])
    counted = flagged.agg(F.count("*").alias("rows"), F.count_if(F.col("is_anomaly") == "true").alias("anomalies"))
    return rounded(trends.join(F.broadcast(counted)), "slope_per_year", "r_squared")


def series_file_report(spark, sf_dir):
    """Directory validation over the written files."""
    from weatherloom.operators import quality

    path = _written_series(spark, sf_dir)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source"))
    text = F.trim("value")
    data = lines.filter((text != "") & ~text.startswith("%"))
    files = quality.file_summary(data, readers.parse_series_lines(lines))
    out = quality.directory_summary(files)
    return out.select("files_with_errors", "success_rate", "total_rows", "total_missing")


def _written_csv(spark, sf_dir):
    key = F.col("o_orderkey")
    path = writers.scratch_dir(spark, "cities")
    placed_orders(spark, sf_dir).select(
        F.when(key % 13 != 0, F.col("dt")).otherwise("not a date").alias("dt"),
        F.when(key % 9 != 0, F.col("temperature")).alias("AverageTemperature"),
        F.col("uncertainty").alias("AverageTemperatureUncertainty"),
        F.col("city").alias("City"),
        F.col("country").alias("Country"),
        F.col("latitude").alias("Latitude"),
        F.col("longitude").alias("Longitude"),
    ).write.option("header", True).csv(path)
    return path


def city_csv(spark, sf_dir):
    rows = readers.read_city_csv(spark, _written_csv(spark, sf_dir))
    out = rows.groupBy("country", "year").agg(
        F.count("*").alias("rows"), F.avg("temperature").alias("avg_temperature"),
        F.count_distinct("city", "latitude", "longitude").alias("stations"),
    )
    return rounded(out, "avg_temperature")


def _counts(spark, paths):
    out = None
    for name, path in paths.items():
        part = spark.read.parquet(path).agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def eleven_tables(spark, sf_dir):
    """The whole city job: eleven tables written, their sizes."""
    written = jobs.process_city_data(spark, _written_csv(spark, sf_dir), writers.scratch_dir(spark, "city"))
    return _counts(spark, written)


def _contents(df, name, keys, number):
    """Rows, a checksum of their keys in any order, and the sum of a measure."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    mark = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    one = df.agg(F.count("*").alias("rows"), F.sum(mark).alias("checksum"), F.sum(number).cast("double").alias("total"))
    return rounded(one.select(F.lit(name).alias("table_name"), "rows", "checksum", "total"), "total", digits=3)


def event_outputs(spark, sf_dir):
    """The whole event job: four tables published together, their contents."""
    path = writers.scratch_dir(spark, "events")
    jobs.publish_events(spark, sensors(spark, sf_dir), path, {"station": ["city"], **TIES})
    at, c = text_time("timestamp"), F.col
    keys = [c("city"), at, c("event_type"), c("trend_direction"), c("alert_level"), c("alert_type"), c("storm_id"), c("storm_category")]
    parts = [_contents(versions.read_published(spark, path, n), n, keys, "event_intensity") for n in ("events", "alerts", "extremes")]
    tracks = versions.read_published(spark, path, "storm_tracks")
    parts.append(_contents(tracks, "storm_tracks", [c("storm_id"), c("storm_name"), at, c("category")], "max_wind_kmh"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def country_job(spark, sf_dir):
    """The whole country job: yearly means by country, continent and region, as published."""
    path = writers.scratch_dir(spark, "countries")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lookup = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("name"), F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country_code"), F.col("r_name").alias("continent")
    )
    jobs.publish_countries(spark, _written_csv(spark, sf_dir), lookup, path)
    country = versions.read_published(spark, path, "country").select(
        "year", "country", "country_code", "continent", F.lit(None).cast("string").alias("region"), "avg_temperature"
    )
    continent = versions.read_published(spark, path, "continental").select(
        "year", *[F.lit(None).cast("string").alias(n) for n in ("country", "country_code")], "continent", F.lit(None).cast("string").alias("region"), "avg_temperature"
    )
    return rounded(country.unionByName(continent), "avg_temperature")


def year_range_read(spark, sf_dir):
    """Table partitioned by year, read back for three years (only their folders are listed)."""
    rows = cleaning.clean(city_orders(spark, sf_dir))
    path = writers.write_table(rows, writers.scratch_dir(spark, "years"), ["year"], columns=["o_orderkey", "year", "month", "temperature"])
    out = readers.read_table(spark, path, (1996, 1998)).groupBy("year", "month").agg(
        F.count("*").alias("rows"), F.avg("temperature").alias("avg_temperature")
    )
    return rounded(out, "avg_temperature")


def deduplicated(spark, sf_dir):
    """One row per city and date: that of the smallest order key."""
    rows = cleaning.clean(city_orders(spark, sf_dir), dedup_keys=["city", "date"], dedup_order=["o_orderkey"])
    out = rows.groupBy("year").agg(
        F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"), F.avg("temperature").alias("avg_temperature")
    )
    return rounded(out, "avg_temperature")


def outlier_marks(spark, sf_dir):
    rows = cleaning.mark_outliers(sensors(spark, sf_dir), "temperature_hourly", -60.0, 60.0)
    return rows.groupBy("is_outlier").agg(F.count("*").alias("rows"))


def seeded_sample(spark, sf_dir):
    """Exactly 200 orders, the same for every partitioning."""
    return cleaning.sample_rows(city_orders(spark, sf_dir), 200, ["o_orderkey"]).select("o_orderkey", "city", "year")


def first_orders(spark, sf_dir):
    """The first hundred orders by key."""
    rows = city_orders(spark, sf_dir).orderBy("o_orderkey")
    return cleaning.first_rows(rows, 100).select("o_orderkey", "city", "year")


def _holes(spark, sf_dir):
    """Orders whose temperature is missing on every third key and whose city on every fifth."""
    return city_orders(spark, sf_dir).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("temperature")).alias("temperature"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("city")).alias("city"),
    )


def zeroed_missing(spark, sf_dir):
    """Missing temperatures as 0, missing cities untouched."""
    return cleaning.zero_missing(_holes(spark, sf_dir), ["temperature"])


def complete_rows(spark, sf_dir):
    """Rows with temperature and city."""
    return cleaning.drop_missing(_holes(spark, sf_dir), ["temperature", "city"])


def metric_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("container"), (F.col("event_id") % 97 / 1.0).alias("cpu_percent"),
        (F.col("event_id") % 4001 / 4.0).alias("mem_usage_mb"), (F.col("event_id") % 89 / 2.0).alias("mem_percent"),
    )
    metrics = {"cpu_percent": ["mean", "max"], "mem_usage_mb": ["mean", "max"], "mem_percent": ["mean"]}
    out = aggregates.metric_summary(rows, "container", metrics)
    return rounded(out, *[c for c in out.columns if c not in ("container", "samples")])


def throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("operation"), (F.col("event_id") % 61 / 8.0).alias("duration_seconds"),
        (F.col("event_id") % 1009).alias("records_processed"),
    )
    return rounded(aggregates.throughput(rows), "records_per_second")


QUERIES = {
    f.__name__: f
    for f in (
        series_text, series_text_strict, series_directory, series_file_results, series_file_report, city_csv,
        eleven_tables, event_outputs, country_job, year_range_read, deduplicated, outlier_marks, seeded_sample, first_orders, zeroed_missing,
        complete_rows, metric_summary,
        throughput,
    )
}

_LINES = CITY_ORDERS + """,
lines AS (SELECT year, month, temperature, CASE WHEN o_orderkey % 10 > 3 THEN uncertainty END AS uncertainty
  FROM city_orders WHERE o_orderkey % 10 > 2)"""
_CSV = f"""{PLACED_ORDERS},
csv AS (SELECT * FROM placed_orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 9 <> 0)"""
_CITY_TABLES = CITY_YEAR.replace("WHERE temperature BETWEEN -100 AND 60", "WHERE o_orderkey % 13 <> 0 AND o_orderkey % 9 <> 0", 1)



def _mark(keys: list[str]) -> str:
    """The checksum of a row's keys."""
    parts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 8) AS BIGINT)"


_CONTENTS = f"count(*) AS rows, CAST(sum(m) AS BIGINT) AS checksum, {r('sum(event_intensity)', 3)} AS total"

SQL = {
    "series_text": f"""WITH {_LINES} SELECT year, month, count(*) AS rows, {r('avg(temperature)')} AS avg_temperature,
        count(uncertainty) AS known FROM lines GROUP BY year, month
      UNION ALL SELECT NULL, NULL, count(*), NULL, 0 FROM orders WHERE o_orderkey % 10 = 2""",
    "series_text_strict": f"""WITH {_LINES} SELECT year, month, {r('avg(temperature)')} AS avg_temperature,
      {r('min(temperature)')} AS min_temperature, {r('max(temperature)')} AS max_temperature, count(*) AS record_count,
      {r('avg(uncertainty)')} AS avg_uncertainty FROM lines GROUP BY year, month""",
    "series_directory": f"WITH {_LINES} SELECT year, month, count(*) AS record_count FROM lines GROUP BY year, month",
    "series_file_results": f"""WITH {_LINES}, y AS (SELECT year, avg(temperature) AS t FROM lines GROUP BY year),
        m AS (SELECT avg(temperature) AS mu, stddev(temperature) AS sd FROM lines)
      SELECT {r('regr_slope(t, year)')} AS slope_per_year, {r('regr_r2(t, year)')} AS r_squared, min(year) AS start_year,
        max(year) AS end_year, (SELECT count(*) FROM lines) AS rows,
        (SELECT count(*) FROM lines, m WHERE abs((temperature - mu) / sd) > 3) AS anomalies FROM y""",
    "series_file_report": f"""WITH {_LINES} SELECT CAST(0 AS BIGINT) AS files_with_errors, 100.0::DOUBLE AS success_rate,
      count(*) AS total_rows, count(*) - count(uncertainty) AS total_missing FROM lines""",
    "city_csv": f"""WITH {_CSV} SELECT country, year, count(*) AS rows, {r('avg(temperature)')} AS avg_temperature,
      count(DISTINCT (city, latitude, longitude)) AS stations FROM csv GROUP BY country, year""",
    "eleven_tables": f"""WITH {_CITY_TABLES}
      SELECT 'monthly' AS table_name, count(*) AS rows FROM city_months
      UNION ALL SELECT 'yearly', count(*) FROM city_year
      UNION ALL SELECT 'anomalies', count(*) FROM city_year
      UNION ALL SELECT 'climatology', count(*) FROM (SELECT DISTINCT city, month FROM city_months)
      UNION ALL SELECT 'extreme_thresholds', count(*) FROM (SELECT DISTINCT city, month FROM city_months)
      UNION ALL SELECT 'seasonal', count(*) FROM (SELECT DISTINCT city, year, floor(month % 12 / 3) FROM city_months)
      UNION ALL SELECT 'regional', count(*) FROM (SELECT DISTINCT region, continent, year FROM city_year)
      UNION ALL SELECT 'continental', count(*) FROM (SELECT DISTINCT continent, year FROM city_year)
      UNION ALL SELECT 'correlation_matrix', 25 UNION ALL SELECT 'descriptive_stats', 4
      UNION ALL SELECT 'chi_square_tests', 3""",
    "event_outputs": f"""WITH {STORMY}, {_alerts('stormy', 'storm_category')},
        marked AS (SELECT *, {_mark(["city", sql_time('timestamp'), "event_type", "trend_direction", "alert_level", "alert_type", "storm_id", "storm_category"])} AS m FROM alerts),
        points AS (SELECT DISTINCT storm_id, storm_name, timestamp, lat_decimal, lon_decimal, wind_speed_kmh, pressure_hpa, storm_category FROM alerts WHERE storm_id IS NOT NULL)
      SELECT 'events' AS table_name, {_CONTENTS} FROM marked
      UNION ALL SELECT 'alerts', {_CONTENTS} FROM marked WHERE alert_active
      UNION ALL SELECT 'extremes', {_CONTENTS} FROM marked WHERE event_type <> 'NORMAL'
      UNION ALL SELECT 'storm_tracks', count(*), CAST(sum({_mark(["storm_id", "storm_name", sql_time('timestamp'), "storm_category"])}) AS BIGINT),
        {r('sum(wind_speed_kmh)', 3)} FROM points""",
    "country_job": f"""WITH {_CSV}, named AS (SELECT c.*, 'C' || n_nationkey AS country_code, r_name AS continent FROM csv c
        LEFT JOIN nation ON n_name = country LEFT JOIN region ON r_regionkey = n_regionkey WHERE temperature BETWEEN -100 AND 60)
      SELECT year, country, country_code, continent, CAST(NULL AS VARCHAR) AS region, {r('avg(temperature)')} AS avg_temperature
      FROM named GROUP BY year, country, country_code, continent
      UNION ALL SELECT year, NULL, NULL, continent, NULL, {r('avg(temperature)')} FROM named GROUP BY year, continent""",
    "year_range_read": f"""WITH {GOOD} SELECT year, month, count(*) AS rows, {r('avg(temperature)')} AS avg_temperature
      FROM good WHERE year BETWEEN 1996 AND 1998 GROUP BY year, month""",
    "deduplicated": f"""WITH {GOOD}, one AS (SELECT city, date, any_value(year) AS year, min(o_orderkey) AS k,
        arg_min(temperature, o_orderkey) AS t FROM good GROUP BY city, date)
      SELECT year, count(*) AS rows, sum(k)::BIGINT AS keys, {r('avg(t)')} AS avg_temperature FROM one GROUP BY year""",
    "outlier_marks": f"""WITH {SENSORS} SELECT NOT (temperature_hourly BETWEEN -60 AND 60) AS is_outlier, count(*) AS rows
      FROM sensors GROUP BY 1""",
    "metric_summary": f"""SELECT event_type AS container, {r('avg(event_id % 97)')} AS cpu_percent_mean,
      {r('max(event_id % 97)::DOUBLE')} AS cpu_percent_max, {r('avg((event_id % 4001) / 4.0::DOUBLE)')} AS mem_usage_mb_mean,
      {r('max((event_id % 4001) / 4.0::DOUBLE)')} AS mem_usage_mb_max, {r('avg((event_id % 89) / 2.0::DOUBLE)')} AS mem_percent_mean,
      count(*) AS samples FROM events GROUP BY event_type""",
    "throughput": f"""SELECT event_type AS operation, sum((event_id % 61) / 8.0::DOUBLE) AS duration_seconds,
      CAST(sum(event_id % 1009) AS BIGINT) AS records_processed,
      {r('sum(event_id % 1009) / sum((event_id % 61) / 8.0::DOUBLE)')} AS records_per_second FROM events GROUP BY event_type""",
}

_HOLES = CITY_ORDERS + """, holes AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN temperature END AS temperature,
  CASE WHEN o_orderkey % 5 <> 0 THEN city END AS city FROM city_orders)"""
SQL |= {
    "seeded_sample": f"WITH {CITY_ORDERS} SELECT o_orderkey, city, year FROM city_orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 200",
    "first_orders": f"WITH {CITY_ORDERS} SELECT o_orderkey, city, year FROM city_orders ORDER BY o_orderkey LIMIT 100",
    "zeroed_missing": f"WITH {_HOLES} SELECT o_orderkey, coalesce(temperature, 0) AS temperature, city FROM holes",
    "complete_rows": f"WITH {_HOLES} SELECT * FROM holes WHERE temperature IS NOT NULL AND city IS NOT NULL",
}
