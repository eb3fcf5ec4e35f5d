"""Streams over JSON files written from the sensor rows; finished before they are read. Several micro-batches each."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.events import LIGHTS, SQL as EVENT_SQL
from catalog.mapping import sensors, sql_time, text_time
from weatherloom.sources.writers import scratch_dir
from weatherloom.streaming import alerts

#: Rows of a file; a micro-batch takes a hundredth of the files, one at least.
FILE_ROWS = 25_000
LEAST_FILES = 3
#: Partitions of the state, or as many as a micro-batch has files: over a run, state tasks grow like the files.
LEAST_STATES = 12


def _written(spark, sf_dir) -> tuple[str, int]:
    """The sensor rows as JSON files in the order of time, and files per micro-batch.

    The number of files follows the counted rows and each file is a range of time, so a busy city is in all of them.
    The file source takes files by their time of change, which is set to their order here.
    """
    path, rows = scratch_dir(spark, "sensors"), sensors(spark, sf_dir)
    files = max(LEAST_FILES, -(-rows.count() // FILE_ROWS))
    rows.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        "city",
        "country",
        F.col("lat_decimal").alias("latitude"),
        F.col("lon_decimal").alias("longitude"),
        F.col("temperature_hourly").alias("temperature_c"),
        "humidity_pct",
        "pressure_hpa",
        "wind_speed_kmh",
        "rain_mm",
        F.col("state").alias("rain_state"),
    ).repartitionByRange(files, "timestamp").write.json(path)
    alerts.in_order_of_names(spark, path)
    return path, max(1, files // 100)


def _stream(spark, path, files_per_batch):
    rows = alerts.read_sensor_stream(spark, path, files_per_batch=files_per_batch)
    return alerts.with_traffic_light(alerts.with_event_time(rows))


def _batch(spark, path):
    rows = spark.read.schema(alerts.SENSOR_SCHEMA).json(path)
    return alerts.with_traffic_light(alerts.with_event_time(rows))


def _totals_query(spark, sf_dir, out):
    path, files_per_batch = _written(spark, sf_dir)
    totals = alerts.alert_totals(_stream(spark, path, files_per_batch))
    return alerts.write_totals(totals, out, scratch_dir(spark, "state"), partitions=max(LEAST_STATES, files_per_batch))


def stream_alert_totals(spark, sf_dir):
    out = scratch_dir(spark, "totals")
    query = _totals_query(spark, sf_dir, out)
    query.awaitTermination()
    return alerts.read_totals(spark, out)


def _windows(spark, sf_dir):
    path, files_per_batch = _written(spark, sf_dir)
    out = scratch_dir(spark, "windows")
    windows = alerts.alert_windows(_stream(spark, path, files_per_batch))
    query = alerts.write_windows(windows, out, scratch_dir(spark, "state"), partitions=max(LEAST_STATES, files_per_batch))
    query.awaitTermination()
    rest = alerts.open_windows(_batch(spark, path), alerts.last_watermark(query))
    return _batch(spark, path), spark.read.parquet(out).unionByName(rest)


def stream_alert_windows(spark, sf_dir):
    """All windows: those the watermark has passed from the stream, the youngest ones from the final flush."""
    _, table = _windows(spark, sf_dir)
    return table.withColumns({c: text_time(c) for c in ("window_start", "window_end")})


def stream_late_rows(spark, sf_dir):
    """Rows that came after the watermark: none, as the files are in the order of time."""
    rows, table = _windows(spark, sf_dir)
    return alerts.late_rows(rows, table)


def stream_run_statistics(spark, sf_dir):
    """Micro-batches and rows of a whole run as its listener counted them, alerts from the totals it wrote."""
    out = scratch_dir(spark, "totals")
    listener = alerts.RunListener()
    spark.streams.addListener(listener)
    try:
        query = _totals_query(spark, sf_dir, out)
        query.awaitTermination()
        seen = listener.rates(query)
    finally:
        spark.streams.removeListener(listener)
    found = F.coalesce(F.sum(F.when(F.col("alert_level") != "green", F.col("alert_count"))), F.lit(0))
    counts = [F.lit(seen[n]).cast("long").alias(n) for n in ("batch_count", "record_count")]
    return alerts.read_totals(spark, out).agg(found.alias("alert_count")).select(*counts, "alert_count")


def stream_file_statistics(spark, sf_dir):
    """The same rows and alerts counted from the files."""
    path, _ = _written(spark, sf_dir)
    rows = _batch(spark, path).withColumn("source", F.col("_metadata.file_name"))
    return alerts.run_statistics(rows)


QUERIES = {f.__name__: f for f in (stream_alert_totals, stream_alert_windows, stream_late_rows, stream_run_statistics, stream_file_statistics)}

_FILES = f"greatest({LEAST_FILES}, (count(*) + {FILE_ROWS - 1}) // {FILE_ROWS})"

SQL = {
    "stream_alert_totals": EVENT_SQL["light_totals"],
    "stream_alert_windows": f"""WITH {LIGHTS}, w AS (SELECT *, date_trunc('hour', timestamp) AS t0 FROM lights)
      SELECT {sql_time('t0')} AS window_start, {sql_time('t0 + INTERVAL 1 HOUR')} AS window_end, city, alert_level,
        count(*) AS alert_count, max(temperature_hourly) AS max_temperature, max(wind_speed_kmh) AS max_wind_speed,
        sum(rain_mm) AS total_rain
      FROM w GROUP BY t0, city, alert_level""",
    "stream_late_rows": "SELECT count(*) FILTER (ts IS NULL) AS late_rows FROM events",
    "stream_run_statistics": f"""WITH {LIGHTS}, n AS (SELECT {_FILES} AS files, count(*) AS record_count,
        count(*) FILTER (alert_level <> 'green') AS alert_count FROM lights)
      SELECT CAST(ceil(files / greatest(1, files // 100)) AS BIGINT) AS batch_count, record_count, alert_count FROM n""",
    "stream_file_statistics": f"""WITH {LIGHTS} SELECT CAST({_FILES} AS BIGINT) AS batch_count, count(*) AS record_count,
      count(*) FILTER (alert_level <> 'green') AS alert_count FROM lights""",
}
