"""Finite streams: every window comes out, late rows are counted, whole runs are counted."""

import json

import pytest
from pyspark.sql import functions as F

from weatherloom.sources.writers import scratch_dir
from weatherloom.streaming import alerts


def write_files(spark, path, batches):
    """One JSON file per batch of (time, city, temperature), in this order."""
    files, _ = alerts._hadoop(spark, path)
    for nth, rows in enumerate(batches):
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-{nth:05d}.json"))
        text = "".join(json.dumps({"timestamp": t, "city": c, "temperature_c": v, "wind_speed_kmh": 0.0, "rain_mm": 1.0}) + "\n" for t, c, v in rows)
        out.write(bytearray(text.encode()))
        out.close()
    alerts.in_order_of_names(spark, path)


def shaped(df):
    return alerts.with_traffic_light(alerts.with_event_time(df))


def run_windows(spark, batches):
    path, out = scratch_dir(spark, "in"), scratch_dir(spark, "out")
    write_files(spark, path, batches)
    stream = shaped(alerts.read_sensor_stream(spark, path, files_per_batch=1))
    query = alerts.write_windows(alerts.alert_windows(stream), out, scratch_dir(spark, "state"))
    query.awaitTermination()
    rows = shaped(spark.read.schema(alerts.SENSOR_SCHEMA).json(path))
    appended = spark.read.schema("window_start timestamp, window_end timestamp, city string, alert_level string, alert_count long, max_temperature double, max_wind_speed double, total_rain double").parquet(out)
    return rows, appended, alerts.open_windows(rows, alerts.last_watermark(query))


def test_late_rows_are_counted_and_the_last_windows_flushed(spark):
    rows, appended, rest = run_windows(
        spark,
        [
            [("2024-01-01 10:10:00", "a", 1.0), ("2024-01-01 12:05:00", "a", 2.0)],
            [("2024-01-01 12:30:00", "a", 3.0)],
            # the first is late: 11:55 had passed before this batch; the second is not, as its window is open
            [("2024-01-01 10:30:00", "a", 9.0), ("2024-01-01 12:10:00", "a", 4.0), ("no time", "a", 5.0)],
        ],
    )
    counts = {(r.window_start.hour, r.alert_count, r.max_temperature) for r in appended.unionByName(rest).collect()}
    assert counts == {(10, 1, 1.0), (12, 3, 4.0)}
    assert [r.window_start.hour for r in rest.collect()] == [12] and appended.count() == 1
    assert alerts.late_rows(rows, appended.unionByName(rest)).first().late_rows == 1


def test_flush_alone_gives_all_windows(spark):
    """One batch: no watermark has been reached when it is read."""
    rows, appended, rest = run_windows(spark, [[(f"2024-01-01 {h:02d}:10:00", c, float(h)) for h in range(5) for c in "ab"]])
    both = appended.unionByName(rest)
    assert both.count() == 10 and both.select("window_start", "city").distinct().count() == 10
    assert alerts.late_rows(rows, both).first().late_rows == 0


def test_runs_of_more_than_a_hundred_batches_are_counted_in_full(spark):
    path = scratch_dir(spark, "in")
    write_files(spark, path, [[("2024-01-01 10:10:00", "a", 1.0)] * (1 + i % 3) for i in range(105)])
    listener = alerts.RunListener()
    spark.streams.addListener(listener)
    try:
        stream = alerts.read_sensor_stream(spark, path, files_per_batch=1)
        query = stream.writeStream.format("noop").option("checkpointLocation", scratch_dir(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        seen = listener.rates(query)
    finally:
        spark.streams.removeListener(listener)
    assert (seen["batch_count"], seen["record_count"]) == (105, 210)
    assert seen["duration_seconds"] > 0 and seen["records_per_second"] == pytest.approx(210 / seen["duration_seconds"])
    assert not alerts.query_rates(query)["complete"]  # Spark's own reports have lost the first batches


def test_windows_of_nothing(spark):
    empty = shaped(spark.createDataFrame([], alerts.SENSOR_SCHEMA))
    windows = alerts.open_windows(empty, None)
    assert windows.count() == 0 and alerts.late_rows(empty, windows).first().late_rows == 0
    assert windows.filter(F.col("alert_count") > 0).count() == 0


@pytest.mark.parametrize("name", ["stream_alert_totals", "stream_alert_windows", "stream_late_rows", "stream_run_statistics"])
def test_state_lies_in_few_partitions_whatever_the_session_shuffles_into(spark, sf_dir, monkeypatch, name):
    from catalog import streams

    queries = []
    for writer in ("write_totals", "write_windows"):
        monkeypatch.setattr(alerts, writer, lambda *a, f=getattr(alerts, writer), **b: queries.append(f(*a, **b)) or queries[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        streams.QUERIES[name](spark, sf_dir).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    states = [p["stateOperators"][0]["numShufflePartitions"] for p in queries[0].recentProgress if p["stateOperators"]]
    assert states and set(states) == {streams.LEAST_STATES}
