"""Event chain: storms, alerts and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from weatherloom.operators import extremes
from weatherloom.operators.hourly import expand_hours, prepare_base
from weatherloom.plans import jobs
from weatherloom.streaming import alerts


@pytest.fixture(scope="module")
def stations(spark):
    """Two cities, ten days each, with daily weather columns."""
    n = F.col("id")
    return spark.range(20).select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n / 2).cast("int")), "yyyy-MM-dd").alias("dt"),
        (10 + n % 5).cast("double").alias("temperature"),
        F.lit(0.5).alias("uncertainty"),
        F.when(n % 2 == 0, "North").otherwise("South").alias("city"),
        F.lit("Land").alias("country"),
        F.when(n % 2 == 0, "51.51N").otherwise("33.87S").alias("latitude"),
        F.lit("0.13W").alias("longitude"),
        F.when(n == 6, 40.0).otherwise(0.0).alias("rain_mm"),
        F.when(n == 6, 130.0).otherwise(20.0).alias("wind_speed_kmh"),
        F.lit(1000.0).alias("pressure_hpa"),
    )


def test_base_columns(stations):
    row = prepare_base(stations).filter("city = 'South'").head()
    assert (row.lat_decimal, row.lon_decimal, row.climate_zone, row.season) == (-33.87, -0.13, "SUBTROPICAL", "SUMMER")


def test_hours(stations):
    base = prepare_base(stations)
    hours = expand_hours(base)
    assert hours.count() == 20 * 24
    mean = hours.groupBy("city", "date").agg(F.avg("temperature_hourly").alias("m"), F.first("avg_temperature").alias("t"))
    assert mean.filter(F.abs(F.col("m") - F.col("t")) > 1e-9).count() == 0
    assert expand_hours(base, hourly=False) is base


def test_event_table_and_tracks(stations):
    table = jobs.event_table(stations, ties=["hour"]).cache()
    assert table.columns == [c for c in jobs.EVENT_TABLE if c in table.columns]
    assert table.count() == 480
    storms = table.filter("event_type = 'STORM'")
    assert storms.count() > 0 and storms.select("storm_id", "storm_name").distinct().count() == 1
    assert {r.storm_category for r in storms.select("storm_category").distinct().collect()} == {2}
    assert {r.alert_level for r in storms.select("alert_level").distinct().collect()} == {"EMERGENCY"}
    quiet = table.filter("event_type != 'STORM'")
    assert quiet.filter("storm_id is not null or storm_category != 0").count() == 0
    tracks = extremes.storm_tracks(table).orderBy("timestamp").collect()
    assert tracks[0].movement_speed_kmh is None and tracks[1].movement_speed_kmh == 0.0
    assert {t.lifecycle_stage for t in tracks} == {"MATURE"}
    foot = extremes.storm_footprint(table).head()
    assert foot.affected_cities == ["North"] and foot.points == len(tracks)


def test_no_storms_need_no_special_case(stations):
    calm = stations.withColumn("rain_mm", F.lit(0.0))
    table = jobs.event_table(calm, ties=["hour"])
    assert table.filter("storm_id is not null").count() == 0
    tracks = extremes.storm_tracks(table)
    assert tracks.count() == 0 and "movement_speed_kmh" in tracks.columns
    off = jobs.event_table(stations, ties=["hour"], storms=False)
    assert off.filter("storm_id is not null or storm_category != 0").count() == 0


def test_single_row_station_gets_unit_deviation(spark):
    rows = spark.sql(
        "select 'a' city, timestamp'2024-01-01 00:00:00' timestamp, 5.0D temperature_hourly, 0.0D rain_mm, 0.0D wind_speed_kmh"
    )
    got = extremes.classify_events(rows, ["city"]).head()
    assert got.anomaly_score == 0.0 and got.trend_direction == "STABLE"


def test_movement_between_points(spark):
    points = [("s", 0, 0.0, 0.0), ("s", 1, 0.0, 1.0), ("s", 2, 1.0, 1.0)]
    df = spark.createDataFrame(points, "storm_id string, h int, lat_decimal double, lon_decimal double").selectExpr(
        "*", "'n' storm_name", "timestamp_seconds(h * 3600) timestamp", "1 storm_category", "70D wind_speed_kmh",
        "1000D pressure_hpa",
    )
    got = extremes.storm_tracks(df).orderBy("timestamp").collect()
    assert [round(r.movement_direction_deg) if r.movement_direction_deg is not None else None for r in got] == [None, 90, 0]
    assert got[1].movement_speed_kmh == pytest.approx(111.19, abs=0.01)
    assert got[0].radius_km == pytest.approx(78.62, abs=0.01)


def record(i, city, minute, temperature, wind=0.0, rain=0.0):
    return json.dumps(
        {"timestamp": f"2024-01-01T{10 + minute // 60:02d}:{minute % 60:02d}:00", "city": city, "temperature_c": temperature,
         "wind_speed_kmh": wind, "rain_mm": rain}
    )


def stream_of(spark, path, **options):
    rows = alerts.read_sensor_stream(spark, str(path), **options)
    return alerts.with_traffic_light(alerts.with_event_time(rows))


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_totals_equal_batch(spark, tmp_path, files_per_batch):
    source = tmp_path / "in"
    source.mkdir()
    for f in range(3):
        lines = [record(i, f"c{i % 2}", 7 * i + f, 30.0 + 2 * i, 10.0 * i, 5.0 * f) for i in range(10)]
        (source / f"{f}.json").write_text("\n".join(lines))
    stream = stream_of(spark, source, files_per_batch=files_per_batch)
    query = alerts.write_totals(alerts.alert_totals(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert alerts.query_rates(query)["record_count"] == 30
    batch = spark.read.schema(alerts.SENSOR_SCHEMA).json(str(source))
    want = alerts.alert_totals(alerts.with_traffic_light(batch))
    got = alerts.read_totals(spark, str(tmp_path / "out")).select(want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_windows_close_with_the_watermark(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [record(0, "a", 5, 50.0), record(1, "a", 50, 50.0), record(2, "a", 65, 20.0), record(3, "a", 200, 20.0), "broken"]
    (source / "0.json").write_text("\n".join(lines))
    query = alerts.write_windows(
        alerts.alert_windows(stream_of(spark, source)), str(tmp_path / "out"), str(tmp_path / "state")
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(str(r.window_start)[11:16], r.alert_level, r.alert_count) for r in got] == [("10:00", "red", 2), ("11:00", "green", 1)]


def test_run_statistics(spark):
    rows = spark.createDataFrame([("f1", "red"), ("f1", "green"), ("f2", "yellow")], "source string, alert_level string")
    assert alerts.run_statistics(rows).head() == (2, 3, 2)
