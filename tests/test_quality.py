"""Quality checks on small tables with known defects."""

import pytest
from pyspark.sql import functions as F

from weatherloom.operators import quality
from weatherloom.operators.cleaning import clean, clean_observed, cleaning_audit, first_rows, project, sample_fraction, sample_rows
from weatherloom.operators.series import Series


@pytest.fixture(scope="module")
def hours(spark):
    """Five hundred hourly rows of one city with the usual columns."""
    n = F.col("id")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + n * 3600)
    return spark.range(500).select(
        ts.alias("timestamp"), F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"),
        F.hour(ts).alias("hour"), F.lit("A").alias("city"), F.lit("X").alias("country"), F.lit(10.0).alias("latitude"),
        F.lit(20.0).alias("longitude"), (15 + 10 * F.sin(n / 24)).alias("temperature_hourly"),
        (n % 7).cast("double").alias("rain_mm"), (n % 50).cast("double").alias("wind_speed_kmh"),
        (n % 100).cast("double").alias("humidity_pct"),
    )


SERIES = Series.by_time(["city"], "timestamp", ["hour"], "day")


def report(df):
    return {(r.check, r.column_name, r.metric): r.value for r in df.collect()}


def test_full_report_of_a_sound_table(hours):
    got = report(quality.full_report(hours, SERIES))
    assert got["overall", "*", "overall_valid"] == "true"
    assert got["coverage", "*", "span_days"] == "20"
    assert got["resolution", "*", "is_hourly"] == "true" and got["resolution", "*", "median_gap"] == "3600.0"
    assert got["schema", "city", "present"] == "true" and got["schema", "storm_id", "present"] == "false"
    assert got["duplicates", "*", "duplicate_rows"] == "0"


def test_full_report_finds_broken_rules_and_missing_columns(hours):
    wet = hours.withColumn("humidity_pct", F.col("humidity_pct") + 2)
    assert report(quality.full_report(wet, SERIES))["overall", "*", "overall_valid"] == "false"
    bare = hours.drop("country")
    assert not quality.schema_is_valid(bare)
    assert report(quality.full_report(bare, SERIES))["overall", "*", "overall_valid"] == "false"


def test_pressure_only_warns(hours):
    low = hours.withColumn("pressure_hpa", F.lit(800.0))
    rows = {r.rule: r.status for r in quality.physical_rules(low).collect()}
    assert rows["pressure_range"] == "warn" and rows["humidity_range"] == "pass"
    assert quality.is_consistent(quality.physical_rules(low)).head()[0] is True


def test_temperature_column_uses_its_own_range(spark):
    df = spark.createDataFrame([(-90.0,), (0.0,), (61.0,)], "temperature_hourly double")
    assert quality.range_checks(df).head().out_of_range == 2


def test_alert_hierarchy(spark):
    def valid(levels):
        return quality.alert_report(spark.createDataFrame([(x,) for x in levels], "alert_level string")).head()

    assert valid(["green"] * 3 + ["yellow"] * 2 + ["red"]).hierarchy_valid
    assert not valid(["green"] + ["yellow"] * 2).hierarchy_valid
    assert not valid(["yellow"] + ["red"] * 2).hierarchy_valid
    assert valid(["red"]).hierarchy_valid and valid(["red"]).n_alerts == 1


def test_domains_of_both_vocabularies(spark):
    df = spark.createDataFrame([("TROPICAL",), ("Tropical",), (None,)], "climate_zone string")
    own = {r.value: r.is_valid for r in quality.domain_values(df, {"climate_zone": quality.OWN_DOMAINS["climate_zone"]}).collect()}
    assert own == {"TROPICAL": True, "Tropical": False}
    assert quality.domain_summary(quality.domain_values(df)).head().n_invalid == 1


def test_track_jump(spark):
    rows = [("a", i, 1.0 * i, 0.0) for i in range(5)] + [("b", 0, 0.0, 0.0), ("b", 1, 0.0, 11.0), ("c", 0, 0.0, 0.0)]
    tracks = spark.createDataFrame(rows, "storm_id string, n int, latitude double, longitude double").withColumn(
        "timestamp", F.timestamp_seconds(F.col("n") * 40_000)
    )
    got = quality.track_continuity(tracks, Series.by_time(["storm_id"], "timestamp", [], "day")).collect()
    assert {r.storm_id: r.is_continuous for r in got} == {"a": True, "b": False, "c": True}


def test_empty_table_gives_no_percentages(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert {r.missing_percent for r in quality.missing_values(empty).collect()} == {None}
    assert quality.duplicates(empty).head().duplicate_rows == 0


def test_cleaning_bounds_and_audit(spark):
    rows = [(1751, 1, 60.0), (1750, 1, 0.0), (2030, 12, -100.0), (2031, 1, 0.0), (2000, 13, 0.0), (2000, 5, 60.1), (2000, 5, None), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "year int, month int, temperature double")
    assert clean(df).count() == 2
    audit = cleaning_audit(df).head()
    assert (audit.rows_in, audit.rows_kept, audit.rows_removed, audit.removed_percent) == (8, 2, 6, 75.0)
    kept, observed = clean_observed(df)
    assert kept.count() == 2 and observed.get == {"rows_in": 8, "rows_kept": 2}


def test_samples(spark):
    df = spark.range(1000)
    a = {r.id for r in sample_rows(df.repartition(3), 50, ["id"]).collect()}
    assert a == {r.id for r in sample_rows(df.repartition(11), 50, ["id"]).collect()} and len(a) == 50
    assert a != {r.id for r in sample_rows(df, 50, ["id"], seed=1).collect()}
    assert 50 < sample_fraction(df, 0.1).count() < 150
    assert first_rows(df, 7).count() == 7


def test_projection_follows_the_contract(spark):
    df = spark.createDataFrame([(1, 2, 3)], "c int, x int, a int")
    assert project(df, ["a", "b", "c"]).columns == ["a", "c"]


def test_duplicates_leave_the_same_row_for_any_partitioning(spark):
    from weatherloom.operators import cleaning

    rows = spark.range(200).select(
        (F.col("id") % 10).alias("k"), F.lit(2000).alias("year"), F.lit(1).alias("month"), (F.col("id") * 37 % 50).cast("double").alias("temperature"), "id"
    )
    found = [sorted(map(tuple, cleaning.clean(rows.repartition(n), dedup_keys=["k"], dedup_order=["id"]).collect())) for n in (1, 7)]
    assert found[0] == found[1] and {r[4] for r in found[0]} == set(range(10))


def test_many_boxes_meet_points_by_cell(spark):
    from weatherloom.operators import places

    boxes = spark.range(12_000).select(
        F.col("id").cast("string").alias("area"), (F.col("id") % 120 - 60).cast("double").alias("south"), (F.col("id") % 120 - 59).cast("double").alias("north"),
        (F.floor(F.col("id") / 120) * 3 - 150).cast("double").alias("west"), (F.floor(F.col("id") / 120) * 3 - 147).cast("double").alias("east"), F.col("id").alias("priority"),
    )
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, -59.5, -149.0), (3, 80.0, 10.0), (4, None, 1.0)], "id int, lat_decimal double, lon_decimal double")
    out = places.with_area_table(points, boxes, ["id"])
    assert {r.id: r.area for r in out.collect()} == {1: "6060", 2: "0", 3: None, 4: None}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_gaps_counted_in_one_pass_equal_those_of_the_rows(spark, unit):
    rows = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7 + 1).alias("city"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 2) * 1700 + F.col("id") % 5 * 400).alias("ts"),
    ).union(spark.sql("SELECT 5000L, 99, timestamp'2023-11-20 00:00:00'"))
    series = Series.by_time(["city"], "ts", ["id"], unit)
    want = quality.gap_summary(quality.gaps(rows, series, "ts"), ["city"], 2000.0)
    got = quality.series_gap_summary(rows.repartition(3), series, "ts", step_seconds=2000.0)
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count() == 8
    whole = quality.series_gap_summary(rows, series, "ts", [], 2000.0)
    assert whole.select(quality.gap_summary(quality.gaps(rows, series, "ts"), [], 2000.0).columns).first() == quality.gap_summary(quality.gaps(rows, series, "ts"), [], 2000.0).first()
    assert quality.series_gap_summary(rows.filter("id < 0"), series, "ts").count() == 0


def test_value_counts_hold_values_nulls_and_points(spark):
    rows = spark.createDataFrame(
        [("a", None, 1.0, 2.0), ("a", "S1", 1.0, 2.0), (None, "S1", 1.0, 2.0), ("b", "S1", 3.0, 2.0)], "kind string, storm string, lat double, lon double"
    ).withColumn("ts", F.timestamp_seconds(F.lit(60)))
    counted = quality.value_counts(rows, {"kind": F.col("kind")}, [F.col(c) for c in ("storm", "ts", "lat", "lon")])
    got = {(r.name, r.value, r.latitude): r.rows for r in counted.collect()}
    assert got == {("kind", "a", None): 2, ("kind", None, None): 1, ("kind", "b", None): 1, (quality.POINT, "S1", 1.0): 2, (quality.POINT, "S1", 3.0): 1}


def test_a_report_reads_its_table_four_times(spark, tmp_path):
    """Passes of the whole report, by the rows that the scans of the table have read."""
    rows = spark.range(500).select(
        (F.col("id") % 4).cast("string").alias("city"), F.timestamp_seconds(F.col("id") * 1800).alias("timestamp"), F.rand(1).alias("rain_mm"),
        F.lit("green").alias("alert_level"), F.when(F.col("id") % 9 == 0, F.lit("S1")).alias("storm_id"), F.lit(1.0).alias("lat_decimal"), F.lit(2.0).alias("lon_decimal"),
    )
    rows.write.parquet(f"{tmp_path}/t")
    table, scans = spark.read.parquet(f"{tmp_path}/t"), []
    store = quality.stored

    def counted(df, name):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return store(df, name)

    quality.stored, keep = counted, quality.stored
    try:
        report = quality.full_report(table, Series.by_time(["city"], "timestamp", ["rain_mm"], "day"))
    finally:
        quality.stored = keep
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    of_table = sum(line.count("rain_mm") and "Relation [" in line for line in plan.splitlines())
    found = {(r["check"], r["column_name"], r["metric"]): r["value"] for r in report.collect()}
    assert found["duplicates", "*", "unique_rows"] == "500" and found["tracks", "*", "n_tracks"] == "1" and found["storms", "*", "n_storm_records"] == "56"
    assert sum(s > 0 for s in scans[:2]) + of_table <= 4

