"""Whole jobs on small files: read, compute, write, read back."""

import math

import pytest
from pyspark.sql import functions as F

from weatherloom.operators import aggregates, anomalies, places, quality, statistics
from weatherloom.plans import jobs
from weatherloom.sources import readers, versions, writers


@pytest.fixture
def series_dir(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    head = "% Global land temperatures\n%\n\n"
    lines = [f"  {y}   {m:2d}  {10 + m + (y - 2020) * 0.5:.3f}  0.1" for y in (2020, 2021, 2022) for m in range(1, 13)]
    (folder / "a.txt").write_text(head + "\n".join(lines) + "\n 2023 1 99.0 0.1\n 2023 2\n")
    (folder / "b.txt").write_text("some words\nwithout numbers\n")
    return folder


def test_series_text(spark, series_dir):
    rows = readers.read_series_text(spark, f"{series_dir}/a.txt")
    assert rows.columns == ["year", "month", "temperature", "uncertainty"]
    assert rows.count() == 38 and rows.filter("temperature is null").count() == 1
    assert readers.read_series_text(spark, f"{series_dir}/a.txt", keep_unparsed=False).count() == 37
    both = readers.read_series_text(spark, f"{series_dir}/*.txt", with_source=True)
    assert {r.source for r in both.select("source").distinct().collect()} == {"a.txt", "b.txt"}


def test_directory_job_and_repeated_run(spark, series_dir, tmp_path):
    def run(name):
        out = jobs.process_directory(spark, f"{series_dir}/*.txt", str(tmp_path / name))
        return {n: sorted(map(tuple, spark.read.parquet(p).drop("source").collect()), key=repr) for n, p in out.items()}

    first = run("one")
    assert len(first["monthly"]) == 36 and len(first["yearly"]) == 3 and len(first["anomalies"]) == 36
    assert run("two") == first and run("one") == first


def test_file_job(spark, series_dir, tmp_path):
    out = jobs.process_file(spark, f"{series_dir}/a.txt", str(tmp_path / "file"))
    trend = spark.read.json(out["trends"]).head()
    assert trend.slope_per_decade == pytest.approx(5.0) and trend.years_of_data == 3
    assert spark.read.option("header", True).csv(out["monthly"]).count() == 36
    with pytest.raises(ValueError, match="unknown result format"):
        writers.write_text_results(spark.range(1), str(tmp_path / "x"), "xlsx")


def test_directory_summary_counts_a_file_without_numbers_as_an_error(spark, series_dir):
    lines = spark.read.text(f"{series_dir}/*.txt").select("value", F.col("_metadata.file_name").alias("source"))
    data = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("%"))
    files = quality.file_summary(data, readers.parse_series_lines(lines))
    assert quality.directory_summary(files).head() == (2, 1, 50.0, 38, 2)


CSV = """dt,AverageTemperature,AverageTemperatureUncertainty,City,Country,Latitude,Longitude
2000-01-01,5.5,0.2,London,United Kingdom,51.51N,0.13W
2000-07-01,17.0,0.2,London,United Kingdom,51.51N,0.13W
2001-01-01,,0.2,London,United Kingdom,51.51N,0.13W
not-a-date,3.0,0.2,London,United Kingdom,51.51N,0.13W
2000-01-01,22.5,abc,Sydney,Australia,33.87S,151.21E
2001-01-01,23.5,0.4,Sydney,Australia,33.87S,151.21E
2001-01-01,70.0,0.4,Atlantis,Nowhere,0.80N,30.00W
"""


@pytest.fixture
def city_csv(tmp_path):
    path = tmp_path / "cities.csv"
    path.write_text(CSV)
    return str(path)


def test_city_csv(spark, city_csv):
    rows = readers.read_city_csv(spark, city_csv)
    assert rows.count() == 5 and rows.filter("uncertainty is null").count() == 1
    assert dict(rows.dtypes)["date"] == "date"


def test_country_job(spark, city_csv, tmp_path):
    lookup = spark.createDataFrame(
        [("United Kingdom", "GBR", "Europe"), ("Australia", "AUS", "Oceania")], "name string, country_code string, continent string"
    )
    out = jobs.process_countries(spark, city_csv, lookup, str(tmp_path / "out"))
    country = {(r.year, r.country): (r.avg_temperature, r.country_code, r.continent) for r in spark.read.parquet(out["country"]).collect()}
    assert country[2000, "United Kingdom"] == (11.25, "GBR", "Europe")
    regions = {r.region for r in spark.read.parquet(out["regional"]).collect()}
    assert regions == {"Central Europe", "Southern Oceania"}
    unknown = places.with_country(readers.read_city_csv(spark, city_csv), lookup).filter("country = 'Nowhere'").head()
    assert unknown.country_code is None and unknown.continent is None


def test_eleven_tables(spark, city_csv, tmp_path):
    out = jobs.process_city_data(spark, city_csv, str(tmp_path / "out"))
    assert len(out) == 11
    tables = {n: spark.read.parquet(p) for n, p in out.items()}
    assert tables["monthly"].count() == 4 and tables["correlation_matrix"].count() == 25
    assert tables["descriptive_stats"].count() == 4 and tables["chi_square_tests"].count() == 3
    year = tables["yearly"].filter("city = 'London'").head()
    assert (year.avg_temperature, year.temperature_range, year.record_count) == (11.25, 11.5, 2)
    odd = tables["anomalies"].filter("city = 'Sydney' and year = 2001").head()
    assert odd.anomaly == pytest.approx(0.5)


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", 9), (2, "b", 9)], "year int, v string, extra int")
    writers.write_table(first, path, ["year", "absent"], columns=["v", "year", "missing"])
    writers.write_table(spark.createDataFrame([(2, "c")], "year int, v string"), path, ["year"])
    assert {(r.year, r.v) for r in readers.read_table(spark, path).collect()} == {(1, "a"), (2, "c")}
    assert {r.v for r in readers.read_table(spark, path, years=(2, 5)).collect()} == {"c"}
    pruned = readers.read_table(spark, path, years=(2, 5))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in pruned


def test_fallback_table(spark, tmp_path):
    path = writers.write_table(spark.range(3), str(tmp_path / "here"))
    assert readers.read_table(spark, str(tmp_path / "gone"), fallback=path).count() == 3
    with pytest.raises(Exception):
        readers.read_table(spark, str(tmp_path / "gone"))


def test_no_tracks_no_folder(spark, tmp_path):
    empty = spark.createDataFrame([], "storm_id string, timestamp timestamp")
    assert writers.write_storm_tracks(empty, str(tmp_path / "none")) is None
    assert not (tmp_path / "none").exists()


def test_trend_of_short_records(spark):
    one = spark.createDataFrame([(2000, 1.0)], "year int, avg_temperature double")
    assert statistics.trend_line(one).head().trend_line is None
    two = spark.createDataFrame([(2000, 1.0), (2001, 2.0)], "year int, avg_temperature double")
    row = statistics.trend_significance(two).head()
    assert row.slope == pytest.approx(1.0) and row.p_value is None
    flat = spark.createDataFrame([(2000, 1.0), (2000, 2.0)], "year int, avg_temperature double")
    assert statistics.quadratic_trend(flat).head().coef_2 is None


def test_both_deviations_of_the_anomaly_flag(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0, 0, 0, 10)], "temperature double")
    population = anomalies.flag_anomalies(df, threshold=1.9).orderBy("temperature").collect()[-1]
    sample = anomalies.flag_anomalies(df, threshold=1.9, ddof=1).orderBy("temperature").collect()[-1]
    assert population.temp_zscore == pytest.approx(2.0) and population.is_anomaly
    assert sample.temp_zscore == pytest.approx(1.7889, abs=1e-4) and not sample.is_anomaly
    two = df.withColumn("k", F.lit("a")).unionByName(df.withColumn("k", F.lit("b")))
    grouped = anomalies.flag_anomalies(two, threshold=1.9, keys=["k"]).filter("is_anomaly").collect()
    assert [(r.k, round(r.temp_zscore, 9)) for r in sorted(grouped)] == [("a", 2.0), ("b", 2.0)]
    constant = anomalies.flag_anomalies(df.filter("temperature = 0"))
    assert constant.filter("is_anomaly or temp_zscore is not null").count() == 0


def test_chi_square_of_a_known_table(spark):
    rows = [("x", "u")] * 10 + [("x", "v")] * 20 + [("y", "u")] * 30 + [("y", "v")] * 40
    df = spark.createDataFrame(rows, "a string, b string")
    row = statistics.chi_square_tests(df, {"t": ("a", "b")}).head()
    assert row.chi_square_statistic == pytest.approx(100 * (10 * 40 - 20 * 30) ** 2 / (30 * 70 * 40 * 60))
    assert row.degrees_of_freedom == 1 and row.p_value == pytest.approx(math.erfc(math.sqrt(row.chi_square_statistic / 2))) and not row.is_significant


def test_approximate_thresholds(spark):
    df = spark.range(1, 1001).selectExpr("cast(id as double) temperature")
    exact = anomalies.extreme_thresholds(df, percentiles=[90.0]).head()
    rough = anomalies.extreme_thresholds(df, percentiles=[90.0], approximate=True).head()
    assert exact.high_threshold == pytest.approx(900.1) and abs(rough.high_threshold - 900.1) <= 1


def test_country_statistics_round_half_even(spark):
    df = spark.createDataFrame([("a", 0.125), ("b", 0.375)], "country string, avg_temperature double")
    got = {r.country: r.mean for r in aggregates.country_statistics(df).collect()}
    assert got == {"a": 0.12, "b": 0.38}


def test_versions_switch_as_a_whole(spark, tmp_path):
    out = str(tmp_path / "results")
    assert versions.current_version(spark, out) is None
    with pytest.raises(ValueError):
        versions.read_published(spark, out, "t")
    seen = []
    for i in range(4):
        version = versions.new_version(out)
        spark.range(i + 1).write.parquet(f"{version}/t")
        if i == 2:
            continue  # a run that failed before its switch
        assert len(seen) == 0 or versions.read_published(spark, out, "t").count() == seen[-1]
        versions.switch(spark, out, version)
        seen.append(versions.read_published(spark, out, "t").count())
        assert versions.current_version(spark, out).rsplit("/", 1)[-1] == version.rsplit("/", 1)[-1]
    left = sorted(p.name for p in (tmp_path / "results").iterdir() if not p.name.startswith("."))
    assert seen == [1, 2, 4] and len([n for n in left if n.startswith("version-")]) == 2 and "_manifest" in left
    assert not [n for n in left if n.startswith("_manifest-")]


def test_a_rerun_without_storms_leaves_no_tracks(spark, tmp_path):
    def rows(wind):
        n = F.col("id")
        return spark.range(60).select(
            n.alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + n * 3600).alias("timestamp"), F.lit("A").alias("city"), F.lit("X").alias("country"),
            F.lit(10.0).alias("lat_decimal"), F.lit(20.0).alias("lon_decimal"), (15 + F.sin(n)).alias("temperature_hourly"),
            F.when(n % 7 == 0, 40.0).otherwise(1.0).alias("rain_mm"), F.lit(wind).alias("wind_speed_kmh"), F.lit(1000.0).alias("pressure_hpa"),
        )

    out, options = str(tmp_path / "events"), {"station": ["city"], "ties": ["event_id"]}
    jobs.publish_events(spark, rows(90.0), out, options)
    assert versions.read_published(spark, out, "storm_tracks").count() == 9
    jobs.publish_events(spark, rows(5.0), out, options)
    tracks = versions.read_published(spark, out, "storm_tracks")
    assert tracks.count() == 0 and "storm_id" in tracks.columns and versions.read_published(spark, out, "events").count() == 60
    plain = str(tmp_path / "tracks")
    stormy = spark.createDataFrame([("S", "2024-01-01 00:00:00")], "storm_id string, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert writers.write_storm_tracks(stormy, plain) == plain
    assert writers.write_storm_tracks(stormy.filter("storm_id is null"), plain) is None and not (tmp_path / "tracks").exists()


def test_chi_square_of_counts_whose_product_leaves_64_bits(spark):
    rows = spark.range(8_000_000).select((F.col("id") % 2).alias("a"), (F.col("id") % 5 < 2 + F.col("id") % 2).alias("b"))
    row = statistics.chi_square_tests(rows, {"t": ("a", "b")}).head()
    cells = {(r.a, r.b): r["count"] for r in rows.groupBy("a", "b").count().collect()}
    p, q, s, t = (cells[k] for k in ((0, False), (0, True), (1, False), (1, True)))
    assert max(cells.values()) ** 2 * 8_000_000 > 2**63
    assert row.chi_square_statistic == pytest.approx(8_000_000 * (p * t - q * s) ** 2 / ((p + q) * (s + t) * (p + s) * (q + t)), rel=1e-9)
