"""Skew-safe operators give what the plain ones give, with a third of all rows in one key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weatherloom.operators import anomalies, extremes, joining
from weatherloom.operators.quantiles import bounded_quantiles, exact_quantiles
from weatherloom.sources.writers import scratch_dir
from weatherloom.operators.series import Series, cell_unit_for, fill_gaps, in_ranges, look_back, positions


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows, a third of them of station 0; ties in time, every fifth value missing."""
    n = F.col("id")
    return spark.range(3000).select(
        n,
        F.when(n % 3 == 0, 0).otherwise(n % 40 + 1).alias("station"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(n / 2) * 1700).alias("ts"),
        F.when(n % 5 != 0, (n * 7919 % 1013) / 8.0).alias("v"),
    ).cache()


def in_order():
    return Window.partitionBy("station").orderBy("ts", "id")


@pytest.mark.parametrize("unit", ["hour", "day", "month", "year"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_look_back_equals_plain_window(spark, skewed, unit, partitions):
    series = Series.by_time(["station"], "ts", ["id"], unit)
    got = look_back(
        skewed.repartition(partitions),
        series,
        lags={"a": ("v", 1), "b": ("v", 12)},
        means={"c": ("v", 24, True), "d": ("v", 3, False)},
    )
    want = got.withColumns(
        {
            "wa": F.lag("v", 1).over(in_order()),
            "wb": F.lag("v", 12).over(in_order()),
            "wc": F.avg("v").over(in_order().rowsBetween(-24, 0)),
            "wd": F.avg("v").over(in_order().rowsBetween(-3, -1)),
        }
    )
    wrong = want.filter(
        ~F.col("a").eqNullSafe(F.col("wa"))
        | ~F.col("b").eqNullSafe(F.col("wb"))
        | ~F.round("c", 9).eqNullSafe(F.round("wc", 9))
        | ~F.round("d", 9).eqNullSafe(F.round("wd", 9))
    )
    assert want.count() == 3000 and wrong.count() == 0


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_fill_equals_plain_window(spark, skewed, unit):
    holes = skewed.withColumn("v", F.when(F.col("id") % 4 == 1, F.col("v")))
    got = fill_gaps(holes, Series.by_time(["station"], "ts", ["id"], unit), ["v"]).select("id", "v")
    after = F.first("v", True).over(in_order().rowsBetween(0, Window.unboundedFollowing))
    before = F.last("v", True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    want = holes.select("id", F.coalesce(after, before).alias("w"))
    assert got.join(want, "id").filter(~F.col("v").eqNullSafe(F.col("w"))).count() == 0


def test_positions_equal_row_numbers(spark, skewed):
    got = positions(skewed, Series.by_time(["station"], "ts", ["id"], "day"))
    size = F.count("*").over(Window.partitionBy("station"))
    want = got.withColumns({"w": F.row_number().over(in_order()) - 1, "n": size})
    assert want.filter("position != w or series_size != n").count() == 0
    everywhere = positions(skewed, Series.by_time([], "ts", ["id"], "day"))
    assert sorted(r.position for r in everywhere.collect()) == list(range(3000))


def test_no_task_gets_a_whole_station(spark, skewed):
    """The shuffle key of the big exchange holds the cell, not only the station."""
    out = look_back(skewed, Series.by_time(["station"], "ts", ["id"], "day"), lags={"a": ("v", 1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(station" in plan and "_cell" in plan
    assert "WindowGroupLimit" in plan


def test_cell_unit_follows_the_fullest_cell(spark, skewed):
    assert cell_unit_for(skewed, ["station"], "ts", 10_000) == "year"
    assert cell_unit_for(skewed, ["station"], "ts", 800) == "month"
    assert cell_unit_for(skewed, ["station"], "ts", 100) == "day"
    assert cell_unit_for(skewed, ["station"], "ts", 3) == "hour"
    assert cell_unit_for(skewed.filter("id < 0"), ["station"], "ts") == "year"


@pytest.mark.parametrize("unit", [None, "hour", "day", "month"])
def test_events_do_not_depend_on_the_cells(spark, skewed, unit):
    rows = skewed.filter("v is not null").selectExpr(
        "*", "v temperature_hourly", "ts timestamp", "0D rain_mm", "0D wind_speed_kmh"
    )
    got = extremes.classify_events(rows, ["station"], ["id"], unit)
    month = Window.partitionBy("station", F.month("ts"))
    want = got.withColumns(
        {
            "z": (F.col("v") - F.avg("v").over(month)) / F.stddev("v").over(month),
            "roll": F.avg("v").over(in_order().rowsBetween(-24, 0)),
        }
    )
    trend = F.when(F.col("v") > F.col("roll") + 1, "UP").when(F.col("v") < F.col("roll") - 1, "DOWN").otherwise("STABLE")
    assert want.count() == 2400
    assert want.filter((F.abs(F.col("anomaly_score") - F.col("z")) > 1e-9) | (F.col("trend_direction") != trend)).count() == 0


NAMES = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 0.99, "f": 1.0}


@pytest.mark.parametrize("accuracy", [40, 20_000])
@pytest.mark.parametrize("keys", [[], ["station"]])
def test_exact_quantiles_equal_percentile(spark, skewed, keys, accuracy):
    got = exact_quantiles(skewed, "v", NAMES, keys, accuracy=accuracy)
    want = bounded_quantiles(skewed, "v", NAMES, keys)
    a = {tuple(r[k] for k in keys): [r[n] for n in NAMES] for r in got.collect()}
    b = {tuple(r[k] for k in keys): [r[n] for n in NAMES] for r in want.collect()}
    assert a.keys() == b.keys()
    for k in b:
        assert a[k] == (b[k] if None in b[k] else pytest.approx(b[k]))


def test_exact_quantiles_of_copies_and_tiny_groups(spark):
    rows = [(1, 5.0)] * 400 + [(2, 1.0), (2, 2.0)] + [(3, 7.0)] + [(4, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: (r.lo, r.mid) for r in exact_quantiles(df, "v", {"lo": 0.3, "mid": 0.5}, ["k"], accuracy=50).collect()}
    assert got[1] == (5.0, 5.0) and got[2] == pytest.approx((1.3, 1.5)) and got[3] == (7.0, 7.0)
    assert got[4] == (None, None)


def test_exact_quantiles_of_nothing(spark, skewed):
    assert exact_quantiles(skewed.filter("id < 0"), "v", {"m": 0.5}, ["station"]).count() == 0


def nasty(n):
    """Values that equal widths do not separate: outliers, heavy ties, both signs, infinities, a NaN."""
    spread = [(-1) ** i * 1.7 ** (i % 300) for i in range(n)]
    ties = [7.0] * n + [7.0 + i / 1e9 for i in range(n // 4)]
    return {"spread": spread, "ties": ties, "outlier": [float(i) for i in range(n)] + [1e300, -1e300], "ends": [float("inf"), float("-inf"), float("nan")] * 30 + [0.5, -0.0, 0.0], "none": [None] * 3, "one": [4.0]}


@pytest.mark.parametrize("most, cells", [(3, 4), (20, 16), (200, 1024)])
def test_narrowed_quantiles_equal_sorted_values(spark, most, cells):
    groups = nasty(400)
    df = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, v double").repartition(5)
    names = {f"p{i}": p for i, p in enumerate((0.0, 0.01, 0.25, 0.3333, 0.5, 0.9, 0.999, 1.0))}
    # whole ranks: no interpolation between an infinity and a number
    got = {r.k: r for r in exact_quantiles(df, "v", names, ["k"], accuracy=100, most=most, cells=cells).collect()}
    want = {r.k: r for r in bounded_quantiles(df.filter("k != 'ends'"), "v", names, ["k"]).collect()}
    for k in want:
        for n in names:
            assert got[k][n] == (want[k][n] if want[k][n] is None else pytest.approx(want[k][n])), (k, n)
    assert got["ends"].p0 == float("-inf") and got["ends"].p7 != got["ends"].p7
    alone = exact_quantiles(df.filter("k = 'spread'"), "v", names, most=most, cells=cells).first()
    assert [alone[n] for n in names] == pytest.approx([want["spread"][n] for n in names])


def test_quantile_tables_stay_small(spark, monkeypatch):
    """At most ``cells`` counted rows or ``most`` values of a bracket meet, and three passes do for spread-out values."""
    from weatherloom.operators import quantiles

    seen, passes = {}, []
    monkeypatch.setattr(quantiles, "stored", lambda df, name: seen.setdefault((name, len(seen)), joining.stored(df, name)))
    placed = quantiles._placed
    monkeypatch.setattr(quantiles, "_placed", lambda *a: passes.append(1) or placed(*a))
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003 / 16).alias("v"))
    got = exact_quantiles(df, "v", {"q": 0.37, "m": 0.5}, most=500, cells=64).first()
    want = df.agg(F.percentile("v", 0.37).alias("q"), F.percentile("v", 0.5).alias("m")).first()
    assert got == want and len(passes) == 2  # and the pass that counts the groups
    cells = [t for (name, _), t in seen.items() if name == "quantile-cells"]
    assert len(cells) == 1 and cells[0].groupBy("_b", "_part").count().agg(F.max("count")).first()[0] <= 64


def test_hot_keys_are_counted_and_only_they_are_cut(spark, skewed):
    hot = {r.station: r._parts for r in joining.hot_keys(skewed, ["station"], 12).collect()}
    assert hot == {0: 4}  # a third of the rows, in parts of a twelfth
    stats = skewed.groupBy("station").agg(F.sum("v").alias("s"))
    joined = joining.join_statistics(skewed, stats, ["station"], ["id"], spread=12, max_rows=1)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in plan and joined.count() == 3000


def test_parts_of_a_hot_key_are_as_large_as_others(spark):
    """A third of the rows in one key: the largest of 8 shuffle partitions is within twice the median."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1).alias("k"))
    hot = joining.hot_keys(rows, ["k"], 64)
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("_parts")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), "k", "left").withColumn("_part", part)
    sizes = sorted(r["count"] for r in dealt.groupBy(F.pmod(F.hash("k", "_part"), F.lit(8))).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]


def test_rows_without_key_meet_nothing_and_are_spread(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(20)], "id int, k int")
    stats = spark.createDataFrame([(1, 5), (None, 9)], "k int, s int")
    got = joining.join_statistics(rows, stats, ["k"], ["id"], spread=4, max_rows=1)
    assert sorted((r.id, r.s) for r in got.collect()) == [(i, None if i % 2 else 5) for i in range(20)]


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(100).select(F.expr("repeat('x', 1000)").alias("text"), F.array(F.lit("y")).alias("list"))
    assert joining.broadcast_if_small(wide, 1000, max_bytes=50_000) is None
    assert joining.broadcast_if_small(wide, 1000, max_bytes=500_000) is not None


@pytest.mark.parametrize("max_rows", [5, 1000])
def test_statistics_join_equals_plain_join(spark, skewed, max_rows):
    stats = skewed.groupBy("station").agg(F.sum("v").alias("s")).filter("station != 5")
    got = joining.join_statistics(skewed, stats, ["station"], ["id"], spread=8, max_rows=max_rows)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert ("_part" in plan) == (max_rows == 5)
    want = skewed.join(stats, "station", "left")
    assert got.count() == 3000
    assert got.select("id", "s").exceptAll(want.select("id", "s")).count() == 0


def test_broadcast_is_only_hinted_below_the_limit(spark):
    hinted = joining.broadcast_if_small(spark.range(10), 20)
    assert "broadcast" in hinted._jdf.queryExecution().logical().toString().lower()
    assert joining.broadcast_if_small(spark.range(50), 20) is None


def test_scratch_folder_follows_the_session(spark):
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first.startswith(spark.sparkContext.getCheckpointDir()) and first != second


def test_a_cluster_without_shared_folder_is_an_error():
    """The settings are fixed at start-up, so a session without them is stood in for."""

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError):
        scratch_dir(Session, "x")


def test_group_scores_equal_window_scores(spark, skewed):
    got = anomalies.value_zscores(skewed, "v", ["station"], ["id"])
    w = Window.partitionBy("station")
    want = got.withColumn("z", (F.col("v") - F.avg("v").over(w)) / F.stddev("v").over(w))
    assert want.filter(F.abs(F.col("anomaly_score") - F.col("z")) > 1e-9).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_results_do_not_depend_on_partitioning(spark, skewed, partitions):
    rows = skewed.repartition(partitions)
    quantile = exact_quantiles(rows, "v", {"m": 0.9}).head().m
    lag = look_back(rows, Series.by_time(["station"], "ts", ["id"], "day"), lags={"a": ("v", 1)})
    total = lag.agg(F.sum(F.col("a") * (F.col("id") % 17))).head()[0]
    assert (quantile, total) == (
        exact_quantiles(skewed, "v", {"m": 0.9}).head().m,
        skewed.select("id", F.lag("v", 1).over(in_order()).alias("a")).agg(F.sum(F.col("a") * (F.col("id") % 17))).head()[0],
    )


@pytest.mark.parametrize("per_range", [100, 1000, 10_000])
def test_ranges_follow_the_order_and_the_counted_rows(spark, per_range):
    """Half of all rows in one month: its ranges are as large as those of thin months."""
    n = F.col("id")
    rows = spark.range(4000).select(n, F.lit(2000).alias("year"), F.when(n % 2 == 0, 6).otherwise(n % 12 + 1).cast("int").alias("month"), (n * 7919 % 4001).alias("station"))
    dealt, order = in_ranges(rows.repartition(5), ["year", "month", "station"], per_range)
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2.5 * per_range
    placed = positions(dealt, order).drop("_range")
    plain = Window.partitionBy(F.lit(0)).orderBy("year", "month", "station")
    wrong = placed.withColumn("w", F.row_number().over(plain) - 1).filter("position != w or series_size != 4000")
    assert wrong.count() == 0
    by_columns = positions(rows, ["year", "month", "station"])
    assert sorted(by_columns.columns) == sorted([*rows.columns, "position", "series_size"])
    assert by_columns.exceptAll(placed).count() == 0


def test_positions_of_nothing(spark):
    rows = spark.createDataFrame([], "year int, month int")
    assert positions(rows, ["year", "month"]).count() == 0


def test_weighted_quantiles_equal_those_of_repeated_rows(spark, skewed):
    counted = skewed.groupBy("station", "v").agg(F.count("*").alias("times"))
    for most in (4, 10_000):
        got = exact_quantiles(counted, "v", NAMES, ["station"], most=most, weight="times")
        want = bounded_quantiles(skewed, "v", NAMES, ["station"])
        pairs = got.join(want.select("station", *[F.col(c).alias(f"w_{c}") for c in NAMES]), "station")
        assert pairs.count() == want.count()
        assert all((r[c] is None and r[f"w_{c}"] is None) or r[c] == pytest.approx(r[f"w_{c}"]) for r in pairs.collect() for c in NAMES)
