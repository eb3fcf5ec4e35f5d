"""Boundary values of every rule and text parser."""

import math

import pytest
from pyspark.sql import functions as F

from weatherloom.functions import climate, dates, geo, probability, rules


def values(spark, schema, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.select(column.alias("x"), "i").orderBy("i").select("x").collect()]


def test_mixed_dates(spark):
    texts = [("1743-12-01",), ("3/1/1969",), ("01/03/1969",), (None,), ("invalid",), ("25/12/1990",)]
    got = values(spark, "t string", texts, dates.parse_mixed_date(F.col("t")).cast("string"))
    assert got == ["1743-12-01", "1969-03-01", "1969-01-03", None, None, "1990-12-25"]
    day_first = values(spark, "t string", texts, dates.parse_mixed_date(F.col("t"), True).cast("string"))
    assert day_first == ["1743-12-01", "1969-01-03", "1969-03-01", None, None, "1990-12-25"]


def test_date_parts(spark):
    df = spark.createDataFrame([("2024-01-07",), ("bad",)], "dt string")
    kept = dates.with_date_parts(df, drop_invalid=True).collect()
    assert [(r.year, r.month, r.day, r.day_of_week) for r in kept] == [(2024, 1, 7, 1)]
    assert dates.with_date_parts(df).count() == 2
    assert dates.with_date_parts(df, "absent") is df


def test_coordinates(spark):
    texts = [("57.05N",), ("33.87S",), ("10.33E",), ("0.13W",), ("12.5",), ("junk",), (None,)]
    got = values(spark, "t string", texts, geo.parse_coordinate(F.col("t")))
    assert got == [57.05, -33.87, 10.33, -0.13, 12.5, None, None]


def test_zones(spark):
    lats = [(0.0,), (23.5,), (-23.6,), (35.0,), (35.1,), (55.0,), (-55.1,), (66.5,), (66.6,), (None,)]
    got = values(spark, "lat double", lats, geo.climate_zone(F.col("lat")))
    assert got == [
        "TROPICAL", "TROPICAL", "SUBTROPICAL", "SUBTROPICAL", "TEMPERATE", "TEMPERATE", "CONTINENTAL",
        "CONTINENTAL", "POLAR", "UNKNOWN",
    ]


def test_first_box_wins_and_open_sea_is_null(spark):
    points = [(36.5, 30.0), (36.5, 5.0), (37.0, 45.0), (30.0, 30.0), (-12.0, 130.0), (-70.0, 0.0), (0.0, -150.0)]
    continent = geo.continent_of(F.col("lat"), F.col("lon"))
    assert values(spark, "lat double, lon double", points, continent) == [
        "Europe", "Europe", "Asia", "Asia", "Oceania", "Antarctica", None,
    ]
    region = geo.region_of(F.col("lat"), F.col("lon"), continent)
    assert values(spark, "lat double, lon double", points, region) == [
        "Southern Europe", "Southern Europe", "Central Asia", "South Asia", "Northern Oceania", "Antarctica", None,
    ]
    assert len({b[0] for b in geo.REGION_BOXES}) == 19


def test_every_point_of_a_continent_has_a_region(spark):
    grid = spark.range(-90, 91).selectExpr("cast(id as double) lat").crossJoin(
        spark.range(-180, 181).selectExpr("cast(id as double) lon")
    )
    placed = grid.withColumn("c", geo.continent_of(F.col("lat"), F.col("lon")))
    placed = placed.withColumn("r", geo.region_of(F.col("lat"), F.col("lon"), F.col("c")))
    assert placed.filter("c is not null and r is null").select("lat", "lon", "c").collect() == []


def test_seasons(spark):
    months = [(m, lat) for m in (12, 3, 6, 9, None) for lat in (10.0, -10.0, None)]
    got = values(spark, "m int, lat double", months, climate.season_hemisphere(F.col("m"), F.col("lat")))
    assert got == [
        "WINTER", "SUMMER", "WINTER", "SPRING", "AUTUMN", "SPRING", "SUMMER", "WINTER", "SUMMER",
        "AUTUMN", "SPRING", "AUTUMN", "UNKNOWN", "UNKNOWN", "UNKNOWN",
    ]
    north = values(spark, "m int", [(m,) for m in range(1, 13)], climate.season_north(F.col("m")))
    assert north == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter"]


def test_amplitude_defaults(spark):
    rows = [("TROPICAL", "SUMMER"), ("POLAR", "WINTER"), ("UNKNOWN", "SPRING"), (None, None)]
    got = values(spark, "z string, s string", rows, climate.diurnal_amplitude(F.col("z"), F.col("s")))
    assert got == pytest.approx([12.0, 6.4, 12.0, 12.0])


def test_diurnal_curve_crosses_at_phase_and_peaks_six_hours_later(spark):
    hours = [(h,) for h in range(24)]
    curve = climate.diurnal_temperature(F.lit(10.0), F.lit(4.0), F.col("h"))
    got = values(spark, "h int", hours, curve)
    assert got[14] == pytest.approx(10.0)
    assert max(range(24), key=got.__getitem__) == 20 and got[20] == pytest.approx(14.0)
    assert sum(got) / 24 == pytest.approx(10.0)


def test_clamp_keeps_null(spark):
    got = values(spark, "x double", [(-1.0,), (5.0,), (11.0,), (None,)], climate.clamp(F.col("x"), 0, 10))
    assert got == [0.0, 5.0, 10.0, None]


def test_zscore_rules(spark):
    rows = [(3.0, 1.0, 2.0), (3.0, 1.0, None), (3.0, 1.0, 0.0)]
    got = values(spark, "x double, m double, s double", rows, climate.zscore(F.col("x"), F.col("m"), F.col("s")))
    assert got == [1.0, 2.0, None]
    classes = values(spark, "z double", [(0.99,), (-1.0,), (1.99,), (-2.0,), (None,)], climate.anomaly_class(F.col("z")))
    assert classes == ["normal", "moderate", "moderate", "extreme", None]


def test_sizes(spark):
    texts = [("1.5GiB",), ("300kB",), ("12MiB",), ("1048576B",), ("7",), ("x",)]
    got = values(spark, "t string", texts, climate.size_to_mb(F.col("t")))
    assert got == [1536.0, 300 / 1024, 12.0, 1.0, 7.0, None]


def test_event_types_in_rule_order(spark):
    rows = [
        (2.5, 99.0, 99.0), (-2.5, 99.0, 99.0), (2.49, 31.0, 51.0), (0.0, 30.0, 51.0), (0.0, 51.0, 50.0),
        (0.0, 50.0, 50.0), (None, 31.0, 51.0),
    ]
    kind = rules.event_type(F.col("z"), F.col("r"), F.col("w"))
    got = values(spark, "z double, r double, w double", rows, kind)
    assert got == ["HEATWAVE", "COLDSNAP", "STORM", "NORMAL", "FLOOD", "NORMAL", "STORM"]
    strength = rules.event_intensity(kind, F.col("z"), F.col("r"), F.col("w"))
    got = values(spark, "z double, r double, w double", rows, strength)
    assert got == pytest.approx([0.0, 0.0, 51 / 150, 0.0, 0.51, 0.0, 51 / 150])
    capped = values(spark, "z double, r double, w double", [(9.0, 0.0, 0.0), (-9.0, 0.0, 0.0)], strength)
    assert capped == [1.0, 1.0]


def test_quiet_band(spark):
    got = values(spark, "z double", [(1.49,), (1.5,), (2.5,), (-2.5,), (-2.0,)], rules.event_type_quiet(F.col("z")))
    assert got == ["NORMAL", None, "HEATWAVE", "COLDSNAP", None]


def test_trend_direction(spark):
    got = values(spark, "v double, m double", [(2.0, 1.0), (2.1, 1.0), (-0.1, 1.0)], rules.trend_direction(F.col("v"), F.col("m")))
    assert got == ["STABLE", "UP", "DOWN"]


def test_storm_categories_and_stages(spark):
    winds = [(62.9,), (63.0,), (118.0,), (154.0,), (178.0,), (209.0,)]
    category = rules.storm_category(F.col("w"))
    assert values(spark, "w double", winds, category) == [0, 1, 2, 3, 4, 5]
    assert values(spark, "w double", winds, rules.lifecycle_stage(category)) == [
        "FORMING", "FORMING", "MATURE", "MATURE", "INTENSE", "INTENSE",
    ]


def test_alert_levels(spark):
    rows = [
        ("NORMAL", 0.0, 0, 60.0, 30.0), ("NORMAL", 0.0, 0, 60.1, 0.0), ("NORMAL", 0.0, 0, 90.1, 0.0),
        ("NORMAL", 0.0, 0, 120.1, 0.0), ("HEATWAVE", 0.41, 0, 0.0, 0.0), ("COLDSNAP", 0.71, 0, 0.0, 0.0),
        ("STORM", 0.1, 2, 0.0, 0.0), ("STORM", 0.1, 4, 0.0, 0.0), ("FLOOD", 0.1, 0, 0.0, 31.0), ("NORMAL", 0.0, 0, 0.0, 31.0),
    ]
    k, i, c, w, r = (F.col(n) for n in "kicwr")
    active = rules.alert_active(k, w, r)
    schema = "k string, i_ double, c int, w double, r double"
    level = rules.alert_level(active, F.col("i_"), c, w)
    assert values(spark, schema, rows, level) == [
        "NONE", "WATCH", "WARNING", "EMERGENCY", "WARNING", "EMERGENCY", "WARNING", "EMERGENCY", "WATCH", "WATCH",
    ]
    assert values(spark, schema, rows, rules.alert_type(active, k, c, w)) == [
        "NONE", "WIND", "WIND", "WIND", "HEAT", "COLD", "STORM", "STORM", "FLOOD", "WEATHER",
    ]


@pytest.mark.parametrize(
    "state, wanted",
    [
        ((20.0, 0.0, 0.0), ("green", "none", "")),
        ((35.0, 0.0, 0.0), ("yellow", "heat", "Heat advisory: 35.0°C")),
        ((40.0, 60.0, 0.0), ("orange", "heat", "Heat warning: 40.0°C")),
        ((36.0, 89.0, 0.0), ("yellow", "heat", "Heat advisory: 36.0°C")),
        ((20.0, 60.0, 0.0), ("yellow", "wind", "Wind advisory: 60.0 km/h")),
        ((41.0, 90.0, 0.0), ("orange", "wind", "Wind warning: 90.0 km/h")),
        ((45.0, 90.0, 0.0), ("red", "heat", "Extreme heat warning: 45.0°C")),
        ((45.0, 120.0, 0.0), ("red", "wind", "Extreme wind warning: 120.0 km/h")),
        ((45.0, 0.0, 50.0), ("red", "heat", "Extreme heat warning: 45.0°C")),
        ((41.0, 95.0, 50.0), ("orange", "flood", "Heavy rain warning: 50.0 mm")),
        ((45.0, 120.0, 100.0), ("red", "flood", "Flood warning: 100.0 mm")),
        ((None, 61.0, None), ("yellow", "wind", "Wind advisory: 61.0 km/h")),
        ((None, None, 50.0), ("orange", "flood", "Heavy rain warning: 50.0 mm")),
    ],
)
def test_combined_light(spark, state, wanted):
    light = rules.combined_light(F.col("t"), F.col("w"), F.col("r"))
    (got,) = values(spark, "t double, w double, r double", [state], light)
    assert tuple(got) == wanted


@pytest.mark.parametrize("variable, numbers", [("heat", (30, 37, 42, 50)), ("wind", (40, 70, 100, 150)), ("rain", (10, 30, 70, 120))])
def test_variable_lights(spark, variable, numbers):
    got = values(spark, "x double", [(float(n),) for n in numbers], rules.traffic_light(F.col("x"), variable))
    assert got == ["green", "yellow", "orange", "red"]


def test_intensity_classes(spark):
    got = values(spark, "x double", [(1.9,), (2.0,), (4.0,), (6.0,), (8.0,), (None,)], rules.intensity_class(F.col("x")))
    assert got == ["Minor", "Moderate", "Significant", "Severe", "Extreme", None]


def test_name_index_stays_in_range(spark):
    got = [r[0] for r in spark.range(500).select(rules.hash_index(F.col("id").cast("string"), 21)).collect()]
    assert min(got) >= 0 and max(got) <= 20 and len(set(got)) == 21


def test_chi_square_tail_against_closed_forms(spark):
    rows = [(x, d) for d in (1, 2, 4, 6, 12) for x in (0.5, 3.0, 20.0)]

    def exact(x, d):
        if d == 1:
            return math.erfc(math.sqrt(x / 2))
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))

    got = values(spark, "x double, d int", rows, probability.chi_square_tail(F.col("x"), F.col("d")))
    assert got == pytest.approx([exact(x, d) for x, d in rows], abs=1e-12)
    assert values(spark, "x double, d int", [(1e6, 6), (0.0, 6)], probability.chi_square_tail(F.col("x"), F.col("d"))) == [0.0, 1.0]


def test_student_tail_against_tables(spark):
    rows = [(12.706, 1), (4.303, 2), (3.182, 3), (2.228, 10), (1.984, 100), (1.972, 199)]
    got = values(spark, "t double, d int", rows, probability.student_two_sided(F.col("t"), F.col("d")))
    assert got == pytest.approx([0.05] * 6, abs=1e-4)
    assert values(spark, "t double, d int", [(1.0, 0)], probability.student_two_sided(F.col("t"), F.col("d"))) == [None]


def test_chi_square_tail_keeps_small_and_large_tails(spark):
    import math

    from weatherloom.functions.probability import chi_square_tail

    def exact(x, dof):  # even dof: a finite sum, in logarithms
        terms = [k * math.log(x / 2) - math.lgamma(k + 1) for k in range(dof // 2)]
        top = max(terms)
        return math.exp(top - x / 2 + math.log(sum(math.exp(t - top) for t in terms)))

    cases = [(200.0, 2), (1399.0, 1500), (1400.0, 1500), (1700.0, 1500), (5000.0, 4900), (0.5, 2), (3.0, 4), (40.0, 10), (9000.0, 10000)]
    df = spark.createDataFrame([(x, d) for x, d in cases], "x double, d int")
    for row in df.select("x", "d", chi_square_tail(F.col("x"), F.col("d")).alias("p")).collect():
        assert row.p == pytest.approx(exact(row.x, row.d), rel=1e-8)
    odd = spark.range(1).select(chi_square_tail(F.lit(3.841458820694124), F.lit(1)).alias("p")).first().p
    assert odd == pytest.approx(0.05, rel=1e-9)
