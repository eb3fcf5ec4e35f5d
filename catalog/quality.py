"""Quality checks on sensor rows and orders with blanks made by a key rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.events import LIGHTS, STORMY, TIES, _alerts, stormy
from catalog.mapping import CITY_ORDERS, SENSORS, city_orders, r, rounded, sensors, sql_time, table, text_time
from weatherloom.operators import quality
from weatherloom.operators.joining import stored
from weatherloom.operators.series import Series, fill_gaps
from weatherloom.plans import jobs
from weatherloom.streaming.alerts import with_traffic_light


def blanked(spark, sf_dir):
    """Sensor rows with holes: rain missing on every seventh, humidity on every eleventh."""
    rows = sensors(spark, sf_dir)
    return rows.withColumns(
        {
            "rain_mm": F.when(F.col("event_id") % 7 != 0, F.col("rain_mm")),
            "humidity_pct": F.when(F.col("event_id") % 11 != 0, F.col("humidity_pct")),
        }
    )


BLANKED = SENSORS + """,
blanked AS (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN rain_mm END AS rain_mm,
  CASE WHEN event_id % 11 <> 0 THEN humidity_pct END AS humidity_pct) FROM sensors)"""

NUMBERS = ["temperature_hourly", "rain_mm", "wind_speed_kmh", "humidity_pct", "pressure_hpa"]
CHECKED = ["city", *NUMBERS]


def missing_values(spark, sf_dir):
    return quality.missing_values(blanked(spark, sf_dir), CHECKED)


def range_checks(spark, sf_dir):
    out = quality.range_checks(blanked(spark, sf_dir))
    return rounded(out, "min_value", "max_value", "mean_value", "std_value")


def _domains(spark, sf_dir):
    """Traffic-light columns of the sensor rows against both vocabularies' column names."""
    rows = with_traffic_light(sensors(spark, sf_dir).withColumnRenamed("temperature_hourly", "temperature_c"))
    return rows.withColumn("event_type", F.col("state"))


def domain_values(spark, sf_dir):
    return quality.domain_values(_domains(spark, sf_dir))


def domain_summary(spark, sf_dir):
    return quality.domain_summary(quality.domain_values(_domains(spark, sf_dir)))


def invalid_values(spark, sf_dir):
    """Nations named in the sensor rows that the nation table lacks in its second half."""
    allowed = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") < 12).select(F.col("n_name").alias("value"))
    return quality.invalid_values(sensors(spark, sf_dir), "country", allowed)


def date_check(spark, sf_dir):
    key, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(key % 5 == 0, "n/a").when(key % 7 != 0, F.date_format(d, "yyyy-MM-dd"))
    out = quality.date_check(table(spark, sf_dir, "orders").select(text.alias("dt")), "dt")
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


def numeric_time_check(spark, sf_dir):
    return quality.numeric_time_check(city_orders(spark, sf_dir))


def duplicates(spark, sf_dir):
    """Copies among (city, month, whole degrees)."""
    rows = city_orders(spark, sf_dir).select("city", "year", "month", F.floor("temperature").alias("degrees"))
    return quality.duplicates(rows)


def coverage(spark, sf_dir):
    out = quality.time_coverage(sensors(spark, sf_dir))
    return out.withColumns({c: text_time(c) for c in ("start", "end")})


def records_per_year(spark, sf_dir):
    return quality.records_per_year(table(spark, sf_dir, "orders"), "o_orderdate")


SERIES = Series.by_time(["city"], "timestamp", ["event_id"], "day")


def gaps(spark, sf_dir):
    return quality.gaps(sensors(spark, sf_dir), SERIES, "timestamp").select("event_id", "gap_seconds")


def gap_summary(spark, sf_dir):
    out = quality.series_gap_summary(sensors(spark, sf_dir), SERIES, "timestamp", step_seconds=86400.0)
    return rounded(rounded(out, "min_gap", "max_gap"), "median_gap", digits=8)


def filled_gaps(spark, sf_dir):
    """Missing rain and humidity filled from the next reading of the city, else the last."""
    out = fill_gaps(blanked(spark, sf_dir), SERIES, ["rain_mm", "humidity_pct"])
    return out.select("event_id", "rain_mm", "humidity_pct")


def absent_members(spark, sf_dir):
    """Customers that never ordered."""
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("city"))
    return quality.absent_members(city_orders(spark, sf_dir), expected, ["city"])


def track_continuity(spark, sf_dir):
    """Each city's wandering between readings, as if the city were a storm."""
    lat = F.col("event_id") * 37 % 60 / 4.0
    points = sensors(spark, sf_dir).select(
        F.col("city").alias("storm_id"), "timestamp", "event_id", lat.alias("latitude"),
        (F.col("event_id") * 11 % 40 / 4.0).alias("longitude"),
    )
    return quality.track_continuity(points, Series.by_time(["storm_id"], "timestamp", ["event_id"], "day"))


def physical_rules(spark, sf_dir):
    rows = blanked(spark, sf_dir).withColumn(
        "feels_like_c", F.col("temperature_hourly") + F.col("event_id") % 8
    )
    return rounded(quality.physical_rules(rows), "measured")


def storm_report(spark, sf_dir):
    return quality.storm_report(stormy(spark, sf_dir))


def category_distribution(spark, sf_dir):
    return quality.category_distribution(stormy(spark, sf_dir).filter("storm_id is not null"), "storm_category")


def alert_report(spark, sf_dir):
    return quality.alert_report(_domains(spark, sf_dir))


def table_report(spark, sf_dir):
    """Single-table report as long rows."""
    rows = blanked(spark, sf_dir).select(
        "city", *NUMBERS, F.col("state").alias("event_type"), F.date_format("timestamp", "yyyy-MM-dd").alias("dt"),
        F.year("timestamp").alias("year"), F.month("timestamp").alias("month"),
    )
    return quality.table_report(rows, "dt")


def _events(spark, sf_dir):
    """Events with storms, traffic lights and the columns of the contract."""
    lights = with_traffic_light(stormy(spark, sf_dir).withColumnRenamed("temperature_hourly", "temperature_c"))
    return lights.withColumnRenamed("temperature_c", "temperature_hourly").select(
        *EVENT_COLUMNS[:-6], F.year("timestamp").alias("year"), F.month("timestamp").alias("month"), F.dayofmonth("timestamp").alias("day"),
        F.hour("timestamp").alias("hour"), F.col("lat_decimal").alias("latitude"), F.col("lon_decimal").alias("longitude"),
    )


EVENT_COLUMNS = [
    "event_id", "timestamp", "state", "city", "country", "lat_decimal", "lon_decimal", *NUMBERS, "event_type", "event_intensity",
    "storm_id", "storm_category", "alert_level", "alert_type", "year", "month", "day", "hour", "latitude", "longitude",
]


def full_report(spark, sf_dir):
    """Every check of an event table with the overall flag; the table is written once, as the report reads it four times."""
    return quality.full_report(stored(_events(spark, sf_dir), "events"), SERIES, ranges={n: quality.RANGES[n] for n in NUMBERS})


def schema_contract(spark, sf_dir):
    """The expected columns of an event table: required or not, present or not."""
    return quality.schema_contract(_events(spark, sf_dir))


def event_distributions(spark, sf_dir):
    """Storm categories, alert levels and types, and the shape of the event table."""
    events = jobs.event_table(sensors(spark, sf_dir), ["city"], **TIES).select("storm_category", "alert_level", "alert_type")
    return quality.distributions(events, ["storm_category", "alert_level", "alert_type"]).select("check", "column_name", "metric", "value")


QUERIES = {
    f.__name__: f
    for f in (
        event_distributions,
        missing_values, range_checks, domain_values, domain_summary, invalid_values, date_check, numeric_time_check,
        duplicates, coverage, records_per_year, gaps, gap_summary, filled_gaps, absent_members, track_continuity, physical_rules,
        storm_report, category_distribution, alert_report, table_report, full_report, schema_contract,
    )
}


def _missing() -> str:
    total = " + ".join(f"(count(*) - count({c}))" for c in CHECKED)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in CHECKED)
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing,
        {r(f'(count(*) - count({c})) * 100.0::DOUBLE / count(*)', 2)} AS missing_percent, {total} AS total_missing,
        count(*) FILTER ({complete}) AS complete_rows FROM blanked"""
        for c in CHECKED
    )


def _ranges() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {r(f'min({c})')} AS min_value, {r(f'max({c})')} AS max_value,
        {r(f'avg({c})')} AS mean_value, {r(f'stddev({c})')} AS std_value,
        count(*) FILTER ({c} < {low} OR {c} > {high}) AS out_of_range FROM blanked"""
        for c, (low, high) in ((c, quality.RANGES[c]) for c in NUMBERS)
    )


def _values() -> str:
    def allowed(c):
        return ", ".join(f"'{v}'" for v in quality.DOMAINS[c])

    columns = {"event_type": "state", "alert_level": "alert_level", "alert_type": "alert_type"}
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {x} AS value, count(*) AS rows, {x} IN ({allowed(c)}) AS is_valid
        FROM lights GROUP BY {x}"""
        for c, x in columns.items()
    )


_RULES = [
    ("humidity_range", "fail", "humidity_pct < 0 OR humidity_pct > 100"),
    ("rain_not_negative", "fail", "rain_mm < 0"),
    ("wind_not_negative", "fail", "wind_speed_kmh < 0"),
    ("pressure_range", "warn", "pressure_hpa < 870 OR pressure_hpa > 1084"),
]


def _physical() -> str:
    parts = [
        f"""SELECT '{n}' AS rule, {r(f'(count(*) FILTER ({cond}))::DOUBLE')} AS measured,
        CASE WHEN count(*) FILTER ({cond}) > 0 THEN '{bad}' ELSE 'pass' END AS status FROM blanked"""
        for n, bad, cond in _RULES
    ]
    corr = "corr(temperature_hourly, temperature_hourly + event_id % 8)"
    parts.append(
        f"""SELECT 'felt_temperature_correlation', {r(corr)}, CASE WHEN {corr} > 0.8 THEN 'pass' ELSE 'warn' END FROM blanked"""
    )
    return " UNION ALL ".join(parts)


_GAPS = SENSORS + """,
gaps AS (SELECT event_id, city, date_diff('microsecond', lag(timestamp) OVER (PARTITION BY city ORDER BY timestamp, event_id),
  timestamp) / 1e6::DOUBLE AS gap_seconds FROM sensors)"""

SQL = {
    "event_distributions": f"""WITH {STORMY}, {_alerts('stormy', 'storm_category')},
      v AS (SELECT 'storm_category' AS k, storm_category::VARCHAR AS x FROM alerts UNION ALL SELECT 'alert_level', alert_level::VARCHAR FROM alerts
        UNION ALL SELECT 'alert_type', alert_type::VARCHAR FROM alerts)
      SELECT k AS "check", coalesce(x, 'null') AS column_name, 'rows' AS metric, count(*)::VARCHAR AS value FROM v GROUP BY k, x
      UNION ALL SELECT 'shape', '*', 'rows', count(*)::VARCHAR FROM alerts UNION ALL SELECT 'shape', '*', 'columns', '3'""",
    "missing_values": f"WITH {BLANKED} {_missing()}",
    "range_checks": f"WITH {BLANKED} {_ranges()}",
    "domain_values": f"WITH {LIGHTS} {_values()}",
    "domain_summary": f"""WITH {LIGHTS}, v AS ({_values()}) SELECT column_name, count(*) AS n_actual,
      count(*) FILTER (NOT is_valid) AS n_invalid,
      CAST(coalesce(sum(rows) FILTER (NOT is_valid), 0) AS BIGINT) AS invalid_rows FROM v GROUP BY column_name""",
    "invalid_values": f"""WITH {SENSORS} SELECT DISTINCT country AS value FROM sensors
      WHERE country NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 12)""",
    "date_check": f"""WITH {CITY_ORDERS}, t AS (SELECT CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN date END AS d
        FROM city_orders)
      SELECT CAST(min(d) AS VARCHAR) AS first_date, CAST(max(d) AS VARCHAR) AS last_date, count(*) - count(d) AS invalid_dates,
        count(DISTINCT d) AS unique_dates FROM t""",
    "numeric_time_check": f"WITH {CITY_ORDERS} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, min({c}) AS min_value, max({c}) AS max_value,
        count(DISTINCT {c}) AS unique_values FROM city_orders"""
        for c in ("year", "month")
    ),
    "duplicates": f"""WITH {CITY_ORDERS}, g AS (SELECT count(*) AS n FROM city_orders
        GROUP BY city, year, month, floor(temperature))
      SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows,
        {r('(sum(n) - count(*)) * 100.0::DOUBLE / sum(n)', 2)} AS duplicate_percent, count(*) AS unique_rows FROM g""",
    "coverage": f"""WITH {SENSORS} SELECT {sql_time('min(timestamp)')} AS start, {sql_time('max(timestamp)')} AS end,
      CAST(floor((epoch(date_trunc('second', max(timestamp))) - epoch(date_trunc('second', min(timestamp)))) / 86400) AS BIGINT) AS span_days,
      count(DISTINCT year(timestamp)) AS years FROM sensors""",
    "records_per_year": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS records FROM orders GROUP BY 1",
    "gaps": f"WITH {_GAPS} SELECT event_id, gap_seconds FROM gaps",
    "gap_summary": f"""WITH {_GAPS} SELECT city, {r('min(gap_seconds)')} AS min_gap, {r('max(gap_seconds)')} AS max_gap,
      count(*) FILTER (gap_seconds > 86400) AS gaps_over_step, {r('quantile_cont(gap_seconds, 0.5)', 8)} AS median_gap,
      quantile_cont(gap_seconds, 0.5) <= 5400 AS is_hourly FROM gaps WHERE gap_seconds IS NOT NULL GROUP BY city""",
    "filled_gaps": f"""WITH {BLANKED} SELECT event_id, {', '.join(
        f"coalesce(first({c} IGNORE NULLS) OVER f, last({c} IGNORE NULLS) OVER b) AS {c}" for c in ("rain_mm", "humidity_pct")
      )} FROM blanked WINDOW b AS (PARTITION BY city ORDER BY timestamp, event_id),
        f AS (PARTITION BY city ORDER BY timestamp, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "absent_members": """SELECT CAST(c_custkey AS VARCHAR) AS city FROM customer
      WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "track_continuity": f"""WITH {SENSORS}, p AS (
        SELECT city AS storm_id, timestamp, event_id, (event_id * 37 % 60) / 4.0::DOUBLE AS la, (event_id * 11 % 40) / 4.0::DOUBLE AS lo
        FROM sensors),
      s AS (SELECT storm_id, greatest(abs(la - lag(la) OVER o), abs(lo - lag(lo) OVER o)) AS step FROM p
        WINDOW o AS (PARTITION BY storm_id ORDER BY timestamp, event_id))
      SELECT storm_id, count(*) AS points, max(step) AS max_step, coalesce(max(step) <= 10, true) AS is_continuous
      FROM s GROUP BY storm_id""",
    "physical_rules": f"WITH {BLANKED} {_physical()}",
    "storm_report": f"""WITH {STORMY} SELECT count(*) > 0 AS has_storms, count(DISTINCT storm_id) AS n_storms,
      count(*) AS n_storm_records FROM stormy WHERE storm_id IS NOT NULL""",
    "category_distribution": f"""WITH {STORMY} SELECT storm_category, count(*) AS rows FROM stormy
      WHERE storm_id IS NOT NULL GROUP BY storm_category""",
    "alert_report": f"""WITH {LIGHTS}, n AS (SELECT count(*) AS n, count(*) FILTER (alert_level = 'green') AS green,
        count(*) FILTER (alert_level = 'yellow') AS yellow, count(*) FILTER (alert_level = 'orange') AS orange,
        count(*) FILTER (alert_level = 'red') AS red FROM lights)
      SELECT n > green AS has_alerts, n - green AS n_alerts, green, yellow, orange, red,
        NOT ((green > 0 AND yellow > green) OR (yellow > 0 AND red > yellow)) AS hierarchy_valid FROM n""",
    "table_report": f"""WITH {BLANKED}, {'{t}'} SELECT * FROM report""",
}


def _report() -> str:
    """The long report rebuilt from plain counts."""
    parts = []
    source = f"""t AS (SELECT city, {', '.join(NUMBERS)}, state AS event_type, strftime(timestamp, '%Y-%m-%d') AS dt,
      CAST(year(timestamp) AS INTEGER) AS year, CAST(month(timestamp) AS INTEGER) AS month FROM blanked)"""
    columns = ["city", *NUMBERS, "event_type", "dt", "year", "month"]

    def row(check, name, metric, value):
        parts.append(
            f"SELECT '{check}' AS check, '{name}' AS column_name, '{metric}' AS metric, CAST({value} AS VARCHAR) AS value FROM t"
        )

    for c in columns:
        row("missing", c, "missing", f"count(*) - count({c})")
        row("missing", c, "missing_percent", f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2)")
    whole = f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM t))"
    row("duplicates", "*", "duplicate_rows", f"count(*) - {whole}")
    row("duplicates", "*", "unique_rows", whole + " + 0 * count(*)")
    for c in NUMBERS:
        low, high = quality.RANGES[c]
        row("ranges", c, "min_value", f"min({c})")
        row("ranges", c, "max_value", f"max({c})")
        row("ranges", c, "out_of_range", f"count(*) FILTER ({c} < {low} OR {c} > {high})")
    allowed = ", ".join(f"'{v}'" for v in quality.DOMAINS["event_type"])
    row("domains", "event_type", "n_actual", "count(DISTINCT event_type)")
    row("domains", "event_type", "n_invalid", f"count(DISTINCT event_type) FILTER (event_type NOT IN ({allowed}))")
    row("dates", "dt", "first_date", "min(dt)")
    row("dates", "dt", "last_date", "max(dt)")
    row("dates", "dt", "invalid_dates", "count(*) - count(dt)")
    row("dates", "dt", "unique_dates", "count(DISTINCT dt)")
    for c in ("year", "month"):
        row("time", c, "min_value", f"min({c})")
        row("time", c, "max_value", f"max({c})")
        row("time", c, "unique_values", f"count(DISTINCT {c})")
    return f"{source}, report AS ({' UNION ALL '.join(parts)})"


SQL["table_report"] = SQL["table_report"].replace("{t}", _report())

# Fixed values, written out: category, expected column, required, present in the event table.
_EXPECTED = [
    ("core", "timestamp", True, True), ("core", "year", True, True), ("core", "month", True, True), ("core", "day", True, True),
    ("core", "hour", True, True), ("location", "city", True, True), ("location", "country", True, True),
    ("location", "latitude", True, True), ("location", "longitude", True, True), ("weather", "temperature_hourly", False, True),
    ("weather", "rain_mm", False, True), ("weather", "wind_speed_kmh", False, True), ("weather", "humidity_pct", False, True),
    ("optional", "pressure_hpa", False, True), ("optional", "uv_index", False, False), ("optional", "cloud_cover_pct", False, False),
    ("optional", "visibility_km", False, False), ("events", "event_type", False, True), ("events", "event_intensity", False, True),
    ("alerts", "alert_level", False, True), ("alerts", "alert_type", False, True), ("storms", "storm_id", False, True),
    ("storms", "storm_category", False, True),
]
_RANGES = {"temperature_hourly": (-80, 60), "rain_mm": (0, 500), "wind_speed_kmh": (0, 400), "humidity_pct": (0, 100), "pressure_hpa": (870, 1084)}
_ALLOWED = {
    "event_type": "'none', 'heatwave', 'cold_snap', 'drought', 'extreme_precipitation', 'hurricane', 'tornado'",
    "alert_level": "'green', 'yellow', 'orange', 'red'",
    "alert_type": "'none', 'heat', 'cold', 'storm', 'flood', 'wind', 'fire', 'air_quality'",
}


def _full() -> str:
    """The report of an event table from plain counts, one row after the other."""
    parts = []
    light = "SELECT event_id, alert_level, alert_type FROM lights"
    columns = ", ".join(c if c not in ("alert_level", "alert_type") else f"l.{c}" for c in EVENT_COLUMNS[:-6])
    source = f"""t AS MATERIALIZED (SELECT {columns.replace("event_id", "s.event_id", 1)}, CAST(year(timestamp) AS INTEGER) AS year,
      CAST(month(timestamp) AS INTEGER) AS month, CAST(day(timestamp) AS INTEGER) AS day, CAST(hour(timestamp) AS INTEGER) AS hour,
      lat_decimal AS latitude, lon_decimal AS longitude FROM stormy s JOIN ({light}) l ON l.event_id = s.event_id),
    g AS (SELECT date_diff('microsecond', lag(timestamp) OVER (PARTITION BY city ORDER BY timestamp, event_id), timestamp) / 1e6::DOUBLE AS gap FROM t),
    steps AS (SELECT storm_id, greatest(abs(lat_decimal - lag(lat_decimal) OVER o), abs(lon_decimal - lag(lon_decimal) OVER o)) AS step
      FROM (SELECT DISTINCT storm_id, timestamp, lat_decimal, lon_decimal FROM t WHERE storm_id IS NOT NULL)
      WINDOW o AS (PARTITION BY storm_id ORDER BY timestamp, lat_decimal, lon_decimal)),
    tracks AS (SELECT storm_id, coalesce(max(step) <= 10, true) AS good FROM steps GROUP BY storm_id)"""

    def row(check, name, metric, value, table="t"):
        parts.append(f"SELECT '{check}' AS check, '{name}' AS column_name, '{metric}' AS metric, CAST({value} AS VARCHAR) AS value FROM {table}")

    for c in EVENT_COLUMNS:
        row("missing", c, "missing", f"count(*) - count({c})")
        row("missing", c, "missing_percent", f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2)")
    row("duplicates", "*", "duplicate_rows", "(SELECT count(*) FROM t) - count(*)", "(SELECT DISTINCT * FROM t)")
    row("duplicates", "*", "unique_rows", "count(*)", "(SELECT DISTINCT * FROM t)")
    for c, (low, high) in _RANGES.items():
        row("ranges", c, "min_value", f"min({c})")
        row("ranges", c, "max_value", f"max({c})")
        row("ranges", c, "out_of_range", f"count(*) FILTER ({c} < {low} OR {c} > {high})")
    for c, allowed in _ALLOWED.items():
        row("domains", c, "n_actual", f"count(DISTINCT {c})")
        row("domains", c, "n_invalid", f"count(DISTINCT {c}) FILTER ({c} NOT IN ({allowed}))")
    for c in ("year", "month"):
        row("time", c, "min_value", f"min({c})")
        row("time", c, "max_value", f"max({c})")
        row("time", c, "unique_values", f"count(DISTINCT {c})")
    for _, c, required, present in _EXPECTED:
        row("schema", c, "required", str(required).lower(), "(SELECT 1)")
        row("schema", c, "present", str(present).lower(), "(SELECT 1)")
    row("coverage", "*", "start", "min(timestamp)")
    row("coverage", "*", "end", "max(timestamp)")
    row("coverage", "*", "span_days", "CAST(floor((epoch(date_trunc('second', max(timestamp))) - epoch(date_trunc('second', min(timestamp)))) / 86400) AS BIGINT)")
    row("coverage", "*", "years", "count(DISTINCT year)")
    rules = [*_RULES, ("intensity_range", "fail", "event_intensity < 0 OR event_intensity > 10")]
    for n, bad, cond in rules:
        row("physical", n, "measured", f"(count(*) FILTER ({cond}))::DOUBLE")
        row("physical", n, "status", f"CASE WHEN count(*) FILTER ({cond}) > 0 THEN '{bad}' ELSE 'pass' END")
    row("resolution", "*", "median_gap", "quantile_cont(gap, 0.5)", "g")
    row("resolution", "*", "min_gap", "min(gap)", "g")
    row("resolution", "*", "max_gap", "max(gap)", "g")
    row("resolution", "*", "is_hourly", "quantile_cont(gap, 0.5) <= 5400", "g")
    row("storms", "*", "n_storms", "count(DISTINCT storm_id)")
    row("storms", "*", "n_storm_records", "count(storm_id)")
    row("tracks", "*", "n_tracks", "count(*)", "tracks")
    row("tracks", "*", "n_continuous", "count(*) FILTER (good)", "tracks")
    row("alerts", "*", "n_alerts", "count(*) FILTER (alert_level <> 'green')")
    n = {c: f"count(*) FILTER (alert_level = '{c}')" for c in ("green", "yellow", "red")}
    row("alerts", "*", "hierarchy_valid", f"NOT (({n['green']} > 0 AND {n['yellow']} > {n['green']}) OR ({n['yellow']} > 0 AND {n['red']} > {n['yellow']}))")
    for c in ("storm_category", "alert_level", "alert_type"):
        parts.append(f"SELECT '{c}', coalesce(CAST({c} AS VARCHAR), 'null'), 'rows', CAST(count(*) AS VARCHAR) FROM t GROUP BY {c}")
    row("shape", "*", "rows", "count(*)")
    row("shape", "*", "columns", str(len(EVENT_COLUMNS)), "(SELECT 1)")
    broken = " + ".join(f"count(*) FILTER ({cond})" for _, bad, cond in rules if bad == "fail")
    row("overall", "*", "overall_valid", f"{broken} = 0")
    return f"{source} {' UNION ALL '.join(parts)}"


_HEAT_ON = LIGHTS.removeprefix(SENSORS)
SQL["full_report"] = f"WITH {STORMY}{_HEAT_ON}, {_full()}"
SQL["schema_contract"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}', {q}, {p})" for k, c, q, p in _EXPECTED) + ") v(category, column_name, required, present)"
