"""Events, storms, alerts and state changes on the sensor rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.mapping import SENSORS, nearest, r, rounded, sensors, sql_time, text_time
from weatherloom.functions import rules
from weatherloom.functions.climate import zscore
from weatherloom.operators import extremes
from weatherloom.operators.series import Series
from weatherloom.plans import jobs
from weatherloom.streaming.alerts import alert_totals, with_traffic_light

TIES = {"ties": ["event_id"]}


def classified(spark, sf_dir):
    return extremes.classify_events(sensors(spark, sf_dir), ["city"], **TIES)


def stormy(spark, sf_dir):
    return extremes.with_storms(classified(spark, sf_dir))


def event_classes(spark, sf_dir):
    out = classified(spark, sf_dir).select(
        "event_id", "city", "anomaly_score", "event_type", "event_intensity", "trend_direction"
    )
    return rounded(out, "anomaly_score", "event_intensity")


def quiet_classes(spark, sf_dir):
    """Temperature-only classes with a quiet band, counted."""
    out = classified(spark, sf_dir).withColumn("quiet_type", rules.event_type_quiet(F.col("anomaly_score")))
    return out.groupBy("quiet_type").agg(F.count("*").alias("rows"))


def storm_rows(spark, sf_dir):
    return stormy(spark, sf_dir).select("event_id", "storm_id", "storm_name", "storm_category")


def storm_tracks(spark, sf_dir):
    out = extremes.storm_tracks(stormy(spark, sf_dir))
    out = out.withColumn("timestamp", text_time("timestamp"))
    moving = ("movement_speed_kmh", "movement_direction_deg", "radius_km")
    return rounded(out, *moving, digits=4)


def storm_footprint(spark, sf_dir):
    out = extremes.storm_footprint(stormy(spark, sf_dir))
    return out.select(
        "storm_id",
        text_time("first_seen").alias("first_seen"),
        text_time("last_seen").alias("last_seen"),
        "peak_wind_kmh",
        "peak_category",
        "points",
        F.array_join("affected_cities", ",").alias("affected_cities"),
        F.array_join("affected_countries", ",").alias("affected_countries"),
    )


def alert_levels(spark, sf_dir):
    out = extremes.with_alerts(stormy(spark, sf_dir))
    return out.select(
        "event_id", "alert_active", "alert_level", "alert_type", text_time("alert_issued_at").alias("alert_issued_at")
    )


def alert_levels_without_storms(spark, sf_dir):
    out = extremes.with_alerts(extremes.without_storms(classified(spark, sf_dir)))
    return out.groupBy("alert_level", "alert_type").agg(F.count("*").alias("rows"))


def run_counts(spark, sf_dir):
    return extremes.run_counts(extremes.with_alerts(stormy(spark, sf_dir)))


def adaptive_alerts(spark, sf_dir):
    out = extremes.adaptive_alerts(
        extremes.with_storms(classified(spark, sf_dir)), ["city"], ["event_id"],
        watch_offset=1.0, emergency_offset=0.5, history=sensors(spark, sf_dir),
    )
    return out.select("event_id", "heat_level", "cold_level", "wind_level", "storm_level")


def _sensor_stream_shape(spark, sf_dir):
    return sensors(spark, sf_dir).withColumnRenamed("temperature_hourly", "temperature_c")


def traffic_light(spark, sf_dir):
    out = with_traffic_light(_sensor_stream_shape(spark, sf_dir))
    text = F.split("alert_message", ":")[0].alias("message_head")
    return out.select("event_id", "alert_level", "alert_type", text)


def variable_lights(spark, sf_dir):
    light = rules.traffic_light
    return sensors(spark, sf_dir).select(
        "event_id",
        light(F.col("temperature_hourly"), "heat").alias("heat"),
        light(F.col("wind_speed_kmh"), "wind").alias("wind"),
        light(F.col("rain_mm"), "rain").alias("rain"),
    )


def light_totals(spark, sf_dir):
    """The running totals of the stream, as one batch."""
    return alert_totals(with_traffic_light(_sensor_stream_shape(spark, sf_dir)))


def state_transitions(spark, sf_dir):
    series = Series.by_time(["city"], "timestamp", unit="day", **TIES)
    return rounded(extremes.state_transitions(sensors(spark, sf_dir), series, "state"), "share")


def event_table(spark, sf_dir):
    """The whole chain with the output contract, summarised per city and day."""
    table = jobs.event_table(sensors(spark, sf_dir), ["city"], **TIES)
    return table.groupBy("city", F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("rows"),
        F.count_if("alert_active").alias("alerts"),
        F.count_if(F.col("event_type") == "STORM").alias("storm_rows"),
        F.count_if(F.col("trend_direction") == "UP").alias("rising"),
        nearest(F.sum("event_intensity")).alias("intensity"),
    )


CLASSIFIED = SENSORS + """,
scored AS (
  SELECT *, (temperature_hourly - avg(temperature_hourly) OVER m)
              / nullif(coalesce(stddev(temperature_hourly) OVER m, 1), 0) AS z,
         avg(temperature_hourly) OVER (PARTITION BY city ORDER BY timestamp, event_id
           ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS rolling
  FROM sensors WINDOW m AS (PARTITION BY city, month(timestamp))),
classified AS (
  SELECT *, CASE WHEN z >= 2.5 THEN 'HEATWAVE' WHEN z <= -2.5 THEN 'COLDSNAP'
      WHEN rain_mm > 30 AND wind_speed_kmh > 50 THEN 'STORM' WHEN rain_mm > 50 THEN 'FLOOD' ELSE 'NORMAL' END AS event_type,
    CASE WHEN temperature_hourly > rolling + 1 THEN 'UP' WHEN temperature_hourly < rolling - 1 THEN 'DOWN'
      ELSE 'STABLE' END AS trend_direction
  FROM scored),
intense AS (
  SELECT *, (CASE event_type WHEN 'HEATWAVE' THEN least(1, (z - 2.5) / 2.5) WHEN 'COLDSNAP' THEN least(1, (-z - 2.5) / 2.5)
      WHEN 'STORM' THEN least(1, wind_speed_kmh / 150.0) WHEN 'FLOOD' THEN least(1, rain_mm / 100.0) ELSE 0 END)::DOUBLE AS event_intensity
  FROM classified)"""
NAMES = ", ".join(f"'{n}'" for n in rules.STORM_NAMES)
STORMY = CLASSIFIED + f""",
ids AS (
  SELECT *, CASE WHEN event_type = 'STORM' THEN 'STM-' || md5(strftime(timestamp, '%Y%m%d') || '_'
      || CAST(round(lat_decimal) AS VARCHAR) || '_' || CAST(round(lon_decimal) AS VARCHAR)) END AS storm_id,
    CAST(CASE WHEN event_type <> 'STORM' OR wind_speed_kmh < 63 THEN 0 WHEN wind_speed_kmh < 118 THEN 1
      WHEN wind_speed_kmh < 154 THEN 2 WHEN wind_speed_kmh < 178 THEN 3 WHEN wind_speed_kmh < 209 THEN 4
      ELSE 5 END AS INTEGER) AS storm_category
  FROM intense),
stormy AS (
  SELECT *, CASE WHEN storm_id IS NOT NULL
    THEN [{NAMES}][CAST('0x' || substr(md5(storm_id), 1, 8) AS BIGINT) % 21 + 1] END AS storm_name FROM ids)"""


def _alerts(source: str, category: str) -> str:
    return f"""active AS (SELECT *, {category} AS cat,
      event_type <> 'NORMAL' OR wind_speed_kmh > 60 OR rain_mm > 30 AS alert_active FROM {source}),
    alerts AS (SELECT *, CASE WHEN NOT alert_active THEN 'NONE'
        WHEN event_intensity > 0.7 OR cat >= 4 OR wind_speed_kmh > 120 THEN 'EMERGENCY'
        WHEN event_intensity > 0.4 OR cat >= 2 OR wind_speed_kmh > 90 THEN 'WARNING' ELSE 'WATCH' END AS alert_level,
      CASE WHEN NOT alert_active THEN 'NONE' WHEN event_type = 'HEATWAVE' THEN 'HEAT'
        WHEN event_type = 'COLDSNAP' THEN 'COLD' WHEN event_type = 'STORM' OR cat > 0 THEN 'STORM'
        WHEN event_type = 'FLOOD' THEN 'FLOOD' WHEN wind_speed_kmh > 60 THEN 'WIND' ELSE 'WEATHER' END AS alert_type
      FROM active)"""


LIGHTS = SENSORS + """,
heat AS (SELECT *, CASE WHEN temperature_hourly >= 45 THEN 3 WHEN temperature_hourly >= 40 THEN 2
    WHEN temperature_hourly >= 35 THEN 1 ELSE 0 END AS h,
  CASE WHEN temperature_hourly >= 35 THEN 'heat' ELSE 'none' END AS hk FROM sensors),
wind AS (SELECT *, CASE WHEN wind_speed_kmh >= 120 THEN 3 WHEN wind_speed_kmh >= 90 AND h < 3 THEN 2
    WHEN wind_speed_kmh >= 60 AND h = 0 THEN 1 END AS w FROM heat),
heat_wind AS (SELECT *, coalesce(w, h) AS l, CASE WHEN w IS NULL THEN hk ELSE 'wind' END AS k FROM wind),
rain AS (SELECT *, CASE WHEN rain_mm >= 100 THEN 3 WHEN rain_mm >= 50 AND l < 3 THEN 2 END AS f FROM heat_wind),
lights AS (SELECT *, ['green', 'yellow', 'orange', 'red'][coalesce(f, l) + 1] AS alert_level,
  CASE WHEN f IS NULL THEN k ELSE 'flood' END AS alert_type FROM rain)"""

_KM = """12742.0 * asin(sqrt(least(power(sin((radians({b}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({b}))
  * power(sin((radians({d}) - radians({c})) / 2), 2), 1.0)))"""
_SPEED = _KM.format(a="lat0", b="latitude", c="lon0", d="longitude") + " / (date_diff('microsecond', t0, timestamp) / 3.6e9)"
_Y = "sin(radians(longitude) - radians(lon0)) * cos(radians(latitude))"
_X = """cos(radians(lat0)) * sin(radians(latitude)) - sin(radians(lat0)) * cos(radians(latitude))
  * cos(radians(longitude) - radians(lon0))"""

QUERIES = {
    f.__name__: f
    for f in (
        event_classes, quiet_classes, storm_rows, storm_tracks, storm_footprint, alert_levels,
        alert_levels_without_storms, run_counts, adaptive_alerts, traffic_light, variable_lights, light_totals,
        state_transitions, event_table,
    )
}

SQL = {
    "event_classes": f"""WITH {CLASSIFIED} SELECT event_id, city, {r('z')} AS anomaly_score, event_type,
      {r('event_intensity')} AS event_intensity, trend_direction FROM intense""",
    "quiet_classes": f"""WITH {CLASSIFIED} SELECT CASE WHEN abs(z) < 1.5 THEN 'NORMAL' WHEN z >= 2.5 THEN 'HEATWAVE'
      WHEN z <= -2.5 THEN 'COLDSNAP' END AS quiet_type, count(*) AS rows FROM classified GROUP BY 1""",
    "storm_rows": f"WITH {STORMY} SELECT event_id, storm_id, storm_name, storm_category FROM stormy",
    "storm_tracks": f"""WITH {STORMY}, points AS (
        SELECT DISTINCT storm_id, storm_name, timestamp, lat_decimal AS latitude, lon_decimal AS longitude,
          storm_category AS category, wind_speed_kmh AS max_wind_kmh, pressure_hpa AS central_pressure_hpa
        FROM stormy WHERE storm_id IS NOT NULL),
      steps AS (SELECT *, lag(timestamp) OVER o AS t0, lag(latitude) OVER o AS lat0, lag(longitude) OVER o AS lon0,
          min(latitude) OVER p AS s, max(latitude) OVER p AS n, min(longitude) OVER p AS w, max(longitude) OVER p AS e
        FROM points WINDOW p AS (PARTITION BY storm_id), o AS (PARTITION BY storm_id
          ORDER BY timestamp, latitude, longitude, max_wind_kmh, central_pressure_hpa))
      SELECT storm_id, storm_name, {sql_time('timestamp')} AS timestamp, latitude, longitude, category, max_wind_kmh,
        central_pressure_hpa,
        {r(_SPEED, 4)} AS movement_speed_kmh,
        {r(f'(degrees(atan2({_Y}, {_X})) + 360) % 360', 4)} AS movement_direction_deg,
        {r(_KM.format(a='s', b='n', c='w', d='e') + ' / 2', 4)} AS radius_km,
        CASE WHEN category <= 1 THEN 'FORMING' WHEN category <= 3 THEN 'MATURE' ELSE 'INTENSE' END AS lifecycle_stage
      FROM steps""",
    "storm_footprint": f"""WITH {STORMY} SELECT storm_id, {sql_time('min(timestamp)')} AS first_seen,
      {sql_time('max(timestamp)')} AS last_seen, max(wind_speed_kmh) AS peak_wind_kmh, max(storm_category) AS peak_category,
      count(*) AS points, array_to_string(list_sort(list(DISTINCT city)), ',') AS affected_cities,
      array_to_string(list_sort(list(DISTINCT country)), ',') AS affected_countries
      FROM stormy WHERE storm_id IS NOT NULL GROUP BY storm_id""",
    "alert_levels": f"""WITH {STORMY}, {_alerts('stormy', 'storm_category')} SELECT event_id, alert_active, alert_level, alert_type,
      CASE WHEN alert_active THEN {sql_time('timestamp')} END AS alert_issued_at FROM alerts""",
    "alert_levels_without_storms": f"""WITH {CLASSIFIED}, {_alerts('intense', '0')}
      SELECT alert_level, alert_type, count(*) AS rows FROM alerts GROUP BY alert_level, alert_type""",
    "run_counts": f"""WITH {STORMY}, {_alerts('stormy', 'storm_category')} SELECT count(*) AS records,
      count(*) FILTER (alert_active) AS active_alerts, count(*) FILTER (event_type <> 'NORMAL') AS events,
      count(storm_id) AS storm_points, count(DISTINCT storm_id) AS storms FROM alerts""",
    "adaptive_alerts": f"""WITH {STORMY}, cuts AS (
        SELECT city, quantile_cont(temperature_hourly, 0.01) AS p1, quantile_cont(temperature_hourly, 0.05) AS p5,
          quantile_cont(temperature_hourly, 0.95) AS p95, quantile_cont(temperature_hourly, 0.99) AS p99
        FROM sensors GROUP BY city)
      SELECT event_id,
        CASE WHEN temperature_hourly >= p99 + 0.5 THEN 'EMERGENCY' WHEN temperature_hourly >= p99 THEN 'WARNING'
          WHEN temperature_hourly >= p95 + 1 THEN 'WATCH' ELSE 'NONE' END AS heat_level,
        CASE WHEN temperature_hourly <= p1 - 0.5 THEN 'EMERGENCY' WHEN temperature_hourly <= p1 THEN 'WARNING'
          WHEN temperature_hourly <= p5 - 1 THEN 'WATCH' ELSE 'NONE' END AS cold_level,
        CASE WHEN wind_speed_kmh >= 120 THEN 'EMERGENCY' WHEN wind_speed_kmh >= 90 THEN 'WARNING'
          WHEN wind_speed_kmh >= 60 THEN 'WATCH' ELSE 'NONE' END AS wind_level,
        CASE WHEN storm_category >= 4 THEN 'EMERGENCY' WHEN storm_category >= 3 THEN 'WARNING'
          WHEN storm_category >= 1 THEN 'WATCH' ELSE 'NONE' END AS storm_level
      FROM stormy JOIN cuts USING (city)""",
    "traffic_light": f"""WITH {LIGHTS} SELECT event_id, alert_level, alert_type,
      CASE alert_type || alert_level WHEN 'heatred' THEN 'Extreme heat warning' WHEN 'heatorange' THEN 'Heat warning'
        WHEN 'heatyellow' THEN 'Heat advisory' WHEN 'windred' THEN 'Extreme wind warning' WHEN 'windorange' THEN 'Wind warning'
        WHEN 'windyellow' THEN 'Wind advisory' WHEN 'floodred' THEN 'Flood warning' WHEN 'floodorange' THEN 'Heavy rain warning'
        ELSE '' END AS message_head FROM lights""",
    "variable_lights": f"""WITH {SENSORS} SELECT event_id,
      CASE WHEN temperature_hourly >= 45 THEN 'red' WHEN temperature_hourly >= 40 THEN 'orange'
        WHEN temperature_hourly >= 35 THEN 'yellow' ELSE 'green' END AS heat,
      CASE WHEN wind_speed_kmh >= 120 THEN 'red' WHEN wind_speed_kmh >= 90 THEN 'orange'
        WHEN wind_speed_kmh >= 60 THEN 'yellow' ELSE 'green' END AS wind,
      CASE WHEN rain_mm >= 100 THEN 'red' WHEN rain_mm >= 50 THEN 'orange' WHEN rain_mm >= 25 THEN 'yellow'
        ELSE 'green' END AS rain FROM sensors""",
    "light_totals": f"""WITH {LIGHTS} SELECT city, alert_level, count(*) AS alert_count, max(temperature_hourly) AS max_temperature,
      max(wind_speed_kmh) AS max_wind_speed, sum(rain_mm) AS total_rain FROM lights GROUP BY city, alert_level""",
    "state_transitions": f"""WITH {SENSORS}, steps AS (
        SELECT state AS to_state, lag(state) OVER (PARTITION BY city ORDER BY timestamp, event_id) AS from_state FROM sensors),
      n AS (SELECT from_state, to_state, count(*) AS changes FROM steps WHERE from_state IS NOT NULL GROUP BY ALL)
      SELECT from_state, to_state, changes,
        {r('changes::DOUBLE / sum(changes) OVER (PARTITION BY from_state)')} AS share FROM n""",
    "event_table": f"""WITH {STORMY}, {_alerts('stormy', 'storm_category')}
      SELECT city, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (alert_active) AS alerts,
        count(*) FILTER (event_type = 'STORM') AS storm_rows, count(*) FILTER (trend_direction = 'UP') AS rising,
        {r('sum(event_intensity)')} AS intensity FROM alerts GROUP BY 1, 2""",
}
