"""Anomalies, extremes, trends, correlations, descriptive statistics, independence tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.climate import CITY_MONTH, CITY_YEAR, GOOD, SEASON, city_month, station_month, station_year
from catalog.mapping import (
    CITY_ORDERS, PLACED_ORDERS, READINGS, STATION_MONTH, STATION_YEAR, city_orders, placed_orders, r, readings,
    rounded, rs,
)
from weatherloom.operators import aggregates, anomalies, cleaning
from weatherloom.operators import statistics as st
from weatherloom.plans import jobs


def _rows(spark, sf_dir):
    return cleaning.clean(city_orders(spark, sf_dir))


def _years(spark, sf_dir):
    return aggregates.yearly(_rows(spark, sf_dir))


def zscore_anomalies(spark, sf_dir):
    out = anomalies.flag_anomalies(readings(spark, sf_dir), threshold=1.5)
    out = out.select("station", "l_orderkey", "l_linenumber", "date", "temperature", "temp_zscore", "is_anomaly")
    return rounded(out, "temperature", "temp_zscore").withColumn("date", F.col("date").cast("string"))


def station_anomaly_flags(spark, sf_dir):
    """Flags against each station's own mean and population deviation, counted."""
    out = anomalies.flag_anomalies(readings(spark, sf_dir), threshold=2.0, keys=["station"], spread_by=["l_orderkey"])
    return out.groupBy("station").agg(F.count("*").alias("rows"), F.count_if("is_anomaly").alias("anomalies"))


def sigma_classes(spark, sf_dir):
    """Classes against the sample deviation, counted."""
    out = anomalies.classify_anomalies(anomalies.flag_anomalies(readings(spark, sf_dir), ddof=1))
    return out.groupBy("anomaly_class").agg(F.count("*").alias("rows"))


def station_zscores(spark, sf_dir):
    """z-scores inside station and month, joined spread out instead of windowed."""
    out = anomalies.value_zscores(
        cleaning.clean(readings(spark, sf_dir)), "temperature", ["station", "month"], ["l_orderkey"]
    )
    out = out.select("station", "month", "l_orderkey", "l_linenumber", "date", "temperature", "anomaly_score")
    return rounded(out, "temperature", "anomaly_score").withColumn("date", F.col("date").cast("string"))


def extreme_thresholds(spark, sf_dir):
    return rounded(anomalies.extreme_thresholds(_rows(spark, sf_dir)), "high_threshold", "low_threshold")


def _extremes(spark, sf_dir):
    return anomalies.extreme_events(_rows(spark, sf_dir), percentile=95.0)


def extreme_events(spark, sf_dir):
    out = _extremes(spark, sf_dir).select("o_orderkey", "city", "year", "month", "temperature", "event_type")
    return rounded(out, "temperature")


def extreme_stats(spark, sf_dir):
    return anomalies.extreme_statistics(_extremes(spark, sf_dir))


def extremes_by_decade(spark, sf_dir):
    return anomalies.extremes_by_decade(_extremes(spark, sf_dir))


def trend_line(spark, sf_dir):
    out = st.trend_line(_years(spark, sf_dir)).select(
        "year", "avg_temperature", "trend_line", "trend_slope_per_year", "trend_slope_per_decade"
    )
    return rounded(out, *[c for c in out.columns if c != "year"])


TREND = ["slope_per_year", "slope_per_decade", "r_squared"]


def trend_summary(spark, sf_dir):
    return rounded(st.trend_summary(_years(spark, sf_dir)), *TREND)


SIGNIFICANCE = ["slope", "slope_per_decade", "intercept", "r_squared", "std_error", "p_value"]


def trend_significance(spark, sf_dir):
    return rounded(st.trend_significance(_years(spark, sf_dir)), *SIGNIFICANCE)


def station_trends(spark, sf_dir):
    """The same test for every station at once."""
    out = st.trend_significance(station_year(spark, sf_dir), keys=["station"])
    return rounded(out, *SIGNIFICANCE)


def quadratic_trend(spark, sf_dir):
    out = st.quadratic_trend(_years(spark, sf_dir))
    return rounded(rounded(out, "coef_0", digits=2), "coef_1", "coef_2", "r_squared", digits=5)


def period_stats(spark, sf_dir):
    return rounded(st.period_statistics(_years(spark, sf_dir)), "mean", "std", "min", "max")


VARIABLES = ["year", "avg_temperature", "min_temperature", "max_temperature", "temperature_range"]


def correlation_matrix(spark, sf_dir):
    out = st.correlation_matrix(station_year(spark, sf_dir), VARIABLES)
    return rounded(out, "correlation", "abs_correlation")


def top_correlations(spark, sf_dir):
    out = st.top_correlations(st.correlation_matrix(station_year(spark, sf_dir), VARIABLES))
    return rounded(out, "correlation", "abs_correlation")


DESCRIBED = ["avg_temperature", "min_temperature", "max_temperature", "avg_uncertainty"]


def descriptive_stats(spark, sf_dir):
    out = st.descriptive_statistics(station_month(spark, sf_dir), DESCRIBED)
    return rounded(out, *[c for c in out.columns if c != "variable"])


def raw_descriptive_stats(spark, sf_dir):
    """Over the raw readings, where each variable is one group with every row of the table."""
    out = st.descriptive_statistics(readings(spark, sf_dir), ["temperature", "uncertainty"])
    return rounded(out, *[c for c in out.columns if c != "variable"])


def chi_square(spark, sf_dir):
    months = aggregates.monthly(cleaning.clean(placed_orders(spark, sf_dir)), jobs.STATION)
    out = st.chi_square_tests(jobs.with_test_categories(months), jobs.INDEPENDENCE_TESTS)
    return rounded(out, "chi_square_statistic", "p_value")


STATION_POINTS = "SELECT year, " + ", ".join(VARIABLES[1:]) + " FROM station_year"


def _pairs(strict: bool) -> str:
    parts = []
    for a in VARIABLES:
        for b in VARIABLES:
            if not strict or a < b:
                parts.append(
                    f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr({a}, {b}) AS c FROM station_year"
                )
    return " UNION ALL ".join(parts)


def _describe(names, source) -> str:
    def one(v):
        m = f"(SELECT avg({v}) FROM {source})"
        skew = f"avg(power({v} - {m}, 3)) / power(var_pop({v}), 1.5)"
        return f"""SELECT '{v}' AS variable, count({v})::DOUBLE AS count, {r(f'avg({v})')} AS mean,
          {r(f'stddev({v})')} AS std_dev, {r(f'min({v})')} AS min, {r(f'quantile_cont({v}, 0.25)')} AS q1,
          {r(f'quantile_cont({v}, 0.5)')} AS median, {r(f'quantile_cont({v}, 0.75)')} AS q3, {r(f'max({v})')} AS max,
          {r(f'quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)')} AS iqr, {r(skew)} AS skewness,
          {r(f'kurtosis_pop({v})')} AS kurtosis FROM {source}"""

    return " UNION ALL ".join(one(v) for v in names)


def _student(t: str, dof: str) -> str:
    """Two-sided tail by summing the same finite series with explicit factorial ratios."""
    theta = f"atan(abs({t}) / sqrt({dof}))"
    even = f"""sin({theta}) * list_sum(list_transform(range(0, greatest(CAST({dof} / 2 AS BIGINT), 1)),
      lambda k: CAST(exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4.0)) AS DOUBLE) * power(cos({theta}), 2 * k)))"""
    odd = f"""2 / pi() * ({theta} + CASE WHEN {dof} = 1 THEN 0 ELSE sin({theta}) * cos({theta}) * list_sum(list_transform(
      range(0, greatest(CAST(floor(({dof} - 1) / 2) AS BIGINT), 1)),
      lambda k: CAST(exp(2 * lgamma(k + 1) + k * ln(4.0) - lgamma(2 * k + 2)) AS DOUBLE) * power(cos({theta}), 2 * k))) END)"""
    return f"CASE WHEN {dof} < 1 THEN NULL WHEN {dof} % 2 = 0 THEN 1 - {even} ELSE 1 - ({odd}) END"


def _significance(source: str, key: str | None) -> str:
    group = f"GROUP BY {key}" if key else ""
    k = f"{key}, " if key else ""
    return f"""f AS (SELECT {k}regr_slope(avg_temperature, year) AS slope, regr_intercept(avg_temperature, year) AS intercept,
        regr_r2(avg_temperature, year) AS r2, regr_sxx(avg_temperature, year) AS sxx, regr_sxy(avg_temperature, year) AS sxy,
        regr_syy(avg_temperature, year) AS syy, count(avg_temperature) AS n FROM {source} {group}),
      e AS (SELECT *, n - 2 AS dof, CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) END AS se FROM f),
      t AS (SELECT *, CASE WHEN se > 0 THEN slope / se END AS tv FROM e),
      p AS (SELECT *, {_student('tv', 'dof')} AS p_raw FROM t)
      SELECT {k}{r('slope')} AS slope, {r('slope * 10')} AS slope_per_decade, {r('intercept')} AS intercept,
        {r('r2')} AS r_squared, {r('se')} AS std_error, {r('greatest(p_raw, 0)')} AS p_value,
        p_raw < 0.05 AS significant, n FROM p"""


YEARS = GOOD + """,
years AS (SELECT year, avg(temperature) AS avg_temperature, min(temperature) AS min_temperature,
  max(temperature) AS max_temperature FROM good GROUP BY year)"""
CUTS = """cuts AS (SELECT quantile_cont(temperature, 0.95) AS hi, quantile_cont(temperature, 0.05) AS lo FROM good),
extremes AS (SELECT good.*, CASE WHEN temperature >= hi THEN 'Hot' ELSE 'Cold' END AS event_type
  FROM good, cuts WHERE temperature >= hi OR temperature <= lo)"""

_CHI_TESTS = {
    "Continent vs Temperature Category": ("continent", "temp_category"),
    "Season vs Temperature Category": ("season", "temp_category"),
    "Time Period vs Temperature Category": ("time_period", "temp_category"),
}


def _chi(name, a, b) -> str:
    # dof is 2 * (rows - 1) with three temperature categories: the tail is a finite sum
    return f"""SELECT '{name}' AS test, '{a}' AS variable_1, '{b}' AS variable_2, x AS chi, dof FROM (
      SELECT sum(power(coalesce(o, 0) - e, 2) / e) AS x,
             CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS INTEGER) AS dof
      FROM (SELECT ra.a, cb.b, ra.n * cb.n / tot.n::DOUBLE AS e, ob.n AS o
            FROM (SELECT {a} AS a, count(*) AS n FROM kinds WHERE {a} IS NOT NULL GROUP BY 1) ra
            CROSS JOIN (SELECT {b} AS b, count(*) AS n FROM kinds WHERE {a} IS NOT NULL GROUP BY 1) cb
            CROSS JOIN (SELECT count(*) AS n FROM kinds WHERE {a} IS NOT NULL) tot
            LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS n FROM kinds GROUP BY 1, 2) ob
              ON ob.a = ra.a AND ob.b = cb.b))"""


QUERIES = {
    f.__name__: f
    for f in (
        zscore_anomalies, station_anomaly_flags, sigma_classes, station_zscores, extreme_thresholds, extreme_events, extreme_stats,
        extremes_by_decade, trend_line, trend_summary, trend_significance, station_trends, quadratic_trend,
        period_stats, correlation_matrix, top_correlations, descriptive_stats, raw_descriptive_stats, chi_square,
    )
}

_MOMENTS = "m AS (SELECT avg(temperature) AS mu, {std}(temperature) AS sd FROM readings)"

SQL = {
    "zscore_anomalies": f"""WITH {READINGS}, {_MOMENTS.format(std='stddev_pop')}
      SELECT station, l_orderkey, l_linenumber, CAST(date AS VARCHAR) AS date, {r('temperature')} AS temperature,
        {r('(temperature - mu) / sd')} AS temp_zscore, abs((temperature - mu) / sd) > 1.5 AS is_anomaly FROM readings, m""",
    "station_anomaly_flags": f"""WITH {READINGS}, m AS (
        SELECT station, avg(temperature) AS mu, stddev_pop(temperature) AS sd FROM readings GROUP BY station)
      SELECT station, count(*) AS rows, count(*) FILTER (abs((temperature - mu) / sd) > 2) AS anomalies
      FROM readings JOIN m USING (station) GROUP BY station""",
    "sigma_classes": f"""WITH {READINGS}, {_MOMENTS.format(std='stddev_samp')},
      z AS (SELECT abs((temperature - mu) / sd) AS z FROM readings, m)
      SELECT CASE WHEN z < 1 THEN 'normal' WHEN z < 2 THEN 'moderate' ELSE 'extreme' END AS anomaly_class,
        count(*) AS rows FROM z GROUP BY 1""",
    "station_zscores": f"""WITH {READINGS}, c AS (SELECT * FROM readings WHERE temperature BETWEEN -100 AND 60),
      w AS (SELECT *, avg(temperature) OVER k AS mu, coalesce(stddev(temperature) OVER k, 1) AS sd FROM c
            WINDOW k AS (PARTITION BY station, month))
      SELECT station, month, l_orderkey, l_linenumber, CAST(date AS VARCHAR) AS date, {r('temperature')} AS temperature,
        CASE WHEN sd <> 0 THEN {r('(temperature - mu) / sd')} END AS anomaly_score FROM w""",
    "extreme_thresholds": f"WITH {GOOD} " + " UNION ALL ".join(
        f"""SELECT {p}::DOUBLE AS percentile, {r(f'quantile_cont(temperature, {p / 100})')} AS high_threshold,
        {r(f'quantile_cont(temperature, {(100 - p) / 100})')} AS low_threshold FROM good"""
        for p in (90.0, 95.0, 99.0)
    ),
    "extreme_events": f"""WITH {GOOD}, {CUTS} SELECT o_orderkey, city, year, month, {r('temperature')} AS temperature,
      event_type FROM extremes""",
    "extreme_stats": f"""WITH {GOOD}, {CUTS} SELECT count(*) AS total_events,
      count(*) FILTER (event_type = 'Hot') AS hot_events, count(*) FILTER (event_type = 'Cold') AS cold_events,
      {r("count(*) FILTER (event_type = 'Hot') * 100.0::DOUBLE / count(*)", 2)} AS hot_event_percentage,
      {r("count(*) FILTER (event_type = 'Cold') * 100.0::DOUBLE / count(*)", 2)} AS cold_event_percentage FROM extremes""",
    "extremes_by_decade": f"""WITH {GOOD}, {CUTS} SELECT CAST(year - year % 10 AS INTEGER) AS decade, count(*) AS events
      FROM extremes GROUP BY 1""",
    "trend_line": f"""WITH {YEARS}, f AS (SELECT regr_slope(avg_temperature, year) AS s,
        regr_intercept(avg_temperature, year) AS i FROM years)
      SELECT year, {r('avg_temperature')} AS avg_temperature, {r('s * year + i')} AS trend_line,
        {r('s')} AS trend_slope_per_year, {r('s * 10')} AS trend_slope_per_decade FROM years, f""",
    "trend_summary": f"""WITH {YEARS} SELECT {r('regr_slope(avg_temperature, year)')} AS slope_per_year,
      {r('regr_slope(avg_temperature, year) * 10')} AS slope_per_decade, {r('regr_r2(avg_temperature, year)')} AS r_squared,
      min(year) AS start_year, max(year) AS end_year, count(*) AS years_of_data FROM years""",
    "trend_significance": f"WITH {YEARS}, {_significance('years', None)}",
    "station_trends": f"WITH {STATION_YEAR}, {_significance('station_year', 'station')}",
    "quadratic_trend": f"""WITH {YEARS}, c AS (SELECT avg(year) AS mx, avg(avg_temperature) AS my FROM years),
      d AS (SELECT year - mx AS x, avg_temperature - my AS y, power(year - mx, 2) AS q, mx, my FROM years, c),
      e AS (SELECT x, y, q - avg(q) OVER () AS q, avg(q) OVER () AS mq, mx, my FROM d),
      s AS (SELECT sum(x * x) AS xx, sum(x * q) AS xq, sum(q * q) AS qq, sum(x * y) AS xy, sum(q * y) AS qy,
              sum(y * y) AS yy, any_value(mq) AS mq, any_value(mx) AS mx, any_value(my) AS my FROM e),
      b AS (SELECT *, (xy * qq - qy * xq) / (xx * qq - xq * xq) AS b1, (xx * qy - xq * xy) / (xx * qq - xq * xq) AS b2 FROM s)
      SELECT {r('my - b2 * mq - b1 * mx + b2 * mx * mx', 2)} AS coef_0, {r('b1 - 2 * b2 * mx', 5)} AS coef_1,
        {r('b2', 5)} AS coef_2, {r('(b1 * xy + b2 * qy) / yy', 5)} AS r_squared FROM b""",
    "period_stats": f"""WITH {YEARS} SELECT min(year) AS start_year, max(year) AS end_year, count(*) AS years_of_data,
      {r('avg(avg_temperature)')} AS mean, {r('stddev(avg_temperature)')} AS std, {r('min(avg_temperature)')} AS min,
      {r('max(avg_temperature)')} AS max FROM years""",
    "correlation_matrix": f"""WITH {STATION_YEAR}, p AS ({_pairs(False)})
      SELECT variable_1, variable_2, {r('c')} AS correlation, {r('abs(c)')} AS abs_correlation FROM p""",
    "top_correlations": f"""WITH {STATION_YEAR}, p AS ({_pairs(True)})
      SELECT variable_1, variable_2, {r('c')} AS correlation, {r('abs(c)')} AS abs_correlation FROM p
      ORDER BY abs(c) DESC LIMIT 10""",
    "descriptive_stats": f"WITH {STATION_MONTH} " + _describe(DESCRIBED, "station_month"),
    "raw_descriptive_stats": f"WITH {READINGS} " + _describe(["temperature", "uncertainty"], "readings"),
    "chi_square": f"""WITH {CITY_YEAR}, kinds AS (
        SELECT continent, {SEASON} AS season,
          CASE WHEN avg_temperature < 10 THEN 'Cold' WHEN avg_temperature < 20 THEN 'Moderate' ELSE 'Hot' END AS temp_category,
          CASE WHEN year < (SELECT (min(year) + max(year)) / 2 FROM city_months) THEN 'Early' ELSE 'Late' END AS time_period
        FROM city_months),
      found AS ({' UNION ALL '.join(_chi(n, *v) for n, v in _CHI_TESTS.items())}),
      tail AS (SELECT *, exp(-chi / 2) * list_sum(list_transform(range(0, CAST(dof / 2 AS BIGINT)),
          lambda k: power(chi / 2, k) / exp(lgamma(k + 1)))) AS p FROM found)
      SELECT test, variable_1, variable_2, {r('chi')} AS chi_square_statistic, dof AS degrees_of_freedom,
        {r('p')} AS p_value, p < 0.05 AS is_significant FROM tail""",
}
