"""Data-quality checks as aggregates.

Reports are long tables ``check, column_name, metric, value, detail`` so that any number of
columns and rules fits one schema. A check over many columns is one wide aggregate that is
turned into rows afterwards, not one job per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherloom.functions.dates import parse_mixed_date
from weatherloom.operators.joining import stored
from weatherloom.operators.quantiles import exact_quantiles
from weatherloom.operators.series import CELL, Series, look_back

# Allowed range per column.
RANGES = {
    "temperature_hourly": (-80, 60),
    "rain_mm": (0, 500),
    "wind_speed_kmh": (0, 400),
    "humidity_pct": (0, 100),
    "pressure_hpa": (870, 1084),
    "uv_index": (0, 15),
    "cloud_cover_pct": (0, 100),
    "visibility_km": (0, 100),
    "dew_point_c": (-80, 40),
    "feels_like_c": (-90, 70),
    "event_intensity": (0, 10),
    "storm_category": (0, 5),
    "latitude": (-90, 90),
    "longitude": (-180, 180),
}

# Category vocabularies of incoming reports ...
DOMAINS = {
    "climate_zone": ["Tropical", "Subtropical", "Temperate", "Continental", "Polar", "Arid"],
    "event_type": [
        "none", "heatwave", "cold_snap", "drought", "extreme_precipitation", "hurricane", "tornado",
    ],
    "alert_level": ["green", "yellow", "orange", "red"],
    "alert_type": ["none", "heat", "cold", "storm", "flood", "wind", "fire", "air_quality"],
    "season": ["Spring", "Summer", "Fall", "Winter", "Dry", "Wet"],
}

# ... and of the tables this library writes.
OWN_DOMAINS = {
    "climate_zone": ["TROPICAL", "SUBTROPICAL", "TEMPERATE", "CONTINENTAL", "POLAR", "UNKNOWN"],
    "event_type": ["NORMAL", "HEATWAVE", "COLDSNAP", "STORM", "FLOOD"],
    "alert_level": ["NONE", "WATCH", "WARNING", "EMERGENCY"],
    "alert_type": ["NONE", "HEAT", "COLD", "STORM", "FLOOD", "WIND", "WEATHER"],
    "season": ["WINTER", "SPRING", "SUMMER", "AUTUMN", "UNKNOWN"],
}

# Expected columns by category; the first two categories are required.
CONTRACT = {
    "core": ["timestamp", "year", "month", "day", "hour"],
    "location": ["city", "country", "latitude", "longitude"],
    "weather": ["temperature_hourly", "rain_mm", "wind_speed_kmh", "humidity_pct"],
    "optional": ["pressure_hpa", "uv_index", "cloud_cover_pct", "visibility_km"],
    "events": ["event_type", "event_intensity"],
    "alerts": ["alert_level", "alert_type"],
    "storms": ["storm_id", "storm_category"],
}
REQUIRED = ("core", "location")


def _rows(entries: Sequence[Mapping[str, Column]]) -> Column:
    return F.inline(F.array(*[F.struct(*[v.alias(k) for k, v in e.items()]) for e in entries]))


@dataclass(frozen=True)
class Check:
    """An algebraic check: aggregates over the table by name, and result rows made of them.

    Checks with different names of aggregates can share one pass over the table, see :func:`table_report`.
    """

    aggregates: Mapping[str, Column]
    entries: Sequence[Mapping[str, Column]]

    def table(self, df: DataFrame) -> DataFrame:
        return df.agg(*[c.alias(n) for n, c in self.aggregates.items()]).select(_rows(self.entries))

    def report(self, check: str, metrics: Sequence[str], name: str | None = "column_name") -> list[dict[str, Column]]:
        """Long report rows; ``name`` is the entry that says what a row is about, None for the whole table."""
        return [
            {
                "check": F.lit(check),
                "column_name": F.lit("*") if name is None else e[name],
                "metric": F.lit(m),
                "value": e[m].cast("string"),
            }
            for e in self.entries
            for m in metrics
        ]


def missing_check(columns: Sequence[str]) -> Check:
    absent = {c: F.col(c).isNull() for c in columns}
    anything = reduce(lambda a, b: a | b, absent.values())
    found = {"missing__rows": F.count("*"), "missing__complete": F.count_if(~anything)}
    found |= {f"missing__{i}": F.count_if(x) for i, x in enumerate(absent.values())}
    total = reduce(lambda a, b: a + b, [F.col(f"missing__{i}") for i in range(len(columns))])
    entries = [
        {
            "column_name": F.lit(c),
            "missing": F.col(f"missing__{i}"),
            "missing_percent": F.round(F.try_divide(F.col(f"missing__{i}") * 100.0, F.col("missing__rows")), 2),
            "total_missing": total,
            "complete_rows": F.col("missing__complete"),
        }
        for i, c in enumerate(columns)
    ]
    return Check(found, entries)


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: missing count and percent, next to table totals."""
    return missing_check(list(columns or df.columns)).table(df)


def range_check(columns: Sequence[str], ranges: Mapping[str, tuple[float, float]]) -> Check:
    found = {}
    for c in columns:
        x, (low, high) = F.col(c), ranges[c]
        found |= {
            f"{c}__min": F.min(x).cast("double"),
            f"{c}__max": F.max(x).cast("double"),
            f"{c}__mean": F.avg(x),
            f"{c}__std": F.stddev(x),
            f"{c}__out": F.count_if((x < low) | (x > high)),
        }
    entries = [
        {
            "column_name": F.lit(c),
            "min_value": F.col(f"{c}__min"),
            "max_value": F.col(f"{c}__max"),
            "mean_value": F.col(f"{c}__mean"),
            "std_value": F.col(f"{c}__std"),
            "out_of_range": F.col(f"{c}__out"),
        }
        for c in columns
    ]
    return Check(found, entries)


def range_checks(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Profile of each column with a rule and the number of values outside it."""
    return range_check([c for c in ranges if c in df.columns], ranges).table(df)


def domain_values(df: DataFrame, domains: Mapping[str, Sequence[str]] = DOMAINS) -> DataFrame:
    """Every distinct value of the checked columns, its count and whether it is allowed.

    Long form instead of one collected set: a column that turns out to hold millions of
    values is still only rows.
    """
    columns = [c for c in domains if c in df.columns]
    entries = [
        {
            "column_name": F.lit(c),
            "value": F.col(c).cast("string"),
        }
        for c in columns
    ]
    counted = (
        df.select(_rows(entries))
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("rows"))
    )
    allowed = reduce(
        lambda a, b: a | b,
        [(F.col("column_name") == c) & F.col("value").isin(*domains[c]) for c in columns],
    )
    return counted.withColumn("is_valid", allowed)


def invalid_values(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Distinct values of ``column`` that the table ``allowed`` (column ``value``) lacks."""
    actual = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return actual.join(allowed, "value", "left_anti")


def domain_summary(values: DataFrame) -> DataFrame:
    return values.groupBy("column_name").agg(
        F.count("*").alias("n_actual"),
        F.count_if(~F.col("is_valid")).alias("n_invalid"),
        F.sum(F.when(~F.col("is_valid"), F.col("rows")).otherwise(0)).alias("invalid_rows"),
    )


def date_check(df: DataFrame, column: str) -> DataFrame:
    """Range, unparsable values (nulls included) and distinct dates of a text date column."""
    date = parse_mixed_date(F.col(column))
    return df.select(date.alias("_d")).agg(
        F.min("_d").alias("first_date"),
        F.max("_d").alias("last_date"),
        F.count_if(F.col("_d").isNull()).alias("invalid_dates"),
        F.count_distinct("_d").alias("unique_dates"),
    )


def numeric_time_check(df: DataFrame, columns: Sequence[str] = ("year", "month")) -> DataFrame:
    wide = []
    for c in columns:
        wide += [
            F.min(c).cast("int").alias(f"{c}__min"),
            F.max(c).cast("int").alias(f"{c}__max"),
            F.count_distinct(c).alias(f"{c}__n"),
        ]
    entries = [
        {
            "column_name": F.lit(c),
            "min_value": F.col(f"{c}__min"),
            "max_value": F.col(f"{c}__max"),
            "unique_values": F.col(f"{c}__n"),
        }
        for c in columns
    ]
    return df.agg(*wide).select(_rows(entries))


def duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Repeated rows beyond the first; copies are counted on the map side."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("_n"))
    total, unique = F.sum("_n"), F.count("*")
    extra = F.coalesce(total - unique, F.lit(0))
    return groups.agg(
        extra.alias("duplicate_rows"),
        F.round(F.try_divide(extra * 100.0, total), 2).alias("duplicate_percent"),
        unique.alias("unique_rows"),
    )


def schema_contract(df: DataFrame, contract: Mapping[str, Sequence[str]] = CONTRACT) -> DataFrame:
    """One row per expected column: category, required, present."""
    entries = [
        {
            "category": F.lit(category),
            "column_name": F.lit(c),
            "required": F.lit(category in REQUIRED),
            "present": F.lit(c in df.columns),
        }
        for category, columns in contract.items()
        for c in columns
    ]
    return df.sparkSession.range(1).select(_rows(entries))


def schema_is_valid(df: DataFrame, contract: Mapping[str, Sequence[str]] = CONTRACT) -> bool:
    return all(c in df.columns for k in REQUIRED for c in contract.get(k, []))


def time_coverage(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    start, end = F.min(timestamp), F.max(timestamp)
    seconds = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return df.agg(
        start.alias("start"),
        end.alias("end"),
        F.floor(seconds / 86400).alias("span_days"),
        F.count_distinct(F.year(timestamp)).alias("years"),
    )


def records_per_year(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    return df.groupBy(F.year(timestamp).alias("year")).agg(F.count("*").alias("records"))


def gaps(df: DataFrame, series: Series, timestamp: str) -> DataFrame:
    """Rows with ``gap_seconds`` to the previous row of the same series (null on the first)."""
    before = look_back(df, series, lags={"_before": (timestamp, 1)})
    micros = F.unix_micros(F.col(timestamp).cast("timestamp")) - F.unix_micros(
        F.col("_before").cast("timestamp")
    )
    return before.withColumn("gap_seconds", micros / 1e6).drop("_before")


def gap_counts(with_gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, gap_seconds, rows)``: how often each gap occurs, stored.

    Regular series have few different gaps, so the table is small; at worst it has a row for every row.
    """
    known = with_gaps.filter(F.col("gap_seconds").isNotNull())
    return stored(known.groupBy(*keys, "gap_seconds").agg(F.count("*").alias("rows")), "gap-counts")


def series_gap_counts(df: DataFrame, series: Series, timestamp: str) -> DataFrame:
    """The same straight from the series, with one pass over it and one shuffle.

    Each cell gives its counted gaps and its first and last time; the gaps between cells come from those.
    """
    keys = list(series.keys)
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    rows = series.with_cell(df.select(*dict.fromkeys([*keys, *series.order, timestamp]))).withColumn("_t", micros)
    before, after = F.lag("_t").over(series.inside), F.lead("_row").over(series.inside)
    rows = rows.withColumn("_row", F.row_number().over(series.inside))
    rows = rows.select(
        *keys, CELL, (F.col("_t") - before).alias("_gap"), F.when(F.col("_row") == 1, F.struct("_t")).alias("_first"),
        F.when(after.isNull(), F.struct("_t")).alias("_last"),
    )
    cells = rows.groupBy(*keys, CELL, "_gap").agg(
        F.count("*").alias("rows"), F.max("_first").alias("_first"), F.max("_last").alias("_last")
    )
    cells = stored(cells, "gap-cells")
    inner = cells.filter("_gap is not null").select(*keys, (F.col("_gap") / 1e6).alias("gap_seconds"), "rows")
    ends = cells.groupBy(*keys, CELL).agg(F.max("_first")["_t"].alias("_from"), F.max("_last")["_t"].alias("_to"))
    between = ends.select(*keys, ((F.col("_from") - F.lag("_to").over(series.chain)) / 1e6).alias("gap_seconds"), F.lit(1).cast("long").alias("rows"))
    both = inner.unionByName(between.filter("gap_seconds is not null"))
    return stored(both.groupBy(*keys, "gap_seconds").agg(F.sum("rows").alias("rows")), "gap-counts")


def _gap_statistics(counts: DataFrame, keys: Sequence[str], step_seconds: float) -> DataFrame:
    ends = counts.groupBy(*keys).agg(
        F.min("gap_seconds").alias("min_gap"),
        F.max("gap_seconds").alias("max_gap"),
        F.coalesce(F.sum(F.when(F.col("gap_seconds") > step_seconds, F.col("rows"))), F.lit(0)).alias("gaps_over_step"),
    )
    median = exact_quantiles(counts, "gap_seconds", {"median_gap": 0.5}, keys, weight="rows")
    joined = ends.join(median, list(keys)) if keys else ends.crossJoin(F.broadcast(median))
    return joined.withColumn("is_hourly", F.col("median_gap") <= 1.5 * 3600)


def gap_summary(with_gaps: DataFrame, keys: Sequence[str], step_seconds: float = 3600.0) -> DataFrame:
    """Median, least and largest gap per series, the hourly flag and gaps beyond one step.

    ``with_gaps`` is read once; everything else comes from the counted gaps.
    """
    return _gap_statistics(gap_counts(with_gaps, keys), keys, step_seconds)


def series_gap_summary(
    df: DataFrame, series: Series, timestamp: str, keys: Sequence[str] | None = None, step_seconds: float = 3600.0
) -> DataFrame:
    """The same from one pass over the series, per series or over all of them (``keys`` empty)."""
    keys = list(series.keys) if keys is None else list(keys)
    counts = series_gap_counts(df, series, timestamp)
    if keys != list(series.keys):
        counts = counts.groupBy(*keys, "gap_seconds").agg(F.sum("rows").alias("rows"))
    return _gap_statistics(counts, keys, step_seconds)


# rule name, severity when broken, columns needed
PHYSICAL_RULES = [
    ("humidity_range", "fail", ["humidity_pct"]),
    ("rain_not_negative", "fail", ["rain_mm"]),
    ("wind_not_negative", "fail", ["wind_speed_kmh"]),
    ("pressure_range", "warn", ["pressure_hpa"]),
    ("intensity_range", "fail", ["event_intensity"]),
]


def _violation(rule: str) -> Column:
    def outside(name: str) -> Column:
        low, high = RANGES[name]
        return (F.col(name) < low) | (F.col(name) > high)

    return {
        "humidity_range": lambda: outside("humidity_pct"),
        "rain_not_negative": lambda: F.col("rain_mm") < 0,
        "wind_not_negative": lambda: F.col("wind_speed_kmh") < 0,
        "pressure_range": lambda: outside("pressure_hpa"),
        "intensity_range": lambda: outside("event_intensity"),
    }[rule]()


def physical_check(columns: Sequence[str], min_correlation: float = 0.8) -> Check:
    rules = [r for r in PHYSICAL_RULES if all(c in columns for c in r[2])]
    found = {f"physical__{name}": F.count_if(_violation(name)).cast("double") for name, _, _ in rules}
    correlated = "temperature_hourly" in columns and "feels_like_c" in columns
    entries = [
        {
            "rule": F.lit(name),
            "measured": F.col(f"physical__{name}"),
            "status": F.when(F.col(f"physical__{name}") > 0, severity).otherwise("pass"),
        }
        for name, severity, _ in rules
    ]
    if correlated:
        found["physical__felt"] = F.corr("temperature_hourly", "feels_like_c")
        entries.append(
            {
                "rule": F.lit("felt_temperature_correlation"),
                "measured": F.col("physical__felt"),
                "status": F.when(F.col("physical__felt") > min_correlation, "pass").otherwise("warn"),
            }
        )
    return Check(found, entries)


def physical_rules(df: DataFrame, min_correlation: float = 0.8) -> DataFrame:
    """One row per applicable rule: ``measured`` (violations) and status pass, warn or fail."""
    return physical_check(df.columns, min_correlation).table(df)


def is_consistent(rules: DataFrame) -> DataFrame:
    return rules.agg((F.count_if(F.col("status") == "fail") == 0).alias("is_consistent"))


def storm_report(df: DataFrame) -> DataFrame:
    storms = df.filter(F.col("storm_id").isNotNull())
    return storms.agg(
        (F.count("*") > 0).alias("has_storms"),
        F.count_distinct("storm_id").alias("n_storms"),
        F.count("*").alias("n_storm_records"),
    )


def category_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("rows"))


def track_continuity(tracks: DataFrame, series: Series, max_step: float = 10.0) -> DataFrame:
    """Per storm: largest step in degrees and whether every step stays within the limit."""
    steps = look_back(tracks, series, lags={"_lat": ("latitude", 1), "_lon": ("longitude", 1)})
    step = F.greatest(
        F.abs(F.col("latitude") - F.col("_lat")), F.abs(F.col("longitude") - F.col("_lon"))
    )
    return steps.withColumn("_step", step).groupBy("storm_id").agg(
        F.count("*").alias("points"),
        F.max("_step").alias("max_step"),
        F.coalesce(~F.bool_or(F.col("_step") > max_step), F.lit(True)).alias("is_continuous"),
    )


def alert_check(level: str = "alert_level") -> Check:
    counts = {c: F.col(f"alerts__{c}") for c in DOMAINS["alert_level"]}
    found = {f"alerts__{c}": F.count_if(F.col(level) == c) for c in counts} | {"alerts__rows": F.count("*")}
    green, yellow, red = (counts[c] for c in ("green", "yellow", "red"))
    broken = ((green > 0) & (yellow > green)) | ((yellow > 0) & (red > yellow))
    alerts = F.col("alerts__rows") - green
    return Check(found, [{"has_alerts": alerts > 0, "n_alerts": alerts, **counts, "hierarchy_valid": ~broken}])


def alert_report(df: DataFrame, level: str = "alert_level") -> DataFrame:
    """Traffic-light counts and whether stronger levels are the rarer ones.

    A level that does not occur is not compared.
    """
    return alert_check(level).table(df)


def absent_members(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected stations that have no row."""
    return expected.join(df.select(*keys).distinct(), list(keys), "left_anti")


def _as_report(check: str, df: DataFrame, name: Column, metrics: Sequence[str]) -> DataFrame:
    entries = [
        {
            "check": F.lit(check),
            "column_name": name,
            "metric": F.lit(m),
            "value": F.col(m).cast("string"),
        }
        for m in metrics
    ]
    return df.select(_rows(entries))


def dates_check(column: str) -> Check:
    date = parse_mixed_date(F.col(column))
    found = {"dates__first": F.min(date), "dates__last": F.max(date), "dates__invalid": F.count_if(date.isNull())}
    entry = {"first_date": F.col("dates__first"), "last_date": F.col("dates__last"), "invalid_dates": F.col("dates__invalid")}
    return Check(found, [entry | {"column_name": F.lit(column)}])


def ends_check(columns: Sequence[str]) -> Check:
    """Least and largest value of whole-number columns."""
    found = {f"ends__{c}__{n}": f(c).cast("int") for c in columns for n, f in (("min", F.min), ("max", F.max))}
    return Check(found, [{"column_name": F.lit(c), "min_value": F.col(f"ends__{c}__min"), "max_value": F.col(f"ends__{c}__max")} for c in columns])


def span_check(timestamp: str) -> Check:
    start, end = F.col("span__start"), F.col("span__end")
    seconds = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    found = {"span__start": F.min(timestamp), "span__end": F.max(timestamp), "span__rows": F.count("*")}
    return Check(found, [{"start": start, "end": end, "span_days": F.floor(seconds / 86400), "rows": F.col("span__rows")}])


#: Name of the counted storm points; no column has it.
POINT = "*point"


def value_counts(df: DataFrame, values: Mapping[str, Column], point: Sequence[Column] | None = None) -> DataFrame:
    """``(name, value, at, latitude, longitude, rows)``: how often each value of each named expression occurs, in one
    pass, stored. The value is text, null for null. ``point`` (storm, time, latitude, longitude) adds the distinct
    points of storms under the name ``POINT``; the last three columns are theirs alone."""
    nothing = {"at": F.lit(None).cast("timestamp"), "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")}
    entries = [{"name": F.lit(n), "value": v.cast("string"), **nothing} for n, v in values.items()]
    if point is not None:
        storm, at, latitude, longitude = point
        entries.append({"name": F.lit(POINT), "value": storm.cast("string"), "at": at.cast("timestamp"), "latitude": latitude.cast("double"), "longitude": longitude.cast("double")})
    # a row without storm is no point
    one = F.array(*[F.struct(*[v.alias(k) for k, v in e.items()]) for e in entries])
    rows = df.select(F.inline(F.filter(one, lambda e: (e["name"] != POINT) | e["value"].isNotNull())))
    return stored(rows.groupBy("name", "value", "at", "latitude", "longitude").agg(F.count("*").alias("rows")), "value-counts")


def _distinct(counted: DataFrame, entries: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Distinct values of named expressions as report rows; ``entries``: name -> (check, column_name, metric)."""
    wide = counted.agg(*[F.count_if((F.col("name") == n) & F.col("value").isNotNull()).alias(f"d{i}") for i, n in enumerate(entries)])
    rows = [
        {"check": F.lit(c), "column_name": F.lit(x), "metric": F.lit(m), "value": F.col(f"d{i}").cast("string")}
        for i, (c, x, m) in enumerate(entries.values())
    ]
    return wide.select(_rows(rows))


def _domain_rows(counted: DataFrame, domains: Mapping[str, Sequence[str]]) -> DataFrame:
    allowed = reduce(lambda a, b: a | b, [(F.col("name") == c) & F.col("value").isin(*v) for c, v in domains.items()])
    known = counted.filter(F.col("name").isin(*domains) & F.col("value").isNotNull())
    values = known.select(F.col("name").alias("column_name"), "value", "rows", allowed.alias("is_valid"))
    return _as_report("domains", domain_summary(values), F.col("column_name"), ["n_actual", "n_invalid"])


def _table_parts(df: DataFrame, date_column, ranges, domains):
    """Checks that share the aggregate pass as ``(check, rows)``, and for the counting pass the values and their rows."""
    checks = [(missing := missing_check(df.columns), missing.report("missing", ["missing", "missing_percent"]))]
    ranged = [c for c in ranges if c in df.columns]
    if ranged:
        check = range_check(ranged, ranges)
        checks.append((check, check.report("ranges", ["min_value", "max_value", "out_of_range"])))
    domains = {c: v for c, v in domains.items() if c in df.columns}
    values, distinct = {c: F.col(c) for c in domains}, {}
    if date_column is not None:
        check = dates_check(date_column)
        checks.append((check, check.report("dates", ["first_date", "last_date", "invalid_dates"])))
        values["*date"] = parse_mixed_date(F.col(date_column))
        distinct["*date"] = ("dates", date_column, "unique_dates")
    numeric = [c for c in ("year", "month") if c in df.columns]
    if numeric:
        check = ends_check(numeric)
        checks.append((check, check.report("time", ["min_value", "max_value"])))
        values |= {c: F.col(c) for c in numeric}
        distinct |= {c: ("time", c, "unique_values") for c in numeric}
    return checks, values, distinct, domains


def _one_pass(df: DataFrame, checks, more: Sequence[Mapping[str, Column]] = ()) -> DataFrame:
    """All algebraic checks in one aggregate of the table, unfolded into report rows."""
    together = reduce(lambda a, b: a | b, [dict(c.aggregates) for c, _ in checks])
    one = df.agg(*[c.alias(n) for n, c in together.items()])
    return one.select(_rows([e for _, rows in checks for e in rows] + list(more)))


def table_report(
    df: DataFrame,
    date_column: str | None = None,
    ranges: Mapping[str, tuple[float, float]] = RANGES,
    domains: Mapping[str, Sequence[str]] = DOMAINS,
) -> DataFrame:
    """Missing values, ranges, categories, dates and duplicates of one table as long rows.

    Three passes over the table: one aggregate for all algebraic checks, one count of values, one for duplicates.
    """
    checks, values, distinct, domains = _table_parts(df, date_column, ranges, domains)
    parts = [_one_pass(df, checks), _as_report("duplicates", duplicates(df), F.lit("*"), ["duplicate_rows", "unique_rows"])]
    if values:
        counted = value_counts(df, values)
        if domains:
            parts.append(_domain_rows(counted, domains))
        if distinct:
            parts.append(_distinct(counted, distinct))
    return reduce(DataFrame.unionByName, parts)


def file_summary(lines: DataFrame, parsed: DataFrame, source: str = "source") -> DataFrame:
    """Per file of a directory: data lines, parsed rows, missing values and an error flag.

    ``lines`` are the raw data lines and ``parsed`` the rows made of them, both with the
    file name in ``source``. A file none of whose lines parses counts as an error.
    """
    fields = [c for c in parsed.columns if c != source]
    lacking = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in fields])
    # fewer than all fields missing means that something of the line was understood
    understood = lacking < len(fields)
    rows = parsed.groupBy(source).agg(
        F.count_if(understood).alias("rows"),
        F.sum(F.when(understood, lacking).otherwise(0)).alias("missing"),
    )
    seen = lines.groupBy(source).agg(F.count("*").alias("lines"))
    return (
        seen.join(rows, source, "left")
        .na.fill(0, ["rows", "missing"])
        .withColumn("has_error", F.col("rows") == 0)
    )


def directory_summary(files: DataFrame) -> DataFrame:
    errors, total = F.count_if("has_error"), F.count("*")
    return files.agg(
        total.alias("total_files"),
        errors.alias("files_with_errors"),
        F.round(F.try_divide((total - errors) * 100.0, total), 2).alias("success_rate"),
        F.sum("rows").alias("total_rows"),
        F.sum("missing").alias("total_missing"),
    )


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of each named column that exists, as long rows; null counts as the value "null"."""
    parts = [
        _as_report(c, category_distribution(df, c), F.coalesce(F.col(c).cast("string"), F.lit("null")), ["rows"])
        for c in columns
        if c in df.columns
    ]
    parts.append(_as_report("shape", df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns))), F.lit("*"), ["rows", "columns"]))
    return reduce(DataFrame.unionByName, parts)


def storm_tracks_report(df: DataFrame, timestamp: str, lat: str = "lat_decimal", lon: str = "lon_decimal") -> DataFrame:
    """Storms, and how many of them move without a jump."""
    points = df.filter(F.col("storm_id").isNotNull()).select(
        "storm_id", F.col(timestamp).alias("at"), F.col(lat).cast("double").alias("latitude"), F.col(lon).cast("double").alias("longitude")
    ).distinct()
    return _tracks(points)


def _tracks(points: DataFrame) -> DataFrame:
    tracks = track_continuity(points, Series.by_time(["storm_id"], "at", ["latitude", "longitude"], "day"))
    return tracks.agg(F.count("*").alias("n_tracks"), F.count_if("is_continuous").alias("n_continuous"))


def full_report(
    df: DataFrame,
    series: Series,
    timestamp: str = "timestamp",
    date_column: str | None = None,
    ranges: Mapping[str, tuple[float, float]] = RANGES,
    domains: Mapping[str, Sequence[str]] = DOMAINS,
) -> DataFrame:
    """All checks of an hourly event table with an overall flag, as long rows.

    Four passes over the table: one aggregate for all algebraic checks, one count of values and storm
    points, one for duplicates, one over the series for its gaps.
    """
    whole = F.lit("*")
    checks, values, distinct, domains = _table_parts(df, date_column, ranges, domains)
    coverage, physical = span_check(timestamp), physical_check(df.columns)
    checks += [(coverage, coverage.report("coverage", ["start", "end", "span_days"], None)), (coverage, coverage.report("shape", ["rows"], None))]
    checks.append((physical, physical.report("physical", ["measured", "status"], "rule")))
    values["*years"] = F.year(timestamp)
    distinct["*years"] = ("coverage", "*", "years")
    point = None
    if "storm_id" in df.columns:
        storms = Check({"storms__records": F.count("storm_id")}, [{"n_storm_records": F.col("storms__records")}])
        checks.append((storms, storms.report("storms", ["n_storm_records"], None)))
        values["storm_id"] = F.col("storm_id")
        distinct["storm_id"] = ("storms", "*", "n_storms")
        if {"lat_decimal", "lon_decimal"} <= set(df.columns):
            point = [F.col(c) for c in ("storm_id", timestamp, "lat_decimal", "lon_decimal")]
    if "alert_level" in df.columns:
        alerts = alert_check()
        checks.append((alerts, alerts.report("alerts", ["n_alerts", "hierarchy_valid"], None)))
    counted_too = [c for c in ("storm_category", "alert_level", "alert_type") if c in df.columns]
    values |= {c: F.col(c) for c in counted_too}

    fails = reduce(lambda a, b: a | b, [e["status"] == "fail" for e in physical.entries], F.lit(False))
    overall = {"overall_valid": ~fails & F.lit(schema_is_valid(df)), "columns": F.lit(len(df.columns))}
    more = [
        {"check": F.lit(c), "column_name": whole, "metric": F.lit(m), "value": overall[m].cast("string")}
        for c, m in (("overall", "overall_valid"), ("shape", "columns"))
    ]
    counted = value_counts(df, values, point)
    parts = [
        _one_pass(df, checks, more),
        _as_report("duplicates", duplicates(df), whole, ["duplicate_rows", "unique_rows"]),
        _as_report("schema", schema_contract(df), F.col("column_name"), ["required", "present"]),
        _as_report("resolution", series_gap_summary(df, series, timestamp, []), whole, ["median_gap", "min_gap", "max_gap", "is_hourly"]),
        _distinct(counted, distinct),
    ]
    if domains:
        parts.append(_domain_rows(counted, domains))
    if counted_too:
        found = counted.filter(F.col("name").isin(*counted_too))
        parts.append(found.select(F.col("name").alias("check"), F.coalesce("value", F.lit("null")).alias("column_name"), F.lit("rows").alias("metric"), F.col("rows").cast("string").alias("value")))
    if point is not None:
        points = counted.filter(F.col("name") == POINT).select(F.col("value").alias("storm_id"), "at", "latitude", "longitude")
        parts.append(_as_report("tracks", _tracks(points), whole, ["n_tracks", "n_continuous"]))
    return reduce(DataFrame.unionByName, parts)
