"""Time and place aggregates.

Every aggregate here is algebraic (sum, count, min, max, moments), so Spark combines it on
the map side and a key with a third of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weatherloom.functions.climate import season_north
from weatherloom.functions.dates import decade
from weatherloom.operators.quantiles import bounded_quantiles, exact_quantiles

MONTHS = list(range(1, 13))


def measures(value: str, uncertainty: str | None = None) -> list[Column]:
    out = [
        F.avg(value).alias("avg_temperature"),
        F.min(value).alias("min_temperature"),
        F.max(value).alias("max_temperature"),
        F.stddev(value).alias("std_temperature"),
        F.count(value).alias("record_count"),
    ]
    if uncertainty is not None:
        out.append(F.avg(uncertainty).alias("avg_uncertainty"))
    return out


def monthly(
    df: DataFrame,
    keys: Sequence[str] = (),
    value: str = "temperature",
    uncertainty: str | None = "uncertainty",
) -> DataFrame:
    """Global month table, or one per station when ``keys`` name it."""
    return df.groupBy(*keys, "year", "month").agg(*measures(value, uncertainty))


def yearly(
    df: DataFrame,
    keys: Sequence[str] = (),
    value: str = "temperature",
    uncertainty: str | None = "uncertainty",
) -> DataFrame:
    return df.groupBy(*keys, "year").agg(*measures(value, uncertainty))


def yearly_from_monthly(month_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Year table with range, from the month table, so the raw rows are read once."""
    low, high = F.min("min_temperature"), F.max("max_temperature")
    return month_table.groupBy(*keys, "year").agg(
        F.avg("avg_temperature").alias("avg_temperature"),
        low.alias("min_temperature"),
        high.alias("max_temperature"),
        (high - low).alias("temperature_range"),
        F.sum("record_count").alias("record_count"),
    )


def station_climatology(month_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return month_table.groupBy(*keys, "month").agg(
        F.avg("avg_temperature").alias("climatology"), F.count("*").alias("record_count")
    )


def station_seasonal(month_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    with_season = month_table.withColumn("season", season_north(F.col("month")))
    return with_season.groupBy(*keys, "year", "season").agg(
        F.avg("avg_temperature").alias("avg_temperature"),
        F.min("min_temperature").alias("min_temperature"),
        F.max("max_temperature").alias("max_temperature"),
        F.sum("record_count").alias("record_count"),
    )


def station_thresholds(month_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p10/p90 of the monthly means; a group holds one value per year, so it is short."""
    names = {"p10_temperature": 0.1, "p90_temperature": 0.9}
    return bounded_quantiles(month_table, "avg_temperature", names, [*keys, "month"])


def climatology(df: DataFrame, value: str = "temperature") -> DataFrame:
    return df.groupBy("month").agg(
        F.avg(value).alias("climatology_mean"),
        F.stddev(value).alias("climatology_std"),
        F.min(value).alias("climatology_min"),
        F.max(value).alias("climatology_max"),
        F.count(value).alias("climatology_count"),
    )


def seasonal(df: DataFrame, value: str = "temperature") -> DataFrame:
    return df.groupBy(season_north(F.col("month")).alias("season")).agg(*measures(value))


def month_distribution(df: DataFrame, value: str = "temperature") -> DataFrame:
    """Mean, std and the five box numbers of every month."""
    box = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    moments = df.groupBy("month").agg(F.avg(value).alias("mean"), F.stddev(value).alias("std"))
    return moments.join(exact_quantiles(df, value, box, ["month"]), "month", "left")


def by_country(df: DataFrame, value: str = "temperature") -> DataFrame:
    """Code and continent depend on the country, so any value of the group is the value."""
    return df.groupBy("year", "country").agg(
        F.avg(value).alias("avg_temperature"),
        F.any_value("country_code").alias("country_code"),
        F.any_value("continent").alias("continent"),
    )


def by_continent(df: DataFrame, value: str = "temperature") -> DataFrame:
    return df.groupBy("year", "continent").agg(F.avg(value).alias("avg_temperature"))


def by_region(df: DataFrame, value: str = "temperature") -> DataFrame:
    return df.groupBy("year", "region", "continent").agg(F.avg(value).alias("avg_temperature"))


def area_yearly(year_table: DataFrame, areas: Sequence[str]) -> DataFrame:
    """Region or continent by year from the station year table."""
    return year_table.groupBy(*areas, "year").agg(
        F.avg("avg_temperature").alias("avg_temperature"),
        F.min("min_temperature").alias("min_temperature"),
        F.max("max_temperature").alias("max_temperature"),
        F.sum("record_count").alias("record_count"),
    )


def year_month_pivot(df: DataFrame, value: str) -> DataFrame:
    """Means, one row per year and one column per month (``m1`` to ``m12``)."""
    return _month_columns(df, "year", value)


def decade_season_pivot(df: DataFrame, value: str, season: str) -> DataFrame:
    """Means by decade and month for the months of one northern season."""
    rows = df.filter(season_north(F.col("month")) == season)
    return _month_columns(rows.withColumn("decade", decade(F.col("year"))), "decade", value)


def _month_columns(df: DataFrame, index: str, value: str) -> DataFrame:
    table = df.groupBy(index).pivot("month", MONTHS).agg(F.avg(value))
    return table.select(index, *[F.col(str(m)).alias(f"m{m}") for m in MONTHS])


def country_metrics(country_year: DataFrame, year: int) -> DataFrame:
    """Countries, mean, hottest and coldest of one year; name order breaks ties."""
    temp, name = F.col("avg_temperature"), F.col("country")
    return country_year.filter(F.col("year") == year).agg(
        F.count_distinct("country").alias("countries"),
        F.avg("avg_temperature").alias("global_avg"),
        F.max_by("country", F.struct(temp, name)).alias("hottest_country"),
        F.min_by("country", F.struct(temp, name)).alias("coldest_country"),
    )


def hottest_countries(country_year: DataFrame, year: int, n: int = 50) -> DataFrame:
    picked = country_year.filter(F.col("year") == year)
    return picked.orderBy(F.desc("avg_temperature"), "country").limit(n)


def country_statistics(
    country_year: DataFrame, countries: Sequence[str] | None = None, digits: int = 2
) -> DataFrame:
    rows = country_year if countries is None else country_year.filter(F.col("country").isin(*countries))
    aggregates = {"mean": F.avg, "std_dev": F.stddev, "min": F.min, "max": F.max}
    return rows.groupBy("country").agg(
        *[F.bround(f("avg_temperature"), digits).alias(n) for n, f in aggregates.items()]
    )


def table_summary(df: DataFrame, value: str = "temperature") -> DataFrame:
    """Record and column counts with the usual description of one column."""
    moments = df.agg(
        F.count("*").alias("total_records"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(F.broadcast(quartiles), F.lit(True), "left")


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def metric_summary(df: DataFrame, key: str, metrics: Mapping[str, Sequence[str]]) -> DataFrame:
    """``metrics``: column -> aggregate names (mean, max, min); plus the sample count."""
    functions = {"mean": F.avg, "max": F.max, "min": F.min}
    wanted = [functions[f](c).alias(f"{c}_{f}") for c, fs in metrics.items() for f in fs]
    return df.groupBy(key).agg(*wanted, F.count("*").alias("samples"))


def throughput(
    timings: DataFrame,
    operation: str = "operation",
    seconds: str = "duration_seconds",
    records: str = "records_processed",
) -> DataFrame:
    totals = timings.groupBy(operation).agg(
        F.sum(seconds).alias("duration_seconds"), F.sum(records).alias("records_processed")
    )
    rate = F.try_divide(F.col("records_processed"), F.col("duration_seconds"))
    return totals.withColumn("records_per_second", F.coalesce(rate, F.lit(0.0)))
