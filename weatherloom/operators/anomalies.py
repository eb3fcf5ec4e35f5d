"""Anomalies, baselines, extremes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weatherloom.functions.climate import anomaly_class, zscore
from weatherloom.functions.dates import decade
from weatherloom.operators.aggregates import year_month_pivot
from weatherloom.operators.joining import join_statistics, with_scalars
from weatherloom.operators.quantiles import exact_quantiles


def station_anomalies(year_table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed minus the station's mean over all its years.

    The window runs over the year table, where a station has one row per year, so its
    groups are short whatever the size of the raw data.
    """
    station = Window.partitionBy(*keys)
    return year_table.select(
        *keys, "year", "avg_temperature", F.avg("avg_temperature").over(station).alias("climatology"),
        "record_count",
    ).withColumn("anomaly", F.col("avg_temperature") - F.col("climatology"))


def flag_anomalies(
    df: DataFrame,
    value: str = "temperature",
    threshold: float = 3.0,
    ddof: int = 0,
    keys: Sequence[str] = (),
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """z-score against the whole table, or against the rows with the same ``keys``.

    ``ddof`` 0 divides by the population std, 1 by the sample std.
    """
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    moments = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), std(value).alias("_std"))
    if keys:
        joined = join_statistics(df, moments, keys, list(spread_by or [value]))
    else:
        joined = with_scalars(df, moments)
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_std"))
    flag = F.coalesce(F.abs("temp_zscore") > threshold, F.lit(False))
    return joined.withColumn("temp_zscore", z).withColumn("is_anomaly", flag).drop("_mean", "_std")


def classify_anomalies(df: DataFrame, z: str = "temp_zscore") -> DataFrame:
    return df.withColumn("anomaly_class", anomaly_class(F.col(z)))


def baseline_anomalies(
    df: DataFrame,
    value: str,
    baseline: tuple[int, int] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Value minus the monthly mean of the baseline years (all years when None).

    Without keys the baseline has at most twelve rows. With keys it grows with the number
    of stations and goes through the spread join.
    """
    inside = df if baseline is None else df.filter(F.col("year").between(*baseline))
    inside = inside.filter(F.col("month").between(1, 12))
    normal = inside.groupBy(*keys, "month").agg(F.avg(value).alias("baseline"))
    if keys:
        joined = join_statistics(df, normal, [*keys, "month"], ["year", value])
    else:
        joined = df.join(F.broadcast(normal), "month", "left")
    return joined.withColumn("anomaly", F.col(value) - F.col("baseline"))


def baseline_anomaly_pivot(
    df: DataFrame, value: str, baseline: tuple[int, int] | None = None
) -> DataFrame:
    return year_month_pivot(baseline_anomalies(df, value, baseline), "anomaly")


def value_zscores(df: DataFrame, value: str, keys: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """Group mean and std on every row plus the z-score, without a window over whole groups."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("group_mean"), F.stddev(value).alias("group_std"))
    joined = join_statistics(df, stats, keys, spread_by)
    score = zscore(F.col(value), F.col("group_mean"), F.col("group_std"))
    return joined.withColumn("anomaly_score", score)


def extreme_thresholds(
    df: DataFrame,
    value: str = "temperature",
    percentiles: Sequence[float] = (90.0, 95.0, 99.0),
    approximate: bool = False,
) -> DataFrame:
    """One row per percentile with its high and low threshold, in one job for all of them."""
    names = {}
    for i, p in enumerate(percentiles):
        names[f"high_{i}"] = p / 100.0
        names[f"low_{i}"] = (100.0 - p) / 100.0
    if approximate:
        found = df.agg(*[F.percentile_approx(value, p).alias(n) for n, p in names.items()])
    else:
        found = exact_quantiles(df, value, names)
    rows = [
        F.struct(
            F.lit(float(p)).alias("percentile"),
            F.col(f"high_{i}").alias("high_threshold"),
            F.col(f"low_{i}").alias("low_threshold"),
        )
        for i, p in enumerate(percentiles)
    ]
    return found.select(F.inline(F.array(*rows)))


def extreme_events(df: DataFrame, value: str = "temperature", percentile: float = 95.0) -> DataFrame:
    """Rows at or beyond the percentile on either side, labelled Hot or Cold."""
    names = {"_high": percentile / 100.0, "_low": (100.0 - percentile) / 100.0}
    cuts = exact_quantiles(df, value, names)
    beyond = with_scalars(df, cuts).filter(
        (F.col(value) >= F.col("_high")) | (F.col(value) <= F.col("_low"))
    )
    label = F.when(F.col(value) >= F.col("_high"), "Hot").otherwise("Cold")
    return beyond.withColumn("event_type", label).drop("_high", "_low")


def extreme_statistics(events: DataFrame) -> DataFrame:
    hot, cold = F.count_if(F.col("event_type") == "Hot"), F.count_if(F.col("event_type") == "Cold")
    total = F.count("*")

    def percent(n):
        return F.bround(F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0)), 2)

    return events.agg(
        total.alias("total_events"),
        hot.alias("hot_events"),
        cold.alias("cold_events"),
        percent(hot).alias("hot_event_percentage"),
        percent(cold).alias("cold_event_percentage"),
    )


def extremes_by_decade(events: DataFrame) -> DataFrame:
    return events.groupBy(decade(F.col("year")).alias("decade")).agg(F.count("*").alias("events"))
