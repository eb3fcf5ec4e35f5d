"""Cleaning, its audit, sampling and null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def plausible(
    value: str = "temperature",
    years: tuple[int, int] = (1750, 2030),
    bounds: tuple[float, float] = (-100.0, 60.0),
) -> Column:
    """Value present and inside ``bounds``, year in (first, last], month 1 to 12."""
    return (
        F.col(value).isNotNull()
        & (F.col("year") > years[0])
        & (F.col("year") <= years[1])
        & F.col("month").between(1, 12)
        & F.col(value).between(*bounds)
    )


def clean(
    df: DataFrame,
    value: str = "temperature",
    dedup_keys: Sequence[str] | None = None,
    dedup_order: Sequence[str] | None = None,
    **limits,
) -> DataFrame:
    """Plausible rows; with ``dedup_keys`` one of each key, the first in the order ``dedup_order`` (all other columns)."""
    kept = df.filter(plausible(value, **limits))
    return first_of_each(kept, dedup_keys, dedup_order) if dedup_keys else kept


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the least by ``order``, then by all other columns, whatever the partitioning."""
    others = [c for c in df.columns if c not in keys]
    first = [*(order or []), *(c for c in others if c not in (order or []))]
    if not first:
        return df.distinct()
    rows = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*first)).alias("_row"))
    return rows.select(*keys, "_row.*").select(*df.columns)


def cleaning_audit(df: DataFrame, value: str = "temperature", **limits) -> DataFrame:
    """Rows in, kept and removed in one pass."""
    counts = df.agg(
        F.count("*").alias("rows_in"),
        F.count_if(F.coalesce(plausible(value, **limits), F.lit(False))).alias("rows_kept"),
    )
    removed = F.col("rows_in") - F.col("rows_kept")
    return counts.select(
        "rows_in",
        "rows_kept",
        removed.alias("rows_removed"),
        F.try_divide(removed * 100.0, F.col("rows_in")).alias("removed_percent"),
    )


def clean_observed(
    df: DataFrame, value: str = "temperature", **limits
) -> tuple[DataFrame, Observation]:
    """Cleaned frame whose audit is collected by whichever action runs it first."""
    audit = Observation("cleaning")
    good = F.coalesce(plausible(value, **limits), F.lit(False))
    watched = df.observe(audit, F.count("*").alias("rows_in"), F.count_if(good).alias("rows_kept"))
    return watched.filter(plausible(value, **limits)), audit


def mark_outliers(df: DataFrame, value: str, low: float = -90.0, high: float = 60.0) -> DataFrame:
    return df.withColumn("is_outlier", ~F.col(value).between(low, high))


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=fraction, seed=seed)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, the same ones for any partitioning: order by the MD5 of seed and key, which any engine can follow."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)), *keys).limit(n)


def first_rows(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def zero_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0, subset=list(columns))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def project(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    """The contract's columns that exist, in the contract's order."""
    return df.select([c for c in contract if c in df.columns])
