"""Date parsing, date parts and calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd"
MONTH_FIRST = "M/d/yyyy"
DAY_FIRST = "d/M/yyyy"


def parse_mixed_date(text: Column, prefer_dayfirst: bool = False) -> Column:
    """ISO first, then the two slash orders; what fits none becomes null."""
    slashes = [DAY_FIRST, MONTH_FIRST] if prefer_dayfirst else [MONTH_FIRST, DAY_FIRST]
    trimmed = F.trim(text)
    return F.coalesce(*[F.try_to_date(trimmed, fmt) for fmt in [ISO, *slashes]])


def with_date_parts(
    df: DataFrame,
    date_col: str = "dt",
    prefer_dayfirst: bool = False,
    drop_invalid: bool = False,
) -> DataFrame:
    """Add ``date``, ``year``, ``month``, ``day`` and ``day_of_week`` (1 = Sunday).

    A frame without ``date_col`` is returned as it is.
    """
    if date_col not in df.columns:
        return df
    kind = df.schema[date_col].dataType.typeName()
    source = F.col(date_col)
    date = parse_mixed_date(source, prefer_dayfirst) if kind == "string" else source.cast("date")
    out = df.withColumn("date", date)
    if drop_invalid:
        out = out.filter(F.col("date").isNotNull())
    return out.withColumns(
        {
            "year": F.year("date"),
            "month": F.month("date"),
            "day": F.dayofmonth("date"),
            "day_of_week": F.dayofweek("date"),
        }
    )


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def hour_timestamp(date: Column, hour: Column) -> Column:
    """Timestamp of ``hour`` o'clock on ``date``, without a round trip through text."""
    return F.make_timestamp(
        F.year(date), F.month(date), F.dayofmonth(date), hour, F.lit(0), F.lit(0)
    )


def time_period(year: Column, midpoint: Column | float) -> Column:
    """Early/Late halves of a record; the cut year itself is Late."""
    return F.when(year < midpoint, "Early").otherwise("Late")
