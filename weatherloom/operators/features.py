"""Feature tables for the monthly models, chronological splits and folds."""

from __future__ import annotations


from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherloom.functions.climate import month_cycle
from weatherloom.operators.joining import with_scalars
from weatherloom.operators.series import Series, look_back, positions

TIME_FEATURES = [
    "year", "month", "year_normalized", "month_sin", "month_cos",
    "is_winter", "is_spring", "is_summer", "is_fall",
]
LAG_FEATURES = ["temp_lag_1", "temp_lag_12", "temp_ma_3", "temp_ma_12"]
SEASON_FEATURES = ["temp_lag_12", "temp_prev_year"]


def season_flags(month: Column) -> dict[str, Column]:
    return {
        "is_winter": month.isin(12, 1, 2).cast("int"),
        "is_spring": month.between(3, 5).cast("int"),
        "is_summer": month.between(6, 8).cast("int"),
        "is_fall": month.between(9, 11).cast("int"),
    }


def time_features(df: DataFrame, year_range: tuple[int, int] | None = None) -> DataFrame:
    """``year_range`` is the frozen range of the training data; None takes the table's own."""
    sine, cosine = month_cycle(F.col("month"))
    if year_range is None:
        span = df.agg(F.min("year").alias("_y0"), F.max("year").alias("_y1"))
        df, low, high = with_scalars(df, span), F.col("_y0"), F.col("_y1")
    else:
        low, high = F.lit(year_range[0]), F.lit(year_range[1])
    scaled = F.try_divide((F.col("year") - low).cast("double"), (high - low).cast("double"))
    return df.withColumns(
        {
            "year_normalized": F.coalesce(scaled, F.lit(0.0)),
            "month_sin": sine,
            "month_cos": cosine,
            **season_flags(F.col("month")),
        }
    ).drop("_y0", "_y1")


def month_series(keys: Sequence[str], ties: Sequence[str] = ()) -> Series:
    """Monthly tables: cells of ten years keep the halo small."""
    return Series(list(keys), ["year", "month", *ties], "CAST(floor(year / 10) AS int)")


def lag_features(
    df: DataFrame, series: Series, value: str = "temperature", include_current: bool = False
) -> DataFrame:
    """Lags 1 and 12 and trailing means 3 and 12; a start without history is filled backwards.

    The means end with the row before the current one. ``include_current`` moves the frame
    up to the current row, which leaks the target into its own features. ``value`` must not
    be null (clean it, or use ``fill_gaps`` first): the only gaps are then at the start
    of a series, and filling them backwards means its first value. A series too short for a lag
    has no value to fill from and gets its own mean. Both ride on the cell table, so the rows are
    still shuffled once.
    """
    keys = list(series.keys)
    start = df.groupBy(*keys).agg(
        F.min_by(value, F.struct(*series.order)).alias("_start"),
        F.count("*").alias("_length"),
        F.avg(value).alias("_mean"),
    )

    def with_start(cells: DataFrame) -> DataFrame:
        return cells.join(start, keys, "left") if keys else with_scalars(cells, start)

    earlier = {"temp_ma_3": 3, "temp_ma_12": 12}
    if include_current:
        earlier = {n: k - 1 for n, k in earlier.items()}
    out = look_back(
        df,
        series,
        lags={"temp_lag_1": (value, 1), "temp_lag_12": (value, 12)},
        means={n: (value, k, include_current) for n, k in earlier.items()},
        annotate=with_start,
    )
    needs = {"temp_lag_1": 1, "temp_lag_12": 12, "temp_ma_3": 1, "temp_ma_12": 1}
    filled = {
        n: F.coalesce(F.col(n), F.when(F.col("_length") > k, F.col("_start")), F.col("_mean")) for n, k in needs.items()
    }
    return out.withColumns(filled).drop("_start", "_length", "_mean")


def feature_table(
    df: DataFrame,
    keys: Sequence[str] = (),
    value: str = "temperature",
    ties: Sequence[str] = (),
    year_range: tuple[int, int] | None = None,
) -> DataFrame:
    """Time, season, lag and rolling features of a monthly table."""
    return time_features(lag_features(df, month_series(keys, ties), value), year_range)


def seasonal_features(df: DataFrame, keys: Sequence[str], value: str = "temperature") -> DataFrame:
    """Same month and mean of the calendar year before, for the block forecast.

    One row per (station, year, month) is expected. Rows without a preceding year get null.
    """
    keys = list(keys)
    year = Window.partitionBy(*keys, "year")
    before = df.select(
        *keys,
        (F.col("year") + 1).alias("year"),
        "month",
        F.col(value).alias("temp_lag_12"),
        F.avg(value).over(year).alias("temp_prev_year"),
    )
    return df.join(before, [*keys, "year", "month"], "left")


def chronological_split(
    df: DataFrame, order: Series | Sequence[str], test_size: float = 0.2, flag: str = "is_test"
) -> DataFrame:
    """Marks the last ``ceil(test_size * n)`` rows of the global order as test rows."""
    placed = positions(df, order, "_at", "_n")
    cut = F.col("_n") - F.ceil(F.col("_n") * test_size)
    return placed.withColumn(flag, F.col("_at") >= cut).drop("_at", "_n")


def expanding_folds(df: DataFrame, order: Series | Sequence[str], splits: int = 5, fold: str = "fold") -> DataFrame:
    """Fold 0 is only ever trained on; fold i is validated by a model of the folds before it.

    Validation folds have ``n // (splits + 1)`` rows each, the rest is fold 0.
    """
    placed = positions(df, order, "_at", "_n")
    size = F.floor(F.col("_n") / (splits + 1))
    first = F.col("_n") - size * splits
    number = F.when(F.col("_at") < first, 0).otherwise(F.floor((F.col("_at") - first) / size) + 1)
    return placed.withColumn(fold, number.cast("int")).drop("_at", "_n")


def block_folds(df: DataFrame, order: Series | Sequence[str], folds: int = 5, fold: str = "fold") -> DataFrame:
    """Contiguous folds of the global order, the first ones a row longer when n is no multiple."""
    placed = positions(df, order, "_at", "_n")
    size, more, at = F.floor(F.col("_n") / folds), F.col("_n") % folds, F.col("_at")
    long_part = more * (size + 1)
    number = F.when(at < long_part, F.floor(at / (size + 1))).otherwise(more + F.floor((at - long_part) / size))
    return placed.withColumn(fold, number.cast("int")).drop("_at", "_n")


def global_month_order(ties: Sequence[str]) -> list[str]:
    """Order by (year, month, ties) over all stations; its cells are ranges of counted size."""
    return ["year", "month", *ties]
