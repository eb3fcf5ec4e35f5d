"""Ordered operators on series whose longest member may hold a third of all rows.

A window ``partitionBy(station).orderBy(time)`` puts a whole station into one task. Here a
series is cut into *cells* along its order (a month, a day, an hour). Rows are shuffled once
by (series, cell); what a cell needs from its neighbours travels in a small table with one
row per cell, which is chained over the cells of a series and joined back on the
partitioning the rows already have. Results equal those of the plain window.

The chain window runs over *cells*, so its length is bounded by the calendar, not by rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherloom.operators.joining import stored

CELL = "_cell"
RANGE = "_range"


@dataclass(frozen=True)
class Series:
    """``keys`` name a series, ``order`` sorts it totally, ``cell`` rises with ``order``.

    ``cell`` is a column or SQL text. Keys must not be null: cells are joined on them.
    """

    keys: Sequence[str]
    order: Sequence[str]
    cell: Column | str

    @classmethod
    def by_time(cls, keys: Sequence[str], time: str, ties: Sequence[str] = (), unit: str = "month"):
        """Cells of one calendar ``unit``; ``ties`` make the order total."""
        return cls(list(keys), [time, *ties], f"date_trunc('{unit}', CAST(`{time}` AS timestamp))")

    def with_cell(self, df: DataFrame) -> DataFrame:
        return df.withColumn(CELL, F.expr(self.cell) if isinstance(self.cell, str) else self.cell)

    @property
    def inside(self):
        return Window.partitionBy(*self.keys, CELL).orderBy(*self.order)

    @property
    def inside_reversed(self):
        return Window.partitionBy(*self.keys, CELL).orderBy(*[F.col(c).desc() for c in self.order])

    @property
    def chain(self):
        return Window.partitionBy(*self.keys).orderBy(CELL)


def in_ranges(df: DataFrame, order: Sequence[str], rows_per_range: int = 1_000_000) -> tuple[DataFrame, Series]:
    """The rows cut along one global order into ranges of about equal counts, and the series over all of them.

    The number of ranges follows the counted rows and the splitters are sampled from the order's own
    values, so a crowded month becomes several ranges and thin ones share one. ``order`` should be
    total: rows that are equal in all of it cannot be split. The rows are stored with the
    number of their range, so that later passes see the same ranges.
    """
    ranges = max(1, -(-df.count() // rows_per_range))
    dealt = df.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id())
    return stored(dealt, "ranges"), Series([], list(order), RANGE)


def cell_unit_for(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    max_rows: int = 5_000_000,
    units: Sequence[str] = ("year", "month", "day", "hour"),
) -> str:
    """Coarsest unit whose fullest cell stays below ``max_rows``; the last one if none does.

    One aggregate per unit tried, over the keys and the time only. Coarse cells keep the
    cell table small; fine ones keep a crowded series out of a single task.
    """
    for unit in units[:-1]:
        cells = df.groupBy(*keys, F.date_trunc(unit, time).alias("_u")).agg(F.count("*").alias("_n"))
        fullest = cells.agg(F.max("_n").alias("n")).head().n
        if fullest is None or fullest <= max_rows:
            return unit
    return units[-1]


def look_back(
    df: DataFrame,
    series: Series,
    lags: Mapping[str, tuple[str, int]] | None = None,
    means: Mapping[str, tuple[str, int, bool]] | None = None,
    annotate: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Lags and trailing means.

    ``lags``: output -> (column, distance). ``means``: output -> (column, earlier rows,
    include the current row). ``annotate`` may add columns to the cell table before it is
    joined, which attaches per-cell values (a climatology, say) without another shuffle.
    """
    lags, means = dict(lags or {}), dict(means or {})
    keys = list(series.keys)
    depth = max([k for _, k in lags.values()] + [n for _, n, _ in means.values()])
    values = sorted({c for c, *_ in lags.values()} | {c for c, *_ in means.values()})

    base = series.with_cell(df)
    # the last rows of every cell: a row_number limit, which Spark also applies before the shuffle
    tails = (
        base.select(*dict.fromkeys([*keys, CELL, *series.order, *values]))
        .withColumn("_back", F.row_number().over(series.inside_reversed))
        .filter(F.col("_back") <= depth)
        .groupBy(*keys, CELL)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("_at"), *values))).alias("_tail"))
    )
    before = F.flatten(F.collect_list("_tail").over(series.chain.rowsBetween(-depth, -1)))
    cells = tails.withColumn("_before", before).select(
        *keys,
        CELL,
        F.slice("_before", F.greatest(F.size("_before") - depth + 1, F.lit(1)), depth).alias("_halo"),
    )
    # totals of the last 1, 2, ... rows before the cell, so that a row only has to index them
    averaged = sorted({c for c, *_ in means.values()})
    for c in averaged:
        sums, counts = _trailing_totals(F.col("_halo").getField(c))
        cells = cells.withColumns({f"_sums_{c}": sums, f"_counts_{c}": counts})
    if annotate is not None:
        cells = annotate(cells)

    row = series.inside
    local = {"_at": F.row_number().over(row)}
    for name, (column, distance) in lags.items():
        local[f"_lag_{name}"] = F.lag(column, distance).over(row)
    for name, (column, earlier, current) in means.items():
        frame = row.rowsBetween(-earlier, 0 if current else -1)
        local[f"_sum_{name}"] = F.sum(column).over(frame)
        local[f"_cnt_{name}"] = F.count(column).over(frame)
    out = base.withColumns(local).join(cells, [*keys, CELL], "left")

    at, halo = F.col("_at"), F.col("_halo")
    final = {}
    for name, (column, distance) in lags.items():
        carried = F.try_element_at(halo, (at - 1 - distance).cast("int"))[column]
        final[name] = F.when(at > distance, F.col(f"_lag_{name}")).otherwise(carried)
    for name, (column, earlier, _) in means.items():
        # rows of the frame that lie before the cell, as far as the series reaches back
        reach = F.least(F.lit(earlier) - (at - 1), F.size(f"_sums_{column}")).cast("int")
        more = F.when(reach > 0, F.try_element_at(f"_sums_{column}", reach))
        count = F.when(reach > 0, F.try_element_at(f"_counts_{column}", reach))
        total = F.coalesce(F.col(f"_sum_{name}"), F.lit(0.0)) + F.coalesce(more, F.lit(0.0))
        final[name] = F.try_divide(total, F.col(f"_cnt_{name}") + F.coalesce(count, F.lit(0)))
    totals = [f"{p}{c}" for p in ("_sums_", "_counts_") for c in averaged]
    return out.withColumns(final).drop("_halo", CELL, *local, *totals)


def _trailing_totals(values: Column) -> tuple[Column, Column]:
    """Arrays whose m-th entry is the sum (and the count) of the last m values, nulls apart."""
    known = F.transform(values, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    ones = F.transform(values, lambda x: F.when(x.isNotNull(), 1.0).otherwise(0.0))

    def running(array: Column) -> Column:
        none = F.array().cast("array<double>")
        return F.aggregate(
            F.reverse(array),
            none,
            lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x),
        )

    return running(known), running(ones)


def fill_gaps(df: DataFrame, series: Series, columns: Sequence[str]) -> DataFrame:
    """Nulls take the next known value of the series, then the last known one."""
    keys = list(series.keys)
    base = series.with_cell(df)
    order = F.struct(*series.order)
    ends = []
    for c in columns:
        known = F.when(F.col(c).isNotNull(), order)
        ends += [F.min_by(c, known).alias(f"_first_{c}"), F.max_by(c, known).alias(f"_last_{c}")]
    cells = base.groupBy(*keys, CELL).agg(*ends)
    # both directions as running frames; a forward-unbounded frame would be quadratic
    later = Window.partitionBy(*keys).orderBy(F.col(CELL).desc()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = series.chain.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *keys,
        CELL,
        *[F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_next_{c}") for c in columns],
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_prev_{c}") for c in columns],
    )
    down = series.inside_reversed.rowsBetween(Window.unboundedPreceding, 0)
    up = series.inside.rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for c in columns:
        local[f"_down_{c}"] = F.last(c, ignorenulls=True).over(down)
        local[f"_up_{c}"] = F.last(c, ignorenulls=True).over(up)
    out = base.withColumns(local).join(cells, [*keys, CELL], "left")
    filled = {
        c: F.coalesce(*[F.col(f"{p}{c}") for p in ("_down_", "_next_", "_up_", "_prev_")]) for c in columns
    }
    extra = [f"{p}{c}" for p in ("_next_", "_prev_") for c in columns]
    return out.withColumns(filled).drop(CELL, *local, *extra)


def positions(df: DataFrame, series: Series | Sequence[str], at: str = "position", size: str = "series_size") -> DataFrame:
    """0-based place of a row in its series and the length of the series.

    ``series.keys`` may be empty: the order is then global, still without a global sort,
    because only the counts per cell are accumulated in one place. A plain list of columns is
    such an order too; its cells are the ranges of :func:`in_ranges`.
    """
    if not isinstance(series, Series):
        df, ranged = in_ranges(df, series)
        return positions(df, ranged, at, size).drop(RANGE)
    keys = list(series.keys)
    base = series.with_cell(df)
    counts = base.groupBy(*keys, CELL).agg(F.count("*").alias("_n"))
    upto = series.chain.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    cells = counts.select(
        *keys,
        CELL,
        (F.sum("_n").over(upto) - F.col("_n")).alias("_start"),
        F.sum("_n").over(whole).alias(size),
    )
    local = base.withColumn("_row", F.row_number().over(series.inside))
    out = local.join(cells, [*keys, CELL], "left")
    return out.withColumn(at, F.col("_start") + F.col("_row") - 1).drop(CELL, "_start", "_row")
