"""Exact percentiles of groups of any size, by distributed selection.

The built-in ``percentile`` keeps every distinct value of a group in the memory of one
task. That is right for groups whose size is bounded (one value per year of a station) and
is what :func:`bounded_quantiles` uses. For groups that grow with the data
:func:`exact_quantiles` selects the wanted order statistics in passes over the rows, all of
which combine on the map side:

1. count, minimum and maximum of every group: the first bracket of each wanted rank;
2. a bracket with more than ``most`` values is cut into cells, the cells are counted, and the
   cell that holds the rank is the next bracket. The number of cells follows the counted size,
   so one such pass is enough for spread-out values;
3. brackets of at most ``most`` values are counted value by value and the rank is read off.

Cells have equal width. Where that does not separate the values (outliers, heavy ties), the
next cells end at the bracket's own approximate percentiles, with a cell of its own for every
edge; so the number of passes grows with the logarithm of the size for any values. No window
runs over a group: at most ``cells`` counted rows of a bracket, or ``most`` values, meet in one place.

The result equals ``percentile`` (linear interpolation between neighbours).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weatherloom.operators.joining import join_statistics, stored, with_scalars

#: Edges of the cells where equal widths fail.
EDGES = 255
BRACKET = "struct<b: bigint, lo: double, hi: double, cells: bigint, edges: array<double>>"


def bounded_quantiles(
    df: DataFrame, value: str, names: Mapping[str, float], keys: Sequence[str]
) -> DataFrame:
    """Built-in exact ``percentile`` per group, for groups known to be short."""
    probs = list(names.values())
    picked = df.groupBy(*keys).agg(
        F.percentile(value, F.array(*[F.lit(p) for p in probs])).alias("_q")
    )
    return picked.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])


def _position(p: float) -> Column:
    return F.lit(p) * (F.col("_n") - 1)


def _brackets(targets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct bracket; ``_b``, its smallest rank, names it within the group."""
    return targets.groupBy(*keys, "_lo", "_hi", "_inside", "_even").agg(F.min("_rank").alias("_b"))


def _placed(rows: DataFrame, brackets: DataFrame, keys: list[str], spread: int | None) -> DataFrame:
    """The rows inside a bracket of their group, with the bracket as ``_k``."""
    one = F.struct(
        F.col("_b").alias("b"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_cells").alias("cells"), F.col("_edges").alias("edges")
    ).cast(BRACKET)
    packed = brackets.groupBy(*keys).agg(F.collect_list(one).alias("_ks"))  # two for each probability at most
    if keys:
        met = join_statistics(rows, packed, keys, ["_v"], spread)
    else:
        met = with_scalars(rows, packed)
    inside = met.select(*keys, "_v", "_w", F.explode("_ks").alias("_k"))
    return inside.filter((F.col("_v") >= F.col("_k.lo")) & (F.col("_v") <= F.col("_k.hi")))


def _cell() -> Column:
    """The row's cell: never smaller for a larger value."""
    v, lo, hi, n = F.col("_v"), F.col("_k.lo"), F.col("_k.hi"), F.col("_k.cells")
    share = F.coalesce(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0))  # halves: no overflow
    even = F.least(n - 1, F.floor(F.nanvl(share, F.lit(0.0)) * n))
    below = F.size(F.filter("_k.edges", lambda e: e < v))
    return F.when(F.col("_k.edges").isNull(), even).otherwise(2 * below + F.array_contains("_k.edges", v).cast("int")).cast("long")


def _with_edges(rows: DataFrame, brackets: DataFrame, keys: list[str], accuracy: int, spread: int | None) -> DataFrame:
    """Approximate percentiles of the brackets that equal widths do not separate."""
    probs = F.array(*[F.lit((i + 1) / (EDGES + 1)) for i in range(EDGES)])
    inside = _placed(rows, brackets, keys, spread)
    edges = inside.groupBy(*keys, F.col("_k.b").alias("_b")).agg(F.array_distinct(F.percentile_approx("_v", probs, F.lit(accuracy))).alias("_edges"))
    return brackets.drop("_edges").join(edges, [*keys, "_b"])


def _reached(counted: DataFrame, targets: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The targets moved to the entry of ``counted`` (``_b, at, n, lo, hi`` per group) that holds their rank."""
    lists = counted.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct(at, "n", "lo", "hi"))).alias("_list"))
    start = F.struct(F.col("_below").alias("below"), F.lit(None).cast(f"struct<{at}: {dict(counted.dtypes)[at]}, n: bigint, lo: double, hi: double>").alias("hit"))

    def step(state, entry):
        further = F.struct((state["below"] + entry["n"]).alias("below"), state["hit"].alias("hit"))
        here = F.struct(state["below"].alias("below"), entry.alias("hit"))
        return F.when(state["hit"].isNotNull(), state).when(state["below"] + entry["n"] > F.col("_rank"), here).otherwise(further)

    found = targets.drop("_list").join(lists, [*keys, "_b"]).withColumn("_f", F.aggregate("_list", start, step))
    return found.drop("_list").withColumns({"_below": F.col("_f.below"), "_hit": F.col("_f.hit")}).drop("_f")


def _narrowed(rows: DataFrame, targets: DataFrame, keys: list[str], most: int, cells: int, accuracy: int, spread: int | None) -> DataFrame:
    """One pass: every target's bracket becomes the counted cell that holds its rank."""
    wanted = F.least(F.lit(cells) * cells, F.greatest(F.lit(4), F.col("_inside") * 16 / most)).cast("long")
    brackets = _brackets(targets, keys).withColumns({"_cells": wanted, "_edges": F.lit(None).cast("array<double>")})
    brackets = stored(brackets, "quantile-brackets")
    crowded = brackets.filter("not _even")
    if not crowded.isEmpty():
        brackets = brackets.filter("_even").unionByName(_with_edges(rows, crowded, keys, accuracy, spread))
    met = _placed(rows, brackets, keys, spread)
    counted = met.groupBy(*keys, F.col("_k.b").alias("_b"), _cell().alias("_cell")).agg(
        F.sum("_w").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    # two levels, so that at most ``cells`` entries meet
    counted = stored(counted.withColumn("_part", F.expr(f"_cell div {cells}")), "quantile-cells")
    parts = counted.groupBy(*keys, "_b", "_part").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    named = targets.join(brackets.select(*keys, "_lo", "_hi", "_inside", "_even", "_b"), [*keys, "_lo", "_hi", "_inside", "_even"])
    coarse = _reached(parts, named, keys, "_part").withColumn("_part", F.col("_hit._part")).drop("_hit")
    finer = counted.join(coarse.select(*keys, "_b", "_part").distinct(), [*keys, "_b", "_part"], "left_semi")
    # several targets of a bracket can lie in different parts: the part is in the name from here on
    part_name = F.struct("_b", "_part")
    fine = _reached(
        finer.withColumn("_b", part_name), coarse.withColumn("_b", part_name), keys, "_cell"
    )
    return fine.select(
        *keys,
        "_rank",
        F.col("_hit.lo").alias("_lo"),
        F.col("_hit.hi").alias("_hi"),
        "_below",
        F.col("_hit.n").alias("_inside"),
        (F.col("_hit.n") * 4 <= F.col("_inside")).alias("_even"),
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    names: Mapping[str, float],
    keys: Sequence[str] = (),
    accuracy: int = 20_000,
    spread: int | None = None,
    most: int = 10_000,
    cells: int = 1024,
    weight: str | None = None,
) -> DataFrame:
    """One row per group with one column per entry of ``names`` (column -> probability).

    Nulls are ignored; a group of nothing else gives nulls. Null keys are not supported.
    ``weight`` names a column that says how often a row counts (for tables that are counted already).
    ``df`` is read once per pass, so a long plan should be stored first. ``most``: values of a
    bracket that may meet in one place; ``cells``: the same for counted cells; ``accuracy``: of the
    percentiles used as edges. ``spread`` goes to the join of brackets.
    """
    keys = list(keys)
    times = F.lit(1) if weight is None else F.col(weight)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), times.cast("long").alias("_w"))
    number = F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))), F.lit(0))
    groups = rows.groupBy(*keys).agg(number.alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    groups = stored(groups, "quantile-groups")
    rows = rows.filter("_v is not null and _w > 0")

    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(_position(p)), F.ceil(_position(p))) for p in names.values()])))
    targets = groups.filter("_n > 0").select(
        *keys, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"), F.lit(True).alias("_even")
    )
    # the ends are known
    end = F.when(F.col("_rank") == 0, F.col("_lo")).when(F.col("_rank") == F.col("_inside") - 1, F.col("_hi"))
    targets = targets.withColumns({"_lo": F.coalesce(end, "_lo"), "_hi": F.coalesce(end, "_hi")})
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_inside") > most)
    done = targets.filter(~wide)
    targets = stored(targets.filter(wide), "quantile-targets")
    while not targets.isEmpty():
        step = stored(_narrowed(rows, targets, keys, most, cells, accuracy, spread), "quantile-targets")
        done = done.unionByName(step.filter(~wide))
        targets = step.filter(wide)

    single = done.filter("_lo = _hi").select(*keys, "_rank", F.col("_lo").alias("_x"))
    several = done.filter("_lo < _hi")
    brackets = _brackets(several, keys).withColumns({"_cells": F.lit(1).cast("long"), "_edges": F.lit(None).cast("array<double>")})
    met = _placed(rows, brackets, keys, spread)
    counted = met.groupBy(*keys, F.col("_k.b").alias("_b"), F.col("_v").alias("lo")).agg(F.sum("_w").alias("n")).withColumn("hi", F.col("lo"))
    named = several.join(brackets.select(*keys, "_lo", "_hi", "_inside", "_even", "_b"), [*keys, "_lo", "_hi", "_inside", "_even"])
    picked = _reached(counted.withColumn("at", F.col("lo")), named, keys, "at").select(*keys, "_rank", F.col("_hit.lo").alias("_x"))
    answers = single.unionByName(picked).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_of"))
    found = groups.join(answers, keys, "left") if keys else with_scalars(groups, answers)

    def interpolated(p: float) -> Column:
        at = _position(p)
        left, right = F.try_element_at("_of", F.floor(at)), F.try_element_at("_of", F.ceil(at))
        between = F.when(left == right, left).otherwise(left + (right - left) * (at - F.floor(at)))
        return F.when(F.col("_n") > 0, between)

    return found.select(*keys, *[interpolated(p).alias(n) for n, p in names.items()])
