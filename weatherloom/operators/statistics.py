"""Trends, correlations, descriptive statistics and independence tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weatherloom.functions.probability import chi_square_tail, student_two_sided
from weatherloom.operators.joining import with_scalars
from weatherloom.operators.quantiles import exact_quantiles


def trend_line(year_table: DataFrame, value: str = "avg_temperature") -> DataFrame:
    """Fitted line and slopes on every row; null where fewer than two years exist."""
    fit = year_table.agg(
        F.regr_slope(value, "year").alias("_slope"), F.regr_intercept(value, "year").alias("_at0")
    )
    return (
        with_scalars(year_table, fit)
        .withColumns(
            {
                "trend_line": F.col("_slope") * F.col("year") + F.col("_at0"),
                "trend_slope_per_year": F.col("_slope"),
                "trend_slope_per_decade": F.col("_slope") * 10,
            }
        )
        .drop("_slope", "_at0")
    )


def trend_summary(
    year_table: DataFrame, value: str = "avg_temperature", keys: Sequence[str] = ()
) -> DataFrame:
    return year_table.groupBy(*keys).agg(
        F.regr_slope(value, "year").alias("slope_per_year"),
        (F.regr_slope(value, "year") * 10).alias("slope_per_decade"),
        F.regr_r2(value, "year").alias("r_squared"),
        F.min("year").alias("start_year"),
        F.max("year").alias("end_year"),
        F.count(value).alias("years_of_data"),
    )


def trend_significance(
    year_table: DataFrame, value: str = "avg_temperature", keys: Sequence[str] = ()
) -> DataFrame:
    """Least squares with standard error and two-sided p-value, for the table or per key."""
    sums = year_table.groupBy(*keys).agg(
        F.regr_slope(value, "year").alias("slope"),
        F.regr_intercept(value, "year").alias("intercept"),
        F.regr_r2(value, "year").alias("r_squared"),
        F.regr_sxx(value, "year").alias("_sxx"),
        F.regr_sxy(value, "year").alias("_sxy"),
        F.regr_syy(value, "year").alias("_syy"),
        F.count(value).alias("n"),
    )
    dof = F.col("n") - 2
    residual = F.greatest(
        F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0)
    )
    error = F.when(dof > 0, F.sqrt(F.try_divide(F.try_divide(residual, dof), F.col("_sxx"))))
    t = F.try_divide(F.col("slope"), F.col("std_error"))
    out = sums.withColumn("std_error", error).withColumn("p_value", student_two_sided(t, dof))
    return out.select(
        *keys,
        "slope",
        (F.col("slope") * 10).alias("slope_per_decade"),
        "intercept",
        "r_squared",
        "std_error",
        "p_value",
        (F.col("p_value") < 0.05).alias("significant"),
        "n",
    )


def quadratic_trend(year_table: DataFrame, value: str = "avg_temperature") -> DataFrame:
    """Second-degree fit in the year: coefficients in plain years and R squared.

    The normal equations are solved from power sums of the *centred* year and value, which
    is one aggregate and well conditioned.
    """
    known = year_table.filter(F.col(value).isNotNull())
    centre = known.agg(F.avg("year").alias("_mx"), F.avg(value).alias("_my"))
    x, y = F.col("_x"), F.col("_y")
    centred = with_scalars(known, centre).select(
        "_mx", "_my", (F.col("year") - F.col("_mx")).alias("_x"), (F.col(value) - F.col("_my")).alias("_y")
    )
    s = centred.agg(
        F.any_value("_mx").alias("mx"),
        F.any_value("_my").alias("my"),
        F.count("_y").alias("n"),
        F.sum(x * x).alias("x2"),
        F.sum(x * x * x).alias("x3"),
        F.sum(x * x * x * x).alias("x4"),
        F.sum(x * y).alias("xy"),
        F.sum(x * x * y).alias("xxy"),
        F.sum(y * y).alias("yy"),
    )
    # centred sums make sum(x) = sum(y) = 0; eliminate the constant, then solve two by two
    var4 = F.col("x4") - F.col("x2") * F.col("x2") / F.col("n")
    det = F.col("x2") * var4 - F.col("x3") * F.col("x3")
    linear = F.try_divide(F.col("xy") * var4 - F.col("xxy") * F.col("x3"), det)
    square = F.try_divide(F.col("x2") * F.col("xxy") - F.col("x3") * F.col("xy"), det)
    fit = s.withColumns({"_b": linear, "_c": square})
    constant = F.col("my") - F.col("_c") * F.col("x2") / F.col("n")
    explained = F.col("_b") * F.col("xy") + F.col("_c") * F.col("xxy")
    return fit.select(
        (constant - F.col("_b") * F.col("mx") + F.col("_c") * F.col("mx") * F.col("mx")).alias("coef_0"),
        (F.col("_b") - 2 * F.col("_c") * F.col("mx")).alias("coef_1"),
        F.col("_c").alias("coef_2"),
        F.try_divide(explained, F.col("yy")).alias("r_squared"),
    )


def period_statistics(year_table: DataFrame, value: str = "avg_temperature") -> DataFrame:
    return year_table.agg(
        F.min("year").alias("start_year"),
        F.max("year").alias("end_year"),
        F.count("*").alias("years_of_data"),
        F.avg(value).alias("mean"),
        F.stddev(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def correlation_matrix(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Long Pearson matrix: all pairs in one aggregate, the lower half mirrored."""
    pairs = [(i, j) for i in range(len(variables)) for j in range(i, len(variables))]
    one = df.agg(*[F.corr(variables[i], variables[j]).alias(f"c_{i}_{j}") for i, j in pairs])

    def entry(i: int, j: int):
        c = F.col(f"c_{min(i, j)}_{max(i, j)}")
        return F.struct(
            F.lit(variables[i]).alias("variable_1"),
            F.lit(variables[j]).alias("variable_2"),
            c.alias("correlation"),
            F.abs(c).alias("abs_correlation"),
        )

    span = range(len(variables))
    return one.select(F.inline(F.array(*[entry(i, j) for i in span for j in span])))


def top_correlations(matrix: DataFrame, n: int = 10) -> DataFrame:
    """Strongest pairs, each once. The matrix has one row per pair of variables."""
    once = matrix.filter(F.col("variable_1") < F.col("variable_2"))
    return once.orderBy(F.desc("abs_correlation"), "variable_1", "variable_2").limit(n)


def descriptive_statistics(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Eleven statistics per variable (population skewness and excess kurtosis).

    Moments are one wide aggregate turned into rows afterwards; only the quartiles need the
    values in long form.
    """
    functions = {
        "count": F.count,
        "mean": F.avg,
        "std_dev": F.stddev,
        "min": F.min,
        "max": F.max,
        "skewness": F.skewness,
        "kurtosis": F.kurtosis,
    }
    wide = df.agg(
        *[f(v).cast("double").alias(f"{v}__{n}") for v in variables for n, f in functions.items()]
    )
    rows = [
        F.struct(F.lit(v).alias("variable"), *[F.col(f"{v}__{n}").alias(n) for n in functions])
        for v in variables
    ]
    moments = wide.select(F.inline(F.array(*rows)))
    values = [
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables
    ]
    long = df.select(F.inline(F.array(*values)))
    quartiles = exact_quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["variable"])
    return (
        moments.join(quartiles, "variable", "left")
        .withColumn("iqr", F.col("q3") - F.col("q1"))
        .select(
            "variable", "count", "mean", "std_dev", "min", "q1", "median", "q3", "max", "iqr",
            "skewness", "kurtosis",
        )
    )


def chi_square_tests(
    df: DataFrame, tests: Mapping[str, tuple[str, str]], alpha: float = 0.05
) -> DataFrame:
    """Independence tests of several pairs of category columns.

    The rows are counted once over all columns in use; each contingency table then comes
    from that small cube.
    """
    columns = sorted({c for pair in tests.values() for c in pair})
    cube = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    pairs = [
        F.struct(
            F.lit(name).alias("test"),
            F.lit(a).alias("variable_1"),
            F.lit(b).alias("variable_2"),
            F.col(a).cast("string").alias("_a"),
            F.col(b).cast("string").alias("_b"),
        )
        for name, (a, b) in tests.items()
    ]
    cells = (
        cube.select("_n", F.inline(F.array(*pairs)))
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .groupBy("test", "variable_1", "variable_2", "_a", "_b")
        .agg(F.sum("_n").alias("_o"))
    )
    row, col, whole = (Window.partitionBy("test", *k) for k in (["_a"], ["_b"], []))
    cells = cells.withColumns(
        {
            "_ra": F.sum("_o").over(row),
            "_cb": F.sum("_o").over(col),
            "_all": F.sum("_o").over(whole),
        }
    )
    # sum (o - e)^2 / e = sum o^2 / e - N, which also covers cells nobody observed
    # in doubles: the product of three counts leaves 64 bits at a few million rows
    o, whole_rows, row_rows, col_rows = (F.col(c).cast("double") for c in ("_o", "_all", "_ra", "_cb"))
    weight = o * o * whole_rows / (row_rows * col_rows)
    found = cells.groupBy("test", "variable_1", "variable_2").agg(
        (F.sum(weight) - F.max("_all")).alias("chi_square_statistic"),
        ((F.count_distinct("_a") - 1) * (F.count_distinct("_b") - 1)).cast("int").alias("degrees_of_freedom"),
    )
    tail = chi_square_tail(F.col("chi_square_statistic"), F.col("degrees_of_freedom"))
    return found.withColumn("p_value", F.when(F.col("degrees_of_freedom") > 0, tail)).withColumn(
        "is_significant", F.col("p_value") < alpha
    )


def daily_agreement(
    hourly: DataFrame, keys: Sequence[str], hourly_value: str, daily_value: str
) -> DataFrame:
    """Correlation of the mean of the hours of a day with that day's own value."""
    days = hourly.groupBy(*keys).agg(
        F.avg(hourly_value).alias("_hours"), F.any_value(daily_value).alias("_day")
    )
    return days.agg(F.corr("_hours", "_day").alias("correlation"), F.count("*").alias("days"))
