"""Readers for series text, city CSV files and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CITY_CSV_SCHEMA = T.StructType(
    [
        T.StructField("dt", T.StringType()),
        T.StructField("AverageTemperature", T.StringType()),
        T.StructField("AverageTemperatureUncertainty", T.StringType()),
        T.StructField("City", T.StringType()),
        T.StructField("Country", T.StringType()),
        T.StructField("Latitude", T.StringType()),
        T.StructField("Longitude", T.StringType()),
    ]
)


def parse_series_lines(lines: DataFrame, keep_unparsed: bool = True) -> DataFrame:
    """``year month temperature uncertainty`` from the text column ``value``.

    Comment (``%``) and blank lines are dropped. With ``keep_unparsed`` a line that does
    not parse stays as a row of nulls for the cleaning step to count; without it only lines
    with three fields and a whole year, month and temperature remain.
    """
    text = F.trim(F.col("value"))
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")

    def whole(i: int) -> Column:
        return F.get(fields, F.lit(i)).try_cast("double").try_cast("int")

    def number(i: int) -> Column:
        return F.get(fields, F.lit(i)).try_cast("double")

    rest = [c for c in lines.columns if c != "value"]
    kept = lines.filter((text != "") & ~text.startswith("%"))
    if not keep_unparsed:
        kept = kept.filter(F.size(fields) >= 3)
    out = kept.select(
        *rest,
        whole(0).alias("year"),
        whole(1).alias("month"),
        number(2).alias("temperature"),
        number(3).alias("uncertainty"),
    )
    if not keep_unparsed:
        out = out.dropna(subset=["year", "month", "temperature"])
    return out


def read_series_text(
    spark: SparkSession, path: str, keep_unparsed: bool = True, with_source: bool = False
) -> DataFrame:
    """One file, a directory or a glob; ``with_source`` keeps the file name per row."""
    lines = spark.read.text(path)
    if with_source:
        lines = lines.select("value", F.col("_metadata.file_name").alias("source"))
    return parse_series_lines(lines, keep_unparsed)


def read_city_csv(spark: SparkSession, path: str) -> DataFrame:
    """City temperatures in the canonical schema; rows without date or value are dropped."""
    raw = (
        spark.read.schema(CITY_CSV_SCHEMA)
        .option("header", True)
        .option("mode", "DROPMALFORMED")
        .csv(path)
    )
    return (
        raw.select(
            "dt",
            F.col("AverageTemperature").try_cast("double").alias("temperature"),
            F.col("AverageTemperatureUncertainty").try_cast("double").alias("uncertainty"),
            F.col("City").alias("city"),
            F.col("Country").alias("country"),
            F.col("Latitude").alias("latitude"),
            F.col("Longitude").alias("longitude"),
            F.try_to_date("dt", "yyyy-MM-dd").alias("date"),
        )
        .dropna(subset=["date", "temperature"])
        .withColumns({"year": F.year("date"), "month": F.month("date")})
    )


def read_table(
    spark: SparkSession,
    path: str,
    years: tuple[int, int] | None = None,
    fallback: str | None = None,
) -> DataFrame:
    """Parquet table from any Hadoop file system, with an optional inclusive year range.

    The range is an ordinary filter, so it prunes partitions or reaches the scan.
    ``fallback`` is read when ``path`` does not exist.
    """
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        if fallback is None:
            raise
        df = spark.read.parquet(fallback)
    return df if years is None else df.filter(F.col("year").between(*years))
