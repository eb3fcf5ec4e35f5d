"""Helpers of the text operators: shared folder, stored tables, sorted lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of the contracts: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Cells of ``locate``; the broadcast table has this many rows.
CELLS = 4096
ROWS_PER_FILE = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet; Hadoop deletes it when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table that has no reader left."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends here and a lost executor costs no rerun.

    Where about ``rows`` light rows are known to come, they go to a file for every ROWS_PER_FILE of them (one per core at
    least), not to one for every shuffle partition.
    """
    path = new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_of(text: Column) -> Column:
    """60 uniform bits of a text's MD5, the same in every engine; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")


def part_of(column: str, remainder_of: int, name: str) -> Column:
    """CRC-32 of an id as text, modulo ``remainder_of``."""
    return (F.crc32(F.col(column).cast("string")) % remainder_of).alias(name)


def locate(df: DataFrame, splitters: DataFrame, key: Column, cell: Column, out: str) -> DataFrame:
    """Adds ``out``: how many splitters are at most ``key``.

    ``splitters`` has ``cell`` (0 to CELLS - 1, not decreasing with the key) and ``key``. The lookup table has CELLS rows
    that together hold every splitter once; callers bound the number of splitters.
    """
    lists = splitters.groupBy("cell").agg(F.sort_array(F.collect_list("key")).alias("_keys"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        df.sparkSession.range(CELLS)
        .select(F.col("id").cast("int").alias("_cell"))
        .join(F.broadcast(lists), F.col("_cell") == F.col("cell"), "left")
        .select("_cell", "_keys", F.coalesce(F.size("_keys"), F.lit(0)).alias("_n"))
        .withColumn("_n", F.when(F.col("_keys").isNull(), 0).otherwise(F.col("_n")))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    inside = F.size(F.filter("_keys", lambda k: k <= F.col("_key")))
    return (
        df.withColumns({"_key": key, "_at": cell})
        .join(F.broadcast(cells), F.col("_at") == F.col("_cell"), "left")
        .withColumn(out, (F.col("_base") + F.when(F.col("_keys").isNull(), 0).otherwise(inside)).cast("long"))
        .drop("_key", "_at", "_cell", "_keys", "_n", "_base")
    )


def running(df: DataFrame, cell: list[str], order: list[str], full: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Adds ``run``, the sum of ``size`` of the rows before a row in its cell, and ``number``, how many they are.

    ``full`` holds the cells with too many rows for one window. Key intervals cannot cut rows that repeat every sort
    column, so in those cells the window sees each different row once, with its count, and the repeats are written out
    again in chunks that any task can take.
    """
    before = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def add_up(rows: DataFrame, size, count) -> DataFrame:
        return rows.withColumns({"run": F.coalesce(F.sum(size).over(before), F.lit(0)), "number": F.coalesce(F.sum(count).over(before), F.lit(0))})

    if full.isEmpty():
        return add_up(df, F.col("size"), F.lit(1))
    full = full.select(*cell)
    plain = add_up(df.join(full, cell, "left_anti").select(*df.columns), F.col("size"), F.lit(1))
    counted = df.join(full, cell, "left_semi").groupBy(*df.columns).agg(F.count("*").alias("_n"))
    counted = add_up(counted, F.col("size") * F.col("_n"), F.col("_n"))
    chunks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long")))).repartition(*cell, "_from")
    last = F.least(F.col("_n"), F.col("_from") + chunk) - 1
    again = chunks.withColumn("_k", F.explode(F.sequence(F.col("_from"), last)))
    again = again.withColumns({"run": F.col("run") + F.col("_k") * F.col("size"), "number": F.col("number") + F.col("_k")})
    return plain.unionByName(again.select(*plain.columns))
