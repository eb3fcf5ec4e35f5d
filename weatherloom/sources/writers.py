"""Writers. None of them counts, sorts globally or collects before it writes."""

from __future__ import annotations

import re
import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; it is deleted when the session ends.

    The folder is the session's checkpoint folder. Without one, a local session gets its own, and a cluster is an error:
    there every executor would write to its own disk.
    """
    context = spark.sparkContext
    shared = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        shared = context.getCheckpointDir()
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    mode: str = "overwrite",
) -> str:
    """Parquet output. With partitions, ``overwrite`` replaces only the partitions written.

    Rows are gathered by the partition columns; adaptive execution splits a hot partition by its measured size and merges
    small ones.
    """
    out = df if columns is None else df.select([c for c in columns if c in df.columns])
    parts = [c for c in partition_by if c in out.columns]
    if not parts:
        out.write.mode(mode).parquet(path)
        return path
    out = out.hint("rebalance", *parts)
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return path


def write_storm_tracks(tracks: DataFrame, path: str, mode: str = "overwrite") -> str | None:
    """Tracks by year. Without any nothing is written, and tracks that an earlier run left at ``path`` go."""
    if tracks.isEmpty():
        target = tracks.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(tracks.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
        return None
    return write_table(tracks.withColumn("year", F.year("timestamp")), path, ["year"], mode=mode)


def write_text_results(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> str:
    if kind == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif kind == "json":
        df.write.mode(mode).json(path)
    else:
        raise ValueError(f"unknown result format: {kind}")
    return path
