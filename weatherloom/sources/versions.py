"""Results that are replaced as a whole: every run writes a version of its own, a manifest names the current one.

The manifest is switched last, by one rename, so readers see either the old results or all of the new ones. The version
before stays for readers that have begun; older ones and those of failed runs go at the next switch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def new_version(output: str) -> str:
    """A folder for the tables of one run; nobody reads it before :func:`switch`."""
    return f"{output.rstrip('/')}/version-{uuid.uuid4().hex}"


def current_version(spark: SparkSession, output: str) -> str | None:
    """The folder that the manifest names, None before the first switch."""
    files, manifest = _files(spark, f"{output.rstrip('/')}/{MANIFEST}")
    if not files.exists(manifest):
        return None
    stream = files.open(manifest)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{output.rstrip('/')}/{name}"


def switch(spark: SparkSession, output: str, version: str) -> None:
    """Makes ``version`` the current one and removes all but it and the one before."""
    output, jvm = output.rstrip("/"), spark._jvm
    before, name = current_version(spark, output), version.rsplit("/", 1)[-1]
    files, temporary = _files(spark, f"{output}/{MANIFEST}-{uuid.uuid4().hex}")
    stream = files.create(temporary)
    stream.write(bytearray(name.encode()))
    stream.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(temporary), context.makeQualified(_files(spark, f"{output}/{MANIFEST}")[1]), overwrite)
    kept = {name, before.rsplit("/", 1)[-1] if before else None}
    for status in files.listStatus(_files(spark, output)[1]):
        found = status.getPath().getName()
        if found.startswith("version-") and found not in kept:
            files.delete(status.getPath(), True)


def read_published(spark: SparkSession, output: str, name: str) -> DataFrame:
    """A table of the current version."""
    version = current_version(spark, output)
    if version is None:
        raise ValueError(f"nothing is published in {output}")
    return spark.read.parquet(f"{version}/{name}")
