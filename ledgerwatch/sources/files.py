"""Scratch folders and partition maintenance on the file system Spark writes to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerwatch.session import checkpoint_root


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and go on from the files.

    As cut_lineage(), but later plans read single columns and know the size, so that small tables need no shuffle.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def partitions(spark: SparkSession, path: str, column: str) -> dict[str, str]:
    """Partition values of the first level below ``path`` and their folders (a listing, no data)."""
    fs, where = _fs(spark, path)
    found = {}
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{column}="):
            found[name.split("=", 1)[1]] = status.getPath().toString()
    return found


def drop_listed(spark: SparkSession, path: str, column: str, values: set[str]) -> None:
    """Delete the partitions with these values."""
    for value, folder in partitions(spark, path, column).items():
        if value in values:
            fs, where = _fs(spark, folder)
            fs.delete(where, True)


def drop_partitions(spark: SparkSession, path: str, column: str, before: str) -> list[str]:
    """Delete the partitions whose value sorts before the cutoff; return their values."""
    old = {v: p for v, p in partitions(spark, path, column).items() if v < before and not v.startswith("__")}
    for folder in old.values():
        fs, where = _fs(spark, folder)
        fs.delete(where, True)
    return sorted(old)
