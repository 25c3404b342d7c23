"""Paths as Spark's own readers see them, and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}").rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder; an error where there is nothing."""
    store, at = _at(spark, path)
    return store.getFileStatus(at).isDirectory()


def new_folder(spark: SparkSession, name: str, below: str | None = None) -> str:
    """An empty folder below ``below``, else below ``siltstone/`` in the shared folder."""
    path = f"{below or f'{shared_folder(spark)}/siltstone'}/{name}-{uuid.uuid4().hex}"
    store, at = _at(spark, path)
    store.mkdirs(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there, and a lost executor costs a reread."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    store, at = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of change (in milliseconds) of a file, or of all data files of a folder."""
    store, at = _at(spark, path)
    files = [f for f in store.listStatus(at) if f.isFile() and f.getPath().getName()[0] not in "._"]
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)


def pointed(spark: SparkSession, pointer: str) -> str | None:
    """The folder that a pointer names. Two builders may both have written one: either folder is whole, the first by name counts."""
    if not exists(spark, f"{pointer}/_SUCCESS"):
        return None
    return min(r["folder"] for r in spark.read.schema("folder string").parquet(pointer).collect())


def point(spark: SparkSession, pointer: str, folder: str) -> str:
    """Makes a folder that is whole now the pointer's, unless it has one; returns the one that counts."""
    if pointed(spark, pointer) is None:
        spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("append").parquet(pointer)
    return pointed(spark, pointer)


def spread(table: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than there are cores (few, large row groups) is dealt out before costly work; others stay as they are."""
    n = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= n else table.repartition(n)
