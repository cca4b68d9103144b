"""Intermediate tables in the folder that driver and executors share: lineage ends there, and lost executors cost nothing."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_paths: WeakKeyDictionary = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Only where driver and executors are one process may it be unset: then the warehouse serves."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A path of its own in the shared folder, removed when the program ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again.

    Unlike a checkpoint the result has the size of its files, not one multiplied up from plan to plan in a loop.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the table behind a result of `durable` that nothing needs any more."""
    if path := _paths.pop(df, None):
        remove(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Remove the intermediate tables that the block makes when it ends: its results must be written or collected within it."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            remove(_written[path], path)


@atexit.register
def forget_all() -> None:
    """Remove all intermediate tables of this program; results that still read them can't be computed afterwards."""
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
