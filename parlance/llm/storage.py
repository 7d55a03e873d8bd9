"""The shared folder in which operators keep intermediate tables.

A lazy result may read such a table, so an operator can't remove it; ``scratch`` removes those that were made within.
The others of an application are in one folder, ``application_dir``, for its owner to remove.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.shared import checkpointed, shared_dir

__all__ = ["application_dir", "checkpointed", "new_path", "scratch", "shared_dir", "small_side", "written"]

_within: ContextVar[str | None] = ContextVar("scratch", default=None)


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/parlance/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_within.get() or application_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all tables that are made within; it is removed at the end, so nothing lazy may leave it."""
    folder = new_path(spark, "scratch")
    token = _within.set(folder)
    try:
        yield folder
    finally:
        _within.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join, broadcast if it has ``rows`` rows at most; it is read twice, so it should be stored."""
    return F.broadcast(df) if df.count() <= rows else df
