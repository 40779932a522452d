"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="barloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only on a single machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/barloom-{uuid.uuid4().hex}/{label}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """For the jobs run inside: a setting of the session."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(spark: SparkSession):
    """For the jobs run inside: their shuffle files go when they end."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """df, written to the shared folder and read back: later jobs survive the loss of any executor, and plans stay short."""
    path = new_path(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
