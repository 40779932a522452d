"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words in every operator of this subpackage.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


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


def cut(df: DataFrame, label: str, rows_at_once: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs survive the loss of any executor.

    rows_at_once: most rows that are handed to Python together, where they are long.
    """
    path = new_path(df.sparkSession, label)
    with batches_of(df.sparkSession, rows_at_once), tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """For the jobs run inside: a setting of the session."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batches_of(spark: SparkSession, rows: int):
    """For the jobs run inside: most rows of an Arrow batch."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)) if rows else contextlib.nullcontext()


def tidy(spark: SparkSession):
    """For the jobs run inside: their shuffle files go when they end."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't use."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def carried(docs: DataFrame, drop: tuple[str, ...] = (), **named: Column) -> DataFrame:
    """The named columns, and row: a struct of docs' own columns (but for drop). So no name of docs meets one of an operator's."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in drop]
    return docs.select(*[c.alias(name) for name, c in named.items()], (F.struct(*own) if own else F.struct(F.lit(0).alias("_none"))).alias("row"))


def starts(totals: DataFrame, key: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Running total of value before each key (a non-negative integer, one row each).

    Two levels: sums of blocks of keys run through one small window, rows run inside their block, so that no task
    holds more than 1/4096 of the keys or one block.
    """
    blocked = totals.withColumn("_block", F.floor(F.col(key) / block))
    heads = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_head"))
    inside = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return blocked.join(heads, "_block").withColumn(out, (F.col("_head") + run).cast("long")).drop("_block", "_head")
