"""Shards of a corpus in random order: a two-pass external shuffle.

Pass one scatters the records by a seeded hash into buckets that fit in memory. Pass two shuffles each bucket by
Fisher-Yates (the built-in shuffle of an array) and writes it: the shuffled stream, bucket after bucket, is cut into
shards, so a bucket goes to one shard or two at their border, and no record moves again. The law that holds is `rows`:
the row counts of any two shards differ by one at most, and slots have no gaps.

The number of buckets follows from the bytes of the corpus alone and each bucket is a partition with a seed of its own,
whose rows are put in order before the shuffle. So the order follows from the seed and from how the input is split, not
from the executors, and a lost bucket comes out the same again. The hash covers key and text, so neither a hot key nor a
large group of copies meets in one bucket; of rows equal in both, every `group` go to a bucket. Null text has no bytes.
Rows may repeat, keys may be null: every row gets a place of its own. A very long text makes its bucket larger by that.
An empty table gives an empty result. Extra columns travel along, whatever their names; columns named shard or slot are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 24


def byte_size(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def external_shuffle(docs: DataFrame, shards: int = SHARDS, *, key: str = "doc_id", text: str = "text", bucket_bytes: int = 16 << 20, seed: int = 7, group: int = 64) -> DataFrame:
    """docs, each row with its shard (0 to shards - 1) and slot in it (gapless from 0)."""
    ends = docs.agg(F.coalesce(F.sum(byte_size(text)), F.lit(0)), F.count(F.lit(1))).first()
    buckets, total = max(-(-ends[0] // bucket_bytes), 1), max(ends[1], 1)
    # Rows equal in key and text part by where they are read; which of them goes where makes no difference.
    part = F.floor(F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)) / group)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text), part), F.lit(buckets)).cast("int")
    scattered = common.carried(docs, ("shard", "slot"), bucket=bucket, key=F.col(key), digest=F.xxhash64(text))
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # A table of known size: Spark broadcasts the bases where they are few, else merges.
    bases = common.cut(common.starts(counts, "bucket", "n", "base").select(F.col("bucket").alias("b"), "base"), "bases")
    # The grouping finds each bucket in its partition.
    dealt = scattered.join(bases, F.col("bucket") == F.col("b")).repartitionById(buckets, "bucket")
    record = F.struct("key", "digest", "row")
    shuffled = dealt.groupBy("bucket", "base").agg(F.shuffle(F.array_sort(F.collect_list(record), _by_digest), seed).alias("records"))
    rows = shuffled.select("base", F.posexplode("records").alias("at", "record")).select((F.col("base") + F.col("at")).alias("place"), F.col("record.row").alias("row"))
    shard = F.floor(((F.col("place") + 1) * shards - 1) / total).cast("int")
    return rows.select("row.*", shard.alias("shard"), (F.col("place") - F.floor(shard.cast("long") * total / shards)).cast("long").alias("slot"))


def _by_digest(a: Column, b: Column) -> Column:
    """Order of records; those equal in key and digest of the text are alike."""
    x, y = F.struct(a.key, a.digest), F.struct(b.key, b.digest)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; a bucket's rows go to one file of it, or of two shards, in slot order."""
    with common.tidy(placed.sparkSession):
        placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path).select(*[F.col(f"`{c}`") for c in like.columns])


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document, from the shards as they were written."""
    placed = external_shuffle(common.documents(spark, sf_dir).select("doc_id", "text"))
    path = common.new_path(spark, "shards")
    write_shards(placed, path)
    return read_shards(spark, path, placed).select(
        "doc_id", byte_size().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
