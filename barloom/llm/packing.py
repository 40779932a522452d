"""Packing documents into sequences along a Hilbert curve.

A document's token ids are hashed to a count vector, which a fixed random projection takes to few dimensions. The
projections, scaled by their extremes over all documents, are cells of a grid, and the Hilbert index of the cell orders
the documents: neighbours on the curve have similar vocabulary. A hash of the key breaks ties, so that a large group of
equal documents spreads over the ranges. The documents' ids, laid end to end in that order, are cut every `longest`
ids: all sequences are full but the last of the corpus.

The vectors are written once, with the ids. What is sorted is light: a document's place on the curve and its number of
ids, dealt to ranges by sampled bounds. Sums of the ranges, then running sums within each, tell where every document
begins in the stream, and each is cut by that alone, wherever its ids are. Nothing is gathered by the driver but the
extremes. A very long text costs its task what it is long.

Null text counts as empty: it has the end id alone. Rows may repeat, each is packed; equal places go in order of the rows. An empty table gives an empty
result. Keys are integers; a null key stays null. Other columns aren't carried.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

LONGEST, END = 4096, 2
DIMENSIONS, CELL_BITS, HASHED = 3, 10, 1024
#: Documents that a task holds at once.
AT_ONCE = 512


def projection(seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, DIMENSIONS))


def hashed_vector(ids: np.ndarray) -> np.ndarray:
    """Square roots of hashed counts, of length 1 (0 without ids)."""
    counts = np.sqrt(np.bincount((ids * np.uint32(2654435761)) >> np.uint32(22), minlength=HASHED))
    return counts / max(1.0, np.sqrt((counts * counts).sum()))


def hilbert_index(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer cells (rows of dimensions, each below 2**bits), after Skilling (2004)."""
    x = [c.astype(np.int64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            index = index << 1 | ((c ^ flip) >> b & 1)
    return index


def _vectors(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = projection()
        for b in batches:
            for k in range(0, b.num_rows, AT_ONCE):
                part = b.slice(k, AT_ONCE)
                ids, ends = tokens.encoder(vocabulary).encode(part.column(1))
                rows = [ids[a:z] for a, z in itertools.pairwise(ends.tolist())]
                at = np.array([hashed_vector(r) for r in rows]) @ plane
                narrow = [np.append(r, np.uint32(end)).astype("<u2" if not len(r) or r.max() < 65536 else "<u4").tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ends) + 1), *[pa.array(at[:, j]) for j in range(DIMENSIONS)], pa.array(narrow, pa.binary())],
                    names=["key", "n", *[f"p{j}" for j in range(DIMENSIONS)], "ids"],
                )

    return run


def _cutter(longest: int, digest: bool):
    """Pieces of documents (key, n, ids, begin: their place in the stream)."""
    names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digest else "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, AT_ONCE) for x in batches for k in range(0, x.num_rows, AT_ONCE)):
            out: list[tuple] = []
            for key, n, ids, at in zip(*(b.column(c).to_pylist() for c in ("key", "n", "ids", "begin"))):
                ids, start = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4"), 0
                while start < n:
                    size = min(n - start, longest - at % longest)
                    piece = ids[start : start + size].tobytes()
                    out.append((key, start, size, n, at // longest, at % longest, zlib.crc32(piece) if digest else piece))
                    start, at = start + size, at + size
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for c, x in zip(columns, names)], names=names)

    return run


def pack(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", end: int = END, longest: int = LONGEST, range_rows: int = 1 << 20, digest: bool = False) -> DataFrame:
    """Pieces: key, start (in the document), length, doc_tokens, sequence_id, offset (in the sequence), ids (unsigned 32-bit; or their ids_crc32)."""
    spark = docs.sparkSession
    names = [f"p{j}" for j in range(DIMENSIONS)]
    columns = ", ".join(f"{c} double" for c in names)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(_vectors(vocabulary, end), f"key long, n long, {columns}, ids binary")
    vectors = common.cut(rows.withColumn("row", F.monotonically_increasing_id()), "pack-vectors", AT_ONCE)
    ends = vectors.agg(F.count(F.lit(1)), *[f(c) for c in names for f in (F.min, F.max)]).first()
    low = np.array([x or 0.0 for x in ends[1::2]])
    span = np.maximum(np.array([x or 0.0 for x in ends[2::2]]) - low, 1e-12)

    @F.pandas_udf("long")
    def curve(p0: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.Series:
        cells = np.clip((np.stack([p0, p1, p2], axis=1) - low) / span * (1 << CELL_BITS), 0, (1 << CELL_BITS) - 1).astype(np.int64)
        return pd.Series(hilbert_index(cells))

    light = vectors.select("row", "n", curve(*names).alias("curve"), F.xxhash64("key").alias("tie"))
    order = ["curve", "tie", "row"]
    ranges = max(-(-ends[0] // range_rows), common.parallelism(spark))
    ranged = common.cut(light.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "pack-curve")
    heads = common.starts(ranged.groupBy("part").agg(F.sum("n").alias("ids")), "part", "ids", "head").select("part", "head")
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("run", F.coalesce(F.sum("n").over(before), F.lit(0)))
    begins = inside.join(heads, "part").select("row", (F.col("head") + F.col("run")).alias("begin"))
    placed = vectors.select("row", "key", "n", "ids").join(begins, "row").select("key", "n", "ids", "begin")
    last = "ids_crc32 long" if digest else "ids binary"
    return placed.mapInArrow(_cutter(longest, digest), f"key long, start long, length long, doc_tokens long, sequence_id long, offset long, {last}").withColumnRenamed("key", key)


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, tokens.vocabulary("word_bpe_49k.json"), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed. Nulls, repeats and empty tables as in pack(); other columns aren't read."""
    return packed(docs)


def op5_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir))
