"""Token ids in a binary table of bit- or byte-plane blocks.

Documents are dealt by range of their key to shards, encoded, and each document's ids (an end id appended) are appended
to the shard's stream, which is cut into blocks of a fixed number of ids. A block is transposed: plane j holds bit (or
byte) j of every id. Each plane is compressed with zstandard by itself; equal high planes shrink to a few bytes. A file
of the table holds one shard: the entries of the documents that begin in a block (key, offset, number of ids), then the
block with its chunk index (the length of each compressed plane). Shards in order hold the corpus in key order.

Rows are ordered by key, then by a hash of the text, then by where they are read; null keys come first and null text is
empty (it has the end id alone). So the rows of a hot key, and rows equal in all, spread over shards; each is stored.
Shards are sized by the bytes of the corpus. A task that writes holds one block, a part of a batch and the entries of
the documents in it; one that reads, a block and the ids of a document, so a very long text costs what it is long. The
table is written by Spark's own writer: a task that is lost is run again and leaves no half file. Readers sort a shard's
rows by their number, however a store splits its file. An empty table gives an empty table. Other columns aren't stored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 16384
END = 0
#: Documents that a task encodes at once.
AT_ONCE = 512
SCHEMA = "shard int, row long, doc_id long, start long, n_tokens long, block long, n_ids int, kind string, plane_bytes array<int>, planes binary"


def pack_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> tuple[list[int], bytes]:
    """Lengths of the compressed planes, and the planes."""
    import zstandard

    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        raw = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    elif kind == "byte":
        raw = np.ascontiguousarray(raw.T)
    else:
        raise ValueError(f"planes are of kind bit or byte, not {kind}")
    packer = zstandard.ZstdCompressor(level=level)
    planes = [packer.compress(p.tobytes()) for p in raw]
    return [len(p) for p in planes], b"".join(planes)


def unpack_planes(lengths: list[int], data: bytes, n: int, kind: str = "byte") -> np.ndarray:
    import zstandard

    opener, ends = zstandard.ZstdDecompressor(), np.cumsum([0, *lengths])
    planes = [np.frombuffer(opener.decompress(data[a:b]), np.uint8) for a, b in zip(ends[:-1], ends[1:])]
    if kind == "bit":
        bits = np.stack([np.unpackbits(p, bitorder="little")[:n] for p in planes], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.stack(planes, axis=1).reshape(-1).view("<u4")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


_ARROW = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("block", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()), ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.binary())])


def _encoder(vocabulary: str, kind: str, block: int, end: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, row, start, number = TaskContext.get().partitionId(), 0, 0, 0
        rest, rows = np.empty(0, "<u4"), []

        def stored(ids: np.ndarray) -> tuple:
            lengths, planes = pack_planes(ids, kind)
            return (shard, row, None, None, None, number, len(ids), kind, lengths, planes)

        for b in batches:
            keys = b.column(0).to_pylist()
            for k in range(0, len(keys), AT_ONCE):
                ids, ends = tokens.encoder(vocabulary).encode(b.column(1).slice(k, AT_ONCE))
                stream = np.concatenate([rest, np.insert(ids, ends[1:], np.uint32(end))])
                sizes = (np.diff(ends) + 1).tolist()
                begun, at = deque(), start
                for key, n in zip(keys[k : k + AT_ONCE], sizes):
                    begun.append((key, at, n))
                    at += n
                start = at
                whole = len(stream) // block * block
                for j in range(0, whole, block):
                    while begun and begun[0][1] < (number + 1) * block:
                        rows.append((shard, row, *begun.popleft(), None, None, None, None, None))
                        row += 1
                    rows.append(stored(stream[j : j + block]))
                    row, number = row + 1, number + 1
                for x in begun:
                    rows.append((shard, row, *x, None, None, None, None, None))
                    row += 1
                rest = stream[whole:]
                if rows:
                    yield _batch(rows, _ARROW)
                    rows = []
        if len(rest):
            yield _batch([stored(rest)], _ARROW)

    return encode


def write_tokens(docs: DataFrame, path: str, vocabulary: str, *, key: str = "doc_id", text: str = "text", kind: str = "byte", block: int = BLOCK, end: int = END, shard_bytes: int = 16 << 20) -> None:
    """Encode docs into a table of plane blocks at path, one file a shard, shards in key order."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    shards = max(-(-total // shard_bytes), common.parallelism(docs.sparkSession))
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).withColumns({"_tie": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    order = ["_key", "_tie", "_row"]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("_key", "_text")
    with common.batches_of(docs.sparkSession, AT_ONCE):
        ordered.mapInArrow(_encoder(vocabulary, kind, block, end), SCHEMA).write.option("compression", "none").parquet(path)


def _decoder(digest: bool):
    """Documents with their ids (or the checksum of these) in order of the shards' rows. A document's entry stands before the block that it begins in."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, next_row, waiting, have = None, 0, deque(), []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["row"] == 0:
                    shard, next_row, waiting, have = r["shard"], 0, deque(), []
                if (r["shard"], r["row"]) != (shard, next_row):
                    raise ValueError(f"shard {r['shard']}: row {r['row']} follows row {next_row - 1} of shard {shard}")
                next_row += 1
                if r["planes"] is None:
                    waiting.append((r["doc_id"], r["start"], r["n_tokens"]))
                    continue
                ids = unpack_planes(r["plane_bytes"], r["planes"], r["n_ids"], r["kind"])
                at = 0
                while waiting:
                    need = waiting[0][2] - sum(map(len, have))
                    piece = ids[at : at + need]
                    have.append(piece)
                    at += len(piece)
                    if len(piece) < need:
                        break
                    doc_id, start, n = waiting.popleft()
                    data = have[0].tobytes() if len(have) == 1 else np.concatenate(have).tobytes()
                    out.append((shard, doc_id, start, n, zlib.crc32(data) if digest else data))
                    have = []
            if out:
                yield _batch(out, _DIGEST if digest else _READ)

    return decode


_HEAD = [("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]
_READ, _DIGEST = pa.schema([*_HEAD, ("ids", pa.binary())]), pa.schema([*_HEAD, ("ids_crc32", pa.int64())])


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """shard, doc_id, start (in the shard), n_tokens, ids (little-endian unsigned 32-bit), or ids_crc32 in their place."""
    table = spark.read.schema(SCHEMA).parquet(path).repartition("shard").sortWithinPartitions("shard", "row")
    return table.mapInArrow(_decoder(digest), f"shard int, doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, shard_start: ids in all shards before it, from the entries alone."""
    entries = spark.read.schema(SCHEMA).parquet(path).filter(F.col("n_tokens").isNotNull())
    sums = entries.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    return common.starts(sums, "shard", "_n", "shard_start").select("shard", "shard_start")


def op3_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    write_tokens(common.documents(spark, sf_dir), path, tokens.vocabulary("byte_bpe_50k.json"))
    placed = read_tokens(spark, path, digest=True).join(shard_starts(spark, path), "shard")
    return placed.select("doc_id", (F.col("shard_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
