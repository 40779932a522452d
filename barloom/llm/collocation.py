"""Phrases of two to four words that occur together more often than their parts would suggest.

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and these into words. A phrase is frequent
if it occurs `least` times within pieces, overlaps included, in the texts of its language (null: `und`).

The corpus is counted in chunks of some megabytes of one language. A chunk's words become a stream of codes of its own,
with a code for what parts pieces. Counts of all chunks are added up by word; a chunk gets back ids and counts of those of its
own words that are frequent in the corpus, so nothing that grows with the corpus is broadcast. Neighbours in the stream
are pairs: words are ranked by falling count and pairs of ranks cut into tiles of 1024 x 1024. A tile with many
occurrences is a dense array that bincount addresses directly; all others are one sorted list of coordinates with counts.
Frequent pairs are ranked in turn and replace the words of the stream, so that a pair of neighbouring pairs,
which share a word, is a phrase of three words, and a pair of these one of four. Every part of a frequent phrase is
frequent, so no phrase is missed and no other is ever counted.

Each (chunk, phrase) is one row, so a phrase, however frequent, has at most one row for each chunk. Null and empty texts
have no words; repeated rows count as often as they occur; an empty table gives no phrases. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer one that holds it occurs at least this often, in percent of it.
HELD = 80
#: Bytes of the texts of a chunk; a task's buffers of all languages together hold at most four times as many.
CHUNK = 16 << 20
TILE_BITS = 10
#: Occurrences from which a tile is counted in a dense array: an eighth of its cells.
DENSE = 1 << 2 * TILE_BITS - 3

#: Rows that are handed back to Spark together.
AT_ONCE = 1 << 16

#: Bits that tell which rows may be of a frequent phrase (8 MB).
MARKS = 1 << 26

_PARTS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", b"\n" * 10)
_WORD = re.compile(rb"\n|[^\x20\x09\n]+")
_STREAM = "chunk long, stream binary, code int, n long"


def packed(codes: np.ndarray) -> bytes:
    """Codes as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i4")


class _Chunk:
    """The stream of one language in one task, until it is written. Code 0 parts pieces."""

    def __init__(self) -> None:
        self.codes, self.streams, self.size = {b"\n": 0}, [], 0

    def add(self, text: str) -> None:
        data, codes = text.encode().lower().translate(_PARTS), self.codes
        found = _WORD.findall(data)
        for w in set(found).difference(codes):
            codes[w] = len(codes)
        self.streams.append(np.array([*map(codes.__getitem__, found), 0], np.int32))
        self.size += len(data)

    def table(self, chunk: int, lang: str, schema: pa.Schema) -> pa.RecordBatch:
        stream = np.concatenate(self.streams)
        counts = np.bincount(stream, minlength=len(self.codes))[1:]
        words = [w.decode() for w in self.codes][1:]
        return _rows(schema, chunk, packed(stream), counts, lang=pa.repeat(pa.scalar(lang, pa.string()), len(words)), word=pa.array(words, pa.string()))


def _rows(schema: pa.Schema, chunk: int, stream: bytes | None, counts: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    """A row with the stream, and one for each code from 1 on."""
    n = len(counts)
    own = {"chunk": pa.array(np.full(n + 1, chunk)), "stream": pa.concat_arrays([pa.array([stream], pa.binary()), pa.nulls(n, pa.binary())])}
    own |= {k: pa.concat_arrays([pa.nulls(1, v.type), v]) for k, v in {"code": pa.array(np.arange(1, n + 1, dtype=np.int32)), "n": pa.array(counts.astype(np.int64)), **columns}.items()}
    return pa.RecordBatch.from_arrays([own[f.name] for f in schema], schema=schema)


_FIELDS = [("chunk", pa.int64()), ("stream", pa.binary()), ("code", pa.int32()), ("n", pa.int64())]
_WORDS, _PAIRS = pa.schema([*_FIELDS, ("lang", pa.string()), ("word", pa.string())]), pa.schema([*_FIELDS, ("head", pa.int64()), ("tail", pa.int64())])


def _word_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, number, open_ = TaskContext.get().partitionId() << 32, 0, {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            part = open_.setdefault(lang, _Chunk())
            part.add(text)
            full = [lang] if part.size >= CHUNK else list(open_) if sum(p.size for p in open_.values()) >= 4 * CHUNK else []
            for done in full:
                yield open_.pop(done).table(first + number, done, _WORDS)
                number += 1
    for lang, part in open_.items():
        yield part.table(first + number, lang, _WORDS)
        number += 1


def count_pairs(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of ranks below n: the code of each occurrence (from 0), and of each code the ranks and the count."""
    low, width = (1 << TILE_BITS) - 1, (n >> TILE_BITS) + 1
    tile = (i >> TILE_BITS).astype(np.int64) * width + (j >> TILE_BITS)
    order = np.argsort(tile, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(tile[order])) + 1, len(order)) if len(order) else np.empty(0, np.int64)
    codes, found, base, sparse, begin = np.empty(len(i), np.int64), [], 0, [], 0
    for end in ends.tolist():
        at, begin = order[begin:end], end
        if len(at) < DENSE:
            sparse.append(at)
            continue
        cell = (i[at] & low) << TILE_BITS | (j[at] & low)
        counts = np.bincount(cell, minlength=1 << 2 * TILE_BITS)
        kept = np.flatnonzero(counts)
        code_of = np.empty(len(counts), np.int64)
        code_of[kept] = np.arange(base, base + len(kept))
        codes[at] = code_of[cell]
        row, column = divmod(int(tile[at[0]]), width)
        found.append(((row << TILE_BITS) + (kept >> TILE_BITS), (column << TILE_BITS) + (kept & low), counts[kept]))
        base += len(kept)
    if sparse:
        # As np.unique does it, with fewer arrays of all occurrences at once.
        at = np.concatenate(sparse)
        del sparse, order, tile
        pair = i[at].astype(np.int64) * n + j[at]
        by_pair = np.argsort(pair)
        at, pair = at[by_pair], pair[by_pair]
        del by_pair
        new = np.append(True, pair[1:] != pair[:-1])
        codes[at] = base - 1 + np.cumsum(new)
        kept, counts = pair[new], np.diff(np.append(np.flatnonzero(new), len(pair)))
        found.append((kept // n, kept % n, counts))
    heads, tails, counts = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    return codes, heads, tails, counts


def _pair_streams(last: bool):
    def pairs(key: tuple, streams: pa.Table, known: pa.Table) -> pa.Table:
        """The pairs of neighbours of a chunk whose codes are all known, and the stream of these pairs."""
        stream = unpacked(streams["stream"][0].as_py())
        code, ids = known["own"].to_numpy(), known["id"].to_numpy()
        by_rank = np.lexsort((ids, -known["f"].to_numpy()))
        rank = np.full(max(stream.max(initial=0), code.max(initial=0)) + 1, -1, np.int32)
        rank[code[by_rank]] = np.arange(len(code))
        ranks, ids = rank[stream], ids[by_rank]
        at = np.flatnonzero((ranks[:-1] >= 0) & (ranks[1:] >= 0))
        left, right = ranks[at], ranks[at + 1]
        del rank, ranks
        codes, heads, tails, counts = count_pairs(left, right, max(len(ids), 1))
        del left, right
        # Codes in order of their ids: rows that follow each other are alike, so they take less room on disk.
        order = np.lexsort((ids[tails], ids[heads]))
        code_of = np.empty(len(order), np.int64)
        code_of[order] = np.arange(1, len(order) + 1)
        following = np.zeros(len(stream), np.int32)
        following[at] = code_of[codes]
        del at, codes, code_of, stream
        heads, tails, counts = ids[heads[order]], ids[tails[order]], counts[order]
        out = _rows(_PAIRS, key[0].as_py(), None if last else packed(following), counts, head=pa.array(heads, pa.int64()), tail=pa.array(tails, pa.int64()))
        # In batches, so that neither side holds all rows a second time.
        return pa.Table.from_batches([out.slice(k, AT_ONCE) for k in range(0, out.num_rows, AT_ONCE)])

    return pairs


def _parted(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a stream, and rows of codes, written to folders of their own by one job: the codes go once they are counted."""
    spark, path = df.sparkSession, common.new_path(df.sparkSession, label)
    with common.tidy(spark), common.setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "2"):
        df.withColumn("kind", F.when(F.col("code").isNull(), "stream").otherwise("code")).write.partitionBy("kind").parquet(path)

    def part(kind: str, columns: list[str]) -> DataFrame:
        place, schema = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}"), df.select(*columns).schema
        some = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
        return spark.read.schema(schema).parquet(f"{path}/kind={kind}") if some else spark.createDataFrame([], schema)

    return part("stream", ["chunk", "stream"]), part("code", [c for c in df.columns if c != "stream"])


def _marked(rows: DataFrame, keys: list[str], least: int) -> Column:
    """Whether a row's keys may be frequent, by one of MARKS bits that the frequent ones set: a table of bounded size, and
    the fewer it lets through the less is shuffled. No frequent one is missed, so what is counted of the others' rows is whole."""
    mark = F.pmod(F.xxhash64(*keys), F.lit(MARKS))
    counted = rows.groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    words = counted.groupBy(F.floor(mark / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(mark, F.lit(64)).cast("int"))).alias("b"))
    words = common.cut(words, "marks")  # at most MARKS / 64 rows; once it is written, what was shuffled for it goes
    found = words.toArrow()
    common.discard(words)
    bits = np.zeros(MARKS // 64, np.int64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    held = rows.sparkSession.createDataFrame(pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))})).scalar()
    return F.call_function("shiftright", F.get(held, F.floor(mark / 64).cast("int")), F.pmod(mark, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _known(codes: DataFrame, keys: list[str], least: int, label: str) -> DataFrame:
    """The chunks' codes that are frequent in the corpus: part (the chunk), own (the code), f, id; the keys in one row of each id."""
    alike = Window.partitionBy(*keys)
    rows = codes.select("chunk", "code", *keys, "n")
    rows = rows.filter(_marked(rows, keys, least)).withColumn("f", F.sum("n").over(alike))
    kept = rows.filter(F.col("f") >= least).withColumn("row", F.monotonically_increasing_id()).withColumn("id", F.min("row").over(alike))
    return common.cut(kept.select(F.col("chunk").alias("part"), F.col("code").alias("own"), "f", "id", *[F.when(F.col("row") == F.col("id"), F.col(k)).alias(k) for k in keys]), label)


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 a / (l + r)), exactly."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(38,0)") * a.cast("decimal(20,0)"), wide(l.cast("decimal(20,0)") + r.cast("decimal(20,0)")))


def _following(streams: DataFrame, known: DataFrame, last: bool, label: str) -> tuple[DataFrame, DataFrame]:
    """The next streams and their pairs, by chunk."""
    own = known.select("part", "own", "f", "id")
    return _parted(streams.groupBy("chunk").cogroup(own.groupBy("part")).applyInArrow(_pair_streams(last), f"{_STREAM}, head long, tail long"), label)


def frequent(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and for each length the frequent phrases.

    Of words: lang, word, f, id. Of longer phrases: head, tail (ids of the phrases without the last and without the
    first word), f, id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    with common.batches_of(spark, 512), common.setting(spark, "spark.sql.parquet.compression.codec", "zstd"):
        streams, codes = _parted(rows.mapInArrow(_word_streams, f"{_STREAM}, lang string, word string"), "words")
        totals = common.cut(codes.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        keys, found = ["lang", "word"], []
        for length in range(1, longest + 1):
            known = _known(codes, keys, least, f"known{length}")
            common.discard(codes)
            found.append(common.cut(known.filter(F.col(keys[0]).isNotNull()).select(*keys, "f", "id"), f"phrases{length}"))
            if length < longest:
                old, (streams, codes) = streams, _following(streams, known, length + 1 == longest, f"pairs{length + 1}")
                common.discard(old)
            common.discard(known)
            keys = ["head", "tail"]
    return totals, found


def scored(found: list[DataFrame]) -> list[DataFrame]:
    """For each length from 2 on: lang, id, phrase, f, l, r, score of the lowest cut, held (the most frequent longer phrase that holds it)."""
    words = found[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("firsts"), F.array("f").alias("lasts"))
    shorter, out = words, []
    for level in found[1:]:
        # firsts: counts of its first 1, 2, ... words (all included); lasts: of its last 1, 2, ... words.
        head = shorter.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("begin"), F.col("firsts").alias("before"))
        tail = shorter.select(F.col("id").alias("tail"), "last", F.col("lasts").alias("after"))
        own = level.join(head, "head").join(tail, "tail")
        own = own.select("lang", "id", "head", "tail", "f", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "before", "after", F.concat("before", F.array("f")).alias("firsts"), F.concat("after", F.array("f")).alias("lasts"))
        shorter = own = common.cut(own, "scored")
        cuts = F.transform("before", lambda l, k: F.struct(_score(F.col("f"), l, F.get("after", F.size("after") - 1 - k)).alias("score"), k.alias("k"), l.alias("l"), F.get("after", F.size("after") - 1 - k).alias("r")))
        out.append(own.withColumn("cut", F.array_min(cuts)).select("lang", "id", "head", "tail", "phrase", "f", "cut.l", "cut.r", "cut.score"))
    held = []
    for level, longer in zip(out, [*out[1:], None]):
        if longer is None:
            held.append(level.withColumn("held", F.lit(0).cast("long")))
        else:
            parts = longer.select(F.col("head").alias("id"), "f").unionByName(longer.select(F.col("tail").alias("id"), "f"))
            most = parts.groupBy("id").agg(F.max("f").alias("held"))
            held.append(level.join(most, "id", "left").withColumn("held", F.coalesce("held", F.lit(0))))
    return [h.select("lang", "id", "phrase", "f", "l", "r", "score", "held") for h in held]


def collocations(docs: DataFrame, *, top: int = TOP, held: int = HELD, **how) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score. A phrase that a longer one nearly always holds is left out."""
    totals, found = frequent(docs, **how)
    levels = scored(found)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    kept = every.filter(F.col("held").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * held)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def op13_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3), (4)) ks(k) WHERE len(w) >= k)),
counted AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS MATERIALIZED (SELECT lang, k AS words, phrase, string_split(phrase, ' ') AS w, f AS a FROM counted WHERE k >= 2),
split AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, words)) AS k FROM cand)),
cuts AS MATERIALIZED (
  SELECT c.*, p.f AS l, s.f AS r, (2000000::HUGEINT * c.a // (p.f::HUGEINT + s.f))::BIGINT AS score
  FROM split c JOIN counted p ON p.lang = c.lang AND p.phrase = c.head JOIN counted s ON s.lang = c.lang AND s.phrase = c.tail),
best AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS MATERIALIZED (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS held
  FROM (SELECT *, unnest(range(1, words - j + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS j FROM cand)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN parts p ON p.lang = b.lang AND p.phrase = b.phrase WHERE coalesce(100::HUGEINT * p.held < 80::HUGEINT * b.a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
