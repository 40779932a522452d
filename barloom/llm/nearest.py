"""Nearest neighbours by inner product: lists of neighbouring vectors, scanned in column blocks and left early.

Vectors are scaled by the largest norm and get one more coordinate, which makes them unit vectors, so that a large inner
product is a small distance. A tree of balanced cuts, fitted on a bounded sample of distinct vectors (SAMPLE), gives the
centres of the lists; every distinct vector is filed under the nearest centre. How many lists a query visits is measured:
PILOTS queries, a bounded number, are compared with all vectors, and the lists that hold KNOWN of their neighbours are
visited.

Within a list, vectors and queries are turned by one random rotation and compared in column blocks. After each block a
candidate is left if the distance so far, scaled to all dimensions, exceeds the query's reach by more than the deviation
that a rotated vector shows with the confidence of EPSILON (the test of a random projection). The reach is that of the
query's 20th neighbour so far: a first round visits the nearest list alone, a second all others with its reach. What is
left gets its inner product from the original vectors in double precision.

Equal vectors are searched once: a class keeps its smallest ids, as no more can be among the nearest, and the number of
its queries. Lists and their visitors are cut into blocks of bounded size, so a hot list is many tasks. Results go back to
a class' queries by a join; those of the few classes that hold over a thousandth of all queries are broadcast.

Vectors that are null or zero, or hold null, NaN or infinite components, take no part, nor do rows without an id. Vectors
of other lengths than the most frequent one (the longer at a tie) are left out too. Rows that repeat an id are rows of
their own: one of them is the query's own, the others are candidates. Ties go to the smaller id. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Neighbours of a query, and every which id is a query.
NEAREST, EVERY = 20, 20
#: Distinct vectors that centres are fitted on, and that one centre stands for at least; most centres.
SAMPLE, A_CENTRE, CENTRES = 65_536, 8, 8192
#: Queries compared with all vectors, and the share of their neighbours that the visited lists hold.
PILOTS, KNOWN = 128, 0.98
#: Columns of a block; deviations that a test allows.
COLUMNS, EPSILON = 16, 2.1
#: Vectors and queries of a block of a list.
ROWS, VISITORS = 8192, 2048


def _order(vec: Column) -> Column:
    """A number drawn from a vector."""
    return F.xxhash64(F.lit(12), vec)


def classes(table: DataFrame, *, key: str, vec: str, every: int, nearest: int) -> DataFrame:
    """Distinct vectors: cid, vec, ids (the smallest nearest + 1, with repeats), queries (how many rows ask)."""
    v = F.col(vec).cast("array<double>")
    # An infinite component, like NaN, makes the sum of x - x NaN.
    rows = table.select(F.col(key).cast("long").alias("vec_id"), v.alias("vec"))
    finite = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x - x)) == 0.0
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    rows = rows.filter(F.size("vec") == (lengths.d if lengths else 0))
    # The smallest ids of each vector: the limit is applied in every task before rows are shuffled.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    small = rows.withColumn("_n", place).filter(F.col("_n") <= nearest + 1)
    ids = small.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.groupBy("vec").agg(F.count_if(F.col("vec_id") % every == 0).alias("queries"))
    return common.cut(ids.join(asked, "vec").withColumn("cid", F.monotonically_increasing_id()), "classes")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


class Space:
    """The unit vectors of an inner product, their rotation, and the lists' centres."""

    def __init__(self, largest: float, sample: np.ndarray, a_centre: int, seed: int = 7) -> None:
        self.largest = largest
        draw = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        q, r = np.linalg.qr(draw.standard_normal((d, d)))
        self.rotation = (q * np.sign(np.diag(r))).astype(np.float32)
        self.centres = self._tree(self.data(sample), a_centre, draw)

    def data(self, x: np.ndarray) -> np.ndarray:
        y = x / self.largest
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", y, y)))
        return np.column_stack([y, rest]).astype(np.float32) @ self.rotation

    def query(self, x: np.ndarray) -> np.ndarray:
        """As unit vectors too: the length of a query doesn't change what is nearest."""
        y = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.column_stack([y, np.zeros(len(y))]).astype(np.float32) @ self.rotation

    @staticmethod
    def _tree(x: np.ndarray, a_centre: int, draw: np.random.Generator) -> np.ndarray:
        """Means of the parts of a tree whose cuts are medians between two means: all parts are of like size."""
        parts, done = [np.arange(len(x))], []
        while parts:
            at = parts.pop()
            if len(at) < 2 * a_centre or len(done) + len(parts) + 2 > CENTRES:
                done.append(x[at].mean(axis=0))
                continue
            y = x[at]
            two = y[draw.choice(len(y), 2, replace=False)]
            for _ in range(4):
                near = y @ (two[0] - two[1]) > (two[0] @ two[0] - two[1] @ two[1]) / 2
                if near.all() or not near.any():
                    break
                two = np.stack([y[near].mean(axis=0), y[~near].mean(axis=0)])
            order = np.argsort(y @ (two[0] - two[1]), kind="stable")
            parts += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        return np.array(done, np.float32)

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centres of each row, nearest first."""
        far = (self.centres**2).sum(axis=1) - 2 * (x @ self.centres.T)
        if n >= far.shape[1]:
            return np.argsort(far, axis=1, kind="stable")
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


def scan(x: np.ndarray, q: np.ndarray, reach: np.ndarray, *, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, query) that no block's test abandons. reach: the squared distance that a query still cares for."""
    d = x.shape[1]
    so_far, rows, queries = None, None, None
    for begin in range(0, d, columns):
        end = min(begin + columns, d)
        xb, qb = x[:, begin:end], q[:, begin:end]
        if so_far is None:
            part = (xb**2).sum(axis=1)[:, None] + (qb**2).sum(axis=1) - 2 * (xb @ qb.T)
        else:
            part = ((xb[rows] - qb[queries]) ** 2).sum(axis=1)
        so_far = part if so_far is None else so_far + part
        allowed = reach * (1.0 if end == d else end / d * (1 + epsilon / np.sqrt(end)) ** 2) + 1e-5
        if rows is None:
            rows, queries = np.nonzero(so_far <= allowed)
            so_far = so_far[rows, queries]
        else:
            kept = so_far <= allowed[queries]
            rows, queries, so_far = rows[kept], queries[kept], so_far[kept]
    return rows, queries


_FOUND = "cid long, ids array<long>, score double, other long"


def _search(space: Space, nearest: int):
    """Of a block of a list and a block of its visitors: each visitor's nearest classes."""
    schema = pa.schema([("query", pa.int64()), ("other", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def run(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        x, q = _matrix(rows["vec"]), _matrix(asked["asked"])
        if not len(x) or not len(q):
            return schema.empty_table()
        turned, asking = space.data(x), space.query(q)
        norms = np.linalg.norm(q, axis=1) * space.largest
        least = asked["least"].to_numpy(zero_copy_only=False).astype(np.float64)
        copies = np.array([len(i) for i in rows["ids"].to_pylist()])
        # Without a reach, a few rows of the list itself give one.
        bare = np.flatnonzero(np.isnan(least))
        if len(bare):
            some = turned[:: max(1, len(turned) // 256)] @ asking[bare].T
            k = min(nearest, len(some) - 1)
            reached = -np.partition(-some, k, axis=0)[k] if len(some) > nearest else np.full(len(bare), -np.inf)
            least[bare] = reached * norms[bare] - 1e-6 * norms[bare]
        reach = 2 - 2 * least / norms
        row, query = scan(turned, asking, np.where(np.isfinite(reach), reach, 9.0))
        score = np.empty(len(row))
        for k in range(0, len(row), 1 << 16):
            score[k : k + (1 << 16)] = (x[row[k : k + (1 << 16)]] * q[query[k : k + (1 << 16)]]).sum(axis=1)
        first = np.array([i[0] for i in rows["ids"].to_pylist()])
        order = np.lexsort((first[row], -score, query))
        row, query, score = row[order], query[order], score[order]
        # Classes that hold the nearest + 1 rows of each visitor, copies counted.
        begin = np.searchsorted(query, np.arange(len(q)))
        held = np.cumsum(copies[row]) - copies[row]
        kept = held - held[begin[query]] <= nearest if len(row) else np.zeros(0, bool)
        row, query, score = row[kept], query[kept], score[kept]
        return pa.Table.from_arrays([asked["query"].take(pa.array(query)), rows["cid"].take(pa.array(row)), rows["ids"].take(pa.array(row)), pa.array(score)], schema=schema)

    return run


def _visit(filed: DataFrame, visits: DataFrame, space: Space, nearest: int) -> DataFrame:
    """All visits (list, query, asked, least): query, other, ids, score of what they find."""
    # Two small tables of at most CENTRES rows: how many blocks a list and its visitors make.
    blocks = filed.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    guests = visits.groupBy("list").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("guests"))
    both = F.broadcast(blocks.join(guests, "list"))
    rows = filed.join(both, "list").withColumn("block", F.pmod("cid", "blocks")).withColumn("guest", F.explode(F.sequence(F.lit(0), F.col("guests") - 1)))
    asked = visits.join(both, "list").withColumn("guest", F.pmod("query", "guests")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.col("block").cast("int").alias("block"), F.col("guest").cast("int").alias("guest"), "cid", "ids", "vec")
    asked = asked.select(F.col("list").alias("l"), F.col("block").cast("int").alias("b"), F.col("guest").cast("int").alias("g"), "query", "asked", "least")
    return rows.groupBy("list", "block", "guest").cogroup(asked.groupBy("l", "b", "g")).applyInArrow(_search(space, nearest), "query long, other long, ids array<long>, score double")


def _best(found: DataFrame, nearest: int) -> DataFrame:
    """Per query the nearest + 1 rows: query, hits (ordered structs of -score, vec_id)."""
    rows = found.select("query", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    kept = rows.withColumn("_n", place).filter(F.col("_n") <= nearest + 1)
    return kept.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("hits"))


def _pilot(known: DataFrame, pilots: list, space: Space, nearest: int) -> int:
    """How many lists hold the share KNOWN of what is nearest to the pilots, found by comparing them with every vector."""
    q = np.array([p.vec for p in pilots])
    own = np.array([p.cid for p in pilots])
    ranks = np.argsort(space.lists(space.query(q), len(space.centres)), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cid = _matrix(b.column(1)), b.column(0).to_numpy()
            score, at = x @ q.T, space.lists(space.data(x), 1)[:, 0]
            score[cid[:, None] == own] = -np.inf
            k = min(nearest, len(x))
            near = np.argpartition(-score, k - 1, axis=0)[:k]
            who = np.broadcast_to(np.arange(len(q)), near.shape)
            yield pa.RecordBatch.from_arrays([pa.array(who.ravel().astype(np.int32)), pa.array(score[near, who].ravel()), pa.array(ranks[who, at[near]].ravel().astype(np.int32))], ["pilot", "score", "visit"])

    place = F.row_number().over(Window.partitionBy("pilot").orderBy(F.desc("score")))
    near = known.select("cid", "vec").mapInArrow(run, "pilot int, score double, visit int").withColumn("_n", place).filter((F.col("_n") <= nearest) & (F.col("score") > float("-inf")))
    counts = dict(near.groupBy("visit").count().collect())  # at most one row for each list
    need, have = KNOWN * sum(counts.values()), 0
    for visit in sorted(counts):
        have += counts[visit]
        if have >= need:
            return visit + 1
    return 1


def search(table: DataFrame, *, key: str = "vec_id", vec: str = "embedding", every: int = EVERY, nearest: int = NEAREST, a_centre: int = A_CENTRE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by every, the nearest other rows."""
    spark = table.sparkSession
    known = classes(table, key=key, vec=vec, every=every, nearest=nearest)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    n, largest, asking = known.agg(F.count("*"), F.sqrt(F.max(square)), F.sum("queries")).first()
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Of n distinct vectors each is drawn by its hash, with the chance that gives the sample's size.
    low = -(2**63) + min(2**64 - 1, (2**64 - 1) * sample // n)
    drawn = known.filter(_order(F.col("vec")) <= low).orderBy(_order(F.col("vec")), "cid").limit(2 * sample).select("vec")
    fitted = _matrix((drawn if n > 1 else known.select("vec")).toArrow()["vec"])
    # Lists grow with the square root of the table, as the time of a query does; more rows of the sample make a centre better.
    centres = min(CENTRES, max(1, int(np.sqrt(n) * 2)))
    space = Space(largest or 1.0, fitted, max(a_centre, len(fitted) // centres))
    pilots = known.filter("queries > 0").orderBy(_order(F.col("vec"))).limit(PILOTS).select("cid", "vec").collect()
    visits = _pilot(known, pilots, space, nearest)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, asks = _matrix(b.column(1)), b.column(3).to_numpy() > 0
            at = space.lists(space.data(x), 1)[:, 0].astype(np.int32)
            ways = np.empty((len(x), 0), np.int32)
            column = [None] * len(x)
            if asks.any():
                ways = space.lists(space.query(x[asks]), visits).astype(np.int32)
                for k, w in zip(np.flatnonzero(asks).tolist(), ways):
                    column[k] = w
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(at), pa.array(column, pa.list_(pa.int32()))], ["cid", "vec", "ids", "queries", "list", "ways"])

    filed = common.cut(known.select("cid", "vec", "ids", "queries").mapInArrow(file, "cid long, vec array<double>, ids array<long>, queries long, list int, ways array<int>"), "filed")
    rows = filed.select("list", "cid", "ids", "vec")
    asked = filed.filter("queries > 0").select(F.col("cid").alias("query"), F.col("vec").alias("asked"), "ways")
    first = asked.select(F.col("ways")[0].alias("list"), "query", "asked", F.lit(None).cast("double").alias("least"))
    near = common.cut(_visit(rows, first, space, nearest), "near")
    reached = _best(near, nearest).select("query", F.when(F.size("hits") > nearest, -F.get("hits", F.lit(nearest))["far"]).alias("least"))
    others = asked.select("query", "asked", F.explode(F.slice("ways", 2, max(visits - 1, 1))).alias("list")).join(reached, "query", "left").select("list", "query", "asked", "least")
    best = common.cut(_best(near.unionByName(_visit(rows, others, space, nearest)), nearest), "best")
    # Back to the rows that ask: rows of a class that holds a thousandth of all are told from the others.
    hot = known.filter(F.col("queries") * 1000 >= asking).select("cid", "vec")
    keyed = table.select(F.col(key).cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("vec")).filter(F.col("query_id") % every == 0)
    few = F.broadcast(hot.join(best, hot.cid == best.query).select("vec", "hits"))
    many = known.filter((F.col("queries") > 0) & (F.col("queries") * 1000 < asking)).select("cid", "vec").join(best, F.col("cid") == F.col("query")).select("vec", "hits")
    told = keyed.join(few, "vec").unionByName(keyed.join(F.broadcast(hot.select("vec")), "vec", "left_anti").join(many, "vec"))
    # One row of the query's id is its own: the first, if any of its class is among the hits.
    at = F.array_position(F.transform("hits", lambda h: h["vec_id"]), F.col("query_id"))
    others_of = F.filter("hits", lambda h, i: (at == 0) | (i != at - 1))
    ranked = told.select("query_id", F.posexplode(F.slice(others_of, 1, nearest)).alias("p", "h"))
    return ranked.select("query_id", (F.col("p") + 1).alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.far")).alias("score"))


def op12_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
