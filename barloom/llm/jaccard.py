"""Jaccard join of documents over word n-grams: size-aware, heavy and light.

Equal sets fall together first, by a fingerprint; what follows works on distinct sets (nodes).

Light: sets of at most `boundary` shingles list all their subsets of every size that a partner may require (few
elements may be missing, so they are few). Two sets link if and only if they share a subset of the required size, and
then both link with the smallest set that has it.
Heavy: larger sets go to inverted lists. Under one order of all shingles, two sets that link share one within their
prefixes. Shingles that are frequent within tasks come last in that order. Only how long lists get depends on the
counts, never which pairs are found, so their table may be bounded. The boundary is the one with the least cost, from
the numbers of small sets and the lengths of the lists that their prefixes would make.

Lists are never expanded into pairs of sets. Each list is known by its smallest set, its lead; lists of one lead make a
family (lead, node), in which every set stands once however many lists it shares. Every set is compared with the lead
that it meets most often; links found so join most of a family. A family that still holds several components is judged
whole: a task (for large ones, one for each two blocks of a bounded number of sets and shingles) finds by size and
sketch which sets might link with one of another component, and only their whole sets are then brought to the family,
where a task links them, closest first, until no two components that link are apart. So a task emits fewer links than
it has sets, and no link between components is lost. The work on a family that falls into many components, and has
more than a block of sets, is quadratic in its blocks; rows that are sent grow with sets times blocks.

A sketch has the parity of the shingles that fall on each of 512 bits or more (one for each shingle): sets differ by at
least as many shingles as their sketches by bits, at any size. Every link is decided on whole sets.

Hot shingles (those of the bounded table with HOT hits or more) have their leads by pre-aggregation and a broadcast of
at most FREQUENT rows, so no task gathers their lists; a lead that many sets are compared with is salted.

Null text, and text without words, has no shingles and no links; a text with fewer words than n is one shingle. Texts
of any length are read whole. Rows with equal keys are told apart by their text. Rows with a null key belong to their
component, but can't name it: one that has no copy with a key stays alone. Among equal counts the greatest lead is
compared; ties don't change a result. An empty table gives an empty result. Other columns are not carried, whatever
their names. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Words that a worker remembers; shingles that a task counts at once; least count in a task; shingles put last in the order; hits of a hot one.
MEMORY, COUNTED, LOCAL, FREQUENT, HOT = 100_000, 1_500_000, 3, 1 << 18, 256
#: Documents, and pairs twice over, whose texts or sets are handed to Python together.
AT_ONCE = 512
#: Bits that mark the documents whose sets are wanted: eight for each, and at least and at most so many (32 MB). Marks by
#: chance only cost reading; with over a quarter of the bits wanted, documents are found by a join instead.
FEWEST_MARKS, MARKS = 1 << 20, 1 << 28
#: Largest size that may count as light.
LIGHT = 24
#: Least bits of a sketch; sets and shingles of a block of a family; pairs compared at once; sets that meet one copy of a lead.
SKETCH, BLOCK, SHINGLES, COMPARED, FAN = 512, 2048, 1 << 20, 1 << 17, 64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_known = _Hashes()
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles. bytes.lower and bytes.split know ASCII letters and white space alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_known) > MEMORY:
        _known.clear()
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    rows = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        rows = rows * _A + h[k : len(h) - size + 1 + k]
    rows = _mix(rows + np.uint64(size))
    rows.sort()
    return rows[np.append(True, rows[1:] != rows[:-1])]


def fingerprint(rows: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(rows.tobytes())).astype(np.int64))


def sketch(rows: np.ndarray) -> bytes:
    """Bit j: whether an odd number of shingles falls on j, of SKETCH bits or the next power of two above the set's size."""
    bits = max(SKETCH, 1 << (len(rows) - 1).bit_length() if len(rows) else 0)
    return np.packbits(np.bincount(rows.view(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(data: bytes, size: int = SKETCH // 8) -> np.ndarray:
    """The sketch of fewer bits that the same set has."""
    words = np.frombuffer(data, np.uint64)
    while len(words) * 8 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def required(a: int, b: int, percent: int) -> int:
    """Shingles that sets of sizes a and b must share to link."""
    return -(-percent * (a + b) // (100 + percent))


def lowest(n: int, percent: int) -> int:
    """The least that a set of size n shares with any partner."""
    return -(-percent * n // 100)


def subset_count(n: int, percent: int) -> int:
    return sum(math.comb(n, k) for k in range(n - lowest(n, percent) + 1))


def light_boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The boundary of least cost. sizes: number of sets of each size up to LIGHT; list_length: of the list that an entry
    of a small set's prefix is in, on average. An entry costs itself and the others of its list; a subset itself."""
    def cost(x: int) -> float:
        entries = lambda n: (n - lowest(n, percent) + 1) * (1 + list_length)
        light = sum(c * 2 * subset_count(n, percent) for n, c in sizes.items() if n <= x)
        return light + sum(c * entries(n) for n, c in sizes.items() if n > x or (x and n >= lowest(x + 1, percent)))

    return min(range(LIGHT + 1), key=cost)


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


_SETS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary()), ("small", pa.binary()), ("token", pa.int64()), ("hits", pa.int64())])


def _describe(n: int):
    """Rows for documents, and rows (token, hits) for shingles of LOCAL or more distinct sets of a task. small: the set itself, up to LIGHT."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kept, size = [], 0

        def counted() -> pa.RecordBatch:
            token, hits = np.unique(np.concatenate(kept), return_counts=True)
            often = hits >= LOCAL
            none = [None] * int(often.sum())
            return _batch([*[none] * 6, token[often].view(np.int64), hits[often]], _SETS)

        for b in batches:
            rows = []
            for key, text, digest in zip(*(b.column(k).to_pylist() for k in range(3))):
                s = shingles(text, n)
                node = fingerprint(s)
                rows.append((key, digest, len(s), node, sketch(s), s.tobytes() if 0 < len(s) <= LIGHT else None, None, None))
                if len(s) and node not in seen:
                    seen.add(node)
                    kept.append(s)
                    size += len(s)
                    if size > COUNTED:
                        yield counted()
                        kept, size = [], 0
            if rows:
                yield _batch(list(zip(*rows)), _SETS)
        if kept:
            yield counted()
        _known.clear()

    return run


def _rare_first(s: np.ndarray, frequent: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set in the order of all shingles, and the hits of each."""
    if not len(frequent):
        return s, np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = np.where(frequent[at] == s, hits[at], 0)
    order = np.argsort(often, kind="stable")
    return s[order], often[order]


def _small_prefixes(percent: int, shared):
    """Tokens of the prefixes of small sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x, np.uint64) for x in b.column(0).to_pylist()]
            found = [_rare_first(s, *shared.value)[0][: len(s) - lowest(len(s), percent) + 1] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["token"])

    return run


def _subsets(percent: int):
    """Rows (token, need, node, n): the subsets of small sets (node, small)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, 64) for x in batches for k in range(0, x.num_rows, 64)):
            token, need, node, length = [], [], [], []
            for who, small in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = np.frombuffer(small, np.uint64)
                size, mixed = len(s), _mix(s)
                for gone in range(size - lowest(size, percent) + 1):
                    without = np.array(list(itertools.combinations(range(size), gone)), np.int64).reshape(math.comb(size, gone), gone)
                    sums = mixed.sum() - mixed[without].sum(axis=1, dtype=np.uint64)
                    token.append(_mix(sums + np.uint64(size - gone)))
                    need.append(np.full(len(sums), size - gone))
                    node.append(np.full(len(sums), who))
                    length.append(np.full(len(sums), size))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), *[pa.array(np.concatenate(x)) for x in (need, node, length)]], names=["token", "need", "node", "n"])

    return run


_ENTRIES = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("hot", pa.bool_())])


def _entries(n: int, percent: int, boundary: int, shared):
    """List entries of heavy sets, and of the light ones that a heavy set may link with."""
    least = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            token, hot, node, length = [], [], [], []
            for text in b.column(0).to_pylist():
                s = shingles(text, n)
                who, size = fingerprint(s), len(s)
                if not size or who in seen or (size <= boundary and size < lowest(boundary + 1, percent)):
                    continue
                seen.add(who)
                prefix = size - lowest(size, percent) + 1
                s, often = _rare_first(s, *shared.value)
                token.append(s[:prefix])
                hot.append(often[:prefix] >= least)
                node.append(who)
                length.append(size)
            if token:
                counts = [len(x) for x in token]
                yield _batch([np.concatenate(token).view(np.int64), np.repeat(node, counts), np.repeat(length, counts), np.concatenate([np.arange(c) for c in counts]), np.concatenate(hot)], _ENTRIES)
        _known.clear()

    return run


def _sets_of(n: int, shared):
    """Sets of the texts whose mark is set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mark = b.column(0).to_numpy()
            texts = b.column(1).filter(pa.array((shared.value[mark >> 5] >> (mark & 31) & 1).astype(bool)))
            sets = [shingles(x, n) for x in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "rows"])
        _known.clear()

    return run


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = int((y[at] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _linked(percent: int):
    """Of pairs (u, v, x, y) those that link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(4)))
            out = [(u, v) for u, v, x, y in rows if links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _within(a: np.ndarray, b: np.ndarray, percent: int, distance: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b may link by the least number of shingles in which they differ."""
    return distance <= a + b - 2 * (-(-percent * (a + b) // (100 + percent)))


def _distances(a: np.ndarray, b: np.ndarray, n: np.ndarray, base: np.ndarray, sketches: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (a, b: rows) those whose sketches allow a link, with the distance; large ones by all bits that both have."""
    d = np.bitwise_count(base[a] ^ base[b]).sum(axis=1).astype(np.int64)
    ok = _within(n[a], n[b], percent, d)
    a, b, d = a[ok], b[ok], d[ok]
    for k in np.flatnonzero((n[a] > SKETCH) & (n[b] > SKETCH)):
        size = min(len(sketches[a[k]]), len(sketches[b[k]]))
        d[k] = np.bitwise_count(folded(sketches[a[k]], size) ^ folded(sketches[b[k]], size)).sum()
    ok = _within(n[a], n[b], percent, d)
    return a[ok], b[ok], d[ok]


def _near(percent: int):
    """Pairs (u, v) of rows (u, v, nu, nv, su, sv) whose sketches allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, nu, nv = (b.column(k).to_numpy() for k in range(4))
            sketches = b.column(4).to_pylist() + b.column(5).to_pylist()
            base = np.array([folded(s) for s in sketches]).reshape(-1, SKETCH // 64)
            a, _, _ = _distances(np.arange(len(u)), np.arange(len(u)) + len(u), np.concatenate([nu, nv]), base, sketches, percent)
            yield pa.RecordBatch.from_arrays([pa.array(u[a]), pa.array(v[a])], names=["u", "v"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by (lead, i, j), each with a column for the group."""
    def grouped(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        keys = [t.column(c).to_numpy() for c in ("lead", "i", "j")]
        change = np.append(False, np.any([k[1:] != k[:-1] for k in keys], axis=0)) if len(t) else np.zeros(0, bool)
        return t, np.cumsum(change)

    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        _, group = grouped(held)
        if len(group) and group[-1]:  # all groups but the last are whole
            at = int(np.searchsorted(group, group[-1]))
            yield held.slice(0, at).append_column("group", pa.array(group[:at]))
            held = held.slice(at)
    if held is not None and len(held):
        yield held.append_column("group", pa.array(grouped(held)[1]))


def _candidates(t: pa.Table, sketches: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of a group that are of different components, and of different blocks where there are two, and might link."""
    group, i, j, own, n, part = (t.column(c).to_numpy() for c in ("group", "i", "j", "own", "n", "component"))
    base = np.array([folded(s) for s in sketches]).reshape(-1, SKETCH // 64)
    order = np.lexsort([n, group])
    # Sorted by group and size, the larger partners that a row may have follow it.
    place = group[order].astype(np.int64) << 32 | n[order]
    last = np.searchsorted(place, (group[order].astype(np.int64) << 32) + 100 * n[order] // percent, side="right")
    counts = last - np.arange(len(order)) - 1
    ends = np.cumsum(counts)
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, side="right")))
        few = counts[at:end]
        a = np.repeat(np.arange(at, end), few)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(few) - few, few)
        a, b, at = order[a], order[b], end
        ok = (part[a] != part[b]) & ((i[a] == j[a]) | (own[a] != own[b]))
        yield _distances(a[ok], b[ok], n, base, sketches, percent)


def _undecided(percent: int):
    """The rows of families that might link with a row of another component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            open_ = np.zeros(len(t), bool)
            for a, b, _ in _candidates(t, t.column("sketch").to_pylist(), percent):
                open_[a] = open_[b] = True
            yield from t.drop_columns(["sketch", "group"]).filter(pa.array(open_)).combine_chunks().to_batches()

    return run


def _spanning(percent: int):
    """Links (u, v), decided on whole sets, that join all components of each group that links join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            sets = [np.frombuffer(x, np.uint64) for x in t.column("rows").to_pylist()]
            group, node, part = (t.column(c).to_pylist() for c in ("group", "node", "component"))
            up: dict[tuple[int, int], tuple[int, int]] = {}

            def top(x: tuple[int, int]) -> tuple[int, int]:
                while (y := up.get(x, x)) != x:
                    up[x] = up.get(y, y)
                    x = y
                return x

            out = []
            for a, b, d in _candidates(t, [sketch(s) for s in sets], percent):
                for k in np.argsort(d, kind="stable"):
                    p, q = a[k], b[k]
                    x, y = top((group[p], part[p])), top((group[q], part[q]))
                    if x != y and links(sets[p], sets[q], percent):
                        up[x] = y
                        out.append((node[p], node[q]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _close(small: tuple[Column, Column], large: tuple[Column, Column], percent: int) -> Column:
    """Whether sets (n, pos of a shared shingle) may link by size, prefix and position; small is not the larger one."""
    (a, i), (b, j) = small, large
    need = F.ceil(F.lit(percent) * (a + b) / (100 + percent))
    index = a - F.ceil(F.lit(2 * percent) * a / (100 + percent)) + 1
    return (100 * a >= percent * b) & (i < index) & (1 + F.least(a - i - 1, b - j - 1) >= need)


def _bits(wanted: int) -> int:
    """Bits of the bitmap that marks so many documents."""
    return min(MARKS, max(FEWEST_MARKS, 1 << (8 * wanted).bit_length()))


def _sets(nodes: DataFrame, docs: DataFrame, holders: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows (node, rows) with the whole sets of the given nodes (distinct), and the table that they are read from. holders: node and a document that has it."""
    holders = holders.join(nodes, "node", "left_semi").select("doc_id")
    number = nodes.count()
    bits = _bits(number)
    if number > bits // 4:
        marked, some = docs.select("doc_id", "text").join(holders.select(F.col("doc_id").alias("holder")).distinct(), F.col("doc_id").eqNullSafe(F.col("holder")), "left_semi"), np.full(1, 1, np.uint32)
        texts = marked.select(F.lit(0).cast("long").alias("mark"), "text")
    else:
        # A bitmap tells nearly all other documents where they are read, so no text is shuffled.
        mark = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
        words = holders.select(mark.alias("m")).groupBy(F.floor(F.col("m") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m % 32 as int))")).alias("b")).toArrow()
        some = np.zeros(bits // 32, np.uint32)
        some[words["w"].to_numpy()] = words["b"].to_numpy()
        texts = docs.select(mark.alias("mark"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(some)
    found = common.cut(texts.mapInArrow(_sets_of(n, shared), "node long, rows binary"), "sets", AT_ONCE)
    shared.destroy()
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"]), found


def _verified(pairs: DataFrame, docs: DataFrame, holders: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (u, v) those that link, decided on whole sets. A v that many u meet goes out in copies, FAN u to each."""
    ends = common.cut(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "ends")
    sets, table = _sets(ends, docs, holders, n)
    fans = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fan"))
    left = pairs.join(fans, "v").withColumn("salt", F.pmod(F.xxhash64("u"), F.col("fan")).cast("int")).join(sets.select(F.col("node").alias("u"), F.col("rows").alias("x")), "u")
    right = sets.join(fans, F.col("node") == F.col("v")).select("v", F.col("rows").alias("y"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"))
    both = left.join(right, ["v", "salt"]).select("u", "v", "x", "y")
    out = common.cut(both.mapInArrow(_linked(percent), "u long, v long"), "linked", AT_ONCE)
    common.discard(table)
    return out


def _light(nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links (u, v) of small sets: those that share a subset of the required size, each with the smallest of them."""
    subsets = common.cut(nodes.filter(F.col("n") <= boundary).select("node", "small").mapInArrow(_subsets(percent), "token long, need long, node long, n long"), "subsets")
    leads = subsets.groupBy("token", "need").agg(F.min(F.struct("n", "node")).alias("lead"), F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a <> _b").drop("_a", "_b")
    met = subsets.join(leads, ["token", "need"]).filter((100 + percent) * F.col("need") >= percent * (F.col("n") + F.col("lead.n")))
    return met.select(F.col("node").alias("u"), F.col("lead.node").alias("v")).filter("u <> v").distinct()


def _families(docs: DataFrame, boundary: int, shared, n: int, percent: int) -> DataFrame:
    """Rows (lead, node, n, met, close): the lists of heavy sets, by their leads. met: in how many lists; close: one allows a link with the lead."""
    entries = common.cut(docs.select("text").mapInArrow(_entries(n, percent, boundary, shared), "token long, node long, n int, pos int, hot boolean"), "entries", AT_ONCE)
    index = F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent)) + 1
    lead = F.min(F.when(F.col("pos") < index, F.struct("n", "node", "pos")))
    by = Window.partitionBy("token")
    cold = entries.filter("NOT hot").select("token", "node", "n", "pos").withColumns({"lead": lead.over(by), "_a": F.min("node").over(by), "_b": F.max("node").over(by)})
    # Hot shingles are of the bounded table, so there are at most FREQUENT leads.
    leads = entries.filter("hot").groupBy("token").agg(lead.alias("lead"), F.min("node").alias("_a"), F.max("node").alias("_b"))
    hot = entries.filter("hot").select("token", "node", "n", "pos").join(F.broadcast(common.cut(leads, "hot-leads")), "token")
    rows = cold.unionByName(hot).filter("_a <> _b AND lead IS NOT NULL")
    close = (F.col("node") != F.col("lead.node")) & _close((F.col("lead.n"), F.col("lead.pos")), (F.col("n"), F.col("pos")), percent)
    found = common.cut(rows.groupBy(F.col("lead.node").alias("lead"), "node").agg(F.min("n").cast("long").alias("n"), F.count(F.lit(1)).alias("met"), F.max(close).alias("close")), "families")
    common.discard(entries)
    return found


def _across(families: DataFrame, known: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between the components of each family that holds several."""
    placed = families.select("lead", "node", "n").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES)).cast("int")
    mixed = placed.groupBy("lead").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), blocks.alias("_blocks")).filter("_a <> _b").drop("_a", "_b")
    rest = placed.join(mixed, "lead").withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rest = rest.select("lead", F.least("own", "_c").alias("i"), F.greatest("own", "_c").alias("j"), "own", "node", "n", "component").join(nodes.select("node", "sketch"), "node")
    dealt = lambda df: df.repartition(F.col("lead"), F.col("i"), F.col("j")).sortWithinPartitions("lead", "i", "j")
    kind = "lead long, i int, j int, own int, node long, n long, component long"
    columns = ["lead", "i", "j", "own", "node", "n", "component"]
    todo = common.cut(dealt(rest.select(*columns, "sketch")).mapInArrow(_undecided(percent), kind), "undecided", 8 * AT_ONCE)
    whole, table = _sets(common.cut(todo.select("node").distinct(), "ends"), docs, nodes, n)
    out = common.cut(dealt(todo.join(whole, "node").select(*columns, "rows")).mapInArrow(_spanning(percent), "u long, v long"), "spanning", AT_ONCE)
    common.discard(table)
    return out


def _placed(docs: DataFrame, n: int, percent: int, boundary: int | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, digest (of the text), n, component_id, kept (it stands for its component: the
    least key, of equal keys the least set). boundary: if not the one of least cost."""
    spark = docs.sparkSession
    described = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(_describe(n), "doc_id long, digest long, n long, node long, sketch binary, small binary, token long, hits long")
    described = common.cut(described, "described", AT_ONCE)
    rows = described.filter("token IS NULL")
    nodes = common.cut(rows.filter("n > 0").groupBy("node").agg(*[F.min(c).alias(c) for c in ("doc_id", "n", "sketch", "small")]), "nodes")

    counts = described.filter("token IS NOT NULL").groupBy("token").agg(F.sum("hits").alias("hits"))
    often = counts.orderBy(F.desc("hits"), "token").limit(FREQUENT).toArrow()
    token, hits = often["token"].to_numpy().view(np.uint64), often["hits"].to_numpy()
    order = np.argsort(token)
    shared = spark.sparkContext.broadcast((token[order], hits[order]))
    if boundary is None:
        small = nodes.filter(F.col("n") <= LIGHT)
        sizes = {r[0]: r[1] for r in small.groupBy("n").count().collect()}
        lists = small.select("small").mapInArrow(_small_prefixes(percent, shared), "token long").groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("c"))
        boundary = light_boundary(sizes, lists.agg(F.coalesce(F.sum(F.col("c") * F.col("c")) / F.sum("c"), F.lit(0.0))).first()[0], percent)

    families = _families(docs, boundary, shared, n, percent)
    shared.destroy()
    first = families.filter("close AND lead <> node").groupBy(F.col("node").alias("u")).agg(F.max_by("lead", F.struct("met", "lead")).alias("v"))
    at = lambda side: nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    near = first.join(at("u"), "u").join(at("v"), "v").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(_near(percent), "u long, v long")
    near = common.cut(near, "near", AT_ONCE)
    found = _verified(near, docs, nodes, n, percent)
    if boundary:
        found = found.unionByName(_light(nodes, boundary, percent))
    found = common.cut(found, "links")
    more = _across(families, components(found), docs, nodes, n, percent)
    known = components(found.unionByName(more))
    common.discard(families)

    named = nodes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("keeper")
    members = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), keeper), "component").select("node", "component_id", "keeper")
    out = rows.select("doc_id", "digest", "n", "node").join(members, "node", "left")
    kept = (F.col("node") == F.col("keeper.node")) & F.col("doc_id").eqNullSafe(F.col("keeper.doc_id"))
    placed = common.cut(out.select("doc_id", "digest", "n", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept")), "placed")
    for table in (described, nodes, near, found):
        common.discard(table)
    return placed


def jaccard_join(docs: DataFrame, *, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least key of the documents that links reach), one row for each of docs."""
    placed = _placed(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), n, percent, boundary)
    return placed.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, rows without an id last.

    Rows that share an id are told apart by their text; of rows equal in both one stays. Rows without words all stay.
    Columns stay as they are, whatever their names. An empty table gives an empty one.
    """
    placed = _placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 5, 80)
    # Both sides are dealt by one key, never null, that also tells repeated rows: texts are shuffled once.
    names = [common.spare_name(docs, stem) for stem in ("_id", "_null", "_digest")]
    key = lambda digest: [c.alias(name) for c, name in zip((F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), digest), names)]
    alone = placed.filter("kept AND n > 0").select(*key(F.col("digest"))).distinct()
    worded = F.coalesce(F.col("text").rlike(common.WORD), F.lit(False))
    marked = docs.filter(worded).select("*", *key(F.xxhash64("text")))
    kept = marked.join(alone, names, "left_semi").dropDuplicates(names)
    return kept.select(*docs.columns).unionByName(docs.filter(~worded))


def op9_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(common.documents(spark, sf_dir), n=4, percent=85)
