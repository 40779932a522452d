"""Chains of trades: of all candidate entries those that come after the last exit.

Within a chunk of a series every entry knows its successor (the first entry after its exit), so one pass from the back
tells where a chain that starts at it leaves the chunk. The entries at which chains come into later chunks form a list
with one link for each; it is ranked by pointer doubling: in each round the known members of the chain are joined with
links that span twice as far. Rounds grow with the logarithm of a series' chunks, tables shrink to one row for each link,
and no task holds more than a chunk's entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.storage import cut, discard

from .ordinal import CHUNK, join_on

_NEVER = 1 << 62


def _successors(entry: np.ndarray, exit_: np.ndarray) -> np.ndarray:
    """Place of the first entry after each entry's exit; the length if there is none."""
    return np.searchsorted(entry, exit_, side="right")


def _sorted(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    t = t.sort_by("entry")
    return t, t["entry"].to_numpy(), t["exit"].fill_null(_NEVER).to_numpy()


def _leave(t: pa.Table) -> pa.Table:
    """free: the exit with which a chain from each entry leaves the chunk."""
    t, entry, exit_ = _sorted(t)
    following, free = _successors(entry, exit_).tolist(), exit_.tolist()
    for i in range(len(free) - 1, -1, -1):
        if following[i] < len(free):
            free[i] = free[following[i]]
    return t.append_column("free", pa.array(free, pa.int64()))


def _follow(t: pa.Table) -> pa.Table:
    """The entries of a chunk that the chain takes; head is the one at which it comes in."""
    t, entry, exit_ = _sorted(t)
    following, at, kept = _successors(entry, exit_).tolist(), int(np.flatnonzero(t["head"].to_numpy(zero_copy_only=False))[0]), []
    while at < len(following):
        kept.append(at)
        at = following[at]
    return t.take(pa.array(kept)).drop_columns(["head"])


def _first_of_chunks(entries: DataFrame, keys: list[str]) -> DataFrame:
    """For each chunk with entries: its first entry and that of the next such chunk."""
    first = entries.groupBy(*keys, "_chunk").agg(F.min("entry").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    return first.withColumn("_next", F.lead("_first").over(w))


def _entry_after(points: DataFrame, entries: DataFrame, chunks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """points (keys, free) with target, the first entry after free (null if none): in free's own chunk, or the first of the next chunk that has entries."""
    # The greatest first entry that isn't later than free tells the last chunk with entries that begins before it.
    rows = points.select(*keys, F.col("free").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("own"))
    both = rows.unionByName(entries.select(*keys, F.col("entry").alias("at"), F.lit(0).alias("side"), F.col("entry").alias("own"))).withColumn("_chunk", F.floor(F.col("at") / size))
    ahead = Window.partitionBy(*keys, "_chunk").orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    # Of equal places the entry comes after the point from the back: an entry at its exit isn't a successor.
    near = both.withColumn("near", F.min("own").over(ahead)).filter("side = 1").drop("side", "own")
    starts = chunks.select(*keys, "_chunk", F.col("_first"))
    every = near.select(*keys, "_chunk").distinct().unionByName(starts.select(*keys, "_chunk")).distinct()
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    later = join_on(every, starts, [*keys, "_chunk"], "left").withColumn("later", F.min("_first").over(w)).drop("_first")
    return join_on(near, later, [*keys, "_chunk"]).select(*keys, F.col("at").alias("free"), F.coalesce("near", "later").alias("target"))


def taken(entries: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """The entries of each series' chain, with all their columns. entries: keys, entry, exit (null: never), ..."""
    rows = entries.withColumn("_chunk", F.floor(F.col("entry") / size))
    schema = rows.schema
    fields = lambda *more: ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema], *more])
    left = cut(rows.groupBy(*keys, "_chunk").applyInArrow(_leave, fields("free long")), "chain")
    chunks = _first_of_chunks(left, keys)
    roots = left.groupBy(*keys).agg(F.min("entry").alias("entry"))
    frees = left.filter(F.col("free") < _NEVER).select(*keys, "free").distinct()
    targets = _entry_after(frees, left, chunks, keys, size).filter(F.col("target").isNotNull())
    # A link for each entry at which a chain may come into a chunk: where it comes in next.
    nodes = targets.select(*keys, F.col("target").alias("entry")).unionByName(roots).distinct()
    from_ = join_on(nodes, left.select(*keys, "entry", "free"), [*keys, "entry"])
    links = cut(join_on(from_, targets, [*keys, "free"]).select(*keys, "entry", F.col("target").alias("to")), "links")
    heads, spans = cut(roots, "heads"), links
    while not spans.isEmpty():
        reached = join_on(heads, spans, [*keys, "entry"]).select(*keys, F.col("to").alias("entry"))
        more = cut(heads.unionByName(reached), "heads")
        twice = cut(join_on(spans.withColumnRenamed("to", "mid"), spans.select(*keys, F.col("entry").alias("mid"), "to"), [*keys, "mid"]).select(*keys, "entry", "to"), "links")
        for old in (heads, spans):
            discard(old)
        heads, spans = more, twice
    heads = heads.distinct().withColumn("head", F.lit(True))
    marked = join_on(left.drop("free"), heads, [*keys, "entry"], "left").withColumn("head", F.coalesce("head", F.lit(False)))
    own = heads.select(*keys, F.floor(F.col("entry") / size).alias("_chunk")).distinct()
    return join_on(marked, own, [*keys, "_chunk"], "left_semi").groupBy(*keys, "_chunk").applyInArrow(_follow, fields()).drop("_chunk")
