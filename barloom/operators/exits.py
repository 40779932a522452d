"""First exits of all candidate entries of a series, however far ahead.

A chunk answers its own entries at once by tables of extremes. An entry that stays open looks for its next chunk in a
tree: a node holds the extremes of up to 16 chunks, or of 16 nodes below. It climbs until a later sibling holds a price
that the entry waits for, and goes down to that chunk, in two rounds for each level of the tree. There it is answered by
the bars. A trailing exit waits twice, for its arming and then for a fall; what falls within or between later chunks
without regard to the entry is found once for each chunk. A task holds one chunk of bars and the entries that meet in it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.storage import cut, discard

from .ordinal import CHUNK, join_on


def _extremes(x: np.ndarray, best: np.ufunc, none: float) -> list[np.ndarray]:
    """Extremes of 2^k values from each place on, for all k; nulls count as none."""
    out = [np.where(np.isnan(x), none, x)]
    for k in range(len(x).bit_length() - 1):
        last, step = out[-1], 1 << k
        out.append(best(last, np.concatenate([last[step:], np.full(min(step, len(x)), none)])))
    return out


def _first(tables: list[np.ndarray], start: np.ndarray, meets: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each start the first place from it on that meets; the length if none. meets holds for an extreme if for any."""
    n, at = len(tables[0]), start.astype(np.int64)
    for k in reversed(range(len(tables))):
        skip = (at < n) & ~meets(tables[k][np.minimum(at, n - 1)])
        at = np.where(skip, at + (1 << k), at)
    return np.minimum(at, n)


def _exits(price: np.ndarray, start: np.ndarray, entry: np.ndarray, high: np.ndarray, cfg) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first exit from start on (the length if none), its reason, and the highest price up to the end."""
    n = len(price)
    low_of, high_of = _extremes(price, np.minimum, np.inf), _extremes(price, np.maximum, -np.inf)
    none = np.full(len(start), n)
    fell, took, lost = none, none, none
    with np.errstate(divide="ignore", invalid="ignore"):
        if cfg.trailing is not None:
            left = 1 - cfg.trailing
            level = entry * (1 + cfg.take_profit)
            # A fall from any earlier price is one from the highest of them; so the first end of all falls suffices.
            ends = _first(low_of, np.arange(1, n + 1), lambda x: x <= price * left)
            falls = np.append(np.minimum.accumulate(ends[::-1])[::-1], n)
            armed = high >= level
            rise = _first(high_of, start, lambda x: x >= level)
            carried = np.minimum(_first(low_of, start, lambda x: x <= high * left), falls[np.minimum(start, n)])
            fell = np.where(armed, carried, falls[rise])
        if cfg.take_profit is not None and not cfg.trailing_only:
            took = _first(high_of, start, lambda x: (1 - cfg.fee) * x / entry - 1 >= cfg.take_profit)
        if cfg.stop_loss is not None:
            lost = _first(low_of, start, lambda x: 1 - (1 - cfg.fee) * x / entry >= cfg.stop_loss)
    at = np.minimum(np.minimum(fell, took), lost)
    reason = np.where((at == fell) | (at == took), 1, -1)
    rest = np.append(np.fmax.accumulate(price[::-1])[::-1], np.nan)
    return at, reason, np.fmax(high, rest[np.minimum(start, n)])


#: Children of a node, as a power of two.
FAN = 4


def _meets(cfg, paid, high, armed, hi, lo):
    """Whether extremes hold a price that an entry waits for."""
    worth = lambda x: (1 - cfg.fee) * x / paid
    out = F.lit(False)
    if cfg.trailing is not None:
        out = out | (~armed & (hi >= paid * (1 + cfg.take_profit))) | (armed & (lo <= high * (1 - cfg.trailing)))
    if cfg.take_profit is not None and not cfg.trailing_only:
        out = out | (worth(hi) - 1 >= cfg.take_profit)
    if cfg.stop_loss is not None:
        out = out | (1 - worth(lo) >= cfg.stop_loss)
    return F.coalesce(out, F.lit(False))


def _tree(chunks: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Nodes of all levels: keys, level, node, children (structs of at, hi, lo, in order); and the number of levels."""
    most = chunks.agg(F.max("_chunk")).first()[0] or 0
    out, below, level = None, chunks.select(*keys, F.col("_chunk").alias("at"), "hi", "lo"), 0
    while True:
        node = F.shiftright("at", FAN)
        nodes = below.groupBy(*keys, node.alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", "hi", "lo"))).alias("children"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
        rows = nodes.select(*keys, F.lit(level).alias("level"), "node", "children")
        out = rows if out is None else out.unionByName(rows)
        level += 1
        if most >> FAN * level == 0:
            return cut(out, "tree"), level
        below = nodes.select(*keys, F.col("node").alias("at"), "hi", "lo")


def _walk(states: DataFrame, tree: DataFrame, levels: int, cfg, keys: list[str]) -> DataFrame:
    """States (keys, _chunk, stop, entry_price, high, armed, ...) with _chunk set to the first later chunk that may answer
    them, null if none does before the series' end. high takes the prices passed. At stop a walk ends in any case."""
    own = [c for c in states.columns if c not in (*keys, "_chunk")]
    going = states.select(*keys, *own, F.lit(0).alias("level"), F.shiftright("_chunk", FAN).alias("node"), (F.col("_chunk") + 1).alias("from"), F.col("high").alias("first_high"), F.lit(None).cast("long").alias("_chunk"))
    arrived, old = [], []
    for _ in range(2 * levels - 1):
        at = F.filter("children", lambda c: (c["at"] >= F.col("from")) & ((F.call_function("shiftleft", c["at"] + 1, F.col("level") * FAN) > F.col("stop")) | _meets(cfg, F.col("entry_price"), F.col("first_high"), F.col("armed"), c["hi"], c["lo"])))
        met = join_on(going, tree, [*keys, "level", "node"], "left").withColumn("found", F.get(at, F.lit(0))["at"])
        passed = F.array_max(F.transform(F.filter("children", lambda c: (c["at"] >= F.col("from")) & (c["at"] < F.coalesce("found", F.lit(1 << 62)))), lambda c: c["hi"]))
        there, last = F.col("found").isNotNull() & (F.col("level") == 0), F.col("found").isNull() & (F.col("level") == levels - 1)
        down, up = F.col("found").isNotNull(), F.col("found").isNull()
        moved = met.select(
            *keys, *[c for c in own if c != "high"], F.greatest("high", passed).alias("high"), "first_high", F.when(there, F.col("found")).alias("_chunk"), (there | last).alias("done"),
            F.when(down, F.shiftleft("found", FAN)).otherwise(F.col("node") + 1).alias("from"), F.when(down, F.col("found")).otherwise(F.shiftright("node", FAN)).alias("node"), F.when(down, F.col("level") - 1).otherwise(F.col("level") + 1).alias("level"),
        )
        written = cut(moved, "walk")
        arrived.append(written.filter("done").select(*keys, *own, "_chunk"))
        old.append(written)
        going = written.filter("NOT done").drop("done")
        if levels == 1 or going.isEmpty():
            break
    out = arrived[0]
    for more in arrived[1:]:
        out = out.unionByName(more)
    return out


def first_exits(df: DataFrame, cfg, keys: list[str], size: int = CHUNK) -> DataFrame:
    """Entries (keys, entry, entry_price, next_sell) with cross, the first later row at which a level is met, and cross_reason.

    cross is null where the next sell or the series' end comes first. df: keys, ord, price, action, next_sell.
    """
    bars = df.select(*keys, F.floor(F.col("ord") / size).alias("_chunk"), "ord", F.col("price").cast("double").alias("price"), "action", "next_sell")
    bars = join_on(bars, bars.groupBy(*keys).agg(F.max("_chunk").alias("_end")), keys)
    bars = cut(bars.withColumns({c: F.lit(None).cast(t) for c, t in (("entry", "long"), ("entry_price", "double"), ("high", "double"))}), "bars")
    kinds = [bars.schema[k] for k in keys]
    answer = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["entry long, entry_price double, next_sell long, cross long, cross_reason int, high double, _chunk long, armed boolean, fell boolean"])

    def solve(t: pa.Table) -> pa.Table:
        column = lambda rows, name: rows[name].to_numpy()
        rows = t.filter(pa.compute.is_valid(t["ord"])).sort_by("ord")
        ords, price = column(rows, "ord"), column(rows, "price").astype(float)
        arrived = t.filter(pa.compute.is_valid(t["entry"]))
        fell = None
        if len(arrived):
            entry, paid, high, sells, start = column(arrived, "entry"), column(arrived, "entry_price").astype(float), column(arrived, "high").astype(float), arrived["next_sell"], np.zeros(len(arrived), np.int64)
        else:
            at = np.flatnonzero(rows["action"].fill_null(0).to_numpy() == 1)
            entry, paid, high, sells, start = ords[at], price[at], price[at], rows["next_sell"].take(pa.array(at)), at + 1
            if cfg.trailing is not None:
                fell = bool((price <= np.append(-np.inf, np.fmax.accumulate(price)[:-1]) * (1 - cfg.trailing)).any())
        place, reason, high = _exits(price, start, paid, high, cfg)
        met, sold = place < len(price), sells.fill_null(1 << 62).to_numpy()
        chunk, end = rows["_chunk"][0], rows["_end"][0]
        done = met | (sold <= ords[-1]) | (chunk == end)
        cross = ords[np.minimum(place, len(ords) - 1)]
        met = met & (cross <= sold)
        with np.errstate(invalid="ignore"):
            armed = high >= paid * (1 + cfg.take_profit) if cfg.trailing is not None else np.zeros(len(entry), bool)
        more = fell is not None
        made = {k: pa.repeat(t[k][0], len(entry) + more) for k in keys}
        null = lambda x: pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x, pa.nulls(int(more), x.type)])
        price_of = lambda x: null(pa.array(x, pa.float64(), from_pandas=True))
        made |= {"entry": null(pa.array(entry, pa.int64())), "entry_price": price_of(paid), "next_sell": null(sells.cast(pa.int64())), "cross": null(pa.array(cross, pa.int64(), mask=~met)), "cross_reason": null(pa.array(reason, pa.int32(), mask=~met))}
        made |= {"high": price_of(high), "_chunk": pa.array([*[None if d else chunk.as_py() for d in done.tolist()], *[chunk.as_py()] * more], pa.int64()), "armed": null(pa.array(armed)), "fell": pa.array([*[None] * len(entry), *[fell] * more], pa.bool_())}
        return pa.table(made)

    chunk_rows = bars.groupBy(*keys, "_chunk").agg(F.max("price").alias("hi"), F.min("price").alias("lo"), F.max(F.col("action") == 1).alias("asks"))
    if cfg.trailing is None:
        own = chunk_rows.filter("asks").select(*keys, "_chunk")
        asked = join_on(bars, own, [*keys, "_chunk"], "left_semi")
    else:
        asked = bars
    found = cut(asked.groupBy(*keys, "_chunk").applyInArrow(solve, answer), "exits")
    rounds = [found.filter("_chunk IS NULL")]
    going = found.filter("_chunk IS NOT NULL AND entry IS NOT NULL")
    nothing = ["cross", "cross_reason", "fell"]
    if not going.isEmpty():
        tree, levels = _tree(chunk_rows, keys)
        falls = _falls(found.filter("fell IS NOT NULL").select(*keys, "_chunk", "fell"), chunk_rows, tree, levels, cfg, keys) if cfg.trailing is not None else None
        for _ in range(2 if cfg.trailing is not None else 1):
            stop = F.coalesce(F.floor(F.col("next_sell") / size), F.lit(1 << 62))
            states = going.drop(*nothing).withColumn("stop", stop)
            if falls is not None:
                states = join_on(states, falls, [*keys, "_chunk"], "left").withColumn("stop", F.when(F.col("armed"), F.least("stop", F.coalesce("falls", F.lit(1 << 62)))).otherwise(F.col("stop"))).drop("falls")
            walked = cut(_walk(states, tree, levels, cfg, keys), "walked")
            rounds.append(walked.filter("_chunk IS NULL").select(*keys, "entry", "entry_price", "next_sell", *[F.lit(None).cast(t).alias(c) for c, t in (("cross", "long"), ("cross_reason", "int"))], "high", "_chunk", "armed", F.lit(None).cast("boolean").alias("fell")))
            there = walked.filter("_chunk IS NOT NULL")
            asking = there.select(*keys, "_chunk", *[F.lit(None).cast(bars.schema[c].dataType).alias(c) for c in ("ord", "price", "action")], "next_sell", F.lit(None).cast("long").alias("_end"), "entry", "entry_price", "high")
            asked = join_on(bars, there.select(*keys, "_chunk").distinct(), [*keys, "_chunk"], "left_semi").unionByName(asking)
            found = cut(asked.groupBy(*keys, "_chunk").applyInArrow(solve, answer), "exits")
            rounds.append(found.filter("_chunk IS NULL"))
            going = found.filter("_chunk IS NOT NULL AND entry IS NOT NULL")
            if going.isEmpty():
                break
        discard(tree)
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.drop("high", "_chunk", "armed", "fell")


def _falls(fell: DataFrame, chunks: DataFrame, tree: DataFrame, levels: int, cfg, keys: list[str]) -> DataFrame:
    """falls: for each chunk the first chunk in which prices fall by the trail from a price of any later chunk than it.

    A chunk's own fall ends in it; a fall from its highest price ends where a walk from it does. The earliest end of all
    later chunks counts.
    """
    only = type(cfg)(cfg.fee, cfg.balance, cfg.take_profit, None, cfg.trailing, True)
    states = join_on(fell, chunks, [*keys, "_chunk"]).select(*keys, "_chunk", F.col("_chunk").alias("of"), "fell", F.lit(1 << 62).alias("stop"), F.col("hi").alias("entry_price"), F.col("hi").alias("high"), F.lit(True).alias("armed"))
    ends = _walk(states, tree, levels, only, keys).select(*keys, F.col("of").alias("_chunk"), F.when(F.col("fell"), F.col("of")).otherwise(F.col("_chunk")).alias("end"))
    later = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    return cut(ends.withColumn("falls", F.min("end").over(later)).select(*keys, "_chunk", "falls"), "falls")
