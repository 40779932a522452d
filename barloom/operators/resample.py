"""Coarser bars at every phase, and alignment of timeframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import MINUTES

from .ordinal import asof_align, join_on


def _bars(grouped, at: str = "ord") -> DataFrame:
    return grouped.agg(
        F.min("timestamp").alias("timestamp"), F.max("timestamp_close").alias("timestamp_close"), F.max_by("price", at).alias("price"), F.min_by("price_open", at).alias("price_open"),
        F.max("price_high").alias("price_high"), F.min("price_low").alias("price_low"), F.sum("volume").alias("volume"), F.sum("asset_volume_quote").alias("asset_volume_quote"),
        F.sum("trades_number").alias("trades_number"), F.count(F.lit(1)).alias("_rows"), F.max(at).alias("end_ord"),
    )


def resample(df: DataFrame, mult: int, offset: int = 0) -> DataFrame:
    """Bars of mult rows each from row offset on; a tail of fewer rows goes. ord is the number of the bar."""
    blocks = df.filter(F.col("ord") >= offset).withColumn("_block", F.floor((F.col("ord") - offset) / mult))
    return _bars(blocks.groupBy("symbol", "_block")).filter(F.col("_rows") == mult).withColumnRenamed("_block", "ord").drop("_rows")


def resample_phases(df: DataFrame, mult: int, step: int = 1, offset: int = 0) -> DataFrame:
    """Bars of mult rows that start at every step-th row: phase, and ord within the phase. One table for all phases.

    A bar's rows are the end of one block of mult rows and the beginning of the next. So running sums and extremes from
    both ends of each block give every phase by one join of a row with the row mult - 1 before it: what is shuffled
    doesn't grow with mult. ord must be dense.
    """
    place, block = F.col("ord") - offset, F.floor((F.col("ord") - offset) / mult)
    sums, kinds = ["volume", "asset_volume_quote", "trades_number"], {"price_high": (F.max, F.greatest), "price_low": (F.min, F.least)}
    rows = df.filter(place >= 0).select("symbol", "ord", "timestamp", "timestamp_close", "price", "price_open", *kinds, *sums).withColumn("_block", block)
    w = Window.partitionBy("symbol", "_block").orderBy("ord")
    head, tail = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    best = {**{c: F.sum for c in sums}, **{c: k[0] for c, k in kinds.items()}}
    rows = rows.withColumns({**{f"_h_{c}": f(c).over(head) for c, f in best.items()}, **{f"_t_{c}": f(c).over(tail) for c, f in best.items()}})
    first = rows.filter(F.pmod(F.pmod(place, F.lit(mult)), F.lit(step)) == 0).select("symbol", (F.col("ord") + (mult - 1)).alias("ord"), F.col("timestamp").alias("_start"), F.col("price_open").alias("_open"), F.col("_block").alias("_first"), *[F.col(f"_t_{c}").alias(f"_f_{c}") for c in best])
    both = join_on(rows.drop(*[f"_t_{c}" for c in best]), first, ["symbol", "ord"])
    two = F.col("_first") != F.col("_block")
    made = {c: F.when(two, F.col(f"_f_{c}") + F.col(f"_h_{c}")).otherwise(F.col(f"_h_{c}")) for c in sums}
    made |= {c: F.when(two, k[1](f"_f_{c}", f"_h_{c}")).otherwise(F.col(f"_h_{c}")) for c, k in kinds.items()}
    start = F.col("end_ord") - (mult - 1) - offset
    out = both.select("symbol", F.col("_start").alias("timestamp"), "timestamp_close", "price", F.col("_open").alias("price_open"), *[made[c].alias(c) for c in (*kinds, *sums)], F.col("ord").alias("end_ord"))
    return out.withColumns({"phase": (F.pmod(start, F.lit(mult)) / step).cast("int"), "ord": F.floor(start / mult)}).filter(F.pmod(start, F.lit(mult)) < mult // step * step)


def multiplier(layer: str, fidelity: str = "1m") -> int:
    return MINUTES[layer] // MINUTES[fidelity]


def phase_slot(ms: Column, run: str, layer: str) -> Column:
    """Which phase of a layer ends at a time: whole run steps since the layer's period began. Weeks begin on Monday."""
    period, unit = MINUTES[layer], MINUTES[run]
    if period <= unit or run not in ("1m", "5m", "10m", "15m", "30m", "1h"):
        return F.lit(0)
    minutes = F.floor(ms / 60_000)
    # The epoch was a Thursday: three days after a Monday.
    since = F.pmod(minutes + (3 * 1440 if layer == "1w" else 0), F.lit(period))
    return F.floor(since / unit).cast("int")


def run_divider(fidelity: str, run: str) -> int:
    """Input rows in one step of a run."""
    if run not in ("1m", "5m", "10m", "15m", "30m", "1h") or MINUTES[run] % MINUTES[fidelity]:
        raise ValueError(f"no run at {run} on bars of {fidelity}")
    return MINUTES[run] // MINUTES[fidelity]


def warmup(mults: list[int], lookback: int, rows: int | None = None, divider: int = 1) -> tuple[int, int, int | None]:
    """Rows before every layer has a full look-back, the first row to run from, and the steps of a series of so many rows."""
    offset = max(mults) * lookback
    return offset, offset - 1, None if rows is None else max(0, (rows - offset) // divider)


def close_boundary(column: str = "timestamp_close") -> Column:
    """A bar that ends at 11:59:59.999 meets 12:00."""
    return F.col(column) + 1


def align_bars(base: DataFrame, other: DataFrame, out: str = "other_ord") -> DataFrame:
    """The last bar of other that has closed when each base bar closes; -1 before the first."""
    keyed = lambda df: df.withColumn("close_key", close_boundary())
    return asof_align(keyed(base), keyed(other), "close_key", "ord", out)


def drop_incomplete(df: DataFrame, counts: list[str], lookback: int) -> DataFrame:
    """Rows from the first on at which every aligned layer has a full look-back (counts are last bar numbers)."""
    full = F.lit(True)
    for c in counts:
        full = full & (F.col(c) >= lookback - 1)
    return df.filter(full)
