"""Trades that an action column makes, and the ledger of every step.

An exit depends on its entry alone, as every trade starts from the same balance. So exits are found for all candidate
entries at once, and the trades are the chain of entries that come after the last exit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import taken
from .exits import first_exits
from .ordinal import CHUNK, forward_fill, join_on, running, running_best, settled


@dataclass(frozen=True)
class Exits:
    fee: float = 0.001
    balance: float = 100_000.0
    take_profit: float | None = None
    stop_loss: float | None = None
    trailing: float | None = None
    trailing_only: bool = False


def match_trades(df: DataFrame, cfg: Exits = Exits(), keys: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """keys, entry_ord, exit_ord (null: open at the end), entry_price, exit_price, reason (1, -1, 0), profit, fees."""
    if cfg.trailing is not None and cfg.take_profit is None:
        cfg = Exits(cfg.fee, cfg.balance, None, cfg.stop_loss)
    df = df.select(*keys, "ord", "price", "action")
    back = df.withColumns({"_back": -F.col("ord"), "next_sell": F.when(F.col("action") == 2, F.col("ord"))})
    df = settled(forward_fill(back, ["next_sell"], key=keys, order="_back").drop("_back"))
    if cfg.take_profit is None and cfg.stop_loss is None:
        exits = df.filter("action = 1").select(*keys, F.col("ord").alias("entry"), F.col("price").alias("entry_price"), "next_sell", F.lit(None).cast("long").alias("cross"), F.lit(None).cast("int").alias("cross_reason"))
    else:
        exits = first_exits(df, cfg, keys)
    exits = exits.withColumn("exit", F.least("next_sell", "cross"))
    kept = taken(exits.select(*keys, "entry", "exit", "entry_price", F.col("cross_reason").alias("_forced"), (F.col("exit") == F.col("next_sell")).alias("_sold")), keys)
    kept = kept.select(*keys, F.col("entry").alias("entry_ord"), F.col("exit").alias("exit_ord"), "entry_price", "_forced", "_sold")
    return settled(priced(kept, df.select(*keys, "ord", "price"), cfg, keys, keys))


def priced(kept: DataFrame, bars: DataFrame, cfg: Exits, keys: list[str], bar_keys: list[str]) -> DataFrame:
    """Trades (keys, entry_ord, exit_ord, entry_price, _forced, _sold) with exit price, reason, profit and fees; bars: bar_keys, ord, price."""
    prices = bars.select(*bar_keys, F.col("ord").alias("exit_ord"), F.col("price").alias("exit_price"))
    out = join_on(kept, prices, [*bar_keys, "exit_ord"], "left")
    ratio = (1 - cfg.fee) * (1 - cfg.fee) * F.col("exit_price") / F.col("entry_price")
    reason = F.when(F.col("exit_ord").isNull(), None).when(F.coalesce("_sold", F.lit(False)), 0).otherwise(F.col("_forced"))
    fees = cfg.fee * cfg.balance + F.coalesce(cfg.balance * (1 - cfg.fee) * F.col("exit_price") / F.col("entry_price") * cfg.fee, F.lit(0.0))
    return out.select(*keys, "entry_ord", "exit_ord", "entry_price", "exit_price", reason.cast("int").alias("reason"), (cfg.balance * (ratio - 1)).alias("profit"), fees.alias("fees"))


def ledger(df: DataFrame, trades: DataFrame, cfg: Exits = Exits(), keys: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """Every step with made, reason, bought, sold, in_position (after it), net_worth, drawdown, highest and counters."""
    entries = trades.select(*keys, F.col("entry_ord").alias("ord"), F.col("entry_ord").alias("_e"), F.col("entry_price").alias("_p"), F.coalesce("exit_ord", F.lit(1 << 62)).alias("_x"), F.col("reason").alias("_r"))
    joined = settled(join_on(df, entries, [*keys, "ord"], "left"))
    rows = forward_fill(joined, ["_e", "_p", "_x", "_r"], key=keys)
    inside = F.coalesce(F.col("ord") <= F.col("_x"), F.lit(False))
    units = cfg.balance * (1 - cfg.fee) / F.col("_p")
    sold = F.coalesce(F.col("ord") == F.col("_x"), F.lit(False))
    worth = F.when(sold, units * F.col("price") * (1 - cfg.fee)).when(inside, units * F.col("price")).otherwise(cfg.balance)
    rows = rows.withColumns({
        "bought": F.coalesce(F.col("ord") == F.col("_e"), F.lit(False)), "sold": sold, "in_position": inside & ~sold, "net_worth": worth,
        "reason": F.when(sold, F.coalesce("_r", F.lit(0))).otherwise(0),
    }).withColumn("made", F.col("bought") | F.col("sold"))
    # Rows out of position need no peak: they are dealt by chunks of time.
    rows = rows.withColumn("_trade", F.when(F.col("in_position"), F.col("_e")).otherwise(-1 - F.floor(F.col("ord") / CHUNK)))
    rows = running_best(rows, "price", "_peak", F.max, [*keys, "_trade"])
    rows = running_best(rows, "price", "_trough", F.min, [*keys, "_trade", "_peak"])
    rows = rows.withColumns({"highest": F.when(F.col("in_position"), F.col("_peak")), "drawdown": F.when(F.col("in_position"), F.col("_trough") / F.col("_peak") - 1).otherwise(0.0)}).drop("_trade", "_peak", "_trough")
    rows = settled(rows)
    counted = running(rows, {"buys": F.col("bought").cast("int"), "sells": F.col("sold").cast("int"), "total_profit": F.when(F.col("sold"), F.col("net_worth") - cfg.balance).otherwise(0.0)}, key=keys)
    return counted.withColumn("entry_price", F.when(F.col("in_position"), F.col("_p"))).drop("_e", "_p", "_x", "_r")


def until_ruin(ledger_: DataFrame, keys: list[str] = ["symbol"], least: float = 0.1) -> DataFrame:  # noqa: B006
    """Steps up to the first with a net worth of least or less."""
    end = ledger_.filter(F.col("net_worth") <= least).groupBy(*keys).agg(F.min("ord").alias("_end"))
    return join_on(ledger_, end, keys, "left").filter(F.col("ord") <= F.coalesce("_end", F.lit(1 << 62))).drop("_end")


def check_mode(mode: str) -> None:
    if mode in ("trade_percent", "trade_position", "trade_amount"):
        raise ValueError(f"mode {mode} isn't supported")
