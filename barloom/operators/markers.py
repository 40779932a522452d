"""Columns that charts of candles mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trade_markers(ledger: DataFrame) -> DataFrame:
    """Close prices at executed buys and sells, attempted buys, stop-loss and take-profit exits; null elsewhere."""
    c, free = F.col, F.col("reason") == 0
    at = lambda test: F.when(test, c("price"))
    return ledger.select("symbol", "ord", *[c(a).alias(b) for a, b in (("price_open", "open"), ("price", "close"), ("price_low", "low"), ("price_high", "high")) if a in ledger.columns],
        at(c("made") & (c("action") == 1) & free).alias("made_buy"), at(c("action") == 1).alias("wanted_buy"), at(c("made") & (c("action") == 2) & free).alias("made_sell"),
        at(c("made") & (c("reason") == -1)).alias("stop_loss"), at(c("made") & (c("reason") == 1)).alias("take_profit"))


def prediction_markers(df: DataFrame, max_wait: int) -> DataFrame:
    """Right calls 50 under the close, wrong ones 50 above it; profitable bars 200 under the low."""
    c = F.col
    wait = c("signal_buy_profitable")
    return df.select("symbol", "ord", F.when(wait == 1, c("price_low") - 200).alias("strong"), F.when((wait >= 2) & (wait < max_wait), c("price_low") - 200).alias("ok"),
        F.when((c("action") > 0) & (c("reward") > 0), c("price") - 50).alias("action_ok"), F.when((c("action") > 0) & (c("reward") < 0), c("price") + 50).alias("action_bad"))


def limit_rows(df: DataFrame, k: int) -> DataFrame:
    return df.filter(F.col("ord") < k)
