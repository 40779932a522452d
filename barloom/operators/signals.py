"""Actions from rules and models: 0 hold, 1 buy, 2 sell. Signals see the past alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import join_on, running


def signals_hodl(df: DataFrame) -> DataFrame:
    """Buy on the first bar, sell on the last."""
    ends = df.groupBy("symbol").agg(F.min("ord").alias("_a"), F.max("ord").alias("_b"))
    return join_on(df, ends, ["symbol"]).withColumn("action", F.when(F.col("ord") == F.col("_a"), 1).when(F.col("ord") == F.col("_b"), 2).otherwise(0)).drop("_a", "_b")


def signals_time(df: DataFrame, buy: int, sell: int) -> DataFrame:
    """Buy or sell when the close, or a second after it, shows HHMM as its UTC time to the second. Buy comes first."""
    seconds = lambda ms: F.pmod(F.floor(ms / 1000), F.lit(86400))
    at = lambda hhmm: (hhmm // 100) * 3600 + (hhmm % 100) * 60
    close = F.col("timestamp_close")
    hit = lambda hhmm: (seconds(close) == at(hhmm)) | (seconds(close + 1000) == at(hhmm))
    return df.withColumn("action", F.when(hit(buy), 1).when(hit(sell), 2).otherwise(0))


@dataclass(frozen=True)
class Rule:
    """Buy and sell conditions on a column each: against a threshold, or the price against the column."""

    buy: str
    sell: str
    buy_threshold: float = 0.0
    sell_threshold: float = 0.0
    buy_price_check: bool = False
    sell_price_check: bool = False
    buy_down: bool = True
    sell_up: bool = True
    buy_multiplier: bool = False
    sell_multiplier: bool = False


def signals_threshold(df: DataFrame, rule: Rule) -> DataFrame:
    def test(column: str, threshold: float, price_check: bool, multiplied: bool, below: bool) -> Column:
        level = F.col(column) * threshold if multiplied else F.col(column)
        left, right = (F.col("price"), level) if price_check else (level, F.lit(threshold))
        return left <= right if below else left >= right

    buy = test(rule.buy, rule.buy_threshold, rule.buy_price_check, rule.buy_multiplier, rule.buy_down)
    sell = test(rule.sell, rule.sell_threshold, rule.sell_price_check, rule.sell_multiplier, not rule.sell_up)
    return df.withColumn("action", F.when(buy, 1).when(sell, 2).otherwise(0))


def score(df: DataFrame, predict: Callable[[pd.Series], pd.Series], column: str = "features", out: str = "action", kind: str = "double") -> DataFrame:
    """A model's output for batches of feature arrays; predict is sent to the tasks once."""
    shared = df.sparkSession.sparkContext.broadcast(predict)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for x in batches:
            yield model(x)

    return df.withColumn(out, run(column))


def decode_action(column: str = "action") -> Column:
    return F.when(F.col(column) == 2, -1).otherwise(F.col(column))


def mask_sell(df: DataFrame) -> DataFrame:
    return df.withColumn("action", F.when(F.col("action") == 2, 0).otherwise(F.col("action")))


def signals_swap_to_orders(df: DataFrame) -> DataFrame:
    """Every action that isn't 0 turns the position over: odd ones buy, even ones sell."""
    df = running(df, {"_turns": F.when(F.col("action") != 0, 1).otherwise(0)})
    return df.withColumn("action", F.when(F.col("action") == 0, 0).when(F.col("_turns") % 2 == 1, 1).otherwise(2)).drop("_turns")
