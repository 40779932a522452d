"""Labels that look ahead: direction runs, bars to profit, drawdown, dips, trends and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordinal import in_chunks, running


def label_runs(df: DataFrame) -> DataFrame:
    """signal_buy_sell: the first bar of an up-run has the run pair's number, later ones 1; down-runs negative; the last bar 0.

    The state before the first bar is down, in pair 1; a run goes up while the next price is higher.
    """
    df = in_chunks(df, lambda w: {"_next": F.lead("price").over(w), "_here": F.col("price")}, after=1)
    up = F.col("_next") > F.col("price")
    df = df.withColumn("_up", F.when(F.col("_next").isNotNull(), up))
    df = in_chunks(df, lambda w: {"_was": F.coalesce(F.lag("_up").over(w), F.lit(False))}, before=1)
    df = running(df, {"_pairs": F.when(F.col("_up") & ~F.col("_was"), 1).otherwise(0)})
    size = F.when(F.col("_up") != F.col("_was"), F.col("_pairs") + 1).otherwise(F.lit(1))
    sign = F.when(F.col("_up"), size).otherwise(-size)
    return df.withColumn("signal_buy_sell", F.when(F.col("_up").isNull(), 0).otherwise(sign).cast("int")).drop("_next", "_here", "_up", "_was", "_pairs")


def label_profit(df: DataFrame, pct: float, max_wait: int) -> DataFrame:
    """signal_buy_profitable: bars until the price is pct higher, one more than can be seen if never, 0 on the last bar;
    signal_buy_drawdown: the lowest return up to there, at most 0."""
    df = in_chunks(df, lambda w: {"_ahead": F.collect_list(F.struct("price")).over(w.rowsBetween(1, max_wait))}, after=max_wait)
    returns = F.transform("_ahead", lambda p: F.try_divide(p["price"], F.col("price")) - 1)
    df = df.withColumn("_returns", returns)
    hit = F.array_position(F.transform("_returns", lambda r: F.when(r >= pct, 1).otherwise(0)), 1)
    df = df.withColumn("_hit", hit)
    seen = F.size("_returns")
    wait = F.when(seen == 0, 0).when(F.col("_hit") > 0, F.col("_hit")).otherwise(seen + 1)
    low = F.array_min(F.slice("_returns", 1, F.when(F.col("_hit") > 0, F.col("_hit").cast("int")).otherwise(F.greatest(seen, F.lit(1)))))
    return df.withColumns({"signal_buy_profitable": wait.cast("int"), "signal_buy_drawdown": F.coalesce(F.least(low, F.lit(0.0)), F.lit(0.0))}).drop("_ahead", "_returns", "_hit")


def label_dip(df: DataFrame, max_wait: int, strict: bool = False, pct: float = 0.0) -> DataFrame:
    """is_dip: profitable within max_wait bars. Near the end a miss counts too; strict asks that the price really rose by pct."""
    near = F.col("signal_buy_profitable") <= max_wait
    if not strict:
        return df.withColumn("is_dip", near)
    best = in_chunks(df, lambda w: {"_best": F.max("price").over(w.rowsBetween(1, max_wait))}, after=max_wait)
    return best.withColumn("is_dip", near & F.coalesce(F.try_divide(F.col("_best"), F.col("price")) - 1 >= pct, F.lit(False))).drop("_best")


def label_trend(df: DataFrame) -> DataFrame:
    return df.withColumn("trend", F.signum(F.col("signal_buy_sell").cast("double")).cast("int"))


def label_turns(df: DataFrame) -> DataFrame:
    """perfect_buy and perfect_sell where a run begins, and the prices there."""
    buy, sell = F.col("signal_buy_sell") > 1, F.col("signal_buy_sell") < -1
    return df.withColumns({"perfect_buy": buy, "perfect_sell": sell, "buy_price": F.when(buy, F.col("price")), "sell_price": F.when(sell, F.col("price"))})
