"""Look-back windows as model input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import in_chunks, join_on


def lookback(df: DataFrame, length: int, column: str = "features", out: str = "window", key: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """The last length rows' features, oldest first; rows without so many go."""
    made = in_chunks(df, lambda w: {out: F.collect_list(column).over(w.rowsBetween(-(length - 1), 0))}, before=length - 1, key=key)
    return made.filter(F.size(out) == length)


def multi_lookback(layers: dict[str, DataFrame], length: int) -> DataFrame:
    """One window of each layer ending at the same base row. Layers have symbol, end_ord, phase, ord and features."""
    tables = [lookback(df, length, out=name, key=["symbol", "phase"]).select("symbol", "end_ord", name) for name, df in layers.items()]
    return reduce(lambda a, b: join_on(a, b, ["symbol", "end_ord"]), tables)


def flatten_time_major(*windows: str) -> Column:
    """All layers' features of the oldest row, then of the next one."""
    joined = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), [F.col(w) for w in windows])
    return F.flatten(joined)


def flatten_layer_major(*windows: str) -> Column:
    return F.flatten(F.concat(*windows))


def portfolio_channels(ledger: DataFrame, take_profit: float | None, stop_loss: float | None, initial: float) -> DataFrame:
    """Per row: net worth change of the open trade, drawdown, closeness to take-profit and stop-loss, in position."""
    gain = F.when(F.col("in_position"), F.col("net_worth") / initial - 1).otherwise(0.0)
    near = lambda x, most: F.when(x > 0, x / most).otherwise(0.0) if most else F.lit(0.0)
    return ledger.withColumns({"ch_net_worth": gain, "ch_drawdown": F.col("drawdown"), "ch_take_profit": near(gain, take_profit), "ch_stop_loss": near(-gain, stop_loss), "ch_position": F.col("in_position").cast("double")})


#: Portfolio channels in the order in which they follow the features of a time row.
CHANNELS = ["ch_net_worth", "ch_drawdown", "ch_take_profit", "ch_stop_loss", "ch_position"]


def with_channels(windows: DataFrame, channels: DataFrame, length: int, *layers: str, names: list[str] = CHANNELS, key: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """observation: layers side by side for each time row, oldest first, each followed by that row's portfolio channels.

    channels: key, ord and the channels of every step; their last length values go with the window that ends at the step.
    """
    last = lookback(channels.select(*key, "ord", F.array(*[F.col(n).cast("double") for n in names]).alias("_channels")), length, "_channels", "_held", key)
    both = join_on(windows, last.select(*key, F.col("ord").alias("end_ord"), "_held"), [*key, "end_ord"])
    return both.withColumn("observation", flatten_time_major(*layers, "_held")).drop("_held")
