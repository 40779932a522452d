"""Statistics of runs and quality of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import join_on, running


def trade_summary(ledger: DataFrame, keys: list[str] = ["symbol"], balance: float = 100_000.0, fee: float = 0.001) -> DataFrame:  # noqa: B006
    """One row for each run: profit, wins and losses (a win is a profit of 0 or more), averages and extremes, fees, volume.

    Losses are negative, so the largest loss is the mildest. What has no trades is 0.
    """
    c = F.col
    profit = F.when(c("sold"), c("net_worth") - balance)
    win, loss = F.when(profit >= 0, profit), F.when(profit < 0, profit)
    paid = F.when(c("bought"), fee * balance).when(c("sold"), c("net_worth") / (1 - fee) * fee)
    stopped = F.when(c("sold") & (c("reason") == -1), profit)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    reward = [zero(F.sum("reward")).alias("total_reward")] if "reward" in ledger.columns else []
    out = ledger.groupBy(*keys).agg(
        *reward, zero(F.sum(profit)).alias("profit"), (zero(F.product(1 + profit / balance) - 1) * balance).alias("compound"),
        F.count(win).alias("wins"), F.count(loss).alias("losses"), *[zero(f(x)).alias(f"{n}_{k}") for k, x in (("win", win), ("loss", loss)) for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))],
        zero(F.avg(profit)).alias("avg_trade"), (-zero(F.sum(paid))).alias("fees"),
        (zero(F.sum(F.when(c("made"), c("net_worth")))) + zero(F.sum(paid))).alias("volume"), (F.count_if("made") / 2).alias("trades"),
        F.count(stopped).alias("stop_losses"), zero(F.sum(stopped)).alias("stop_loss_sum"),
    )
    total = c("wins") + c("losses")
    return out.withColumns({"profit_pct": c("profit") / balance, "win_pct": F.coalesce(100 * F.try_divide(c("wins"), total), F.lit(0.0))})


def _counts(predicted: Column, actual: Column) -> dict[str, Column]:
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return {"correct": flag(predicted & actual), "positives": flag(actual), "wrong": flag(predicted & ~actual), "negatives": flag(~actual)}


def _quality(df: DataFrame) -> DataFrame:
    """Recall, precision, negative recall (1 without cases), balanced accuracy, F1 and the ratio of right to wrong."""
    c, one = F.col, lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    df = df.withColumns({"recall": one(c("correct"), c("positives")), "precision": one(c("correct"), c("correct") + c("wrong")), "negative_recall": one(c("negatives") - c("wrong"), c("negatives"))})
    return df.withColumns({
        "balanced": (c("recall") + c("negative_recall")) / 2, "f1": F.coalesce(F.try_divide(2 * c("precision") * c("recall"), c("precision") + c("recall")), F.lit(0.0)),
        "ratio": F.coalesce(F.try_divide(c("correct"), c("wrong")), c("correct").cast("double")),
        "totals": F.format_string("[%d/%d]-[%d/%d]", c("correct"), c("positives"), c("wrong"), c("negatives")),
    })


def dip_metrics(df: DataFrame, predicted: Column, actual: Column, keys: list[str] = []) -> DataFrame:  # noqa: B006
    return _quality(df.groupBy(*keys).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in _counts(predicted, actual).items()]))


def dip_metrics_running(df: DataFrame, predicted: Column, actual: Column, keys: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    return _quality(running(df, _counts(predicted, actual), key=keys))


def hit_streaks(df: DataFrame, hit: Column, counted: Column | None = None, keys: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """Streaks of hits among the counted rows: every miss ends one (of 0 or more), the end of the series the open one,
    unless the last row was a miss. keys, avg_streak, max_streak, streaks."""
    counted = F.lit(True) if counted is None else counted
    last = df.groupBy(*keys).agg(F.max("ord").alias("_end"))
    rows = join_on(df.withColumns({"_hit": F.coalesce(hit, F.lit(False)), "_counted": F.coalesce(counted, F.lit(False))}), last, keys)
    rows = running(rows, {"_misses": (F.col("_counted") & ~F.col("_hit")).cast("int")}, key=keys)
    miss = F.col("_counted") & ~F.col("_hit")
    island = F.col("_misses") - miss.cast("int")
    groups = rows.groupBy(*keys, island.alias("_island")).agg(F.count_if(F.col("_counted") & F.col("_hit")).alias("length"), F.max(miss).alias("_ended"), F.max(F.col("ord") == F.col("_end")).alias("_last"))
    done = groups.filter("_ended OR _last")
    return done.groupBy(*keys).agg(F.avg("length").alias("avg_streak"), F.max("length").alias("max_streak"), F.count(F.lit(1)).alias("streaks"))


def dip_reward(predicted: Column, actual: Column, buy: float = 1.0, wrong: float = -1.0, sell: float = -10.0, nothing: float = 0.01) -> Column:
    """Four payoffs: a dip called, a call without a dip, a dip missed, and rightly nothing."""
    return F.when(predicted & actual, buy).when(predicted, wrong).when(actual, sell).otherwise(nothing)


def trend_hit(action: str = "action", run: str = "signal_buy_sell") -> Column:
    return ((F.col(action) == 1) & (F.col(run) < 0)) | ((F.col(action) == 0) & (F.col(run) > 0))


def trend_metrics(df: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """reward 1 for a hit, and the accuracy so far."""
    hits = running(df.withColumn("reward", trend_hit().cast("int")), {"_hits": F.col("reward"), "_rows": F.lit(1)}, key=keys)
    return hits.withColumn("accuracy", F.col("_hits") / F.col("_rows")).drop("_hits", "_rows")


def regression_metrics(df: DataFrame, given: str, target: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """r2 with the total sum of squares of the first argument, and the mean squared relative error."""
    x, t = F.col(given), F.col(target)
    agg = df.groupBy(*keys).agg(F.var_pop(x).alias("_v"), F.count(x).alias("_n"), F.sum((x - t) * (x - t)).alias("_r"), F.avg(F.pow(F.try_divide(t - x, t), 2)).alias("relative_error"))
    return agg.select(*keys, (1 - F.try_divide(F.col("_r"), F.col("_v") * F.col("_n"))).alias("r2"), "relative_error")


def run_id(*columns: str) -> Column:
    return F.translate(F.concat_ws("_", *columns), ".|", "~]")


def fmt_multipliers(values: list[float] | Column) -> Column:
    texts = [F.format_string("%.3f;", F.lit(float(v))) for v in values]
    return F.concat(*texts)
