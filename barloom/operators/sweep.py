"""Grids of runs, evaluated side by side in one job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.storage import cut

from .chains import taken
from .exits import first_exits
from .metrics import run_id
from .ordinal import CHUNK, join_on
from .trades import Exits, priced

# Columns of the results of trade runs and of dip runs.
TRADE_RESULT = ["Data", "Env", "Name", "Rewards", "$", "%", "Trade$", "CompoundTrade$", "Wins", "Losses", "Win%", "Avg$Win", "Max$Win", "Min$Win", "Avg$Loss", "Max$Loss", "Min$Loss", "Avg$Trade", "Fees$", "Volume$", "#trades", "SLs", "SL$", "Multipliers"]
DIP_RESULT = ["Data", "Env", "Name", "Rewards", "F1", "Ratio", "Acc%", "Prec%", "Rec%", "-Rec%", "AvgStreak", "MaxStreak", "Totals", "Multipliers"]
_TRADE_FROM = ["data", "env", "name", "total_reward", "profit", "profit_pct", "profit", "compound", "wins", "losses", "win_pct", "avg_win", "max_win", "min_win", "avg_loss", "max_loss", "min_loss", "avg_trade", "fees", "volume", "trades", "stop_losses", "stop_loss_sum", "multipliers"]
_DIP_FROM = ["data", "env", "name", "total_reward", "f1", "ratio", "balanced", "precision", "recall", "negative_recall", "avg_streak", "max_streak", "totals", "multipliers"]


def param_grid(spark: SparkSession, fields: Mapping[str, Iterable]) -> DataFrame:
    """All combinations of the fields' values, with a run_id: configuration, not data, and as small as the lists given."""
    tables = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in fields.items()]
    grid = reduce(lambda a, b: a.crossJoin(b), tables)
    return grid.withColumn("run_id", run_id(*[F.col(c).cast("string") for c in fields]))


def run_count(grid: DataFrame) -> int:
    return grid.count()


#: Most runs of a grid that is broadcast.
BROADCAST_RUNS = 10_000


def run_matrix(data: DataFrame, grid: DataFrame) -> DataFrame:
    """Every run over all rows. A grid of up to BROADCAST_RUNS runs is broadcast; a larger one is left to Spark."""
    return data.crossJoin(F.broadcast(grid) if run_count(grid.limit(BROADCAST_RUNS + 1)) <= BROADCAST_RUNS else grid)


def filter_runs(runs: DataFrame, kinds: Iterable[str] = ("deep", "hodl"), kind: str = "kind") -> DataFrame:
    """Runs of these kinds of strategy alone, as where rule strategies are skipped; without it all runs are evaluated."""
    return runs.filter(F.col(kind).isin(*kinds))


def _entries(t: pa.Table, heads: pa.Table) -> pa.Table:
    """The entries of a chunk in every run, each with the run's next sell; heads holds the next sells of later chunks."""
    t = t.sort_by("ord")
    ords, price, n = t["ord"].to_numpy(), t["price"], len(t)
    actions = np.array(t["actions"].combine_chunks().flatten()).reshape(n, -1)
    later = heads["later"][0].as_py()
    made: list[tuple] = []
    for run in range(actions.shape[1]):
        at = np.flatnonzero(actions[:, run] == 1)
        if not len(at):
            continue
        sells = np.flatnonzero(actions[:, run] == 2)
        place = np.searchsorted(sells, at)
        never = (1 << 62) if later[run] is None else later[run]
        made.append((np.full(len(at), run), at, np.append(ords[sells], never)[place]))
    run, at, sell = (np.concatenate([m[k] for m in made]) if made else np.empty(0, np.int64) for k in range(3))
    symbol = pa.nulls(len(at), pa.string()) if not t["symbol"][0].is_valid else pa.repeat(t["symbol"][0].cast(pa.string()), len(at))
    return pa.table({"run": pa.array(run, pa.int32()), "symbol": symbol, "entry": pa.array(ords[at], pa.int64()), "entry_price": price.take(pa.array(at)).cast(pa.float64()), "next_sell": pa.array(sell, pa.int64(), mask=sell == 1 << 62)})


def sweep_trades(bars: DataFrame, rules: Mapping[str, tuple[Column, Column]], cfg: Exits = Exits(), size: int = CHUNK) -> DataFrame:  # noqa: B008
    """Trades of every run at once: run_id, symbol and what match_trades returns.

    rules: for each run_id the buy and the sell condition; bars: symbol (text), ord, price and what the conditions read. A bar
    is written once with an array of all runs' actions. Exits by level don't depend on the run, so they are found once for
    the bars at which any run buys; of each run only its candidate entries are rows.
    """
    actions = F.array(*[F.when(buy, 1).when(sell, 2).otherwise(0).cast("byte") for buy, sell in rules.values()])
    rows = cut(bars.select("symbol", "ord", F.col("price").cast("double").alias("price"), actions.alias("actions"), F.floor(F.col("ord") / size).alias("_chunk")), "sweep")
    runs = range(len(rules))
    first = rows.groupBy("symbol", "_chunk").agg(F.array(*[F.min(F.when(F.col("actions")[i] == 2, F.col("ord"))) for i in runs]).alias("sells"))
    after = Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    heads = first.select(F.col("symbol").alias("of"), F.col("_chunk").alias("of_chunk"), F.array(*[F.min(F.col("sells")[i]).over(after) for i in runs]).alias("later"))
    found = rows.groupBy("symbol", "_chunk").cogroup(heads.groupBy("of", "of_chunk")).applyInArrow(_entries, "run int, symbol string, entry long, entry_price double, next_sell long")
    entries = cut(found, "entries")
    if cfg.take_profit is None and cfg.stop_loss is None:
        met = entries.withColumns({"cross": F.lit(None).cast("long"), "cross_reason": F.lit(None).cast("int")})
    else:
        any_buy = F.when(F.array_contains("actions", F.lit(1).cast("byte")), 1).otherwise(0)
        exits = first_exits(rows.select("symbol", "ord", "price", any_buy.alias("action"), F.lit(None).cast("long").alias("next_sell")), cfg, ["symbol"], size)
        met = join_on(entries, exits.select("symbol", "entry", "cross", "cross_reason"), ["symbol", "entry"])
    met = met.withColumn("exit", F.least("next_sell", "cross"))
    chain = taken(met.select("run", "symbol", "entry", "exit", "entry_price", F.col("cross_reason").alias("_forced"), (F.col("exit") == F.col("next_sell")).alias("_sold")), ["run", "symbol"], size)
    kept = chain.select("run", "symbol", F.col("entry").alias("entry_ord"), F.col("exit").alias("exit_ord"), "entry_price", "_forced", "_sold")
    names = F.array(*[F.lit(r) for r in rules])
    return priced(kept, rows, cfg, ["run", "symbol"], ["symbol"]).withColumn("run_id", names[F.col("run")]).drop("run")


def evaluate(bars: DataFrame, rules: Mapping[str, tuple[Column, Column]], cfg: Exits = Exits(), size: int = CHUNK) -> DataFrame:  # noqa: B008
    """One row for each run and symbol, also those without a trade: run_id, symbol, profit, wins, losses, trades."""
    done = sweep_trades(bars, rules, cfg, size)
    totals = done.groupBy("run_id", "symbol").agg(F.coalesce(F.sum("profit"), F.lit(0.0)).alias("profit"), F.count_if(F.col("profit") >= 0).alias("wins"), F.count_if(F.col("profit") < 0).alias("losses"), ((F.count(F.lit(1)) + F.count("exit_ord")) / 2).alias("trades"))
    every = bars.select("symbol").distinct().withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in rules])))
    out = join_on(every, totals, ["run_id", "symbol"], "left")
    return out.select("run_id", "symbol", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("profit", "wins", "losses", "trades")])


def repeat(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def results_table(df: DataFrame, kind: str, more: Iterable[str] = ()) -> DataFrame:
    """The layout of trade or dip results, and more columns behind; what df lacks is null."""
    names, source = (TRADE_RESULT, _TRADE_FROM) if kind == "trade" else (DIP_RESULT, _DIP_FROM)
    return df.select(*[(F.col(s) if s in df.columns else F.lit(None).cast("string")).alias(n) for n, s in zip(names, source)], *more)


# Columns that the compact report leaves out.
DETAIL = ["Data", "Env", "Acc%", "Prec%", "Rec%", "-Rec%", "AvgStreak", "MaxStreak", "Multipliers"]


def compact_report(df: DataFrame) -> DataFrame:
    return df.drop(*DETAIL)
