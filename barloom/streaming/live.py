"""Live candles: duplicates, coarser bars, newest bars and signals on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.signals import Rule
from barloom.sources.sinks import trigger


def dedupe(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row for each symbol and bar among the rows that polls repeat."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["symbol", "timestamp"])


def stream_resample(stream: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Bars of a window's length, at every slide (the phases) if one is given; a bar comes once the watermark passes it."""
    at = F.struct("event_time", "timestamp")
    window = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    bars = stream.withWatermark("event_time", delay).groupBy(window.alias("window"), "symbol").agg(
        F.min_by("price_open", at).alias("price_open"), F.max("price_high").alias("price_high"), F.min("price_low").alias("price_low"), F.max_by("price", at).alias("price"),
        F.sum("volume").alias("volume"), F.sum("trades_number").alias("trades_number"), F.count(F.lit(1)).alias("rows"),
    )
    return bars.select("symbol", F.unix_millis("window.start").alias("timestamp"), (F.unix_millis("window.end") - 1).alias("timestamp_close"), "price_open", "price_high", "price_low", "price", "volume", "trades_number", "rows")


def _newest(n: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = dict(zip(*state.get)) if state.exists else {}
        last, new = max(kept, default=None), {}
        for b in batches:
            for t, p in zip(b["timestamp"].tolist(), b["price"].tolist()):
                # Older than the newest bar of earlier batches: late. In the batch itself rows come in any order.
                if last is None or t >= last:
                    new[t] = max(p, new.get(t, p))
        kept |= new
        newest = sorted(kept, reverse=True)[:n]
        state.update((newest, [kept[t] for t in newest]))
        yield pd.DataFrame({"symbol": [key[0]] * len(newest), "timestamp": newest, "price": [kept[t] for t in newest], "place": range(len(newest))})

    return update


def latest_n(stream: DataFrame, n: int = 10) -> DataFrame:
    """The newest n bars of each symbol after every batch (update mode); state holds no more than those.

    A newer bar is added, the same one replaced, one older than those of earlier batches ignored; of rows of one batch with
    equal times the highest price counts, so the order of a batch's rows doesn't matter.
    """
    return stream.groupBy("symbol").applyInPandasWithState(_newest(n), "symbol string, timestamp long, price double, place int", "timestamps array<long>, prices array<double>", "update", GroupStateTimeout.NoTimeout)


def latest_n_batch(df: DataFrame, n: int = 10) -> DataFrame:
    """The same on a table. Every task passes on no more than n bars of a symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("timestamp"))
    ranked = df.groupBy("symbol", "timestamp").agg(F.max("price").alias("price")).withColumn("place", F.row_number().over(w) - 1)
    return ranked.filter(F.col("place") < n).select("symbol", "timestamp", "price", "place")


#: Columns of a bar that live features are made from.
BAR = ["price", "price_open", "price_high", "price_low", "volume", "asset_volume_quote"]


class _Windows(StatefulProcessor):
    """Bars of a symbol until the watermark passes them, and the last ones before those."""

    def __init__(self, length: int) -> None:
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getValueState("bars", "passed long, timestamp array<long>, " + ", ".join(f"{c} array<double>" for c in BAR))

    def _load(self) -> tuple[int, dict]:
        if not self.bars.exists():
            return -(1 << 62), {}
        passed, times, *columns = self.bars.get()
        return passed, dict(zip(times, zip(*columns)))

    def _store(self, passed: int, bars: dict) -> None:
        times = sorted(bars)
        columns = list(zip(*[bars[t] for t in times])) if times else [()] * len(BAR)
        self.bars.update((passed, times, *[list(c) for c in columns]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, bars = self._load()
        new = {}
        for b in rows:
            for t, *values in b[["timestamp", *BAR]].itertuples(index=False):
                if t > passed:  # a bar that has been passed on stays as it was
                    values = tuple(float(v) for v in values)
                    new[t] = max(values, new.get(t, values))
        if new:
            for t in new.keys() - bars.keys():
                self.handle.registerTimer(int(t))
            self._store(passed, bars | new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, bars = self._load()
        mark = timerValues.getCurrentWatermarkInMs()
        times, out = sorted(bars), []
        for i, t in enumerate(times):
            if passed < t <= mark:
                last = times[max(0, i + 1 - self.length) : i + 1]
                out.append((key[0], t, last, *[list(c) for c in zip(*[bars[x] for x in last])]))
        if out:
            passed = out[-1][1]
            old = [t for t in times if t <= passed][-self.length :]
            self._store(passed, {t: bars[t] for t in times if t > passed or t in old})
            yield pd.DataFrame(out, columns=["symbol", "timestamp", "times", *BAR])

    def close(self) -> None:
        pass


def live_windows(stream: DataFrame, length: int, delay: str = "1 hour") -> DataFrame:
    """Each bar once the watermark has passed it, with the last length bars up to it (fewer at first), oldest first.

    Rows may come in any order and repeatedly, within and across batches, until then; later ones are ignored, and of
    unlike rows for one bar the highest counts. State holds length bars of a symbol and those that aren't passed yet.
    Needs spark.sql.streaming.stateStore.providerClass to be the RocksDB provider.
    """
    schema = "symbol string, timestamp long, times array<long>, " + ", ".join(f"{c} array<double>" for c in BAR)
    rows = stream.withWatermark("event_time", delay).select("symbol", "event_time", "timestamp", *[F.col(c).cast("double").alias(c) for c in BAR])
    return rows.groupBy("symbol").transformWithStateInPandas(_Windows(length), schema, "append", "EventTime")


def live_features(windows: DataFrame, kind: str = "only_price_percent", timestamp: str = "none", step: int = 60_000) -> DataFrame:
    """symbol, timestamp, the feature columns of each window's last bar, and observation: those and four channels of zero,
    as a live model has no position. The same feature functions as on tables, within each window."""
    from barloom.functions import features as ft
    from barloom.operators.clean import clean_features

    at = ["symbol", "_window"]
    rows = windows.select("symbol", F.col("timestamp").alias("_window"), F.size("times").alias("_n"), F.posexplode(F.arrays_zip("times", *BAR)).alias("ord", "_b"))
    rows = rows.select(*at, "_n", F.col("ord").cast("long").alias("ord"), F.col("_b.times").alias("timestamp"), (F.col("_b.times") + step - 1).alias("timestamp_close"), *[F.col(f"_b.{c}").alias(c) for c in BAR])
    made, columns = ft.feature_set(rows, kind, "none", timestamp, at)
    last = clean_features(made.filter(F.col("ord") == F.col("_n") - 1), [c for c in columns if c != "timestamp_close"])
    return ft.assemble(last, columns).select("symbol", "timestamp", *[c for c in columns if c != "timestamp"], F.concat("features", F.array_repeat(F.lit(0.0), 4)).alias("observation"))


def run_live(stream: DataFrame, decide: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, length: int, delay: str = "1 hour", kind: str = "only_price_percent", every: str | None = None):
    """Live bars to windows, features, decisions and a sink, batch by batch. decide gets what live_features returns and
    adds an action; a batch that is repeated after a failure has the same number."""
    def act(batch: DataFrame, number: int) -> None:
        sink(decide(live_features(batch, kind)), number)

    return live_windows(stream, length, delay).writeStream.foreachBatch(act).outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger(every)).start()


def stream_signals(stream: DataFrame, rule: Rule, identifier: str, interval: str) -> DataFrame:
    """A threshold rule's signal for each live candle, in the layout of the signal sink."""
    from barloom.functions.features import explode_indicators
    from barloom.operators.signals import signals_threshold

    names = sorted({rule.buy, rule.sell} - set(stream.columns))
    acted = signals_threshold(explode_indicators(stream, names) if names else stream, rule)
    return acted.select(F.lit(identifier).alias("identifier"), F.col("symbol").alias("tokenPair"), F.lit(interval).alias("interval"), "timestamp", F.when(F.col("action") == 2, -1).otherwise(F.col("action")).alias("action"), F.lit(1).alias("certainty"))
