"""Streams give what the same operators give on tables."""

import json
import random

from pyspark.sql import functions as F

from barloom.functions import features as ft
from barloom.operators import clean, resample
from barloom.operators.signals import Rule
from barloom.sources import candles, sinks
from barloom.streaming import live


#: Minutes before the first bar: at time 0 a bar would be at the first watermark.
START = 10_000


def files(path, n, symbol="s", part=4):
    for k in range(0, n, part):
        rows = [{"symbol": symbol, "timestamp": (START + i) * 60_000, "timestamp_close": (START + i) * 60_000 + 59_999, "price": float(i % 17), "price_open": float(i), "price_high": i + 1.0, "price_low": i - 1.0, "volume": 1.0, "trades_number": 2, "indicators": {"k": str(i)}} for i in range(k, min(n, k + part))]
        (path / f"{k:04}.json").write_text("\n".join(map(json.dumps, [*rows, rows[0]])))


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_deduped_bars_equal_the_table(spark, tmp_path):
    files(tmp_path, 40)
    stream = candles.stream_candles(spark, str(tmp_path))
    assert run(live.dedupe(stream), "deduped").count() == 40
    got = run(live.stream_resample(stream.dropDuplicates(["symbol", "timestamp", "event_time"]), "10 minutes", delay="0 seconds"), "bars").orderBy("timestamp").collect()
    table = spark.read.schema(candles.CANDLE).json(str(tmp_path)).dropDuplicates(["symbol", "timestamp"]).withColumn("asset_volume_quote", candles.F.lit(0.0)).withColumn("ord", (candles.F.col("timestamp") / 60_000).cast("long") - START)
    want = resample.resample(table, 10).orderBy("ord").collect()
    assert 2 <= len(got) <= len(want) and all((a.timestamp, a.timestamp_close, a.price, a.price_high, a.volume) == (b.timestamp, b.timestamp_close, b.price, b.price_high, b.volume) for a, b in zip(got, want))
    hops = run(live.stream_resample(stream, "10 minutes", "5 minutes", "0 seconds"), "hops")
    assert {r.timestamp % 300_000 for r in hops.collect()} == {0}


def test_newest_bars(spark, tmp_path):
    files(tmp_path, 12)
    out = run(live.latest_n(candles.stream_candles(spark, str(tmp_path), maxFilesPerTrigger="1"), 3), "newest", "update").collect()
    last = sorted({(r.timestamp, r.price) for r in out if r.timestamp >= (START + 9) * 60_000})
    want = {(r.timestamp, r.price) for r in live.latest_n_batch(spark.read.schema(candles.CANDLE).json(str(tmp_path)), 3).collect()}
    assert set(last) == want


def test_signals_reach_the_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files(tmp_path / "in", 8)
    stream = live.stream_signals(candles.stream_candles(spark, str(tmp_path / "in")), Rule("k", "k", 2.0, 6.0), "model", "1m")
    sinks.write_signals(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    rows = [(r.key, json.loads(r.value)) for r in spark.read.json(str(tmp_path / "out")).collect()]
    assert {k for k, _ in rows} == {"model-s-1m"} and {v["timestamp"] // 60_000 - START: v["action"] for _, v in rows} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: -1, 7: -1}
    assert sinks.latest_signal(spark.createDataFrame([("p", 1, 5), ("p", 2, 9)], "tokenPair string, action int, timestamp long")).first().action == 2


def rows_to(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps({"symbol": s, "timestamp": t, "timestamp_close": t + 59_999, "price": p, "price_open": p, "price_high": p + 1, "price_low": p - 1, "volume": p * 2, "asset_volume_quote": p, "trades_number": 2}) for s, t, p in rows))


def test_newest_bars_in_any_order(spark, tmp_path):
    minute = lambda *ms: [("s", m * 60_000, float(m)) for m in ms]
    rows_to(tmp_path / "in", "1.json", minute(30, 10, 20))
    rows_to(tmp_path / "in", "2.json", [*minute(25, 30, 50, 40), ("s", 50 * 60_000, 7.0), (None, 60_000, 1.0)])
    stream = candles.stream_candles(spark, str(tmp_path / "in"), maxFilesPerTrigger="1")
    seen = {}
    q = live.latest_n(stream, 3).writeStream.foreachBatch(lambda df, n: seen.__setitem__(n, sorted((r.symbol or "", r.place, r.timestamp // 60_000, r.price) for r in df.collect()))).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen[0] == [("s", 0, 30, 30.0), ("s", 1, 20, 20.0), ("s", 2, 10, 10.0)]
    assert seen[1] == [("", 0, 1, 1.0), ("s", 0, 50, 50.0), ("s", 1, 40, 40.0), ("s", 2, 30, 30.0)]
    batch = spark.createDataFrame([("s", 50, 50.0), ("s", 50, 7.0), ("s", 40, 40.0), ("s", 30, 30.0), ("s", 20, 20.0), (None, 1, 1.0)], "symbol string, timestamp long, price double")
    assert sorted((r.symbol or "", r.place, r.timestamp, r.price) for r in live.latest_n_batch(batch, 3).collect()) == seen[1]


def test_live_features_equal_those_of_the_table(spark, tmp_path):
    rng = random.Random(2)
    minutes = [m for m in range(START, START + 60) if m % 7 != 3]
    rows = [(s, m * 60_000, round(50 + rng.random(), 6)) for s in ("a", "b") for m in minutes]
    spread, at = sorted(rows, key=lambda r: (r[1], rng.random())), 0
    for k in range(0, len(spread), 12):
        # Shuffled and repeated in a batch, and again in the next one.
        part = spread[k : k + 12] + spread[max(0, k - 4) : k + 3]
        rng.shuffle(part)
        rows_to(tmp_path / "in", f"{at:03}.json", part)
        at += 1
    rows_to(tmp_path / "in", f"{at:03}.json", [("end", (START + 500) * 60_000, 1.0)])
    rows_to(tmp_path / "in", f"{at + 1:03}.json", [("a", (START + 2) * 60_000, 9.0)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream, got = candles.stream_candles(spark, str(tmp_path / "in"), maxFilesPerTrigger="1"), []
        decide = lambda df: df.withColumn("action", F.when(F.col("price_percent") > 0, 1).otherwise(0))
        q = live.run_live(stream, decide, lambda df, n: got.extend(df.collect()), str(tmp_path / "checkpoint"), 5, "3 minutes")
        q.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    table = spark.createDataFrame([(s, t, t + 59_999, p, p, p + 1, p - 1, p * 2, p, i) for s in ("a", "b") for i, (_, t, p) in enumerate(r for r in rows if r[0] == s)], "symbol string, timestamp long, timestamp_close long, price double, price_open double, price_high double, price_low double, volume double, asset_volume_quote double, ord long")
    made, columns = ft.feature_set(table, "only_price_percent")
    want = {(r.symbol, r.timestamp): [round(r[c], 9) for c in columns] + [0.0] * 4 for r in clean.clean_features(made, columns).collect()}
    assert {(r.symbol, r.timestamp): [round(x, 9) for x in r.observation] for r in got if r.symbol != "end"} == want and len(got) == len(want)
    assert all(r.action == int(r.price_percent > 0) for r in got) and sum(r.action for r in got) > 20


def test_polling_trigger():
    assert sinks.trigger("10 seconds") == {"processingTime": "10 seconds"} and sinks.trigger(None) == {"availableNow": True}
