"""Hand-worked cases of the candle operators."""

import decimal
import json
import random

import pytest

from barloom.functions import features as ft
from barloom.operators import clean, exits, experience, labels, metrics, ordinal, resample, signals, sweep, trades
from barloom.operators.metrics import F
from barloom.schema import EXIT_PRESETS, INDICATOR_SETS, TEST_LABEL_PRESETS
from barloom.sources import candles, sinks


def series(spark, prices, step=60_000, **more):
    rows = [("s", i * step, i * step + step - 1, float(p), float(p), float(p), float(p), 1.0, 2.0, 3, i, *[v[i] for v in more.values()]) for i, p in enumerate(prices)]
    names = "symbol string, timestamp long, timestamp_close long, price_open double, price_high double, price_low double, price double, volume double, asset_volume_quote double, trades_number long, ord long"
    return spark.createDataFrame(rows, names + "".join(f", {k} {'int' if isinstance(v[0], int) else 'double'}" for k, v in more.items()))


def column(df, *names):
    rows = df.orderBy("ord").collect()
    return [r[names[0]] for r in rows] if len(names) == 1 else [tuple(r[n] for n in names) for r in rows]


def test_gap_fill(spark):
    df = series(spark, [10, 20]).withColumn("timestamp", F.when(F.col("ord") == 1, 180_000).otherwise(0)).withColumn("timestamp_close", F.col("timestamp") + 59_999)
    out = clean.fill_gaps(df, 60_000).orderBy("timestamp").collect()
    assert [(r.timestamp, r.timestamp_close, r.price_low, r.volume) for r in out] == [(0, 59_999, 10, 1), (60_000, 119_999, 10, 0), (120_000, 179_999, 10, 0), (180_000, 239_999, 20, 1)]
    assert clean.find_gaps(df, 60_000).collect()[0].missing == 2


def test_percent_change_of_zero(spark):
    df = clean.clean_features(ft.pct_change(series(spark, [100, 110, 0, 0, 55]), {"x": "price"}), ["x"])
    assert [round(x, 9) for x in column(df, "x")] == [0, 0.1, -1, 0, 0]


def test_runs_and_profit(spark):
    df = series(spark, [10, 11, 12, 12, 11, 13])
    assert column(labels.label_runs(df), "signal_buy_sell") == [2, 1, -2, -1, 3, 0]
    out = column(labels.label_profit(df, 0.15, 2), "signal_buy_profitable", "signal_buy_drawdown")
    assert [x for x, _ in out] == [2, 3, 3, 3, 1, 0] and [round(y, 9) for _, y in out] == [0, 0, round(-1 / 12, 9), round(-1 / 12, 9), 0, 0]


def test_phase_slots(spark):
    ms = F.lit(1704289620000)  # Wednesday 2024-01-03 13:47
    want = {("1m", "15m"): 2, ("1m", "1h"): 47, ("1m", "4h"): 107, ("1m", "1d"): 827, ("1m", "1w"): 3707, ("5m", "1h"): 9, ("15m", "1h"): 3, ("1h", "4h"): 1, ("1h", "1d"): 13, ("1h", "1w"): 61, ("1d", "1w"): 0, ("1h", "1h"): 0}
    got = spark.range(1).select(*[resample.phase_slot(ms, a, b).alias(f"{a}{b}") for a, b in want]).first()
    assert list(got) == list(want.values())


def test_asof(spark):
    base = spark.createDataFrame([("s", 10), ("s", 20), ("s", 30)], "symbol string, t long")
    other = spark.createDataFrame([("s", 15, 0), ("s", 20, 1), ("s", 40, 2)], "symbol string, t long, i int")
    assert [r.i2 for r in ordinal.asof_align(base, other, "t", "i", "i2").orderBy("t").collect()] == [-1, 1, 1]


def test_resample_drops_the_tail(spark):
    out = resample.resample(series(spark, range(1, 8)), 3).orderBy("ord").collect()
    assert [(r.price_open, r.price, r.volume) for r in out] == [(1, 3, 3), (4, 6, 3)]


@pytest.mark.parametrize("prices,actions,cfg,want", [
    ([10, 12], [1, 2], trades.Exits(0.01, 100), [(1, 17.612, 0)]),
    ([100, 104, 111], [1, 0, 0], trades.Exits(0, 100, take_profit=0.1), [(2, 11, 1)]),
    ([100, 97, 94], [1, 0, 0], trades.Exits(0, 100, stop_loss=0.05), [(2, -6, -1)]),
    ([100, 97, 98], [1, 0, 1], trades.Exits(0, 100, stop_loss=0.05), [(None, None, None)]),
])
def test_trades(spark, prices, actions, cfg, want):
    out = trades.match_trades(series(spark, prices, action=actions), cfg).orderBy("entry_ord").collect()
    assert [(r.exit_ord, None if r.profit is None else round(r.profit, 6), r.reason) for r in out] == want


def walk(prices, actions, cfg):
    """The same by one loop over the steps."""
    entry, high, out = None, 0.0, []
    for i, (p, a) in enumerate(zip(prices, actions)):
        if entry is None:
            if a == 1:
                entry, high = i, p
            continue
        worth, reason = (1 - cfg.fee) * p / prices[entry], None
        if a == 2:
            reason = 0
        elif cfg.trailing and high >= prices[entry] * (1 + cfg.take_profit) and p <= high * (1 - cfg.trailing):
            reason = 1
        elif cfg.take_profit is not None and not cfg.trailing_only and worth - 1 >= cfg.take_profit:
            reason = 1
        elif cfg.stop_loss is not None and 1 - worth >= cfg.stop_loss:
            reason = -1
        high = max(high, p)
        if reason is not None:
            out.append((entry, i, reason))
            entry = None
    return out + ([(entry, None, None)] if entry is not None else [])


@pytest.mark.parametrize("cfg", [trades.Exits(), trades.Exits(take_profit=0.02, stop_loss=0.02), trades.Exits(take_profit=0.3, stop_loss=0.2), trades.Exits(take_profit=0.02, stop_loss=0.03, trailing=0.005, trailing_only=True)])
def test_trades_equal_a_walk(spark, cfg):
    rng = random.Random(7)
    prices = [100.0]
    for _ in range(1500):
        prices.append(prices[-1] * (1 + rng.gauss(0, 0.004)))
    actions = [rng.choice([0] * 300 + [1] * 20 + [2]) for _ in prices]
    got = trades.match_trades(series(spark, prices, action=actions), cfg).orderBy("entry_ord").collect()
    assert [(r.entry_ord, r.exit_ord, r.reason) for r in got] == walk(prices, actions, cfg)


def test_trailing_exits_far_from_their_entries(spark):
    cfg = trades.Exits(0, take_profit=0.2, stop_loss=0.3, trailing=0.05, trailing_only=True)
    for late, want in ((60, [(0, 3000, -1), (3001, None, None)]), (130, [(0, 3001, 1)])):
        prices, actions = [100.0] * 3000 + [late, 100, 100], [1] + [0] * 3000 + [1, 0]
        got = trades.match_trades(series(spark, prices, action=actions), cfg).orderBy("entry_ord").collect()
        assert [(r.entry_ord, r.exit_ord, r.reason) for r in got] == want == walk(prices, actions, cfg)


@pytest.mark.parametrize("size", [150, 1000])
def test_exits_carried_over_chunks(spark, size):
    cfg = trades.Exits(take_profit=0.03, stop_loss=0.04, trailing=0.01, trailing_only=True)
    rng = random.Random(size)
    prices = [100.0]
    for _ in range(1200):
        prices.append(prices[-1] * (1 + rng.gauss(0, 0.002)))
    df = series(spark, prices, action=[int(i % 7 == 0) for i in range(len(prices))]).withColumn("next_sell", F.lit(None).cast("long"))
    got = {r.entry: (r.cross, r.cross_reason) for r in exits.first_exits(df, cfg, ["symbol"], size).collect()}
    want = {i: walk(prices[i:], [1] + [0] * len(prices), cfg)[0] for i in range(0, len(prices), 7)}
    assert got == {i: (None if at is None else i + at, reason) for i, (_, at, reason) in want.items()}


def test_drawdown(spark):
    df = series(spark, [100, 110, 99, 120, 108], action=[1, 0, 0, 0, 0])
    cfg = trades.Exits(0, 100)
    assert [round(x, 9) for x in column(trades.ledger(df, trades.match_trades(df, cfg), cfg), "drawdown")] == [0, 0, -0.1, 0, -0.1]


def test_dip_metrics(spark):
    rows = [(True, True)] * 3 + [(False, True)] * 2 + [(True, False)] + [(False, False)] * 4
    r = metrics.dip_metrics(spark.createDataFrame(rows, "p boolean, a boolean"), F.col("p"), F.col("a")).first()
    assert [round(x, 9) for x in (r.recall, r.precision, r.negative_recall, r.balanced, r.f1, r.ratio)] == [0.6, 0.75, 0.8, 0.7, round(2 / 3, 9), 3] and r.totals == "[3/5]-[1/5]"


def test_streaks(spark):
    df = spark.createDataFrame([("s", i, h) for i, h in enumerate([True, True, False, True, False, False, True])], "symbol string, ord long, hit boolean")
    r = metrics.hit_streaks(df, F.col("hit")).first()
    assert (r.streaks, r.avg_streak, r.max_streak) == (4, 1, 2)


def test_n_step_and_weights(spark):
    df = spark.createDataFrame([("s", i, float(i + 1), int(i == 3), i) for i in range(4)], "symbol string, ord long, reward double, done int, next_obs int")
    assert [(r.ord, r.n_return) for r in experience.n_step(df, 3, 0.5).orderBy("ord").collect()] == [(0, 2.75), (1, 4.5)]
    cut = spark.createDataFrame([("s", 0, 1.0, 0, 1), ("s", 1, 2.0, 1, 2), ("s", 2, 3.0, 0, 3)], "symbol string, ord long, reward double, done int, next_obs int")
    assert [tuple(r) for r in experience.n_step(cut, 3, 0.5).select("n_return", "n_done", "n_next_obs").collect()] == [(2.0, 1, 2)]
    weights = experience.importance_weights(spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.25)], "ord long, p double"), 1.0)
    assert [r.weight for r in weights.orderBy("ord").collect()] == [0.5, 1, 1]


def test_time_rule(spark):
    df = series(spark, [1]).withColumn("timestamp_close", F.lit(43_199_999))
    assert signals.signals_time(df, 1200, 1400).first().action == 1


@pytest.mark.parametrize("size", [3, 7, 64])
def test_chunks_change_nothing(spark, size):
    rng = random.Random(size)
    df = series(spark, [rng.random() for _ in range(50)])
    whole, parts = (ordinal.in_chunks(df, lambda w: {"x": F.sum("price").over(w.rowsBetween(-3, 2))}, 3, 2, size=s) for s in (1 << 16, size))
    assert column(whole, "x") == column(parts, "x")
    assert [round(x, 9) for x in column(ordinal.running(df, {"x": F.col("price")}, size=size), "x")] == [round(x, 9) for x in column(ordinal.running(df, {"x": F.col("price")}), "x")]
    holes = df.withColumn("y", F.when(F.col("ord") % 9 == 4, F.col("price")))
    assert column(ordinal.forward_fill(holes, ["y"], size=size), "y") == column(ordinal.forward_fill(holes, ["y"]), "y")


def test_large_frames_equal_native_ones(spark, monkeypatch):
    rng = random.Random(1)
    df = series(spark, [rng.random() * 100 for _ in range(90)])
    native = ft.rolling(df, "price", [7])
    monkeypatch.setattr(ft, "NATIVE", 1)
    for a, b in zip(column(native, "mean_7", "std_7", "max_7"), column(ft.rolling(df, "price", [7]), "mean_7", "std_7", "max_7")):
        assert a == b or all(abs(x - y) < 1e-9 for x, y in zip(a, b))


def test_read_and_ingest(spark, tmp_path):
    row = {"timestamp": 0, "timestamp_close": 59999, "price": "1.5", "price_open": 1, "price_high": "x", "price_low": 1.0, "volume": "2", "asset_volume_quote": 3, "asset_volume_taker_base": "616.24854100", "trades_number": 4, "indicators": {"rsi5": "7", "bad": "n/a"}}
    (tmp_path / "a.json").write_text(json.dumps([row, row | {"timestamp": 60000}]))
    candles.ingest_symbol(spark, str(tmp_path / "a.json"), "ABC", str(tmp_path / "lake"))
    out = ft.explode_indicators(candles.read_candles(spark, str(tmp_path / "lake"), form="parquet"), ["rsi5", "bad", "none"]).orderBy("timestamp").collect()
    assert [(r.symbol, r.timestamp, r.price, r.price_high, r.asset_volume_taker_base, r.trades_number, r.rsi5, r.bad, r.none) for r in out] == [("ABC", t, 1.5, None, 616.248541, 4, 7.0, None, None) for t in (0, 60000)]


def test_presets_and_modes():
    assert len(INDICATOR_SETS) == 15 and len(INDICATOR_SETS["indicators10"]) == 14 and len(EXIT_PRESETS) == 12
    for mode in ("trade_percent", "trade_position", "trade_amount"):
        with pytest.raises(ValueError):
            trades.check_mode(mode)
    # Preset n of the grid: take-profits run within stop-losses.
    assert EXIT_PRESETS[4] == (0.001, 0.02, 0.001) and EXIT_PRESETS[11] == (0.01, 0.01, 0.001)
    assert {k: w for k, (_, w) in TEST_LABEL_PRESETS.items()} == {"1m": 240, "5m": 60, "10m": 240, "15m": 240, "1h": 60}


@pytest.mark.parametrize("style", [(",", ":"), (", ", ": "), "indented"])
def test_array_files_are_split(spark, tmp_path, style):
    rows = [{"timestamp": i * 60_000, "timestamp_close": i * 60_000 + 59_999, "price": str(i), "volume": 1, "indicators": {} if i % 3 else {"rsi5": str(i), "odd": "{x"}, "trades_number": i} for i in range(2000)]
    text = json.dumps(rows, indent=2) if style == "indented" else json.dumps(rows, separators=style)
    (tmp_path / "many.json").write_text(text)
    (tmp_path / "one.json").write_text(json.dumps(rows[:1]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = candles.read_candles(spark, str(tmp_path / "many.json"), "s")
        assert df.rdd.getNumPartitions() > 5
        got = sorted((r.timestamp, r.price, r.volume, r.trades_number, sorted((r.indicators or {}).items()), r.symbol) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(r["timestamp"], float(r["price"]), 1.0, r["trades_number"], sorted(r["indicators"].items()), "s") for r in rows]
    assert candles.read_candles(spark, str(tmp_path)).count() == 2001 and candles.read_candles(spark, [str(tmp_path / "one.json")]).count() == 1


def test_array_files_that_change_their_style_are_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"timestamp":1},{"timestamp":2}, {"timestamp":3}]')
    with pytest.raises(Exception, match="more than one way"):
        candles.read_candles(spark, str(tmp_path / "a.json")).collect()


def test_results_and_reports(spark, tmp_path):
    table = sweep.results_table(spark.createDataFrame([("d", 1.5)], "data string, profit double"), "trade")
    sinks.write_results(table, str(tmp_path / "r") + "/")
    sinks.write_results(table, str(tmp_path / "named"))
    (folder,) = (tmp_path / "r").iterdir()
    assert folder.name.startswith("results_") and spark.read.option("header", True).csv(str(folder)).first()["Data"] == "d" and spark.read.option("header", True).csv(str(tmp_path / "named")).columns == sweep.TRADE_RESULT
    assert "Data" not in sweep.compact_report(table).columns and "$" in sweep.compact_report(table).columns
    grid = sweep.param_grid(spark, {"kind": ["deep", "hodl", "rule"], "x": [1, 2]})
    assert sweep.run_count(grid) == 6 and sweep.filter_runs(grid).count() == 4 and sweep.run_matrix(spark.range(3), grid).count() == 18 and sweep.repeat(grid, 10).count() == 60


def test_layers_and_warm_up():
    assert resample.multiplier("1w") == 10_080 and resample.multiplier("1d", "1h") == 24
    assert [resample.run_divider("1m", r) for r in ("5m", "10m", "15m", "30m", "1h")] == [5, 10, 15, 30, 60]
    with pytest.raises(ValueError):
        resample.run_divider("1m", "4h")
    assert resample.warmup([1, 60, 1440], 32) == (46_080, 46_079, None) and resample.warmup([1, 60], 32, 174_240, 60) == (1920, 1919, 2872)


def test_lenient_numbers_and_strict_dips(spark):
    df = clean.to_double(spark.createDataFrame([("1.5",), ("x",), (None,)], "a string"), ["a"])
    assert [r.a for r in df.collect()] == [1.5, None, None]
    prices = series(spark, [10, 12, 9, 9])
    dips = lambda **how: column(labels.label_dip(labels.label_profit(prices, 0.1, 2), 2, **how), "is_dip")
    assert dips() == [True, False, True, True] and dips(strict=True, pct=0.1) == [True, False, False, False]
    flat = clean.fill_gaps(series(spark, [10, 20]).withColumn("timestamp", F.when(F.col("ord") == 1, 120_000).otherwise(0)).withColumn("price_open", F.lit(3.0)), 60_000, flat=True).orderBy("timestamp").collect()
    assert (flat[1].price_open, flat[1].asset_volume_quote, flat[1].trades_number) == (10, 0, 0)


def test_null_symbols_stay(spark):
    df = series(spark, [1, 2, 4]).withColumn("symbol", F.when(F.col("ord") < 9, F.lit(None).cast("string")))
    assert ordinal.with_ordinal(df.drop("ord"), 60_000).count() == 3 and column(ordinal.running(df, {"x": F.col("price")}), "x") == [1, 3, 7]
    assert column(ft.pct_change(df, {"x": "price"}), "x") == [None, 1, 1] and clean.fill_gaps(df, 60_000).count() == 3
    assert [r.i2 for r in ordinal.asof_align(df.select("symbol", "ord"), df.select("symbol", "ord", F.col("ord").alias("i")), "ord", "i", "i2").orderBy("ord").collect()] == [0, 1, 2]


def test_asof_over_ranges_of_a_hot_key(spark):
    rng = random.Random(1)
    base = [(rng.choice(["a", "a", "a", "b"]), rng.randint(0, 50), i) for i in range(600)] + [("a", None, -5)]
    other = [("a", t, None if t == 20 else t * 10) for t in range(5, 40, 3)] + [("b", 49, 1)]
    got = ordinal.asof_align(spark.createDataFrame(base, "symbol string, t long, n long"), spark.createDataFrame(other, "symbol string, t long, v long"), "t", "v", "found")
    want = {n: next((v for s2, t2, v in reversed(other) if t is not None and s2 == s and t2 <= t and v is not None), -1) for s, t, n in base}
    assert {r.n: r.found for r in got.collect()} == want


def test_uniform_samples_agree(spark):
    df = spark.range(1000).withColumnRenamed("id", "ord")
    a, b = ({r.ord for r in experience.sample_uniform(d, 100, 3).collect()} for d in (df, df.repartition(7)))
    assert a == b and len(a) == 100 and 400 < sum(a) / 100 < 600 and a != {r.ord for r in experience.sample_uniform(df, 100, 4).collect()}


def test_candles_equal_their_sql_at_half_milliseconds_and_nulls(spark, tmp_path):
    """Events in the last half millisecond of an hour, and first and last ones without a value or properties."""
    import duckdb

    from barloom.plans import catalog

    con = duckdb.connect()
    con.sql("""CREATE TABLE events AS SELECT CAST(i AS BIGINT) AS event_id, CAST(t AS TIMESTAMP) AS ts, CAST(1 AS BIGINT) AS user_id, 'a' AS event_type, CAST(v AS DOUBLE) AS value, p AS props FROM (VALUES
      (0, '2024-01-01 00:00:00.0001', NULL, NULL), (1, '2024-01-01 00:10:00', 1, '{"k": 5}'), (2, '2024-01-01 00:50:00', 2, NULL), (3, '2024-01-01 00:59:59.999499', NULL, '{"k": 7}'),
      (4, '2024-01-01 00:59:59.9995', 3, '{"k": 9}'), (5, '2024-01-01 01:30:00', 4, '{"k": 90}'), (6, '2024-01-01 01:59:59.999999', 8, NULL), (7, '2024-01-01 03:00:00', NULL, NULL)) v(i, t, v, p)""")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("candles_hourly", "gap_filled", "feature_set_solo_price", "phase_slots"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.sql(catalog.ORACLE_SQL[name]).select(*[f'"{c}"' for c in got.columns]).fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), name


def test_queries_equal_their_sql_with_bars_without_time_symbol_or_price(spark, tmp_path):
    """A bar without a time comes after the series' last one; SQL's joins leave out what has no symbol or no ord."""
    import duckdb

    from barloom.plans import catalog

    con = duckdb.connect()
    con.sql("""CREATE TABLE events AS SELECT CAST(i AS BIGINT) AS event_id, CAST(t AS TIMESTAMP) AS ts, CAST(1 AS BIGINT) AS user_id, s AS event_type, CAST(v AS DOUBLE) AS value, '{"k": ' || k || '}' AS props FROM (VALUES
      (0, '2024-01-01 00:10:00', 'a', 4, 5), (1, '2024-01-01 01:10:00', 'a', 2, 95), (2, '2024-01-01 02:10:00', 'a', NULL, 10), (3, '2024-01-01 03:10:00', 'a', 3, 50), (4, '2024-01-01 05:10:00', 'a', 2, 7),
      (5, NULL, 'a', 9, 15), (6, NULL, 'a', 8, 3), (7, '2024-01-01 00:10:00', NULL, 4, 5), (8, '2024-01-01 01:10:00', NULL, 7, 5), (9, NULL, NULL, 1, 2), (10, NULL, 'b', 1, 6)) v(i, t, s, v, k)""")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    names = ["dip_metrics", "dip_metrics_running", "dip_rewards", "flagship", *[f"feature_set_{k}" for k in ft.FEATURE_TYPES], "label_profit", "pct_features", "gap_filled_to_day"]
    for name in names:
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.sql(catalog.ORACLE_SQL[name]).select(*[f'"{c}"' for c in got.columns]).fetchall()
        row = lambda r: tuple(float(x) if isinstance(x, decimal.Decimal) else x for x in r)
        assert sorted(map(str, map(row, got.collect()))) == sorted(map(str, map(row, want))), name


def equal_their_sql(spark, folder, names):
    """Bars of an hour each from the folder's events: queries and their SQL, row by row."""
    import duckdb

    from barloom.plans import catalog

    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    row = lambda r: tuple(float(x) if isinstance(x, decimal.Decimal) else x for x in r)
    for name in names:
        got = catalog.QUERIES[name](spark, str(folder))
        want = con.sql(catalog.ORACLE_SQL[name]).select(*[f'"{c}"' for c in got.columns]).fetchall()
        assert sorted(map(str, map(row, got.collect()))) == sorted(map(str, map(row, want))), name


def hours(folder, values, props):
    """An event an hour with a value and properties each."""
    import duckdb

    rows = [(i, v, p) for i, (v, p) in enumerate(zip(values, props))]
    con = duckdb.connect()
    con.sql("CREATE TABLE e (i BIGINT, v DOUBLE, p VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", rows)
    con.sql(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * i AS ts, i AS user_id, 'a' AS event_type, v AS value, p AS props FROM e) TO '{folder}/events.parquet' (FORMAT parquet)")


def test_indicators_are_numbers_where_sql_reads_one(spark, tmp_path):
    texts = ["12d", "12F", "0x1p3", "1_0", "1_0.5_0", "_1", "1__0", "1.5e0_1", " 7\\t", "\\u000012", "+5", "+-5", ".5", "5.", "1e", "12 3", "NaN", "-nan", "inf", "-Infinity", "1e400", "", "٣", "x"]
    props = [f'{{"k": "{t}"}}' for t in texts] + [f'{{"k": {t}}}' for t in ("1e400", "-1e400", "NaN", "true", "null", "[5]", '{"k": 5}', "5, \"k\": 6", "2.5e1")]
    hours(tmp_path, [1 + 3 * (i % 4) for i in range(len(props))], props)
    equal_their_sql(spark, tmp_path, ["dip_rewards", "dip_metrics_running", "dip_metrics"])


def test_values_round_as_in_sql(spark, tmp_path):
    """Halves of the sixth place that no double holds exactly, values beyond the product, and no values."""
    import duckdb

    from barloom.plans import catalog

    values = [3951 / 1920, 58.93 / 6.4 - 1, -(58.93 / 6.4 - 1), -1e-9, 0.0, 1e305, 2e15, 0.1234565, float("inf"), float("nan"), None]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", catalog.rounded("v", 6).alias("x")).orderBy("i").collect()]
    assert list(map(str, got)) == [str(duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0]) for v in values]
    hours(tmp_path, [6.4, 58.93, 6.4, 5.0], ['{"k": 5}'] * 4)
    equal_their_sql(spark, tmp_path, ["feature_set_only_price_percent", "flagship"])


def test_features_keep_nan_and_infinite_values_as_sql_does(spark, tmp_path):
    values = [2.0, float("nan"), float("inf"), 3.0, float("-inf"), 0.0, 5.0, 1e308, None, 4.0, 1e200, 2.0]
    hours(tmp_path, values, [f'{{"k": "{t}"}}' for t in ("5", "nan", "inf", "7", "-inf", "1e400", "x", "3", "0", "2", "2", "nan")])
    equal_their_sql(spark, tmp_path, [*[f"feature_set_{k}" for k in ft.FEATURE_TYPES], "pct_features", "flagship"])
