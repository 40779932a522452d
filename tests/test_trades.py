"""Chains and exits over many chunks against loops over all bars."""

import random

import pytest

from barloom.operators import chains, exits, sweep, trades
from barloom.operators.metrics import F
from tests.test_candles import series, walk


def chain(entries):
    free, out = -1, []
    for entry, end in sorted(entries):
        if entry > free:
            out.append(entry)
            free = (1 << 62) if end is None else end
    return out


@pytest.mark.parametrize("size", [4, 16, 1 << 16])
def test_chains_equal_a_loop(spark, size):
    rng, rows = random.Random(size), []
    for symbol in ("a", "b", None, "idle"):
        n = 400 if symbol != "idle" else 3
        for i in range(n):
            if rng.random() < 0.4 or symbol == "idle":
                rows.append((symbol, i, None if rng.random() < 0.01 else i + rng.choice([1, 1, 2, 5, 40, 90]), "x"))
    df = spark.createDataFrame(rows, "symbol string, entry long, exit long, note string").repartition(3)
    got = {}
    for r in chains.taken(df, ["symbol"], size).collect():
        got.setdefault(r.symbol, []).append(r.entry)
    want = {s: chain([r[1:3] for r in rows if r[0] == s]) for s in ("a", "b", None, "idle")}
    assert {s: sorted(e) for s, e in got.items()} == want
    assert chains.taken(df.limit(0), ["symbol"], size).count() == 0


@pytest.mark.parametrize("cfg", [
    trades.Exits(take_profit=0.05, stop_loss=0.04), trades.Exits(stop_loss=0.05), trades.Exits(take_profit=0.06, stop_loss=0.08, trailing=0.02, trailing_only=True),
    trades.Exits(take_profit=0.04, trailing=0.03), trades.Exits(take_profit=0.05, trailing=0.04, trailing_only=True),
])
def test_exits_over_a_tree_of_chunks(spark, cfg):
    rng = random.Random(5)
    rows, want = [], {}
    for symbol in ("a", None):
        prices = [100.0]
        for _ in range(1300):
            prices.append(prices[-1] * (1 + rng.gauss(0, 0.005)))
        sells = sorted(rng.sample(range(1300), 3))
        for i, p in enumerate(prices):
            rows.append((symbol, i, p, 2 if i in sells else int(i % 23 == 0), min((s for s in sells if s >= i), default=None)))
        for i in range(0, 1301, 23):
            if i in sells:
                continue
            sell = min((s for s in sells if s > i), default=len(prices))
            _, at, reason = walk(prices[i : sell + 1], [1] + [0] * len(prices), cfg)[0]
            want[symbol, i] = (None if at is None else i + at, reason)
    df = spark.createDataFrame(rows, "symbol string, ord long, price double, action int, next_sell long").repartition(3)
    got = {(r.symbol, r.entry): (r.cross, r.cross_reason) for r in exits.first_exits(df, cfg, ["symbol"], 8).collect()}
    assert got == want and len({a for a, _ in got.values()}) > 5


def test_a_trade_held_over_chunks(spark, monkeypatch):
    rng = random.Random(3)
    prices = [100 + rng.random() for _ in range(300)]
    df = series(spark, prices, action=[1] + [0] * 299)
    cfg = trades.Exits(0, 100)
    whole = trades.ledger(df, trades.match_trades(df, cfg), cfg).orderBy("ord").select("drawdown", "highest", "net_worth").collect()
    peak = trough = prices[0]
    for r, p in zip(whole, prices):
        peak, trough = (p, p) if p > peak else (peak, min(trough, p))
        assert r.highest == peak and abs(r.drawdown - (trough / peak - 1)) < 1e-12
    parts = trades.running_best(df.withColumn("_t", F.lit(0)), "price", "top", F.max, ["symbol", "_t"], size=7).orderBy("ord").collect()
    assert [r.top for r in parts] == [max(prices[: i + 1]) for i in range(300)]


def test_early_finish(spark):
    df = spark.createDataFrame([("s", i, w) for i, w in enumerate([5.0, 0.2, 0.1, 3.0])] + [(None, 0, 1.0), (None, 1, 0.05)], "symbol string, ord long, net_worth double")
    assert sorted((r.symbol or "", r.ord) for r in trades.until_ruin(df).collect()) == [("", 0), ("", 1), ("s", 0), ("s", 1), ("s", 2)]


def test_null_symbols_are_a_series(spark):
    df = series(spark, [10, 12, 11, 13], action=[1, 2, 1, 0]).withColumn("symbol", F.lit(None).cast("string"))
    found = trades.match_trades(df, trades.Exits(0, 100))
    assert [(r.symbol, r.entry_ord, r.exit_ord) for r in found.orderBy("entry_ord").collect()] == [(None, 0, 1), (None, 2, None)]
    assert trades.ledger(df, found, trades.Exits(0, 100)).count() == 4


@pytest.mark.parametrize("cfg", [trades.Exits(), trades.Exits(take_profit=0.01, stop_loss=0.01)])
def test_a_sweep_equals_its_runs(spark, cfg):
    rng = random.Random(8)
    rows = [(s, i, 100 + 3 * rng.random(), rng.random()) for s in ("a", "b", None) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, ord long, price double, k double").repartition(3)
    rules = {f"{low}-{high}": (F.col("k") <= low, F.col("k") >= high) for low in (0.1, 0.3, 2.0, -1.0) for high in (0.2, 0.9)}
    got, want = {}, {}
    for r in sweep.sweep_trades(df, rules, cfg, 16).collect():
        got.setdefault((r.run_id, r.symbol), []).append((r.entry_ord, r.exit_ord, r.reason))
    for name, (low, high) in ((f"{low}-{high}", (low, high)) for low in (0.1, 0.3, 2.0, -1.0) for high in (0.2, 0.9)):
        for s in ("a", "b", None):
            own = [r for r in rows if r[0] == s]
            found = walk([r[2] for r in own], [1 if r[3] <= low else 2 if r[3] >= high else 0 for r in own], cfg)
            if found:
                want[name, s] = found
    assert {k: sorted(v) for k, v in got.items()} == want
    totals = {(r.run_id, r.symbol): (r.wins + r.losses, r.trades) for r in sweep.evaluate(df, rules, cfg, 16).collect()}
    assert totals == {(n, s): (sum(x[1] is not None for x in want.get((n, s), [])), sum(1 + (x[1] is not None) for x in want.get((n, s), [])) / 2) for n in rules for s in ("a", "b", None)}
