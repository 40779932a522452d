"""Schemas and fixed tables of the candle library."""

from __future__ import annotations

from pyspark.sql import types as T

CANDLE = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("timestamp_close", T.LongType()),
    T.StructField("price_open", T.DoubleType()), T.StructField("price_high", T.DoubleType()), T.StructField("price_low", T.DoubleType()), T.StructField("price", T.DoubleType()),
    T.StructField("volume", T.DoubleType()), T.StructField("asset_volume_quote", T.DoubleType()),
    T.StructField("asset_volume_taker_base", T.DoubleType()), T.StructField("asset_volume_taker_quote", T.DoubleType()),
    T.StructField("trades_number", T.LongType()), T.StructField("indicators", T.MapType(T.StringType(), T.StringType())),
])
SIGNAL = "identifier string, tokenPair string, interval string, timestamp long, action int, certainty int"
RAW = ["timestamp", "timestamp_close", "price_open", "price_high", "price_low", "price", "volume", "asset_volume_quote", "trades_number"]

#: Minutes in a bar of each layer.
MINUTES = {"1m": 1, "5m": 5, "10m": 10, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440, "1w": 10080}

# Indicator bundles by name.
_BASE = ["timeseriesMomentum7", "closenessTo1000", "closenessTo10000", "meanReversion10", "meanReversion15"]
INDICATOR_SETS = {
    "indicators1": ["kallman15", *_BASE, "rsi5", "rsi10", "rsi15"],
    "indicators2": [*_BASE, "rsi10", "choppiness30"],
    "indicators3": ["kallman15", *_BASE, "rsi10", "choppiness30"],
    "indicators4": ["kallman15", *_BASE, "choppiness30"],
    "indicators5": [*_BASE, "choppiness30"],
    "indicators6": [*_BASE, "choppiness30", "cci10"],
    "indicators7": [*_BASE, "choppiness30", "disparityIndex7", "disparityIndex10"],
    "indicators8": [*_BASE, "choppiness30", "sortinoRatio30"],
    "indicators9": [*_BASE, "choppiness30", "volatilityVolume30", "volatilityVolume7"],
    "indicators10": [*_BASE, "choppiness30", "cci5", "cci7", "cci10", "turbulenceIndex10", "disparityIndex7", "disparityIndex10", "volatilityVolume30", "volatilityVolume7"],
    "indicators11": [*_BASE, "choppiness30", "williams5"],
    "indicators12": [*_BASE, "choppiness30", "williams10"],
    "indicators13": [*_BASE, "choppiness30", "stochasticOscillator5"],
    "indicators14": [*_BASE, "choppiness30", "stochasticOscillator10"],
    "indicators15": [*_BASE, "choppiness30", "sortinoRatio5"],
}

# Take-profit, stop-loss and trailing presets; label presets (return, most bars waited).
EXIT_PRESETS = [(tp, sl, 0.001) for sl in (0.03, 0.02, 0.01) for tp in (0.001, 0.002, 0.005, 0.01)]
LABEL_PRESETS = {"1m": (0.01, 240), "5m": (0.005, 12), "10m": (0.01, 24), "15m": (0.01, 16), "1h": (0.005, 1)}
TEST_LABEL_PRESETS = {"1m": (0.01, 240), "5m": (0.005, 60), "10m": (0.01, 240), "15m": (0.01, 240), "1h": (0.005, 60)}
