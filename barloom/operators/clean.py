"""Repair and cleaning of candle tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinal import following


def find_gaps(df: DataFrame, step: int) -> DataFrame:
    """Rows whose close does not meet the next open: symbol, timestamp, next_timestamp, missing (bars)."""
    gaps = following(df.select("symbol", "timestamp", "timestamp_close"), "next_timestamp", step)
    missing = F.floor((F.col("next_timestamp") - F.col("timestamp") - step) / step).cast("long")
    return gaps.filter(F.col("timestamp_close") + 1 != F.col("next_timestamp")).select("symbol", "timestamp", "next_timestamp", missing.alias("missing"))


def fill_gaps(df: DataFrame, step: int, flat: bool = False, pad_to_day: bool = False) -> DataFrame:
    """Insert a copy of the bar before each gap for every missing step: low = high = close, no volume.

    Other columns are copied; flat also sets the open to the close and the counts to nothing. The close time of a bar
    before a gap is mended. pad_to_day carries the last bar on to midnight; a bar without a time has none and goes.
    """
    spaced = following(df, "_next", step)
    if pad_to_day:
        day = 86_400_000
        spaced = spaced.filter("timestamp IS NOT NULL").withColumn("_next", F.coalesce("_next", (F.floor(F.col("timestamp") / day) + 1) * day))
    extra = F.greatest(F.floor((F.col("_next") - F.col("timestamp")) / step).cast("int") - 1, F.lit(0))
    rows = spaced.withColumn("_k", F.explode(F.sequence(F.lit(0), F.coalesce(extra, F.lit(0)))))
    added = F.col("_k") > 0
    changed: dict[str, Column] = {
        "price_high": F.when(added, F.col("price")).otherwise(F.col("price_high")), "price_low": F.when(added, F.col("price")).otherwise(F.col("price_low")),
        "volume": F.when(added, 0.0).otherwise(F.col("volume")),
        "timestamp_close": F.when(added | (F.col("_next") != F.col("timestamp_close") + 1), F.col("timestamp") + F.col("_k") * step + (step - 1)).otherwise(F.col("timestamp_close")),
        "timestamp": F.col("timestamp") + F.col("_k") * step,
    }
    if flat:
        changed |= {"price_open": F.when(added, F.col("price")).otherwise(F.col("price_open")), "asset_volume_quote": F.when(added, 0.0).otherwise(F.col("asset_volume_quote")), "trades_number": F.when(added, F.lit(0).cast("long")).otherwise(F.col("trades_number"))}
    return rows.withColumns(changed).drop("_next", "_k")


def number(text: Column) -> Column:
    """Text as a double, read as SQL reads it: digits may be grouped by _, NaN and infinities are numbers; suffixes (12d),
    hexadecimal digits and control characters make it null."""
    space, digits = r"[ \t\n\x0B\f\r]*", r"\d+(?:_\d+)*"
    plain = text.rlike(rf"\A{space}\+?-?(?:{digits}(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?{space}\z")
    # A bare NaN in JSON, or a number beyond a double, is quoted by from_json.
    named = lambda names: text.rlike(rf'(?i)\A{space}"?\+?-?(?:{names})"?{space}\z')
    infinite = F.when(text.contains("-"), float("-inf")).otherwise(float("inf"))
    return F.when(plain, F.translate(text, "_+", "").try_cast("double")).when(named("nan"), float("nan")).when(named("inf|infinity"), infinite)


def to_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text that isn't a number becomes null."""
    return df.withColumns({c: number(F.col(c).cast("string")) for c in columns})


def clean_features(df: DataFrame, columns: list[str], finite: bool = True) -> DataFrame:
    """Null, NaN and infinite values become 0; the last step, as earlier ones tell warm-up by null. Without finite, NaN
    and infinite values stay."""
    odd = lambda c: F.col(c).isNull() | (F.isnan(c) | (F.abs(F.col(c)) == float("inf")) if finite else F.lit(False))
    return df.withColumns({c: F.when(odd(c), 0.0).otherwise(F.col(c)) for c in columns})


def stride(df: DataFrame, start: int, k: int, order: str = "ord") -> DataFrame:
    return df.filter((F.col(order) >= start) & (F.pmod(F.col(order) - start, F.lit(k)) == 0))
