"""Feature columns of candle tables. Rows have symbol and a dense ord; every frame runs within chunks of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.clean import number
from barloom.operators.ordinal import forward_fill, in_chunks, join_on, running
from barloom.schema import INDICATOR_SETS

#: Frames of up to this many rows run natively; larger ones by prefix sums and block extremes.
NATIVE = 256


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def pct_change(df: DataFrame, columns: dict[str, str], key: list[str] = ["symbol"], fill: bool = True) -> DataFrame:  # noqa: B006
    """Out column <- in column: change against the bar before; null where there is none or it is 0.

    Nulls count as the last value before them (fill), so the change at such a bar is 0; the columns themselves stay as
    they are. Without fill a null makes both changes that it is part of null.
    """
    names = {c: f"_filled_{i}" for i, c in enumerate(dict.fromkeys(columns.values()))}
    if fill:
        df = forward_fill(df.withColumns({f: F.col(c) for c, f in names.items()}), list(names.values()), key=key)
    source = lambda c: F.col(names[c] if fill else c)
    return in_chunks(df, lambda w: {out: ratio(source(c), F.lag(source(c)).over(w)) - 1 for out, c in columns.items()}, before=1, key=key).drop(*names.values())


def hl_offset(df: DataFrame) -> DataFrame:
    return df.withColumns({"price_high_percent": ratio(F.col("price_high"), F.col("price")) - 1, "price_low_percent": ratio(F.col("price_low"), F.col("price")) - 1})


def total_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("total_volume", F.col("volume") + F.col("asset_volume_quote"))


def rolling(df: DataFrame, column: str, windows: list[int], key: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """mean_<w>, std_<w>, max_<w> of the last w rows, null until there are w."""
    small, large = [w for w in windows if w <= NATIVE], [w for w in windows if w > NATIVE]
    if small:
        def frames(o):
            out = {}
            for w in small:
                f = o.rowsBetween(-(w - 1), 0)
                full = F.count(F.lit(1)).over(f) == w
                out |= {f"mean_{w}": F.when(full, F.avg(column).over(f)), f"std_{w}": F.when(full, F.stddev_samp(column).over(f)), f"max_{w}": F.when(full, F.max(column).over(f))}
            return out

        df = in_chunks(df, frames, before=max(small) - 1, key=key)
    for w in large:
        df = _large(df, column, w, key)
    return df


def _large(df: DataFrame, column: str, w: int, key: list[str]) -> DataFrame:
    """Mean and deviation from prefix sums of the centred values; the maximum from two block extremes.

    Blocks have w rows: the last w rows are a block's tail from row i-w+1 on and the next block's head up to row i.
    """
    center = df.groupBy(*key).agg(F.avg(column).alias("_c"))
    x = F.col(column) - F.col("_c")
    df = running(join_on(df, center, key), {"_s": x, "_q": x * x}, key=key)
    head = in_chunks(df, lambda o: {"_head": F.max(column).over(o.rowsBetween(Window.unboundedPreceding, 0)), "_tail": F.max(column).over(o.rowsBetween(0, Window.unboundedFollowing))}, key=key, size=w)
    # What stands w rows before, by an equi-join on its place.
    back = head.select(*key, (F.col("ord") + w).alias("ord"), F.col("_s").alias("_s0"), F.col("_q").alias("_q0"))
    edge = head.select(*key, (F.col("ord") + (w - 1)).alias("ord"), F.col("_tail").alias("_tail0"))
    out = join_on(join_on(head, back, [*key, "ord"], "left"), edge, [*key, "ord"], "left")
    full = F.col("ord") >= w - 1
    s, q = F.col("_s") - F.coalesce("_s0", F.lit(0.0)), F.col("_q") - F.coalesce("_q0", F.lit(0.0))
    return out.withColumns({
        f"mean_{w}": F.when(full, s / w + F.col("_c")), f"std_{w}": F.when(full, F.sqrt(F.greatest((q - s * s / w) / (w - 1), F.lit(0.0)))),
        f"max_{w}": F.when(full, F.greatest("_head", "_tail0")),
    }).drop("_c", "_s", "_q", "_head", "_tail", "_s0", "_q0", "_tail0")


def rolling_features(df: DataFrame, column: str, windows: list[int], key: list[str] = ["symbol"], by: str = "rows", step: int = 1) -> DataFrame:  # noqa: B006
    """zscore_<w>, to_max_<w> and to_avg_<w> of a column. Windows count rows, or by="time" milliseconds on bars of step."""
    df = rolling(df, column, windows, key) if by == "rows" else rolling_by_time(df, column, windows, step, key)
    x = F.col(column)
    made = {}
    for w in windows:
        made |= {f"zscore_{w}": ratio(x - F.col(f"mean_{w}"), F.col(f"std_{w}")), f"to_max_{w}": ratio(x, F.col(f"max_{w}")), f"to_avg_{w}": ratio(x, F.col(f"mean_{w}"))}
    return df.withColumns(made).drop(*[f"{k}_{w}" for w in windows for k in ("mean", "std", "max")])


def rolling_by_time(df: DataFrame, column: str, spans: list[int], step: int, key: list[str] = ["symbol"], at: str = "timestamp", size: int = 1 << 16) -> DataFrame:  # noqa: B006
    """mean_<ms>, std_<ms>, max_<ms> of the rows of the last so many milliseconds, however many there are.

    Null until the series has lasted so long. Rows are dealt to chunks of time no shorter than the longest span; those
    within that span of a chunk's end are also seen by the next one.
    """
    length = max(*spans, size * step)
    chunk = F.floor(F.col(at) / length)
    near = F.col(at) > (chunk + 1) * length - max(spans)
    first = df.groupBy(*key).agg(F.min(at).alias("_first"))
    rows = join_on(df, first, key).withColumn("_chunk", F.explode(F.array_compact(F.array(chunk, F.when(near, chunk + 1)))))
    w, made = Window.partitionBy(*key, "_chunk").orderBy(at), {}
    for span in spans:
        f = w.rangeBetween(-(span - 1), 0)
        full = F.col(at) - F.col("_first") + step >= span
        made |= {f"{name}_{span}": F.when(full, fn(column).over(f)) for name, fn in (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max))}
    return rows.withColumns(made).filter(F.col("_chunk") == chunk).drop("_chunk", "_first")


def explode_indicators(df: DataFrame, names: list[str] | str) -> DataFrame:
    """Columns of the indicators map: a bundle's name, or names. What is missing or isn't a number is null."""
    names = INDICATOR_SETS.get(names, [names]) if isinstance(names, str) else names
    return df.withColumns({n: number(F.get_json_object(F.to_json("indicators"), f"$.{n}") if "." in n else F.col("indicators")[n]) for n in names})


def indicator_names(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.map_keys("indicators")).alias("name")).distinct()


def ms_to_ts(column: str) -> Column:
    return F.timestamp_millis(F.col(column))


def calendar_features(df: DataFrame, mode: str, at: str = "timestamp_close") -> DataFrame:
    """expanded: month, day, time and day_of_week scaled to 0..1; day_of_week; normal: open and close in epoch seconds."""
    ts = ms_to_ts(at)
    weekday = F.weekday(ts) / 6
    if mode == "expanded":
        return df.withColumns({
            "month": (F.month(ts) - 1) / 11, "day": (F.dayofmonth(ts) - 1) / (F.dayofmonth(F.last_day(ts)) - 1),
            "time": (F.hour(ts) * 60 + F.minute(ts)) / 1439, "day_of_week": weekday,
        })
    if mode == "day_of_week":
        return df.withColumn("day_of_week", weekday)
    if mode == "normal":
        return df.withColumns({"open_seconds": F.floor(F.col("timestamp") / 1000).cast("double"), "close_seconds": F.floor(F.col("timestamp_close") / 1000).cast("double")})
    raise ValueError(f"no calendar mode {mode}")


#: Columns that each feature type keeps, from raw prices and their changes.
FEATURE_TYPES = {
    "standard": ["price", "price_open", "price_high", "price_low", "volume", "timestamp_close"],
    "only_price": ["price", "price_high", "price_low", "volume"],
    "solo_price": [],
    "solo_price_percent": ["price_percent"],
    "only_price_percent": ["price_percent", "price_high_percent", "price_low_percent", "volume_percent"],
    "only_price_percent_change": ["price_percent", "price_high_percent", "price_low_percent", "volume_percent"],
    "only_price_percent_sin_volume": ["price_percent", "price_high_percent", "price_low_percent"],
    "all_percents": ["price_percent", "price_high_percent", "price_low_percent", "volume_percent"],
}


def feature_set(df: DataFrame, kind: str, indicator: str | list[str] = "none", timestamp: str = "none", key: list[str] = ["symbol"], fill: bool = True) -> tuple[DataFrame, list[str]]:
    """The table with the columns of a feature type, and their names in order. Nulls are left for clean_features().

    fill is that of pct_change() for prices and volumes; indicators always count as their last values.
    """
    columns = list(FEATURE_TYPES[kind])
    df = hl_offset(pct_change(df, {"price_percent": "price", "volume_percent": "volume"}, key, fill))
    if indicator != "none":
        names = indicator if isinstance(indicator, list) else INDICATOR_SETS.get(indicator, [indicator])
        df = explode_indicators(df, names)
        if kind == "all_percents":
            df = pct_change(df, {f"{n}_percent": n for n in names}, key)
            names = [f"{n}_percent" for n in names]
        columns += names
    if timestamp != "none":
        df = calendar_features(df, timestamp)
        columns += {"expanded": ["month", "day", "time", "day_of_week"], "day_of_week": ["day_of_week"], "normal": ["open_seconds", "close_seconds"]}[timestamp]
    return df, columns


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))
