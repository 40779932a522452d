"""Dense ordinals, windows over chunks with a halo, prefix sums and as-of matches.

Keys are compared null-safely: rows without a symbol are a series of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.storage import cut

#: Bars of a series that one task holds; a series of any length takes as many tasks as it has chunks.
CHUNK = 1 << 16

#: Written once for the several steps that read it: plans stay short however many steps follow, nothing stays in memory,
#: and what a lost executor held is read again.
settled = cut


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet null keys; the keys of right don't come along."""
    named = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(named, cond, how).drop(*[f"_on_{k}" for k in keys])


def with_ordinal(df: DataFrame, step: int, key: str = "symbol") -> DataFrame:
    """ord: place on the series' grid of step milliseconds, without a sort.

    A bar without a time has no ord; _place puts it after the series' last bar, as SQL orders nulls.
    """
    at = lambda c: ((F.col(c) - F.col("_first")) / step).cast("long")
    ends = df.groupBy(key).agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    return join_on(df, ends, [key]).withColumn("ord", at("timestamp")).withColumn("_place", F.coalesce("ord", at("_last") + 1, F.lit(0))).drop("_first", "_last")


def place(df: DataFrame, order: str = "ord") -> str:
    """The column that windows over ord go by: _place, where with_ordinal gave one, so that bars without a time stay."""
    return "_place" if order == "ord" and "_place" in df.columns else order


def in_chunks(df: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0, key: list[str] = ["symbol"], order: str = "ord", size: int = CHUNK) -> DataFrame:  # noqa: B006
    """Add columns that look at most before rows back and after rows ahead.

    Rows near a chunk's edge are copied to the neighbour (the halo), the window runs within (key, chunk), and the copies
    go. order must be dense.
    """
    size, order = max(size, before, after, 1), place(df, order)
    own, at = F.floor(F.col(order) / size), F.pmod(F.col(order), F.lit(size))
    chunks = F.array_compact(F.array(own, F.when(at >= size - before, own + 1), F.when(at < after, own - 1)))
    spread = df.withColumn("_chunk", F.explode(chunks)) if before or after else df.withColumn("_chunk", own)
    w = Window.partitionBy(*key, "_chunk").orderBy(order)
    return spread.withColumns(columns(w)).filter(F.col("_chunk") == own).drop("_chunk")


def running(df: DataFrame, sums: dict[str, Column], key: list[str] = ["symbol"], order: str = "ord", size: int = CHUNK) -> DataFrame:  # noqa: B006
    """Running totals (this row included) of the given expressions: totals of chunks first, then within each chunk."""
    order = place(df, order)
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / size)).withColumns({f"_x_{n}": c for n, c in sums.items()})
    totals = chunked.groupBy(*key, "_chunk").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*key, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_h_{n}") for n in sums])
    inside = Window.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_on(chunked, heads, [*key, "_chunk"])
    return out.withColumns({n: F.col(f"_h_{n}") + F.coalesce(F.sum(f"_x_{n}").over(inside), F.lit(0)) for n in sums}).drop("_chunk", *[f"_{p}_{n}" for n in sums for p in "xh"])


def forward_fill(df: DataFrame, columns: list[str], key: list[str] = ["symbol"], order: str = "ord", size: int = CHUNK) -> DataFrame:  # noqa: B006
    """Nulls take the last value before them; a table of each chunk's last values carries over chunk ends."""
    order = place(df, order)
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / size))
    last = chunked.groupBy(*key, "_chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}") for c in columns])
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = last.select(*key, "_chunk", *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_h_{c}") for c in columns])
    inside = Window.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = join_on(chunked, heads, [*key, "_chunk"])
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_h_{c}")) for c in columns}).drop("_chunk", *[f"_h_{c}" for c in columns])


def running_best(df: DataFrame, column: str, out: str, best: Callable[[str], Column], key: list[str], order: str = "ord", size: int = CHUNK) -> DataFrame:
    """Running extreme (best is F.max or F.min) of a column within each key; however long a key is, a task holds a chunk of it."""
    order = place(df, order)
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / size))
    ends = chunked.groupBy(*key, "_chunk").agg(best(column).alias("_end"))
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(*key, "_chunk", best("_end").over(earlier).alias("_head"))
    inside = Window.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.greatest if best is F.max else F.least
    return join_on(chunked, heads, [*key, "_chunk"]).withColumn(out, pick("_head", best(column).over(inside))).drop("_chunk", "_head")


def following(df: DataFrame, out: str, step: int, key: list[str] = ["symbol"], at: str = "timestamp", size: int = CHUNK) -> DataFrame:  # noqa: B006
    """The next row's time, which may be far ahead: rows are cut into chunks of time, and a chunk's last row takes the first
    time of the next chunk that has rows. At equal times a row follows the other."""
    chunked = df.withColumn("_chunk", F.floor(F.col(at) / (step * size)))
    first = chunked.groupBy(*key, "_chunk").agg(F.min(at).alias("_first"))
    chain = first.select(*key, "_chunk", F.lead("_first").over(Window.partitionBy(*key).orderBy("_chunk")).alias("_later"))
    inside = F.lead(at).over(Window.partitionBy(*key, "_chunk").orderBy(at))
    return join_on(chunked, chain, [*key, "_chunk"]).withColumn(out, F.coalesce(inside, "_later")).drop("_chunk", "_later")


def asof_align(base: DataFrame, other: DataFrame, on: str, value: str, out: str, key: str | None = "symbol", default: int = -1) -> DataFrame:
    """For each base row the value of the last other row whose `on` is not later; default before the first.

    Both sides are laid together, rows of other first on ties, and dealt to ranges of (key, on) that Spark samples, so that
    a key of any size and any number of ties are split. Within a range the value is carried forward; of each range one value
    for each key goes on to the later ranges of that key. Rows whose `on` is null get the default.
    """
    keys = [key] if key else []
    left = base.select(*keys, F.col(on).alias("_on"), F.lit(1).alias("_side"), F.lit(None).cast(other.schema[value].dataType).alias("_v"), F.struct(*base.columns).alias("_row"))
    right = other.filter(F.col(on).isNotNull()).select(*keys, F.col(on).alias("_on"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = left.unionByName(right).withColumn("_tie", F.monotonically_increasing_id())
    ranged = cut(both.repartitionByRange(n, *keys, "_on", "_side", "_tie").withColumn("_range", F.spark_partition_id()), "ranges")
    last = ranged.filter("_side = 0 AND _v IS NOT NULL").groupBy(*keys, "_range").agg(F.max_by("_v", F.struct("_on", "_tie")).alias("_last"))
    ranges = ranged.select(*keys, "_range").distinct()
    held = join_on(ranges, last, [*keys, "_range"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = held.select(*keys, "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_head"))
    inside = Window.partitionBy("_range", *keys).orderBy("_on", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = join_on(ranged, heads, [*keys, "_range"]).withColumn("_v", F.coalesce(F.last("_v", ignorenulls=True).over(inside), "_head"))
    return rows.filter("_side = 1").select("_row.*", F.coalesce("_v", F.lit(default)).alias(out))
