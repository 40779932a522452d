"""Tables of transitions for learning from replayed steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinal import asof_align, in_chunks, join_on, running


def transitions(df: DataFrame, obs: str = "features") -> DataFrame:
    """obs, action, reward, next_obs and done (1 on the last step) of each step."""
    return in_chunks(df, lambda w: {"next_obs": F.lead(obs).over(w)}, after=1).withColumn("done", F.col("next_obs").isNull().cast("int"))


def n_step(df: DataFrame, n: int, gamma: float, carried: list[str] = ["next_obs"]) -> DataFrame:  # noqa: B006
    """n_return, and done and the carried columns as of the first terminal step within n, else the last; whole windows only."""
    made = in_chunks(df, lambda w: {"_steps": F.collect_list(F.struct("reward", "done", *carried)).over(w.rowsBetween(0, n - 1))}, after=n - 1).filter(F.size("_steps") == n)
    total = F.aggregate(F.reverse("_steps"), F.lit(0.0), lambda a, s: s.reward + gamma * a * (1 - s.done))
    first = F.array_position(F.transform("_steps", lambda s: s.done), 1)
    at = F.get("_steps", F.when(first > 0, first.cast("int") - 1).otherwise(n - 1))
    return made.withColumn("n_return", total).withColumns({"n_done": at["done"], **{f"n_{c}": at[c] for c in carried}}).drop("_steps")


def cap_newest(df: DataFrame, size: int, order: str = "ord") -> DataFrame:
    """The newest rows: a top-k, not a sort of the table."""
    return df.orderBy(F.desc(order)).limit(size)


def sample_uniform(df: DataFrame, n: int, seed: int, key: list[str] = ["ord"]) -> DataFrame:  # noqa: B006
    """n rows without replacement: those with the smallest digests of seed and key, so reruns agree however rows are dealt."""
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *named)), *key).limit(n)


def sample_priority(df: DataFrame, draws: DataFrame, alpha: float = 1.0, stratified: bool = True, key: str = "ord") -> DataFrame:
    """For each draw (k, u in 0..1; k counts from 0) the first row whose running priority exceeds it.

    Stratified: draw k falls in the k-th of as many equal strata as there are draws; otherwise anywhere.
    """
    powered = running(df.withColumns({"_one": F.lit(0), "_p": F.pow("priority", F.lit(alpha))}), {"_to": F.col("_p")}, key=["_one"], order=key)
    sums = powered.agg(F.max("_to").alias("_total"))
    size = draws.agg(F.count(F.lit(1)).alias("_n"))
    point = (F.col("k") + F.col("u")) / F.col("_n") * F.col("_total") if stratified else F.col("u") * F.col("_total")
    asked = draws.crossJoin(F.broadcast(sums.crossJoin(size))).withColumn("_at", point).drop("_total", "_n")
    # A row begins where the rows before it end; the last one that begins at or before the point holds it.
    begins = powered.withColumn("_at", F.col("_to") - F.col("_p")).filter("_p > 0")
    return asof_align(asked, begins, "_at", key, "picked", key=None).drop("_at")


def importance_weights(df: DataFrame, beta: float, probability: str = "p", batch: str | None = None, size: int | None = None) -> DataFrame:
    """(N P)^-beta over its maximum: in the table, or in the row's batch if df holds several. N: size, or the rows of the table."""
    weight = lambda p: F.pow(F.col("_n") * p, F.lit(-beta))
    rows = df.agg(F.count(F.lit(1)).alias("_n"), F.min(probability).alias("_low"))
    counted = df.crossJoin(F.broadcast(rows.withColumn("_n", F.lit(size)) if size else rows))  # one row
    if batch:
        counted = join_on(counted.drop("_low"), df.groupBy(batch).agg(F.min(probability).alias("_low")), [batch])
    return counted.withColumn("weight", weight(F.col(probability)) / weight(F.col("_low"))).drop("_n", "_low")


def update_priorities(df: DataFrame, updates: DataFrame, alpha: float, epsilon: float = 0.0, key: str = "ord") -> DataFrame:
    """New priorities to the power alpha for the updated rows; rows without a priority yet get the largest there is."""
    new = updates.select(key, F.pow(F.col("priority") + epsilon, F.lit(alpha)).alias("_new"))
    top = df.agg(F.coalesce(F.max("priority"), F.lit(1.0)).alias("_top"))
    return df.join(new, key, "left").crossJoin(F.broadcast(top)).withColumn("priority", F.coalesce("_new", "priority", "_top")).drop("_new", "_top")
