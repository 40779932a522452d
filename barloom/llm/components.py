"""Connected components of a table of links, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Large: every neighbour above a node is hung on the least of node and neighbours; small: every one below and the node."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of links (u, v: long): the least node that links reach from it.

    Rounds go on until the links no longer change; each is written to the shared folder.
    """
    links = common.cut(links.filter("u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before or state[0] == 0:
            break
        before = state
        links, old = common.cut(_stars(_stars(links, True), False), "stars"), links
        common.discard(old)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
