"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives each of its documents the same expected number of copies, target / size. The whole part is
taken outright; the fraction p is rounded. Two documents with fractions meet: a random amount of mass (fraction times
words) moves from one to the other, as much as makes one of them integral, in one direction or the other with the odds
that keep both expectations. So the words of a source stay exactly at its target until one fraction is left, which is
rounded by a draw: a source ends within one document's words of its target. Larger documents meet first, so the last
fraction is mostly a short one's.

The pairing runs as a reduction tree. Documents of a source are dealt by hash to chunks of about chunk rows; a chunk
leaves one fraction at most. Fractions of fan chunks meet on the next level, and so on up to one for each source. A hot
source only has more chunks. All draws come from a hash of seed, key and level and chunks are put in order first, so
reruns agree, on any cluster.

Sources go by code point, a null source last. Rows that share key and source stand or fall together; rows without a key
go by their text. Of equal sizes the order of a hash decides who meets first. Null text has no words; documents without
words are never taken. Texts are counted whole; of long ones only the size is held. An empty table gives an empty
result. Extra columns travel along, whatever their names; ones named like an added column (size, source_size, target,
copies) are replaced. A stage returns the columns that it got.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
ADDED = ("size", "source_size", "target", "copies")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source, source_size) get a target: min(most * source_size, level * weight), summing up to share * all sizes.

    The level comes from one pass over the sources in order of most * source_size / weight, where they reach their cap.
    Handing out the excess of capped sources by weight, again and again, ends at the same targets.
    """
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    df = sizes.withColumn("_w", w).withColumn("_cap", most * F.col("source_size"))
    fill = one.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({
        "_all": F.sum("source_size").over(one) * share,
        "_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_left": F.sum("_w").over(one) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    level = (F.col("_all") - F.col("_full")) / F.col("_left")
    # The level if this source and all after it aren't capped: the first source whose cap is above it tells the level.
    df = df.withColumn("_level", F.when(F.col("_cap") / F.col("_w") >= level, level))
    df = df.withColumn("_level", F.first("_level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return df.select("source", "source_size", target.alias("target"))


def _pivot(seed: int):
    def rounds(pdf: pd.DataFrame) -> pd.DataFrame:
        """Round all fractions of a chunk but one, which is left as it is; at the root it is rounded too."""
        pdf = pdf.sort_values(["size", "_tie", "_key"], ascending=False, kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, int(pdf["_level"].iloc[0]), *(int(x) & 0xFFFFFFFF for x in (pdf["_tie"].iloc[0], pdf["_node"].iloc[0]))])
        draws = rng.random(len(pdf))
        size, p = pdf["size"].to_numpy(float), pdf["_p"].to_numpy(float).copy()
        held = -1
        for i in range(len(p)):
            if not 0 < p[i] < 1:
                continue
            if held < 0:
                held = i
                continue
            a, b = held, i
            up = min((1 - p[a]) * size[a], p[b] * size[b])  # words that may move from b to a
            down = min(p[a] * size[a], (1 - p[b]) * size[b])
            moved = up if draws[i] * (up + down) < down else -down
            full_a = moved == (1 - p[a]) * size[a] if moved > 0 else -moved == p[a] * size[a]
            full_b = moved == p[b] * size[b] if moved > 0 else -moved == (1 - p[b]) * size[b]
            p[a] = (1.0 if moved > 0 else 0.0) if full_a else p[a] + moved / size[a]
            p[b] = (0.0 if moved > 0 else 1.0) if full_b else p[b] - moved / size[b]
            held = next((k for k in (a, b) if 0 < p[k] < 1), -1)
        if held >= 0 and pdf["_root"].iloc[0]:
            p[held] = float(draws[held] < p[held])
        return pdf.assign(_p=p)

    return rounds


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, *, key: str = "doc_id", text: str = "text", source: str = "source", chunk: int = 1024, fan: int = 256, seed: int = 11) -> DataFrame:
    """docs with size (words), source_size, target (of its source) and copies (0 to most) that the mix takes."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")
    unit = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("t"), F.xxhash64(text).cast("string")))
    units = docs.select(unit.alias("_key"), F.col(source).alias("source"), words.alias("size"))
    units = common.cut(units.groupBy("_key", "source").agg(F.sum("size").alias("size")), "mix-units")
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("_rows"))
    chunks = F.greatest(F.ceil(F.col("_rows") / chunk), F.lit(1)).cast("long")
    plan = common.cut(targets(sums, weights, share, most).join(sums.select("source", chunks.alias("_chunks")).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-plan")
    deepest = plan.agg(F.coalesce(F.max("_chunks"), F.lit(1))).first()[0]

    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    tie = F.xxhash64(F.lit(seed), F.col("_key"))
    open_units = units.filter("size > 0").join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    tree = open_units.select("_key", "source", "size", "_chunks", F.floor(rate).cast("int").alias("_whole"), (rate - F.floor(rate)).alias("_p"), tie.alias("_tie"))
    tree = tree.withColumns({"_node": F.pmod("_tie", "_chunks"), "_level": F.lit(0), "_root": F.col("_chunks") == 1})
    schema = tree.schema
    # For each level: the rows decided there go, the fractions left climb.
    decided, levels = [], 1 + math.ceil(math.log(deepest, fan)) if deepest > 1 else 1
    for level in range(levels):
        if level:
            tree = tree.withColumns({"_node": F.floor(F.col("_node") / fan).cast("long"), "_chunks": F.ceil(F.col("_chunks") / fan).cast("long"), "_level": F.lit(level)}).withColumn("_root", F.col("_chunks") == 1)
        tree = common.cut(tree.groupBy("source", "_node").applyInPandas(_pivot(seed), schema), f"mix-level-{level}")
        done = (F.col("_p") <= 0) | (F.col("_p") >= 1)
        decided.append(tree.filter(done).select("_key", "source", (F.col("_whole") + F.col("_p").cast("int")).alias("copies")))
        tree = tree.filter(~done)
    taken = decided[0]
    for more in decided[1:]:
        taken = taken.unionByName(more)
    copies = units.join(taken.withColumnsRenamed({"_key": "_k", "source": "_s"}), F.col("_key").eqNullSafe(F.col("_k")) & F.col("source").eqNullSafe(F.col("_s")), "left").select("_key", "source", F.coalesce("copies", F.lit(0)).alias("copies"))
    rows = common.carried(docs, ADDED, own_key=unit, own_source=F.col(source), size=words)
    out = rows.join(copies, F.col("own_key").eqNullSafe(F.col("_key")) & F.col("own_source").eqNullSafe(F.col("source"))).select("row", "own_source", "size", "copies")
    out = out.join(plan, F.col("own_source").eqNullSafe(F.col("source")))
    return out.select("row.*", "size", "source_size", "target", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken. All that is said of mix() holds; columns stay as they are."""
    taken = mix(common.carried(docs, doc_id=F.col("doc_id"), text=F.col("text"), source=F.col("source"))).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The operator joins whole rows; of them this query needs no text beyond its size.
    mixed = mix(common.documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
