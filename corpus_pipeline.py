"""The corpus pipeline: quality rules, language ID, near duplicates, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import common, jaccard, langid, mixing, packing, quality

STAGES = [
    ("quality_rules", quality.stage),
    ("language_id", langid.stage),
    ("jaccard_join", jaccard.stage),
    ("source_mix", mixing.stage),
    ("packing", packing.stage),
]

#: Language ID, mixing and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder before the next reads it, and goes once that is written."""
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
