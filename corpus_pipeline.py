"""Corpus pipeline: classify, dedup, decontaminate, mix and shard ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet before the next one reads it. All but the last return the columns of
``documents``; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import decontamination, mixing, near_dedup, quality, sharding
from docloom.session import removed, scratch, stored, table

STAGES = [
    ("quality classifier", quality.stage),
    ("near-dedup", near_dedup.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: The classifier's scores can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves behind goes when the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = stored(out, name.replace(" ", "-"))
        docs = spark.read.schema(out.schema).parquet(path)
        if last is not None:
            removed(spark, last)
        last = path
    return docs
