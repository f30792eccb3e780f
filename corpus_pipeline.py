"""A corpus pipeline of the package's operators over the table documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motioncheck.llm import decontam, langid, ngram_join, packing, substring
from motioncheck.llm.shared import ready, workspace, written

STAGES = [
    ("language_id", langid.keep_identified),
    ("ngram_join", ngram_join.keep_one),
    ("substring_dedup", substring.keep_unique),
    ("decontamination", decontam.keep_clean),
    ("packing", packing.packed),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over what its predecessor kept, written and read again."""
    ready(spark)
    folder = workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
