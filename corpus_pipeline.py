"""Corpus pipeline over ``documents``: quality rules, toxicity, MinHash near-dedup, packing.

Every stage takes what its predecessor kept, written as Parquet, and applies one
operator of ``cohortlake.llm``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm import stages
from cohortlake.llm.common import freeze, table

STAGES = [
    ("quality", stages.quality_stage),
    ("toxicity", stages.toxicity_stage),
    ("minhash", stages.minhash_stage),
    ("packing", stages.packing_stage),
]

#: No stage is SQL (EM, kNN, hashing, tokens); tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
