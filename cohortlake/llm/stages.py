"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import setup, table
from cohortlake.llm.minhash import without_duplicates
from cohortlake.llm.packing import pack
from cohortlake.llm.quality import quality
from cohortlake.llm.toxicity import CUT, held_out, learn, score


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model (and the base rules) keep, columns as given."""
    setup(spark)
    judged, names = quality(docs)
    return judged.where(F.col(names["kept"])).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut, columns as given; learnt from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out("doc_id"))
    scored, names = score(docs, learn(docs.select("doc_id", "text"), labels))
    return scored.where(F.col(names["score"]) < CUT).select(*docs.columns)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, columns as given."""
    setup(spark)
    return without_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 ids, with their digests."""
    setup(spark)
    return pack(docs, with_ids=False).drop("ids")
