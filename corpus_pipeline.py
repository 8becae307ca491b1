"""A corpus from ``documents``: stages that each write a table for the next.

Language ID, line dedup, SimHash near-dedup, benchmark decontamination, mixing to target weights. Each
stage works on all that its predecessor kept. Stages are functions of (spark, docs, sf_dir); their results
go to the shared folder as Parquet, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import common, decontam, langid, linededup, mixing, nearcopies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups of SimHash on five-word shingles, with the pairs of 0.8 or more that its fingerprints leave."""
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: texts cut and repeated as the slots take them, with the words taken."""
    return mixing.emit(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
]

#: Language ID learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = common.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs, path = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if last:
            common.discard(spark, last)
        last = path
    return docs
