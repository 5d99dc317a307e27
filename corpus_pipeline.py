"""The corpus pipeline: documents in, a cleaned and mixed training corpus out.

Each stage calls one operator, is written as Parquet and read again by the next one. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parley.llm.decontaminate import decontaminate
from parley.llm.language_id import accepted
from parley.llm.line_dedup import drop_duplicate_lines
from parley.llm.mixing import mix
from parley.llm.near_dedup import drop_near_duplicates
from parley.llm.queries import MIX_TARGETS
from parley.llm.shared import ensure_checkpoint_dir, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, or with no language of probability 0.5 at least, go."""
    return accepted(docs, least_score=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents that have nothing else."""
    return drop_duplicate_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, k=5, threshold="4/5")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with wording of the benchmark go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled to meet the target shares, with their weights and probabilities."""
    return mix(docs, MIX_TARGETS).where("sampled").drop("sampled")


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("mixing", mixture)]

#: Models, signatures and components can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents. Between them, tables are written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
