"""Queries over texts: normalisation, sentiment, personal data, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tf
from ..sources.audio import small_batches
from .registry import query, table


@query("sf1_norm", r"""select doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}_\s''?!¿¡]', ' ', 'g'), '\s+', ' ', 'g')) as clean from documents""")
def sf1_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tf.norm(F.col("text")).alias("clean"))


@query("sf2_lexicon")
def sf2_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tf.lexicon_sentiment(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("sf2_lexicon_corrected")
def sf2_lexicon_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tf.lexicon_sentiment(F.col("text"), "corrected").alias("s")).select("conv_id", "turn", "s.*")


@query("sf3_pii")
def sf3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity found: doc_id, entity, start, end. Rules need lookbehind and span arithmetic, so they run in
    an Arrow-batched function."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *span) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for span in tf.pii_spans(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "entity", "start", "end"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").where(tf.may_have_pii(F.col("text"))).mapInPandas(find, "doc_id long, entity string, start int, end int")


def redacted(rows: DataFrame, text: str, where: Column | None = None) -> DataFrame:
    """rows with the personal data of `text` replaced by placeholders, where the condition holds; null is empty. Only
    texts with a mark of personal data leave the JVM."""
    small_batches(rows.sparkSession)
    asked = tf.may_have_pii(F.col(text)) & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    plain = rows.where(~asked).withColumn(text, F.coalesce(text, F.lit("")))
    return plain.union(rows.where(asked).withColumn(text, _redact()(F.col(text))))


def _redact():
    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tf.redact(t or ""))

    return hide


@query("sf3_redaction")
def sf3_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("redacted")), "redacted")


@query("prj2_redacted")
def prj2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as a reader sees them who may see personal data of odd documents only."""
    return redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", F.col("doc_id") % 2 == 0)


@query("sf4_collapse_repeats")
def sf4_collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tf.collapse_repeats(F.col("text")).alias("text"))


@query("st1_distinct_lines", "select doc_id, len(list_distinct(string_split(text, chr(10))))::int as distinct_lines from documents")
def st1_distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.split("text", "\n"))).alias("distinct_lines"))
