"""Manifests of data sets: CSV rows with times in seconds or clock form, and what is wrong with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LABELS

#: The columns of a manifest.
COLUMNS = ["audio", "speaker", "emotion", "satisfaction", "start", "end", "language", "speaker_group"]


def seconds(value: Column) -> Column:
    """Seconds of '83.5', 'MM:SS' or 'HH:MM:SS'; null for anything else."""
    parts = F.transform(F.split(value, ":"), lambda x: x.try_cast("double"))
    whole = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when(F.forall(parts, lambda x: x.isNotNull()), whole)


def numbered(rows: DataFrame, name: str, first: int) -> DataFrame:
    """rows with `name`: their number in the order of the files, from `first` on. Rows are counted in their tasks, so
    only the counts of tasks meet."""
    marked = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    counts = {r["_part"]: r["n"] for r in marked.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = {}, first
    for part in sorted(counts):
        before[part], at = at, at + counts[part]
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("_part")] if before else F.lit(first)
    return marked.withColumn(name, (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + offset).cast("long")).drop("_id", "_part")


def read_manifest(spark: SparkSession, path: str, known_audio: DataFrame | None = None) -> DataFrame:
    """The rows of a CSV with a header: row (its number, 2 for the first), the columns as trimmed text (emotion in lower
    case) or null, start_s, end_s, satisfaction_n and error, null for a sound row.

    Columns that the file lacks are null, others are left out. A BOM before the header is skipped. An audio path must
    stay below the manifest's folder, and be one of known_audio(audio) if that is given. The first error counts.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip().lower() for c in raw.columns))
    text = {c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit(None).cast("string") for c in COLUMNS}
    rows = numbered(raw.select(*(x.alias(c) for c, x in (text | {"emotion": F.lower(text["emotion"])}).items())), "row", 2)
    rows = rows.withColumns({"satisfaction_n": F.col("satisfaction").try_cast("double"), "start_s": F.coalesce(seconds(F.col("start")), F.lit(0.0)), "end_s": seconds(F.col("end"))})
    found = F.lit(True)
    if known_audio is not None:
        rows = rows.join(known_audio.select(F.col("audio").alias("_known")).distinct(), F.col("audio") == F.col("_known"), "left")
        found = F.col("_known").isNotNull()
    wrong = {
        "audio is missing": F.col("audio").isNull(),
        "audio is outside of the folder": F.col("audio").rlike(r"^([/\\]|[A-Za-z]:|.*://)") | F.col("audio").rlike(r"(^|[/\\])\.\.([/\\]|$)"),
        "audio is not found": ~found,
        "emotion is not known": F.col("emotion").isNotNull() & ~F.col("emotion").isin(LABELS),
        "neither emotion nor satisfaction": F.col("emotion").isNull() & F.col("satisfaction").isNull(),
        "satisfaction is no number from 0 to 100": F.col("satisfaction").isNotNull() & ~F.coalesce(F.col("satisfaction_n").between(0, 100), F.lit(False)),
        "time is not readable": (F.col("start").isNotNull() & seconds(F.col("start")).isNull()) | (F.col("end").isNotNull() & F.col("end_s").isNull()),
        "end is not after start": F.col("end_s") <= F.col("start_s"),
    }
    error = F.coalesce(*(F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in wrong.items()))
    return rows.select("row", *COLUMNS, "satisfaction_n", "start_s", "end_s", error.alias("error"))


def import_report(rows: DataFrame, most: int = 200) -> DataFrame:
    """read_manifest() -> imported, error_count and errors: the first `most` of them as (row, error)."""
    totals = rows.agg(F.count_if(F.col("error").isNull()).alias("imported"), F.count("error").alias("error_count"))
    first = rows.where("error is not null").orderBy("row").limit(most).agg(F.array_sort(F.collect_list(F.struct("row", "error"))).alias("errors"))
    return totals.crossJoin(first)  # one row each
