"""Exports of analysed calls: one nested document a call, and the sheets of a workbook as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTICE = "Estimates of a model, not findings: probabilities, times and texts are observed, satisfaction and events are interpretation."


def _ordered(rows: DataFrame, name: str, order: list[str], *columns: Column | str) -> DataFrame:
    """(call_id, name): a call's rows as a list of structs, in order."""
    lists = rows.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("x")))).alias("l"))
    return lists.select("call_id", F.col("l.x").alias(name))


def call_documents(calls: DataFrame, speakers: DataFrame, segments: DataFrame, utterances: DataFrame, emotions: DataFrame, scores: DataFrame, timeline: DataFrame, events: DataFrame, config: dict,
                   model: DataFrame | None = None, interaction: DataFrame | None = None, confidence: DataFrame | None = None, redact: bool = False, exported_at: str | None = None) -> DataFrame:
    """One row per call: call (its columns), speakers, segments, transcription, emotions, satisfaction (a speaker's score,
    components, metrics and timeline), events, model, interaction, confidence, config, redacted, exported_at and notice.

    What a call has none of is an empty list; model, interaction and confidence, one row a call each, are null for calls
    without one. With redact, text_redacted stands for the text of utterances that have one. exported_at is the time of
    the query, in UTC, unless it is given.
    """
    if redact:
        utterances = utterances.withColumn("text", F.coalesce("text_redacted", "text"))
    line = timeline.groupBy("call_id", "speaker").agg(F.array_sort(F.collect_list(F.struct(F.round("t", 2).alias("t"), F.round("score", 2).alias("score")))).alias("timeline"))
    scored = scores.join(line, ["call_id", "speaker"], "left")
    parts = [
        _ordered(speakers, "speakers", ["speaker"], "speaker", "turns", "talk_s", "ratio"),
        _ordered(segments, "segments", ["start_ms", "turn"], "speaker", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end")),
        _ordered(utterances, "transcription", ["start_ms", "turn"], "speaker", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", F.col("text_conf").alias("confidence")),
        _ordered(emotions, "emotions", ["widx"], "speaker", (F.col("w_start") / 1000).alias("start"), (F.col("w_end") / 1000).alias("end"), F.transform("p", lambda x: F.round(x, 5)).alias("probabilities"), F.round("conf", 4).alias("confidence")),
        _ordered(scored, "satisfaction", ["speaker"], *(c for c in scored.columns if c != "call_id")),
        _ordered(events, "events", ["t", "type"], *(c for c in events.columns if c != "call_id")),
    ]
    out = calls.select("call_id", F.struct(*calls.columns).alias("call"))
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "call_id", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    for name, one in (("model", model), ("interaction", interaction), ("confidence", confidence)):
        if one is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
        else:
            known = one.select(F.col("call_id"), F.struct(*(c for c in one.columns if c != "call_id")).alias(name))
            out = out.join(known, "call_id", "left")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if exported_at is None else F.lit(exported_at)
    out = out.withColumns({"redacted": F.lit(redact), "exported_at": now})
    return out.withColumn("config", F.lit(json.dumps(config, sort_keys=True))).withColumn("notice", F.lit(NOTICE))


def transcription_sheet(utterances: DataFrame) -> DataFrame:
    return utterances.select("call_id", "turn", "speaker", F.round(F.col("start_ms") / 1000, 2).alias("start"), F.round(F.col("end_ms") / 1000, 2).alias("end"), "text", F.col("text_conf").alias("confidence"))


def events_sheet(events: DataFrame) -> DataFrame:
    return events.select("call_id", F.round("t", 2).alias("timestamp"), "speaker", F.col("type").alias("event"), "emotion", F.round("confidence", 3).alias("confidence"), "satisfaction", "description")


def satisfaction_sheet(timeline: DataFrame) -> DataFrame:
    return timeline.select("call_id", "speaker", "t", F.round(F.col("score") + 1e-9, 2).alias("score"))
