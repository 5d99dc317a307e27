"""Interval algebra: unions, silences, overlap joins, speaker reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: list[str], gap: float, least: float = 0, any_of: list[str] | None = None) -> DataFrame:
    """df(keys, start_ms, end_ms) -> keys, start_ms, end_ms of unions: intervals at most `gap` apart are one.

    Unions shorter than `least` are dropped; the flags in any_of hold if they hold for any part. Keys decide what may be
    merged: with the speaker among them, other speakers' turns in between don't matter.
    """
    by = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reached = F.max("end_ms").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (reached.isNull() | (F.col("start_ms") - reached > gap)).cast("int"))
    grouped = marked.withColumn("_group", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    flags = [F.bool_or(c).alias(c) for c in any_of or []]
    return grouped.groupBy(*keys, "_group").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), *flags).where(F.col("end_ms") - F.col("start_ms") >= least).drop("_group")


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """df(keys, start_ms, end_ms) -> keys, start_ms, end_ms, gap_ms of what lies between its unions."""
    busy = merge_intervals(df, keys, 0)
    after = F.lead("start_ms").over(Window.partitionBy(*keys).orderBy("start_ms"))
    return busy.select(*keys, F.col("end_ms").alias("start_ms"), after.alias("next")).where("next is not null").select(*keys, "start_ms", F.col("next").alias("end_ms"), (F.col("next") - F.col("start_ms")).alias("gap_ms"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int, how: str = "inner", pad: int = 0, condition: Column | None = None) -> DataFrame:
    """Pairs of left(keys, l_start, l_end) and right(keys, r_start, r_end) that touch or overlap, with `pad` around.

    Both sides are dealt to time buckets, so that a key with very many intervals is an equi join on small buckets and
    not a product; a pair is taken in the first bucket that both have. condition: what else must hold. how: inner or
    left (then a left row without a pair comes once, with nulls; its rows must be distinct).
    """
    slot = lambda x: F.floor(x / bucket)
    le = left.withColumn("_b", F.explode(F.sequence(slot(F.col("l_start") - pad), slot(F.col("l_end") + pad))))
    ri = right.withColumn("_b", F.explode(F.sequence(slot(F.col("r_start")), slot(F.col("r_end")))))
    met = le.join(ri, [*keys, "_b"]).where((F.col("r_end") >= F.col("l_start") - pad) & (F.col("r_start") <= F.col("l_end") + pad))
    met = met.where(F.col("_b") == F.greatest(slot(F.col("l_start") - pad), slot(F.col("r_start"))))
    if condition is not None:
        met = met.where(condition)
    met = met.drop("_b")
    return met if how == "inner" else left.join(met, left.columns, "left")


def overlaps(turns: DataFrame, least_ms: int = 300, bucket: int = 60_000) -> DataFrame:
    """turns (call_id, turn, speaker, start_ms, end_ms) -> pairs of turns of different speakers, the later one (by start,
    end, turn) beginning inside the earlier: call_id, turn_a, speaker_a, turn_b, speaker_b, at_ms, overlap_ms.

    An overlap of least_ms at least is also an interruption by b.
    """
    a = turns.select("call_id", F.col("turn").alias("turn_a"), F.col("speaker").alias("speaker_a"), F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    b = turns.select("call_id", F.col("turn").alias("turn_b"), F.col("speaker").alias("speaker_b"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    later = (F.struct("r_start", "r_end", "turn_b") > F.struct("l_start", "l_end", "turn_a")) & (F.col("r_start") < F.col("l_end")) & (F.col("speaker_a") != F.col("speaker_b"))
    shared = F.least("l_end", "r_end") - F.col("r_start")
    met = interval_join(a, b, ["call_id"], bucket, condition=later)
    return met.where(shared >= least_ms).select("call_id", "turn_a", "speaker_a", "turn_b", "speaker_b", F.col("r_start").alias("at_ms"), shared.alias("overlap_ms"))


def mark_overlaps(turns: DataFrame) -> DataFrame:
    """turns with overlap: whether another speaker's turn shares time with it."""
    pairs = overlaps(turns, 1)
    touched = pairs.select("call_id", F.col("turn_a").alias("turn")).union(pairs.select("call_id", F.col("turn_b").alias("turn"))).distinct().withColumn("overlap", F.lit(True))
    return turns.join(touched, ["call_id", "turn"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(False)))


def interaction(turns: DataFrame, long_silence_ms: int = 4000, pause_ms: int = 1000, least_ms: int = 300) -> DataFrame:
    """One row per call: overlaps, overlap_ms, interruptions, long_silences, pauses, silence_ms, longest_silence_ms."""
    pairs = overlaps(turns, least_ms).groupBy("call_id").agg(F.count(F.lit(1)).alias("overlaps"), F.sum("overlap_ms").alias("overlap_ms"))
    quiet = gaps(turns.select("call_id", "start_ms", "end_ms"), ["call_id"]).groupBy("call_id").agg(
        F.count_if(F.col("gap_ms") >= long_silence_ms).alias("long_silences"),
        F.count_if((F.col("gap_ms") >= pause_ms) & (F.col("gap_ms") < long_silence_ms)).alias("pauses"),
        F.sum("gap_ms").alias("silence_ms"),
        F.max("gap_ms").alias("longest_silence_ms"),
    )
    base = turns.groupBy("call_id").agg(F.count(F.lit(1)).alias("turns"), F.max("end_ms").alias("duration_ms"))
    return base.join(pairs, "call_id", "left").join(quiet, "call_id", "left").na.fill(0)


def talk_time(turns: DataFrame) -> DataFrame:
    """Per call and speaker: turns, talk_s, ratio of the call's talk, words and words a minute."""
    per = turns.groupBy("call_id", "speaker").agg(F.count(F.lit(1)).alias("turns"), F.sum("dur_ms").alias("talk_ms"), F.sum("n_words").alias("words"))
    ratio = F.col("talk_ms") / F.sum("talk_ms").over(Window.partitionBy("call_id"))
    wpm = F.when(F.col("talk_ms") > 0, F.round(60000.0 * F.col("words") / F.col("talk_ms"), 1))
    return per.select("call_id", "speaker", "turns", F.round(F.col("talk_ms") / 1000.0, 2).alias("talk_s"), F.round(ratio, 4).alias("ratio"), "words", wpm.alias("wpm"))


def reduce_to_two(turns: DataFrame, minor: float = 0.05) -> DataFrame:
    """turns (call_id, speaker, turn, start_ms, end_ms) -> the same with label P1 or P2 and n_speakers of the call.

    The two speakers with most time (those with `minor` of it at least) stay, labelled by first appearance; turns of
    others go to the speaker of the last turn before that stays, else of the first one after.
    """
    per = turns.groupBy("call_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("talk"), F.min("start_ms").alias("first"))
    by_talk = Window.partitionBy("call_id").orderBy(F.desc("talk"), "speaker")
    share = F.col("talk") / F.sum("talk").over(Window.partitionBy("call_id"))
    ranked = per.withColumn("rank", F.row_number().over(by_talk)).withColumn("share", share)
    n = ranked.groupBy("call_id").agg(F.count_if(F.col("share") >= minor).alias("n_speakers"))
    major = ranked.where((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("share") >= minor)))
    major = major.withColumn("label", F.concat(F.lit("P"), F.row_number().over(Window.partitionBy("call_id").orderBy("first", "speaker")).cast("string"))).select("call_id", "speaker", "label")
    known = turns.join(major, ["call_id", "speaker"], "left")
    by = Window.partitionBy("call_id").orderBy("start_ms", "turn")
    before = F.last("label", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    # A turn with no such turn before it comes before the call's first one. A frame to the call's end would be read whole for each turn.
    placed = F.when(F.col("label").isNotNull(), F.struct("start_ms", "turn"))
    after = F.min_by("label", placed).over(Window.partitionBy("call_id"))
    return known.withColumn("label", F.coalesce("label", before, after)).join(n, "call_id")
