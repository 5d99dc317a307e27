"""Operators over one series per key: slices, runs, peaks, trends, block planning, utterances, activity."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..config import DEFAULTS
from .intervals import gaps
from .windows import runs


def trailing_slices(cells: DataFrame, keys: list[str], step: float, width: float) -> DataFrame:
    """cells(keys, t, ...) with k: each cell once for every multiple k * step of the grid that it lies up to `width` before.
    The grid ends one step after the series, whose cells last a second."""
    ends = cells.groupBy(*keys).agg((F.ceil((F.max("t") + 0.5 + step) / step) - 1).alias("_last"))
    reach = F.sequence(F.ceil((F.col("t") - 1e-6) / step), F.floor((F.col("t") + width) / step))
    return cells.withColumn("k", F.explode(reach)).join(ends, keys).where("k <= _last").drop("_last")


def hot_runs(rows: DataFrame, keys: list[str], at: str, value: str, step: int, least: float) -> DataFrame:
    """rows that are hot, on a grid of `step` -> keys, first_s, last_s and the largest value of each unbroken run that
    lasts `least` at least."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    grouped = rows.withColumn("_run", (F.col(at) / step).cast("long") - place).groupBy(*keys, "_run")
    found = grouped.agg(F.min(at).alias("first_s"), F.max(at).alias("last_s"), F.max(value).alias(value))
    return found.where(F.col("last_s") - F.col("first_s") >= least).drop("_run")


def find_peaks(x: np.ndarray, height: float, distance: int, prominence: float = 0.0) -> np.ndarray:
    """Indices of local maxima (the middle of a plateau) that reach a height, are `distance` apart (the higher one stays,
    the later on ties), and rise by `prominence` over the higher of the two lowest points towards higher ground."""
    edge = np.flatnonzero(np.diff(x) != 0)
    begin, end = np.append(0, edge + 1), np.append(edge, len(x) - 1)
    level = x[begin]
    inner = np.arange(1, len(level) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    at = (begin[top] + end[top]) // 2
    at = at[x[at] >= height]
    keep = np.ones(len(at), bool)
    for i in np.argsort(x[at], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep[near] = False
    at = at[keep]
    if prominence:
        rises = []
        for i in at:
            higher = np.flatnonzero(x > x[i])
            left = higher[higher < i].max(initial=-1) + 1
            right = higher[higher > i].min(initial=len(x))
            rises.append(x[i] - max(x[left : i + 1].min(), x[i:right].min()))
        at = at[np.asarray(rises) >= prominence] if len(at) else at
    return at


def peaks(series: DataFrame, keys: list[str], time: str, value: str, height: float, distance: int, prominence: float = 0.0) -> DataFrame:
    """series(keys, time, value) -> keys, time, value of its peaks. A key's series is one call's cells, a few thousand
    rows; a task gets many keys."""

    def each(group: pa.Table) -> pa.Table:
        group = group.sort_by(time)
        return group.take(pa.array(find_peaks(group.column(value).to_numpy(), height, distance, prominence)))

    rows = series.select(*keys, time, value).where(F.col(value).isNotNull())
    # A series that doesn't reach the height has no peak and stays in the JVM.
    high = rows.withColumn("_most", F.max(value).over(Window.partitionBy(*keys))).where(F.col("_most") >= height).drop("_most")
    return high.groupBy(*keys).applyInArrow(each, rows.schema)


def jumps(series: DataFrame, keys: list[str], time: str, value: str, step: float) -> DataFrame:
    """Per key: n, the share of steps that change by more than `step`, and the population deviation."""
    change = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(time)))
    marked = series.withColumn("_d", (change > step).cast("double"))
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("_d"), F.lit(0.0)).alias("jumps"), F.stddev_pop(value).alias("spread"))


def trend(series: DataFrame, keys: list[str], time: str, value: str, least_rows: int = 6, least_span: float = 20) -> DataFrame:
    """Per key the slope of value over time from 0 to 1; 0 for short series."""
    whole = Window.partitionBy(*keys)
    rows = series.withColumn("_t0", F.min(time).over(whole)).withColumn("_t1", F.max(time).over(whole))
    span = F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1e-6))
    slope = F.regr_slope(F.col(value), (F.col(time) - F.col("_t0")) / span)
    enough = (F.count(F.lit(1)) >= least_rows) & (F.max(F.col("_t1") - F.col("_t0")) + 1 > least_span)
    return rows.groupBy(*keys).agg(F.when(enough, slope).otherwise(0.0).alias("slope"))


def plan_blocks(turns: DataFrame, block: int, search: int, slack: float = 1.15, least_gap: int = 300) -> DataFrame:
    """turns (call_id, start_ms, end_ms) -> call_id, block, b_start, b_end: blocks of about `block`, each cut in the middle
    of the longest silence within `search` of its aim (the later one on ties), else at the aim; what is left at the end
    may be longer by `slack`. A fold over a call's silences in the JVM."""
    silences = gaps(turns.select("call_id", "start_ms", "end_ms"), ["call_id"]).where(F.col("gap_ms") > least_gap)
    silence = F.struct("gap_ms", ((F.col("start_ms") + F.col("end_ms")) / 2).alias("mid"))
    calls = turns.groupBy("call_id").agg(F.max("end_ms").cast("double").alias("duration"))
    calls = calls.join(silences.groupBy("call_id").agg(F.collect_list(silence).alias("silences")), "call_id", "left")
    # Cuts are no closer than block - search, so this many steps are enough.
    steps = F.sequence(F.lit(1), F.ceil(F.col("duration") / (block - search)).cast("int") + 1)

    def cut(acc: Column, _: Column) -> Column:
        aim = F.element_at(acc, -1) + block
        best = F.array_max(F.filter(F.col("silences"), lambda s: F.abs(s["mid"] - aim) <= search))
        more = F.col("duration") - F.element_at(acc, -1) > block * slack
        return F.when(more, F.concat(acc, F.array(F.coalesce(best["mid"], aim)))).otherwise(acc)

    cuts = F.aggregate(steps, F.array(F.lit(0.0)), cut)
    each = calls.select("call_id", "duration", cuts.alias("cuts")).select("call_id", "duration", "cuts", F.posexplode("cuts").alias("block", "b_start"))
    return each.select("call_id", "block", "b_start", F.coalesce(F.get("cuts", F.col("block") + 1), "duration").alias("b_end"))


def utterances(words: DataFrame, gap: int = 1200, longest: int = 25_000) -> DataFrame:
    """words (call_id, speaker, start_ms, end_ms, word) -> call_id, utterance, speaker, start_ms, end_ms, n_words, text.

    A word begins an utterance if its speaker is another one, if more than `gap` is silent before it, or if the
    utterance would be longer than `longest` and its text ends in . ? or !. Words without a leading blank are glued to
    the one before. The last rule depends on where an utterance began, so a call's words are folded in order; a task
    folds many calls.
    """
    schema = "call_id long, utterance int, speaker string, start_ms long, end_ms long, n_words int, text string"

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for call, speaker, start, end, word in group.sort_values(["start_ms", "end_ms", "speaker"])[["call_id", "speaker", "start_ms", "end_ms", "word"]].itertuples(index=False):
            last = out[-1] if out else None
            if last is None or last[2] != speaker or start - last[4] > gap or (end - last[3] > longest and last[6].endswith((".", "?", "!"))):
                out.append([call, len(out), speaker, start, end, 1, word.strip()])
            else:
                last[4], last[5] = max(last[4], end), last[5] + 1
                last[6] += (" " if word.startswith(" ") else "") + word.strip()
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return words.groupBy("call_id").applyInPandas(fold, schema)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, not twice: the product's and the sum's rounding errors are worked out and added at the end."""

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (ah, al), (bh, bl) = halves(a), halves(b)
    product = a * b
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    total = product + c
    late = total - product
    return total + (((product - (total - late)) + (c - late)) + lost)


def tenth_percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, tenth: the tenth percentile of the values, interpolated between the two around it with one rounding of the sum,
    as DuckDB does; F.percentile rounds twice, and a value that equals a limit is then on its other side."""
    by = Window.partitionBy(*keys)
    placed = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    placed = placed.withColumn("_i", F.row_number().over(by.orderBy("_v")) - 1).withColumn("_at", (F.count(F.lit(1)).over(by) - 1) * F.lit(0.1))
    around = placed.groupBy(*keys).agg(F.max("_at").alias("_at"), *(F.max(F.when(F.col("_i") == f("_at"), F.col("_v"))).alias(c) for c, f in (("_low", F.floor), ("_high", F.ceil))))
    part = F.col("_at") - F.floor("_at")
    between = fused(F.col("_low"), 1 - part, F.col("_high") * part)
    return around.select(*keys, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("tenth"))


def active_runs(frames: DataFrame, keys: list[str], floor: float, above: float, least: int) -> DataFrame:
    """frames (keys, event_id, ms, db) -> keys, start_ms, end_ms, frames of the runs of active ones, `least` at least:
    louder than the floor and than the tenth percentile of their key plus `above`."""
    threshold = tenth_percentiles(frames, keys, "db").select(*keys, F.greatest(F.lit(floor), F.col("tenth") + above).alias("_limit"))
    marked = frames.join(threshold, keys).withColumn("_active", F.col("db") > F.col("_limit")).withColumn("_order", F.struct("ms", "event_id"))
    grouped = runs(marked, keys, "_order", "_active").where("_active").groupBy(*keys, "_run")
    return grouped.agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count(F.lit(1)).alias("frames")).where(F.col("frames") >= least).drop("_run")


def interaction_satisfaction(scores: DataFrame) -> DataFrame:
    """scores (call_id, initial, final, score), one row a speaker -> the means of calls with two speakers, with their
    variation and trend."""
    turn = DEFAULTS["satisfaction"]["trend_delta"]
    g = scores.groupBy("call_id").agg(F.count(F.lit(1)).alias("_n"), *(F.avg(c).alias(c) for c in ("initial", "final", "score"))).where("_n = 2").drop("_n")
    g = g.withColumn("variation", F.col("final") - F.col("initial"))
    return g.withColumn("trend", F.when(F.col("variation") > turn, "improving").when(F.col("variation") < -turn, "declining").otherwise("stable"))


def analysis_quality(audio: Column, speech_ratio: Column, valid_windows: Column, model_confidence: Column, diarization: Column, word_confidence: Column, mismatch: Column | None = None) -> tuple[Column, Column]:
    """(quality from 0 to 100, whether it is low) of a call's analysis.

    audio and diarization are from 0 to 100, the others are shares. Speech is full at a share of .4; the model's confidence
    counts from .3 to .8, less where the model is made for another language. A null diarization, that of a call with one
    speaker, drops out with its weight; other parts that are null count 0.
    """
    settings = DEFAULTS["analysis_quality"]
    unit = lambda x: F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 100
    model = unit((model_confidence - 0.3) / 0.5)
    if mismatch is not None:
        model = F.when(F.coalesce(mismatch, F.lit(False)), settings["mismatch"] * model).otherwise(model)
    quality = weighted_quality({"audio": F.coalesce(audio, F.lit(0.0)), "speech": unit(speech_ratio / 0.4), "segments": unit(valid_windows), "model": model, "diarization": diarization, "transcription": unit(word_confidence)})
    return quality, quality < settings["low"]


def weighted_quality(parts: dict[str, Column]) -> Column:
    """Weighted mean of the parts that are not null."""
    weights = DEFAULTS["analysis_quality"]["weights"]
    top = sum((F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    return top / sum((F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))


def reconcile(vectors: DataFrame, keys: list[str], order: str, vector: str, most: float = 0.55) -> DataFrame:
    """vectors(keys, order, vector) with speaker: each one, in order, joins the nearest centroid (cosine distance `most`
    or less), which moves to the mean, or founds its own. A key is one call's chunks."""
    schema = vectors.select(*keys, order).schema.add("speaker", IntegerType())

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        centres: list[np.ndarray] = []
        counts: list[int] = []
        names = []
        group = group.sort_values(order)
        for v in (np.asarray(x, float) for x in group[vector]):
            far = [1 - v @ c / (np.linalg.norm(v) * np.linalg.norm(c) + 1e-9) for c in centres]
            best = int(np.argmin(far)) if far else -1
            if far and far[best] <= most:
                counts[best] += 1
                centres[best] = centres[best] + (v - centres[best]) / counts[best]
            else:
                best = len(centres)
                centres.append(v)
                counts.append(1)
            names.append(best)
        return group[[*keys, order]].assign(speaker=names)

    return vectors.select(*keys, order, vector).groupBy(*keys).applyInPandas(fold, schema)

