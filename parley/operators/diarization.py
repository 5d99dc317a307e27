"""Who speaks when, from sound alone: cepstral windows, two clusters a call, turns; and the plan of long calls' chunks.

Features come from blocks of audio, each by itself, so one long call is the work of many tasks; only one row for every
0.75 s goes on. Clustering takes a call's rows together: a call ends at 12 hours (57,600 rows of 66 numbers, 30 MB).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal
from . import intervals

#: Seconds of a window and between windows; least share of speech in a window.
WINDOW, HOP, VOICED = 1.5, 0.75, 0.7
#: From which silhouette and separation on two clusters are two voices; windows below which nothing is separated.
SILHOUETTE, SEPARATION, FEWEST = 0.25, 1.30, 4
#: Most windows over which the silhouette is taken.
SAMPLE = 2000
SOLVED = "call_id long, start_ms long, end_ms long, voice int, silhouette double, separation double, minor_share double, windows long"


FEATURES = "call_id long, start_ms long, end_ms long, features array<double>"


def _frame_features(x: np.ndarray, rate: int) -> np.ndarray:
    magnitudes = signal.spectrum(x, 512, rate // 100)
    cepstra = signal.mfcc(magnitudes, rate)
    return np.hstack([cepstra, signal.slopes(cepstra)[:, :8], signal.centroid(magnitudes, rate)[:, None] / 1000])


def feature_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """FEATURES of batches with call_id, offset_s, sample_rate, samples, as window_features() has them."""
    size, hop = int(WINDOW * 100), int(HOP * 100)
    for batch in batches:
        calls, begins, features = [], [], []
        for call, offset, rate, samples in zip(batch["call_id"], batch["offset_s"], batch["sample_rate"], batch["samples"], strict=True):
            if samples is None or len(samples) < rate:
                continue
            frames = _frame_features(np.asarray(samples, float), int(rate))
            starts = range(0, len(frames) - size + 1, hop)
            features += [np.concatenate([frames[i : i + size].mean(axis=0), frames[i : i + size].std(axis=0)]) for i in starts]
            begins += [round(1000 * offset) + 10 * i for i in starts]
            calls += [call] * len(starts)
        if calls:
            yield pd.DataFrame({"call_id": calls, "start_ms": begins, "end_ms": [b + int(1000 * WINDOW) for b in begins], "features": features})


def window_features(blocks: DataFrame) -> DataFrame:
    """blocks(call_id, offset_s, sample_rate, samples) -> call_id, start_ms, end_ms, features of each window of a block.

    66 features: mean and deviation of 24 cepstral coefficients, 8 of their slopes and the centroid in kHz, in frames
    every 10 ms. Blocks of less than a second have no window; neither have null samples.
    """
    asked = blocks.select(F.col("call_id").cast("long"), F.col("offset_s").cast("double"), F.col("sample_rate").cast("int"), "samples")
    return asked.mapInPandas(feature_rows, FEATURES)


def voiced_windows(windows: DataFrame, segments: DataFrame) -> DataFrame:
    """windows of which speech segments(call_id, start_ms, end_ms; without overlaps) cover VOICED at least. Calls without
    any segment keep all."""
    left = windows.select("call_id", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    right = segments.select("call_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    spoken = intervals.interval_join(left, right, ["call_id"], 60_000).groupBy("call_id", F.col("l_start").alias("start_ms"), F.col("l_end").alias("end_ms")).agg(F.sum(shared).alias("_spoken"))
    known = segments.select("call_id").distinct().withColumn("_known", F.lit(True))
    met = windows.join(spoken, ["call_id", "start_ms", "end_ms"], "left").join(known, "call_id", "left")
    return met.where(F.col("_known").isNull() | (F.col("_spoken") >= VOICED * (F.col("end_ms") - F.col("start_ms")))).drop("_spoken", "_known")


def two_means(rows: np.ndarray, seed: int = 0, tries: int = 10, rounds: int = 100) -> np.ndarray:
    """Cluster 0 or 1 of each row: the best of several runs from starts far apart."""
    rng = np.random.default_rng(seed)
    best, least = np.zeros(len(rows), int), np.inf
    for _ in range(tries):
        first = rows[rng.integers(len(rows))]
        away = ((rows - first) ** 2).sum(axis=1)
        if not away.sum():
            return best
        centres = np.stack([first, rows[rng.choice(len(rows), p=away / away.sum())]])
        labels = None
        for _ in range(rounds):
            far = np.stack([((rows - c) ** 2).sum(axis=1) for c in centres])
            now = far.argmin(axis=0)
            if labels is not None and (now == labels).all():
                break
            labels = now
            centres = np.stack([rows[labels == k].mean(axis=0) if (labels == k).any() else centres[k] for k in (0, 1)])
        cost = far.min(axis=0).sum()
        if cost < least:
            best, least = labels, cost
    return best


def silhouette(rows: np.ndarray, labels: np.ndarray, seed: int = 0) -> float:
    """Mean over rows (SAMPLE of them at most) of how much nearer their own cluster is than the other one."""
    at = np.sort(np.random.default_rng(seed).choice(len(rows), min(len(rows), SAMPLE), replace=False))
    rows, labels = rows[at], labels[at]
    counts = np.bincount(labels, minlength=2)
    if min(counts) == 0:
        return 0.0
    square = (rows**2).sum(axis=1)
    distance = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * rows @ rows.T, 0))
    np.fill_diagonal(distance, 0)
    to = np.stack([distance[:, labels == k].sum(axis=1) for k in (0, 1)], axis=1)
    own = to[np.arange(len(rows)), labels] / np.maximum(counts[labels] - 1, 1)
    other = to[np.arange(len(rows)), 1 - labels] / counts[1 - labels]
    score = (other - own) / np.maximum(np.maximum(own, other), 1e-12)
    return float(np.where(counts[labels] > 1, score, 0).mean())


def cluster_stats(rows: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Silhouette, distance of the centres in units of the spread within, share of the smaller cluster; all 0 if a
    cluster has fewer than two rows."""
    counts = np.bincount(labels, minlength=2)
    if min(counts) < 2:
        return 0.0, 0.0, 0.0
    a, b = rows[labels == 0], rows[labels == 1]
    within = np.sqrt((a.var(axis=0).mean() + b.var(axis=0).mean()) / 2) + 1e-9
    apart = np.linalg.norm(a.mean(axis=0) - b.mean(axis=0)) / (within * np.sqrt(rows.shape[1]))
    return silhouette(rows, labels), float(apart), float(min(counts) / counts.sum())


def median_of_five(labels: np.ndarray) -> np.ndarray:
    return (np.lib.stride_tricks.sliding_window_view(np.pad(labels, 2, mode="edge"), 5).sum(axis=1) > 2).astype(int) if len(labels) else labels


def clustered(windows: DataFrame) -> DataFrame:
    """windows(call_id, start_ms, end_ms, features) -> SOLVED: the voice of each window, 0 or 1, with the call's figures.
    Calls of fewer than FEWEST windows have voice 0 only."""

    def solve(call: pd.DataFrame) -> pd.DataFrame:
        call = call.sort_values("start_ms")
        rows = np.array(call["features"].tolist())
        voice, stats = np.zeros(len(call), int), (0.0, 0.0, 0.0)
        if len(call) >= FEWEST:
            rows = (rows - rows.mean(axis=0)) / (rows.std(axis=0) + 1e-6)
            voice = median_of_five(two_means(rows))
            stats = cluster_stats(rows, voice)
        return pd.DataFrame({"call_id": call["call_id"], "start_ms": call["start_ms"], "end_ms": call["end_ms"], "voice": voice, "silhouette": stats[0], "separation": stats[1], "minor_share": stats[2], "windows": len(call)})

    return windows.groupBy("call_id").applyInPandas(solve, SOLVED)


def decided(solved: DataFrame, segments: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One row a call of solved or segments: call_id, windows, silhouette, separation, minor_share, forced, voices, reason,
    quality.

    hints(call_id, speakers): 1 or 2 decide by themselves. Otherwise two voices need SILHOUETTE and SEPARATION. One voice
    has quality 100, two have 60 at most. reason says why a call has one voice.
    """
    figures = solved.groupBy("call_id").agg(*(F.max(c).alias(c) for c in ("windows", "silhouette", "separation", "minor_share")))
    calls = segments.select("call_id").distinct().join(figures, "call_id", "full").na.fill(0)
    hint = F.lit(None).cast("int")
    if hints is not None:
        calls = calls.join(hints.select("call_id", F.col("speakers").cast("int").alias("_hint")).dropDuplicates(["call_id"]), "call_id", "left")
        hint = F.col("_hint")
    hint = F.coalesce(hint, F.lit(0))
    reason = (
        F.when(hint == 1, "asked for").when(F.col("windows") < FEWEST, "too little speech")
        .when((hint != 2) & ~((F.col("silhouette") >= SILHOUETTE) & (F.col("separation") >= SEPARATION)), "no second voice")
    )
    found = calls.withColumns({"forced": hint == 2, "reason": reason})
    share = F.least(F.greatest((F.col("silhouette") + 0.1) / 0.6, F.lit(0.0)), F.lit(1.0))
    return found.select(
        "call_id", "windows", "silhouette", "separation", "minor_share", "forced", F.when(F.col("reason").isNull(), 2).otherwise(1).alias("voices"), "reason",
        F.when(F.col("reason").isNull(), F.round(60 * share, 1)).otherwise(100.0).alias("quality"),
    )


def turns_of(solved: DataFrame, decisions: DataFrame, segments: DataFrame, gap_ms: int = 800, least_ms: int = 600) -> DataFrame:
    """call_id, speaker, turn, start_ms, end_ms, overlap: turns of one or two voices.

    With two voices each window stands for the HOP around its middle; neighbours of one voice are joined, cut to speech
    segments (pieces of 0.1 s or less go), named by who speaks first, and joined over pauses of gap_ms. With one voice
    the segments are its turns. Turns of less than least_ms go.
    """
    half = int(500 * HOP)
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    two = solved.join(decisions.where("voices = 2").select("call_id"), "call_id")
    spoken = intervals.merge_intervals(two.select("call_id", F.col("voice").cast("string").alias("voice"), (middle - half).alias("start_ms"), (middle + half).alias("end_ms")), ["call_id", "voice"], 50)
    left = spoken.select("call_id", "voice", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    right = segments.select("call_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    pieces = intervals.interval_join(left, right, ["call_id"], 60_000).select("call_id", "voice", F.greatest("l_start", "r_start").alias("start_ms"), F.least("l_end", "r_end").alias("end_ms"))
    pieces = pieces.where("end_ms - start_ms > 100")
    first = pieces.groupBy("call_id", "voice").agg(F.min("start_ms").alias("_first"))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("_first", "voice")) - 1
    named = pieces.join(first.select("call_id", "voice", F.format_string("SPEAKER_%02d", place).alias("speaker")), ["call_id", "voice"])
    one = segments.join(decisions.where("voices = 1").select("call_id"), "call_id").select("call_id", F.lit("SPEAKER_00").alias("speaker"), "start_ms", "end_ms")
    whole = intervals.merge_intervals(named.select("call_id", "speaker", "start_ms", "end_ms").unionByName(one), ["call_id", "speaker"], gap_ms, least_ms)
    numbered = whole.withColumn("turn", F.row_number().over(Window.partitionBy("call_id").orderBy("start_ms", "end_ms", "speaker")) - 1)
    return intervals.mark_overlaps(numbered).select("call_id", "speaker", "turn", "start_ms", "end_ms", "overlap")


def diarize(blocks: DataFrame, segments: DataFrame, hints: DataFrame | None = None, cut=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(turns_of(), decided()) of blocks(call_id, offset_s, sample_rate, samples) and speech segments(call_id, start_ms,
    end_ms). `cut` may store the voices of all windows, which both results begin with."""
    return diarize_windows(window_features(blocks), segments, hints, cut)


def diarize_windows(windows: DataFrame, segments: DataFrame, hints: DataFrame | None = None, cut=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """diarize() of windows with their features."""
    solved = cut(clustered(voiced_windows(windows, segments)))
    decisions = decided(solved, segments, hints)
    return turns_of(solved, decisions, segments), decisions


def plan_chunks(calls: DataFrame, chunk_ms: int = 30 * 60_000, overlap_ms: int = 15_000) -> DataFrame:
    """calls(call_id, duration_ms) -> call_id, chunk, start_ms, end_ms, own_from_ms, own_until_ms.

    A chunk begins every chunk_ms - overlap_ms; it owns its time but for half of what it shares with the chunks before
    and after it. What lies within the chunk before is no chunk of its own, or else nobody would own the call's end. A
    call without duration has one empty chunk; a null duration is none.
    """
    if not 0 <= overlap_ms < chunk_ms:
        raise ValueError("the overlap must be shorter than a chunk")
    step, long_ = chunk_ms - overlap_ms, F.col("duration_ms").cast("long")
    last = F.greatest(F.ceil((long_ - overlap_ms) / step) - 1, F.lit(0))
    each = calls.where("duration_ms is not null").select("call_id", long_.alias("_all"), last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    start = F.col("chunk") * step
    end = F.least(F.col("_all"), start + chunk_ms)
    half = overlap_ms // 2
    return each.select(
        "call_id", "chunk", start.alias("start_ms"), end.alias("end_ms"),
        F.when(F.col("chunk") > 0, start + half).otherwise(start).alias("own_from_ms"),
        F.when(F.col("chunk") < F.col("_last"), end - (overlap_ms - half)).otherwise(end).alias("own_until_ms"),
    )


def owned_turns(found: DataFrame, chunks: DataFrame, least_ms: int = 50) -> DataFrame:
    """found(call_id, chunk, speaker, start_ms, end_ms, counted from the chunk's begin) -> call_id, chunk, speaker, start_ms,
    end_ms in the call: what a chunk owns of its turns, if that is more than least_ms."""
    met = found.join(chunks.withColumnsRenamed({"start_ms": "_start", "end_ms": "_end"}), ["call_id", "chunk"])
    begin = F.greatest(F.col("start_ms") + F.col("_start"), "own_from_ms")
    end = F.least(F.col("end_ms") + F.col("_start"), "own_until_ms")
    return met.where(end - begin > least_ms).select("call_id", "chunk", "speaker", begin.alias("start_ms"), end.alias("end_ms"))


def joined_turns(owned: DataFrame, gap_ms: int = 0) -> DataFrame:
    """call_id, speaker, start_ms, end_ms: pieces of a turn that was cut between chunks are one again."""
    return intervals.merge_intervals(owned.select("call_id", "speaker", "start_ms", "end_ms"), ["call_id", "speaker"], gap_ms)
