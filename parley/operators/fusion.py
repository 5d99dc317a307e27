"""Probability vectors: tempering, fusion of audio and text, calibration, cosine distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def normalised(p: Column) -> Column:
    return F.transform(p, lambda x: x / _total(p))


def temper(p: Column, temperature: float) -> Column:
    """p to the power 1 / temperature, normalised; nothing below 1e-12; p itself at temperature 1."""
    if abs(temperature - 1) < 1e-6:
        return p
    return normalised(F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(1e-12)), F.lit(1 / temperature))))


def fuse(audio: Column, text: Column, audio_weight: float, text_weight: float) -> Column:
    """Struct of p, the weighted mean of both (audio alone where text is null or has no mass), and agreement: half for the
    same first label, half for the text's mass on the audio's two first labels (ties to the later label)."""
    there = text.isNotNull() & (_total(text) > 0)
    t = normalised(text)
    mixed = F.zip_with(audio, t, lambda a, b: (audio_weight * a + text_weight * b) / (audio_weight + text_weight))
    order = F.reverse(F.array_sort(F.transform(audio, lambda x, i: F.struct(x.alias("v"), i.alias("i")))))
    top = F.get(t, order[0]["i"]) + F.get(t, order[1]["i"])
    same = (F.array_position(audio, F.array_max(audio)) == F.array_position(t, F.array_max(t))).cast("double")
    return F.struct(F.when(there, mixed).otherwise(audio).alias("p"), F.when(there, 0.5 * same + 0.5 * top).alias("agreement"))


def dot_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot_arrays(a, b) / (F.sqrt(dot_arrays(a, a)) * F.sqrt(dot_arrays(b, b)) + 1e-9)


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """ece: mean difference of accuracy and confidence over equal bins (low, high], by their share of rows; a confidence
    of 0 is in no bin."""
    total = F.count(F.lit(1)).alias("n"), F.sum(confidence).alias("c"), F.sum(correct).alias("a")
    per = rows.groupBy(F.when(F.col(confidence) > 0, F.ceil(F.col(confidence) * bins)).alias("bin")).agg(*total)
    return per.agg((F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("a") - F.col("c")))) / F.sum("n")).alias("ece"))


def _losses(grid: list[float]):
    """Batches of (p, truth) -> a row a batch: n, and the sum of the negative log-likelihoods at each temperature."""

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = 1e-12
        for batch in batches:
            lists, truth = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(lists.flatten(), least).to_numpy(zero_copy_only=False)
            begins = np.cumsum(sizes) - sizes
            at = pc.fill_null(truth, -1).to_numpy(zero_copy_only=False)
            # Rows without a probability of their label count as the least one.
            known = (at >= 0) & (at < sizes)
            logs = np.log(np.maximum(flat, least))
            own, full = logs[(begins + at)[known]], sizes > 0
            sums = []
            for t in grid:
                total = np.full(len(sizes), np.nan)
                if full.any():
                    total[full] = np.add.reduceat(np.exp(logs / t), begins[full])
                ratio = np.exp(own / t) / total[known]
                sums.append(float(-np.log(np.maximum(ratio, least)).sum() - np.log(least) * (~known).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([len(sizes)], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], names=["n", "sums"])

    return losses


def best_temperature(rows: DataFrame, p: str, truth: str, grid: list[float]) -> DataFrame:
    """temperature, nll: of a grid, the first with the least mean negative log-likelihood of the label number `truth`.

    Batches of rows are summed up for all temperatures at once, so the rows are read once and not once for each; no row
    gives one of nulls.
    """
    pairs = rows.select(F.col(p).cast("array<double>").alias("p"), F.col(truth).cast("int").alias("truth"))
    sums = pairs.mapInArrow(_losses(grid), "n long, sums array<double>")
    n = F.sum("n")
    means = F.array(*(F.struct((F.sum(F.col("sums")[i]) / n).alias("nll"), F.when(n > 0, F.lit(t)).alias("temperature")) for i, t in enumerate(grid)))
    return sums.agg(F.array_min(means).alias("best")).select("best.temperature", "best.nll")
