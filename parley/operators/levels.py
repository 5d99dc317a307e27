"""Levels of recordings from their frames, the layout of two channels, and the state of a calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .learning import linear_calibration


def frame_levels(frames: DataFrame, keys: list[str], db: str, clipped: Column | None = None) -> DataFrame:
    """frames(keys, db) -> keys, noise_floor (p10), median, speech_level (p90), snr, silence_ratio (the share of frames
    below p90 - 35, or -50 if that is higher), clipping_ratio (the share for which `clipped` holds) and frames."""
    p = frames.groupBy(*keys).agg(F.percentile(db, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_p"))
    both = frames.join(p, keys)
    silent = F.col(db) < F.greatest(F.lit(-50.0), F.col("_p")[2] - 35.0)
    share = lambda x: F.avg(x.cast("double"))
    g = both.groupBy(*keys).agg(F.first("_p").alias("_p"), share(silent).alias("silence_ratio"), (share(clipped) if clipped is not None else F.lit(0.0)).alias("clipping_ratio"), F.count(F.lit(1)).alias("frames"))
    return g.select(*keys, F.col("_p")[0].alias("noise_floor"), F.col("_p")[1].alias("median"), F.col("_p")[2].alias("speech_level"), (F.col("_p")[2] - F.col("_p")[0]).alias("snr"), "silence_ratio", "clipping_ratio", "frames")


def channel_layout(frames: DataFrame, keys: list[str], left: str, right: str, left_db: str, right_db: str) -> DataFrame:
    """frames(keys, left, right, left_db, right_db) -> keys, correlation, active_left, active_right, overlap_ratio, split
    (one speaker a channel) and reason.

    A frame is active in a channel if it is louder than the channel's 95th percentile less 25, or -55 if that is higher,
    and than -60; overlap is measured against the less active channel.
    """
    c = DEFAULTS["channels"]
    p = frames.groupBy(*keys).agg(*(F.percentile(x, 0.95).alias(f"_{side}") for side, x in (("l", left_db), ("r", right_db))))
    both = frames.join(p, keys)
    on = {side: ((F.col(x) > F.greatest(F.lit(-55.0), F.col(f"_{side}") - 25.0)) & (F.col(x) > -60)).cast("double") for side, x in (("l", left_db), ("r", right_db))}
    g = both.groupBy(*keys).agg(F.coalesce(F.corr(left, right), F.lit(0.0)).alias("correlation"), F.avg(on["l"]).alias("active_left"), F.avg(on["r"]).alias("active_right"), (F.sum(on["l"] * on["r"]) / F.greatest(F.lit(1.0), F.least(F.sum(on["l"]), F.sum(on["r"])))).alias("overlap_ratio"))
    alike = F.abs("correlation") > c["max_correlation"]
    reason = F.when(alike, "correlated channels").when(F.least("active_left", "active_right") < c["min_active"], "a channel with hardly any voice").when(F.col("overlap_ratio") > c["max_overlap"], "both channels active at once").otherwise("one speaker a channel")
    return g.withColumn("reason", reason).withColumn("split", F.col("reason") == "one speaker a channel")


def calibration_status(pairs: DataFrame, real: str, predicted: str, order: str, most: int = 500) -> DataFrame:
    """n, current_a, current_b (those in use), proposed_a, proposed_b (null under three pairs), enough (min_samples are
    there) and the first `most` pairs by `order`. Pairs with a null on either side are left out."""
    c = DEFAULTS["calibration"]
    sound = pairs.dropna(subset=[real, predicted])
    fit = linear_calibration(sound, real, predicted)
    first = sound.orderBy(order).limit(most).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(predicted).alias("predicted"), F.col(real).alias("real")))).alias("pairs"))
    three = F.col("n") >= 3
    return fit.crossJoin(first).select("n", F.lit(float(c["a"])).alias("current_a"), F.lit(float(c["b"])).alias("current_b"), F.when(three, F.col("a")).alias("proposed_a"), F.when(three, F.col("b")).alias("proposed_b"), (F.col("n") >= c["min_samples"]).alias("enough"), "pairs")


def dataset_stats(samples: DataFrame, group: str, label: str, duration: str, split: str, issues: Column) -> DataFrame:
    """One row: samples, groups, duration, classes and splits (maps of counts) and issues (rows with one)."""
    counted = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n"))))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    totals = samples.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct(value(group)).alias("groups"), F.sum(duration).alias("duration"), F.count_if(F.coalesce(issues, F.lit(False))).alias("issues"))
    for name, column in (("classes", label), ("splits", split)):
        totals = totals.crossJoin(samples.groupBy(value(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).agg(counted(column).alias(name)))  # one row each
    return totals
