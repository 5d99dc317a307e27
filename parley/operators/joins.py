"""As-of, nearest and overlap-weighted joins in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import interval_join


def asof_interpolate(points: DataFrame, knots: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """points(keys, time, ...) with `value` interpolated linearly between the knots (keys, time, value) around, held
    constant beyond the first and last; null where a key has no knot.

    Both sides go through one sort by key and time, so no point meets more than two knots.
    """
    extra = [c for c in points.columns if c not in (*keys, time)]
    p = points.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_point"), F.lit(None).cast("double").alias("_v"), F.struct(F.col(time), *extra).alias("_row"))
    k = knots.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_point"), F.col(value).cast("double").alias("_v"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"))
    by = Window.partitionBy(*keys).orderBy("_t", "_point")
    knot = F.when(F.col("_point") == 0, F.struct("_t", "_v"))
    both = p.union(k).withColumn("_lo", F.last(knot, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.first(knot, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    span = F.col("_hi._t") - F.col("_lo._t")
    between = F.col("_lo._v") + (F.col("_hi._v") - F.col("_lo._v")) * (F.col("_t") - F.col("_lo._t")) / span
    found = F.when(F.col("_lo").isNull(), F.col("_hi._v")).when(F.col("_hi").isNull() | (span == 0), F.col("_lo._v")).otherwise(between)
    return both.where("_point = 1").select(*keys, "_row.*", found.alias(value))


def nearest(points: DataFrame, series: DataFrame, keys: list[str], time: str, take: str) -> DataFrame:
    """points(keys, time, ...) with `take` of the row of series(keys, time, take) nearest in time, the earlier on ties."""
    extra = [c for c in points.columns if c not in (*keys, time)]
    p = points.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_point"), F.struct(F.col(time), *extra).alias("_row"), F.lit(None).cast(series.schema[take].dataType).alias("_x"))
    s = series.select(*keys, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_point"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(take).alias("_x"))
    by = Window.partitionBy(*keys).orderBy("_t", "_point")
    row = F.when(F.col("_point") == 0, F.struct("_t", "_x"))
    both = p.union(s).withColumn("_lo", F.last(row, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.first(row, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    low = F.col("_lo").isNotNull() & (F.col("_hi").isNull() | (F.col("_t") - F.col("_lo._t") <= F.col("_hi._t") - F.col("_t")))
    return both.where("_point = 1").select(*keys, "_row.*", F.when(low, F.col("_lo._x")).otherwise(F.col("_hi._x")).alias(take))


def overlap_weighted(windows: DataFrame, pieces: DataFrame, keys: list[str], value: str, least_ms: int = 250, bucket: int = 60_000) -> DataFrame:
    """windows(keys, w_start, w_end, ...) with the mean of pieces(keys, start_ms, end_ms, value), weighted by the time
    they share; null if that is less than least_ms."""
    left = windows.withColumnsRenamed({"w_start": "l_start", "w_end": "l_end"})
    right = pieces.select(*keys, F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col(value).alias("_v"))
    shared = F.greatest(F.lit(0), F.least("l_end", "r_end") - F.greatest("l_start", "r_start"))
    met = interval_join(left, right, keys, bucket).withColumn("_o", shared)
    means = met.groupBy(*left.columns).agg(F.sum("_o").alias("overlap_ms"), (F.sum(F.col("_o") * F.col("_v")) / F.sum("_o")).alias("_m")).where(F.col("overlap_ms") >= least_ms)
    out = left.join(means, left.columns, "left").withColumnRenamed("_m", value)
    return out.withColumnsRenamed({"l_start": "w_start", "l_end": "w_end"}).withColumn("overlap_ms", F.coalesce("overlap_ms", F.lit(0)))


def forward_fill(column: str, keys: list[str], order: list[str]) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def words_to_turns(words: DataFrame, turns: DataFrame, reach_ms: int = 1000, bucket: int = 60_000) -> DataFrame:
    """words (call_id, word_id, mid_ms), turns (call_id, turn, speaker, start_ms, end_ms) -> words with speaker.

    The shortest turn that holds the word's middle has it, else the nearest one less than reach_ms away, else the
    speaker of the word before.
    """
    w = words.select("call_id", "word_id", F.col("mid_ms").alias("l_start"), F.col("mid_ms").alias("l_end"))
    t = turns.select("call_id", "turn", "speaker", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = interval_join(w, t, ["call_id"], bucket, pad=reach_ms)
    mid = F.col("l_start")
    inside = (mid >= F.col("r_start")) & (mid <= F.col("r_end"))
    away = F.greatest(F.col("r_start") - mid, mid - F.col("r_end"))
    rank = F.when(inside, F.struct(F.lit(0).alias("k"), (F.col("r_end") - F.col("r_start")).alias("d"), "turn")).when(away < reach_ms, F.struct(F.lit(1).alias("k"), away.alias("d"), "turn"))
    best = met.where(rank.isNotNull()).groupBy("call_id", "word_id").agg(F.min_by("speaker", rank).alias("own"))
    joined = words.join(best, ["call_id", "word_id"], "left")
    return joined.withColumn("speaker", forward_fill("own", ["call_id"], ["mid_ms", "word_id"])).drop("own")
