"""Resampling of overlapping windows and texts onto a one-second grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LABELS


def cell_range(start_ms: Column, end_ms: Column) -> Column:
    """Numbers of the seconds from start to end, one at least."""
    first = F.floor(start_ms / 1000)
    return F.sequence(first, F.greatest(first + 1, F.ceil(end_ms / 1000)) - 1)


def cells_of(windows: DataFrame, utterances: DataFrame | None = None) -> DataFrame:
    """windows (call_id, speaker, w_start, w_end, p, conf, tension, agreement), utterances (call_id, speaker, turn, start_ms, end_ms,
    text_score, text_conf, text_frust) -> one row per call, speaker and covered second.

    p and conf are means over covering windows, tension and agreement (of audio and text) over those that have one. Text values are those of the last
    utterance to start, null without utterances; seconds that no window covers are left out.
    """
    probabilities = [F.col("p")[k].alias(f"p{k}") for k in range(len(LABELS))]
    covered = windows.select("call_id", "speaker", F.explode(cell_range(F.col("w_start"), F.col("w_end"))).alias("cell"), *probabilities, "conf", "tension", "agreement", F.lit(True).alias("covered"))
    means = [F.array(*(F.avg(f"p{k}") for k in range(len(LABELS)))).alias("p"), *(F.avg(c).alias(c) for c in ("conf", "tension", "agreement"))]
    t, keys = F.col("cell") + 0.5, ["call_id", "speaker", "cell"]
    if utterances is None:
        return covered.groupBy(*keys).agg(*means).withColumns({"text_score": F.lit(None).cast("double"), "text_frust": F.lit(None).cast("double"), "t": t})
    # The order of utterances as one number, as sums of structs are sorted for.
    latest = F.col("start_ms") * 100_000 + F.coalesce("turn", F.lit(0))
    said = utterances.select(
        "call_id", "speaker", F.explode(cell_range(F.col("start_ms"), F.col("end_ms"))).alias("cell"), (F.col("text_score") * F.least(F.lit(1.0), 0.4 + F.col("text_conf"))).alias("text_score"), "text_frust", latest.alias("latest")
    )
    # Both meet in one sum and not in a join: where they are dealt by calls already, no second is shuffled.
    both = covered.unionByName(said, allowMissingColumns=True).groupBy(*keys)
    found = both.agg(*means, *(F.max_by(c, "latest").alias(c) for c in ("text_score", "text_frust")), F.max("covered").alias("covered"))
    return found.where("covered").drop("covered").withColumn("t", t)
