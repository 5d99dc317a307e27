"""Deterministic views over the test tables that stand in for analysed calls, for Spark and (as CTEs) for DuckDB.

Times are whole milliseconds, so both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LABELS
from ..operators.grid import cells_of
from ..operators.windows import plan_windows
from .registry import table


#: Turns that a task takes. Windows and seconds are made in the stage that reads the shuffled turns, and weigh up to some
#: hundred times as much; adaptive execution sees the turns only and would leave a few tasks with all of them.
TURNS_A_TASK = 4_000


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, turn, speaker, text, n_words, start_ms, end_ms, dur_ms; a call in one partition, their number by the rows."""
    rows = table(spark, sf_dir, "conversations")
    spoken = rows.where("role in ('user', 'assistant')").select(
        F.col("conv_id").alias("call_id"),
        "turn",
        F.when(F.col("role") == "user", "SPEAKER_00").otherwise("SPEAKER_01").alias("speaker"),
        "text",
        F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("n_words"),
    )
    spoken = spoken.withColumn("dur_ms", 400 * F.col("n_words")).withColumn("gap_ms", ((F.col("call_id") * 7 + F.col("turn") * 13) % 14 - 2) * 400)
    spoken = spoken.repartition(rows.count() // TURNS_A_TASK + 1, "call_id")
    so_far = F.sum(F.col("dur_ms") + F.col("gap_ms")).over(Window.partitionBy("call_id").orderBy("turn"))
    spoken = spoken.withColumn("start_ms", F.greatest(F.lit(0).cast("long"), so_far - F.col("dur_ms")))
    return spoken.withColumn("end_ms", F.col("start_ms") + F.col("dur_ms")).drop("gap_ms")


TURNS = r"""
turns as (
  select *, start_ms + dur_ms as end_ms from (
    select call_id, turn, speaker, text, n_words, dur_ms,
           greatest(0, (sum(dur_ms + gap_ms) over (partition by call_id order by turn))::bigint - dur_ms) as start_ms
    from (select conv_id as call_id, turn, case when role = 'user' then 'SPEAKER_00' else 'SPEAKER_01' end as speaker, text,
                 len(regexp_split_to_array(trim(text), '\s+'))::bigint as n_words,
                 400 * len(regexp_split_to_array(trim(text), '\s+'))::bigint as dur_ms,
                 ((conv_id * 7 + turn * 13) % 14 - 2) * 400 as gap_ms
          from conversations where role in ('user', 'assistant'))))"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, turn, speaker, widx, w_start, w_end: analysis windows of each turn."""
    return plan_windows(turns(spark, sf_dir), 5000, 2500, 1000)


WINDOWS = TURNS + r""",
windows as (
  select call_id, turn, speaker, (row_number() over (partition by call_id order by turn, w_start, w_end) - 1)::bigint as widx, w_start, w_end from (
    select call_id, turn, speaker, start_ms as w_start, end_ms as w_end from turns where dur_ms between 1000 and 5000
    union all
    select call_id, turn, speaker, start_ms + i * 2500, start_ms + i * 2500 + 5000
    from (select *, unnest(range(0, (dur_ms - 5000) // 2500 + 1)) as i from turns where dur_ms > 5000)
    union all
    select call_id, turn, speaker, end_ms - 5000, end_ms from turns where dur_ms > 5000 and (dur_ms - 5000) % 2500 >= 1000))"""


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """windows with p: probabilities of the labels in order, and conf, the largest."""
    found = windows(spark, sf_dir)
    idx = F.when(F.col("speaker") == "SPEAKER_00", 0).otherwise(1)
    favourite = (F.col("call_id") + F.floor(F.col("turn") / 3) + 3 * idx) % len(LABELS)
    raw = [1 + (F.col("call_id") * 31 + F.col("turn") * 17 + F.col("widx") * 5 + k * k * 13) % 23 + F.when(favourite == k, 60).otherwise(0) for k in range(len(LABELS))]
    found = found.withColumn("raw", F.array(*(r.cast("double") for r in raw)))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    found = found.withColumn("total", total).withColumn("p", F.transform("raw", lambda x: x / F.col("total")))
    return found.withColumn("conf", F.array_max("p")).drop("raw", "total")


_RAW = ", ".join(f"(1 + (call_id * 31 + turn * 17 + widx * 5 + {k * k * 13}) % 23 + case when (call_id + turn // 3 + 3 * (case when speaker = 'SPEAKER_00' then 0 else 1 end)) % 7 = {k} then 60 else 0 end)::double" for k in range(len(LABELS)))
EMISSIONS = WINDOWS + f""",
raws as (select *, [{_RAW}] as raw from windows),
emissions as (select call_id, turn, speaker, widx, w_start, w_end, list_transform(raw, lambda x: x / list_sum(raw)) as p, list_max(raw) / list_sum(raw) as conf from raws)"""


def tension_of_windows(emitted: DataFrame) -> DataFrame:
    """emissions with a bounded tension and agreement of audio and text, from 0 to 1, null for one window in five and four."""
    value, agreement = ((F.col("call_id") * a + F.col("widx") * b) % 101 / 100.0 for a, b in ((13, 7), (19, 11)))
    return emitted.withColumn("tension", F.when(F.col("widx") % 5 != 0, value)).withColumn("agreement", F.when(F.col("widx") % 4 != 0, agreement))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a text score from -1 to 1, its confidence and frustration, bounded integers in hundredths."""
    t = turns(spark, sf_dir)
    score = ((F.col("call_id") * 11 + F.col("turn") * 29) % 201 - 100) / 100.0
    return t.withColumn("text_score", score).withColumn("text_conf", ((F.col("turn") * 17) % 61) / 100.0).withColumn("text_frust", ((F.col("call_id") + F.col("turn") * 37) % 101) / 100.0)


def cells(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """One row per call, speaker and covered second: t, p, conf, tension, agreement, text_score, text_frust; the last two
    null without texts, for queries that don't ask for them."""
    return cells_of(tension_of_windows(emissions(spark, sf_dir)), utterances(spark, sf_dir) if texts else None)


_MEANS = ", ".join(f"avg(p[{k + 1}])" for k in range(len(LABELS)))
CELLS = EMISSIONS + f""",
tense as (select *, case when widx % 5 <> 0 then ((call_id * 13 + widx * 7) % 101) / 100.0::double end as tension,
          case when widx % 4 <> 0 then ((call_id * 19 + widx * 11) % 101) / 100.0::double end as agreement from emissions),
covered as (select *, unnest(range(w_start // 1000, greatest(w_start // 1000 + 1, (w_end + 999) // 1000))) as cell from tense),
means as (select call_id, speaker, cell, [{_MEANS}] as p, avg(conf) as conf, avg(tension) as tension, avg(agreement) as agreement from covered group by all),
said as (select call_id, speaker, turn, start_ms, ((call_id * 11 + turn * 29) % 201 - 100) / 100.0::double as text_score, ((turn * 17) % 61) / 100.0::double as text_conf,
                ((call_id + turn * 37) % 101) / 100.0::double as text_frust,
                unnest(range(start_ms // 1000, greatest(start_ms // 1000 + 1, (end_ms + 999) // 1000))) as cell from turns),
texts as (select call_id, speaker, cell, arg_max(text_score * least(1.0, 0.4 + text_conf), start_ms * 100000 + turn) as text_score, arg_max(text_frust, start_ms * 100000 + turn) as text_frust
          from said group by all),
cells as (select means.*, cell + 0.5::double as t, text_score, text_frust from means left join texts using (call_id, speaker, cell))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: call_id, org_id, status, created_at, duration_s, allow_training, language."""
    per = turns(spark, sf_dir).groupBy("call_id").agg((F.max("end_ms") / 1000.0).alias("duration_s"))
    status = F.element_at(F.array(*map(F.lit, ["COMPLETED", "COMPLETED", "COMPLETED", "PROCESSING", "ERROR"])), (F.col("call_id") % 5 + 1).cast("int"))
    return per.select(
        "call_id",
        (F.col("call_id") % 3).alias("org_id"),
        status.alias("status"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("call_id") * 3600000000).alias("created_at"),
        "duration_s",
        (F.col("call_id") % 4 != 0).alias("allow_training"),
        F.element_at(F.array(*map(F.lit, ["es", "en", "es-MX"])), (F.col("call_id") % 3 + 1).cast("int")).alias("language"),
    )


CALLS = TURNS + """,
calls as (select call_id, call_id % 3 as org_id, ['COMPLETED', 'COMPLETED', 'COMPLETED', 'PROCESSING', 'ERROR'][call_id % 5 + 1] as status,
                 timestamp '2024-01-01' + to_hours(call_id::int) as created_at, max(end_ms) / 1000.0::double as duration_s, call_id % 4 <> 0 as allow_training,
                 ['es', 'en', 'es-MX'][call_id % 3 + 1] as language
          from turns group by call_id)"""
