"""Critical events, and the exports that show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, LABELS
from ..operators import events, exports, intervals, joins, narrative, satisfaction, series
from ..sources.tables import written
from . import fixtures
from .registry import query, table
from .satisfaction_queries import TIMELINE, _components
from .series_queries import rounded, rounded_sql

KEYS = ["call_id", "speaker"]


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return satisfaction.timeline(fixtures.cells(spark, sf_dir), KEYS)


def _shown(found: DataFrame) -> DataFrame:
    return found.withColumn("severity", rounded("severity", 4)).withColumn("confidence", rounded("confidence", 4))


@query("ev1_emotion_peaks")
def ev1_emotion_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(events.emotion_peaks(events.indices(fixtures.cells(spark, sf_dir))))


@query("ev2_shifts")
def ev2_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(events.shifts(events.indices(fixtures.cells(spark, sf_dir))))


@query("ev3_timeline_moves")
def ev3_timeline_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = written(fixtures.cells(spark, sf_dir))
    return _shown(events.timeline_moves(satisfaction.timeline(cells, KEYS), events.indices(cells)))


@query("ev4_endings", f"""with {fixtures.CELLS}, {_components('cells', 'call_id, speaker', (0.2, 30, 300), 1.0)}, z as (select call_id, speaker, min(t) as t0, max(t) as t1 from cells group by 1, 2)
select call_id, speaker, greatest(t0, t1 - least(greatest(0.2::double * (t1 - t0), 30), 300)) as t, t1 as t_end, case when final_state > 0 then 'positive_ending' else 'negative_ending' end as type,
  {rounded_sql('least(1.0::double, abs(final_state))', 4)} as severity, {rounded_sql('0.4::double + 0.5::double * least(1.0::double, abs(final_state))', 4)} as confidence
from scored join z using (call_id, speaker) where n >= 5 and abs(final_state) >= 0.2""")
def ev4_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(events.endings(fixtures.cells(spark, sf_dir, texts=False)))


@query("ev5_conflicts")
def ev5_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.turns(spark, sf_dir)
    return _shown(events.conflicts(events.indices(fixtures.cells(spark, sf_dir)), intervals.overlaps(t)))


@query("ev6_critical_events")
def ev6_critical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = written(fixtures.cells(spark, sf_dir))
    found = events.critical_events(cells, written(satisfaction.timeline(cells, KEYS)), intervals.overlaps(fixtures.turns(spark, sf_dir)), fixtures.utterances(spark, sf_dir), stored=True)
    return _shown(found).withColumn("evidence", F.to_json(F.transform("evidence", lambda x: F.struct(x["text"], x["start"], x["end"]))))


_P = ", ".join(f"{rounded_sql(f'p[{i + 1}]', 5)} as {x}" for i, x in enumerate(LABELS))


def _probabilities() -> list[Column]:
    return [rounded(F.col("p")[i], 5).alias(x) for i, x in enumerate(LABELS)]


@query("snk1_csv_export", f"""with recursive {TIMELINE},
pts as (select *, (w_start + w_end) / 2000.0::double as m from emissions),
lo as (select pts.*, k.t as t0, k.score as s0 from pts asof left join line k on pts.call_id = k.call_id and pts.speaker = k.speaker and pts.m >= k.t),
hi as (select lo.*, k.t as t1, k.score as s1 from lo asof left join line k on lo.call_id = k.call_id and lo.speaker = k.speaker and lo.m < k.t)
select call_id, speaker, round(w_start / 1000.0::double, 2) as start, round(w_end / 1000.0::double, 2) as "end", {_P}, {LABELS!r}[list_position(p, conf)] as emotion, {rounded_sql('conf', 4)} as confidence,
  {rounded_sql('case when t0 is null then s1 when t1 is null then s0 else s0 + (s1 - s0) * (m - t0) / (t1 - t0) end', 1)} as satisfaction from hi""")
def snk1_csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per emotion window, with the satisfaction of its middle; sources.tables.write_csv() writes it."""
    e = fixtures.emissions(spark, sf_dir).withColumn("t", (F.col("w_start") + F.col("w_end")) / 2000.0)
    found = joins.asof_interpolate(e, _timeline(spark, sf_dir), KEYS, "t", "score")
    names = F.array(*map(F.lit, LABELS))
    return found.select(
        *KEYS, F.round(F.col("w_start") / 1000.0, 2).alias("start"), F.round(F.col("w_end") / 1000.0, 2).alias("end"), *_probabilities(),
        F.element_at(names, F.array_position("p", F.col("conf")).cast("int")).alias("emotion"), rounded("conf", 4).alias("confidence"), rounded("score", 1).alias("satisfaction"),
    )


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that each call was analysed with: a part stands for one."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("call_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("version"), F.lit("emotion").alias("kind"))
    return parts.where("call_id >= 0")


@query("snk2_json_export")
def snk2_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON document per call: all that is known of it, each list in order."""
    cells = written(fixtures.cells(spark, sf_dir))
    timeline = written(satisfaction.timeline(cells, KEYS))
    t, said = fixtures.turns(spark, sf_dir), fixtures.utterances(spark, sf_dir)
    found = events.critical_events(cells, timeline, intervals.overlaps(t), said, stored=True)
    scored = satisfaction.components(cells, KEYS).join(satisfaction.confidence(cells, KEYS), KEYS).join(satisfaction.initial_and_final(cells, KEYS).drop("delta").withColumnRenamed("trend", "direction"), KEYS, "left").join(satisfaction.speaker_metrics(cells, KEYS).select(*KEYS, "dominant", "frustration", "tension"), KEYS)
    doc = exports.call_documents(fixtures.calls(spark, sf_dir), intervals.talk_time(t), t, said, fixtures.emissions(spark, sf_dir), scored, timeline, found, DEFAULTS,
                                 model=_models(spark, sf_dir), interaction=intervals.interaction(t), confidence=scored.groupBy("call_id").agg(F.round(F.avg("confidence"), 3).alias("speakers")), exported_at="2024-02-01T00:00:00Z")
    return doc.select("call_id", F.size("segments").cast("long").alias("n_segments"), F.size("events").cast("long").alias("n_events"), F.to_json(F.struct(*doc.columns)).alias("document"))


@query("snk3_transcription", """with d as (select conv_id as call_id, turn, role, text from conversations where role in ('user', 'assistant'))
select call_id, turn, case when role = 'user' then 'SPEAKER_00' else 'SPEAKER_01' end as speaker, text, ((turn * 17) % 61) / 100.0::double as confidence from d""")
def snk3_transcription(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.transcription_sheet(fixtures.utterances(spark, sf_dir)).select("call_id", "turn", "speaker", "text", "confidence")


@query("snk3_satisfaction", f"with recursive {TIMELINE} select call_id, speaker, t, round(score + 1e-9::double, 2) as score from line")
def snk3_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.satisfaction_sheet(_timeline(spark, sf_dir))


@query("snk3_events")
def snk3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = written(fixtures.cells(spark, sf_dir))
    found = events.critical_events(cells, written(satisfaction.timeline(cells, KEYS)), intervals.overlaps(fixtures.turns(spark, sf_dir)), stored=True)
    return exports.events_sheet(found)


@query("snk3_sheet_summary", f"""with {fixtures.EMISSIONS}
select call_id, speaker, count(*) as windows, {rounded_sql('avg(conf)', 4)} as confidence, {rounded_sql('avg(p[1])', 4)} as positive from emissions group by 1, 2""")
def snk3_sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.emissions(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("windows"), rounded(F.avg("conf"), 4).alias("confidence"), rounded(F.avg(F.col("p")[0]), 4).alias("positive"))


@query("snk4_report_series", f"""with {fixtures.EMISSIONS}
select call_id, speaker, widx, {rounded_sql('(coalesce(lag(conf) over w, conf) + conf + coalesce(lead(conf) over w, conf)) / 3', 6)} as conf from emissions window w as (partition by call_id, speaker order by widx)""")
def snk4_report_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of three windows; the first and last one count twice at the ends."""
    w = Window.partitionBy(*KEYS).orderBy("widx")
    three = F.coalesce(F.lag("conf").over(w), F.col("conf")) + F.col("conf") + F.coalesce(F.lead("conf").over(w), F.col("conf"))
    return fixtures.emissions(spark, sf_dir).select(*KEYS, "widx", rounded(three / 3, 6).alias("conf"))


@query("sf9_summary")
def sf9_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per speaker: how satisfaction moved and which emotion prevailed."""
    c = fixtures.cells(spark, sf_dir)
    both = satisfaction.initial_and_final(c, KEYS).join(satisfaction.speaker_metrics(c, KEYS), KEYS)
    text = F.format_string("%s: %s, from %.1f to %.1f; mostly %s.", "speaker", "trend", F.coalesce("initial", F.lit(50.0)), F.coalesce("final", F.lit(50.0)), "dominant")
    return both.select(*KEYS, text.alias("summary"))


@query("sf9_executive_summary")
def sf9_executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of each call: its speakers, how satisfaction moved, and its events."""
    c = written(fixtures.cells(spark, sf_dir))
    scores = satisfaction.components(c, KEYS).select(*KEYS, "score").join(satisfaction.confidence(c, KEYS), KEYS)
    moves = satisfaction.initial_and_final(c, KEYS)
    told = scores.join(moves, KEYS).join(satisfaction.speaker_metrics(c, KEYS).select(*KEYS, "initial_emotion", "final_emotion"), KEYS)
    both = series.interaction_satisfaction(told.select(*KEYS, "score", "initial", "final"))
    found = events.critical_events(c, written(satisfaction.timeline(c, KEYS)), intervals.overlaps(fixtures.turns(spark, sf_dir)), stored=True)
    return narrative.executive_summary(told, both.select("call_id", "initial", "final", "variation"), found)
