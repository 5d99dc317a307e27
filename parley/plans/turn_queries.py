"""Queries over turns and windows: intervals, joins in time, talk time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, joins, windows
from . import fixtures
from .registry import query


@query("flagship_interaction", f"""with {fixtures.TURNS},
o as (select a.call_id, least(a.end_ms, b.end_ms) - b.start_ms as ov from turns a join turns b on a.call_id = b.call_id and a.speaker <> b.speaker
      and (b.start_ms, b.end_ms, b.turn) > (a.start_ms, a.end_ms, a.turn) and b.start_ms < a.end_ms),
os as (select call_id, count(*) as "overlaps", sum(ov) as overlap_ms from o where ov >= 300 group by 1),
r as (select call_id, start_ms, end_ms, max(end_ms) over (partition by call_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reached from turns),
g as (select call_id, start_ms - reached as gap from r where start_ms > reached),
gs as (select call_id, count(*) filter (gap >= 4000) as long_silences, count(*) filter (gap >= 1000 and gap < 4000) as pauses, sum(gap) as silence_ms, max(gap) as longest_silence_ms from g group by 1),
b as (select call_id, count(*) as turns, max(end_ms) as duration_ms from turns group by 1)
select call_id, turns, duration_ms, coalesce("overlaps", 0)::bigint as "overlaps", coalesce(overlap_ms, 0)::bigint as overlap_ms, coalesce(long_silences, 0)::bigint as long_silences,
       coalesce(pauses, 0)::bigint as pauses, coalesce(silence_ms, 0)::bigint as silence_ms, coalesce(longest_silence_ms, 0)::bigint as longest_silence_ms
from b left join os using (call_id) left join gs using (call_id)""")
def flagship_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.interaction(fixtures.turns(spark, sf_dir))


@query("jn2_overlaps", f"""with {fixtures.TURNS}
select a.call_id, a.turn as turn_a, a.speaker as speaker_a, b.turn as turn_b, b.speaker as speaker_b, b.start_ms as at_ms, least(a.end_ms, b.end_ms) - b.start_ms as overlap_ms
from turns a join turns b on a.call_id = b.call_id and a.speaker <> b.speaker and (b.start_ms, b.end_ms, b.turn) > (a.start_ms, a.end_ms, a.turn) and b.start_ms < a.end_ms
where least(a.end_ms, b.end_ms) - b.start_ms >= 300""")
def jn2_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps(fixtures.turns(spark, sf_dir))


@query("jn3_mark_overlaps", f"""with {fixtures.TURNS}
select call_id, turn, exists (select 1 from turns b where b.call_id = a.call_id and b.speaker <> a.speaker and b.start_ms < a.end_ms and a.start_ms < b.end_ms
       and least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) >= 1) as overlap from turns a""")
def jn3_mark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.mark_overlaps(fixtures.turns(spark, sf_dir)).select("call_id", "turn", "overlap")


_WORDS = f"""{fixtures.TURNS},
words as (select call_id, turn * 1000 + i as word_id, start_ms + i * 400 + 200 + ((call_id + i * 7) % 5 - 2) * 300 as mid_ms from (select *, unnest(range(0, n_words)) as i from turns))"""


def _words(t: DataFrame) -> DataFrame:
    each = t.where("n_words > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_words") - 1)))
    return each.select("call_id", (F.col("turn") * 1000 + F.col("i")).alias("word_id"), (F.col("start_ms") + F.col("i") * 400 + 200 + ((F.col("call_id") + F.col("i") * 7) % 5 - 2) * 300).alias("mid_ms"))


@query("jn4_words_to_turns", f"""with {_WORDS},
m as (select w.call_id, w.word_id, w.mid_ms, t.speaker, case when w.mid_ms between t.start_ms and t.end_ms then 0 else 1 end as k,
             case when w.mid_ms between t.start_ms and t.end_ms then t.end_ms - t.start_ms else greatest(t.start_ms - w.mid_ms, w.mid_ms - t.end_ms) end as d, t.turn
      from words w join turns t on w.call_id = t.call_id and w.mid_ms > t.start_ms - 1000 and w.mid_ms < t.end_ms + 1000),
b as (select call_id, word_id, arg_min(speaker, (k, d, turn)) as own from m group by 1, 2)
select call_id, word_id, mid_ms, last_value(own ignore nulls) over (partition by call_id order by mid_ms, word_id rows between unbounded preceding and current row) as speaker
from words left join b using (call_id, word_id)""")
def jn4_words_to_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.turns(spark, sf_dir)
    return joins.words_to_turns(_words(t), t).select("call_id", "word_id", "mid_ms", "speaker")


@query("jn5_containment", f"""with {fixtures.WINDOWS}
select w.call_id, w.widx, arg_min(t.turn, (t.start_ms, t.turn)) as turn from windows w left join turns t
on w.call_id = t.call_id and w.speaker = t.speaker and (w.w_start + w.w_end) // 2 between t.start_ms - 300 and t.end_ms + 300 group by 1, 2""")
def jn5_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fixtures.windows(spark, sf_dir).select("call_id", "speaker", "widx", F.floor((F.col("w_start") + F.col("w_end")) / 2).alias("l_start"))
    t = fixtures.turns(spark, sf_dir).select("call_id", "speaker", "turn", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    met = intervals.interval_join(w.withColumn("l_end", F.col("l_start")), t, ["call_id", "speaker"], 60_000, "left", pad=300)
    return met.groupBy("call_id", "widx").agg(F.min_by("turn", F.struct("r_start", "turn")).alias("turn"))


_KNOTS = "knots as (select call_id, speaker, start_ms / 1000.0::double as t, (50 + (turn * 7 + call_id) % 41)::double as score from turns)"


def _knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.turns(spark, sf_dir).select("call_id", "speaker", (F.col("start_ms") / 1000.0).alias("t"), (50 + (F.col("turn") * 7 + F.col("call_id")) % 41).cast("double").alias("score"))


@query("jn6_asof_interpolation", f"""with {fixtures.WINDOWS}, {_KNOTS},
p as (select call_id, speaker, widx, (w_start + w_end) / 2000.0::double as t from windows),
lo as (select p.*, k.t as t0, k.score as s0 from p asof left join knots k on p.call_id = k.call_id and p.speaker = k.speaker and p.t >= k.t),
hi as (select lo.*, k.t as t1, k.score as s1 from lo asof left join knots k on lo.call_id = k.call_id and lo.speaker = k.speaker and lo.t < k.t)
select call_id, speaker, widx, t, round(case when t0 is null then s1 when t1 is null then s0 else s0 + (s1 - s0) * (t - t0) / (t1 - t0) end, 4) as score from hi""")
def jn6_asof_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.windows(spark, sf_dir).select("call_id", "speaker", "widx", ((F.col("w_start") + F.col("w_end")) / 2000.0).alias("t"))
    found = joins.asof_interpolate(points, _knots(spark, sf_dir), ["call_id", "speaker"], "t", "score")
    return found.select("call_id", "speaker", "widx", "t", F.round("score", 4).alias("score"))


@query("jn7_nearest_cell", f"""with {fixtures.CELLS},
p as (select call_id, turn, (start_ms + end_ms) / 2000.0::double as t from turns),
m as (select p.call_id, p.turn, arg_min(c.conf, (abs(c.t - p.t), c.t, c.speaker)) as conf from p join (select call_id, min(speaker) as speaker, t, arg_min(conf, speaker) as conf from cells group by call_id, t) c using (call_id) group by 1, 2)
select call_id, turn, round(conf, 6) as conf from m""")
def jn7_nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fixtures.turns(spark, sf_dir).select("call_id", "turn", ((F.col("start_ms") + F.col("end_ms")) / 2000.0).alias("t"))
    series = fixtures.cells(spark, sf_dir).groupBy("call_id", "t").agg(F.min_by("conf", "speaker").alias("conf"))
    return joins.nearest(points, series, ["call_id"], "t", "conf").select("call_id", "turn", F.round("conf", 6).alias("conf"))


@query("jn8_overlap_weighted", f"""with {fixtures.WINDOWS},
said as (select call_id, speaker, start_ms, end_ms, ((call_id * 11 + turn * 29) % 201 - 100) / 100.0::double as text_score from turns),
m as (select w.call_id, w.widx, greatest(0, least(w.w_end, s.end_ms) - greatest(w.w_start, s.start_ms)) as o, s.text_score from windows w join said s
      on w.call_id = s.call_id and w.speaker = s.speaker and s.end_ms >= w.w_start and s.start_ms <= w.w_end),
g as (select call_id, widx, sum(o)::bigint as overlap_ms, sum(o * text_score) / sum(o) as s from m group by 1, 2 having sum(o) >= 250)
select call_id, widx, coalesce(overlap_ms, 0)::bigint as overlap_ms, round(s, 6) as text_score from windows left join g using (call_id, widx)""")
def jn8_overlap_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.overlap_weighted(fixtures.windows(spark, sf_dir).select("call_id", "speaker", "widx", "w_start", "w_end"), fixtures.utterances(spark, sf_dir), ["call_id", "speaker"], "text_score")
    return found.select("call_id", "widx", "overlap_ms", F.round("text_score", 6).alias("text_score"))


@query("jn9_evidence", f"""with {fixtures.TURNS},
said as (select *, ((call_id * 11 + turn * 29) % 201 - 100) / 100.0::double as text_score from turns),
peaks as (select call_id, turn as peak, start_ms + 500 as t from turns where turn % 3 = 0),
m as (select p.call_id, p.peak, s.turn, abs(s.text_score) as relevance, substr(s.text, 1, 180) as text,
             row_number() over (partition by p.call_id, p.peak order by abs(s.text_score) desc, s.turn) as rank
      from peaks p join said s on p.call_id = s.call_id and (p.t between s.start_ms and s.end_ms or abs((s.start_ms + s.end_ms) - 2 * p.t) <= 40000))
select call_id, peak, rank, turn, relevance, text from m where rank <= 2 and relevance > 0.05""")
def jn9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = fixtures.utterances(spark, sf_dir)
    peaks = said.where("turn % 3 = 0").select("call_id", F.col("turn").alias("peak"), (F.col("start_ms") + 500).alias("l_start"), (F.col("start_ms") + 500).alias("l_end"))
    s = said.select("call_id", "turn", F.abs("text_score").alias("relevance"), F.substring("text", 1, 180).alias("text"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    near = F.col("l_start").between(F.col("r_start"), F.col("r_end")) | (F.abs(F.col("r_start") + F.col("r_end") - 2 * F.col("l_start")) <= 40000)
    met = intervals.interval_join(peaks, s, ["call_id"], 60_000, pad=20_000, condition=near)
    rank = F.row_number().over(Window.partitionBy("call_id", "peak").orderBy(F.desc("relevance"), "turn"))
    return met.withColumn("rank", rank.cast("long")).where("rank <= 2 and relevance > 0.05").select("call_id", "peak", "rank", "turn", "relevance", "text")


@query("jn10_turn_vad", f"""with {fixtures.TURNS},
vad as (select call_id, turn as v, start_ms + 300 as s, end_ms - 200 as e from turns where dur_ms > 500)
select t.call_id, t.turn, v.v, greatest(t.start_ms, v.s) as start_ms, least(t.end_ms, v.e) as end_ms from turns t join vad v on t.call_id = v.call_id and v.s <= t.end_ms and v.e >= t.start_ms
where least(t.end_ms, v.e) - greatest(t.start_ms, v.s) > 100""")
def jn10_turn_vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.turns(spark, sf_dir)
    a = t.select("call_id", "turn", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    v = t.where("dur_ms > 500").select("call_id", F.col("turn").alias("v"), (F.col("start_ms") + 300).alias("r_start"), (F.col("end_ms") - 200).alias("r_end"))
    both = intervals.interval_join(a, v, ["call_id"], 60_000)
    return both.select("call_id", "turn", "v", F.greatest("l_start", "r_start").alias("start_ms"), F.least("l_end", "r_end").alias("end_ms")).where("end_ms - start_ms > 100")


def _merged_sql(keys: str, gap: int, least: int) -> str:
    return f"""select {keys}, min(start_ms) as start_ms, max(end_ms) as end_ms from (
  select *, sum(n) over (partition by {keys} order by start_ms, end_ms rows unbounded preceding) as g from (
    select *, case when reached is null or start_ms - reached > {gap} then 1 else 0 end as n from (
      select *, max(end_ms) over (partition by {keys} order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reached from turns)))
group by {keys}, g having max(end_ms) - min(start_ms) >= {least}"""


@query("iv1_merge_segments", f"with {fixtures.TURNS} {_merged_sql('call_id', 300, 500)}")
def iv1_merge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(fixtures.turns(spark, sf_dir), ["call_id"], 300, 500)


@query("iv2_merge_turns", f"with {fixtures.TURNS} {_merged_sql('call_id, speaker', 800, 600)}")
def iv2_merge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(fixtures.turns(spark, sf_dir), ["call_id", "speaker"], 800, 600)


@query("iv3_silences", f"""with {fixtures.TURNS}, b as ({_merged_sql('call_id', 0, 0)}),
g as (select call_id, end_ms as start_ms, lead(start_ms) over (partition by call_id order by start_ms) as end_ms from b)
select call_id, start_ms, end_ms, end_ms - start_ms as gap_ms, case when end_ms - start_ms >= 4000 then 'long_silence' when end_ms - start_ms >= 1000 then 'pause' else 'gap' end as kind from g where end_ms is not null""")
def iv3_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.gaps(fixtures.turns(spark, sf_dir).select("call_id", "start_ms", "end_ms"), ["call_id"])
    return found.withColumn("kind", F.when(F.col("gap_ms") >= 4000, "long_silence").when(F.col("gap_ms") >= 1000, "pause").otherwise("gap"))


@query("iv4_speech_ratio", f"""with {fixtures.TURNS}, b as ({_merged_sql('call_id', 0, 0)}), d as (select call_id, max(end_ms) as d from turns group by 1)
select call_id, round(sum(end_ms - start_ms) / greatest(max(d), 1)::double, 6) as speech_ratio from b join d using (call_id) group by 1""")
def iv4_speech_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.turns(spark, sf_dir)
    busy = intervals.merge_intervals(t, ["call_id"], 0).groupBy("call_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("busy"))
    return busy.join(t.groupBy("call_id").agg(F.max("end_ms").alias("d")), "call_id").select("call_id", F.round(F.col("busy") / F.greatest(F.col("d"), F.lit(1)), 6).alias("speech_ratio"))


@query("iv5_reduce_to_two", """with e as (select date_trunc('hour', ts) as hour, user_id, event_id, epoch_ms(ts) as start_ms, epoch_ms(ts) + 1000 as end_ms from events),
p as (select hour, user_id, sum(end_ms - start_ms) as talk, min(start_ms) as first from e group by 1, 2),
r as (select *, row_number() over (partition by hour order by talk desc, user_id) as rank, talk / (sum(talk) over (partition by hour))::double as share from p),
n as (select hour, count(*) filter (share >= 0.05) as n_speakers from r group by 1),
m as (select hour, user_id, 'P' || row_number() over (partition by hour order by first, user_id) as label from r where rank = 1 or (rank = 2 and share >= 0.05)),
k as (select e.*, m.label as own from e left join m using (hour, user_id)),
f as (select *, coalesce(own, last_value(own ignore nulls) over (partition by hour order by start_ms, event_id rows between unbounded preceding and current row),
  first_value(own ignore nulls) over (partition by hour order by start_ms, event_id rows between current row and unbounded following)) as label from k)
select event_id, label, n_speakers from f join n using (hour)""")
def iv5_reduce_to_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    t = e.select(F.date_trunc("hour", "ts").alias("call_id"), F.col("user_id").alias("speaker"), F.col("event_id").alias("turn"), ms.alias("start_ms"), (ms + 1000).alias("end_ms"))
    return intervals.reduce_to_two(t).select(F.col("turn").alias("event_id"), "label", "n_speakers")


@query("iv6_diarization_quality", f"""with {fixtures.TURNS},
s as (select *, case when speaker <> lag(speaker) over (partition by call_id order by start_ms, turn) then 1 else 0 end as switch from turns),
g as (select call_id, count(distinct speaker) as n, count(*) as turns, sum(switch)::bigint as switches, sum(dur_ms) as talk, max(end_ms) as d from s group by 1)
select call_id, switches, round(100 * (0.5 * 0.8 + 0.3 * least(1.0::double, talk / greatest(d, 1)::double) + 0.2 * least(1.0::double, switches / greatest(turns - 1, 1)::double)) * (case when n < 2 then 0.5 else 1 end), 4)::double as quality from g""")
def iv6_diarization_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half separation (0.8 here), three tenths assigned speech, two tenths plausible switching; half of it with one speaker."""
    t = fixtures.turns(spark, sf_dir)
    switch = (F.col("speaker") != F.lag("speaker").over(Window.partitionBy("call_id").orderBy("start_ms", "turn"))).cast("int")
    g = t.withColumn("switch", F.coalesce(switch, F.lit(0))).groupBy("call_id").agg(
        F.count_distinct("speaker").alias("n"), F.count(F.lit(1)).alias("turns"), F.sum("switch").alias("switches"), F.sum("dur_ms").alias("talk"), F.max("end_ms").alias("d")
    )
    one = F.lit(1.0)
    q = 0.5 * F.lit(0.8) + 0.3 * F.least(one, F.col("talk") / F.greatest("d", F.lit(1))) + 0.2 * F.least(one, F.col("switches") / F.greatest(F.col("turns") - 1, F.lit(1)))
    return g.select("call_id", "switches", F.round(100 * q * F.when(F.col("n") < 2, 0.5).otherwise(1.0), 4).alias("quality"))


@query("iv7_channel_quality", f"""with {fixtures.TURNS},
o as (select a.call_id, sum(least(a.end_ms, b.end_ms) - b.start_ms) as ov from turns a join turns b on a.call_id = b.call_id and a.speaker <> b.speaker
      and (b.start_ms, b.end_ms, b.turn) > (a.start_ms, a.end_ms, a.turn) and b.start_ms < a.end_ms where least(a.end_ms, b.end_ms) - b.start_ms >= 1 group by 1),
p as (select call_id, speaker, sum(dur_ms) as talk from turns group by 1, 2), l as (select call_id, min(talk) as l from p group by 1)
select call_id, round(greatest(0.0::double, least(100.0::double, 96 - 40 * coalesce(ov, 0) / greatest(1, l)::double)), 4) as quality from l left join o using (call_id)""")
def iv7_channel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.turns(spark, sf_dir)
    shared = intervals.overlaps(t, 1).groupBy("call_id").agg(F.sum("overlap_ms").alias("ov"))
    least = t.groupBy("call_id", "speaker").agg(F.sum("dur_ms").alias("talk")).groupBy("call_id").agg(F.min("talk").alias("l"))
    ratio = F.coalesce("ov", F.lit(0)) / F.greatest(F.lit(1), F.col("l"))
    return least.join(shared, "call_id", "left").select("call_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 96 - 40 * ratio)), 4).alias("quality"))


@query("iv8_has_speech", f"""with {fixtures.TURNS}, b as (select call_id, unnest(range(0, max(end_ms) // 30000 + 1)) as block from turns group by call_id)
select call_id, block from b where exists (select 1 from turns t where t.call_id = b.call_id and t.start_ms < (block + 1) * 30000 and t.end_ms > block * 30000)""")
def iv8_has_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.turns(spark, sf_dir).where("dur_ms > 0")
    return t.select("call_id", F.explode(F.sequence(F.floor(F.col("start_ms") / 30000), F.floor((F.col("end_ms") - 1) / 30000))).alias("block")).distinct()


@query("ag6_talk_time", f"""with {fixtures.TURNS}, g as (select call_id, speaker, count(*) as turns, sum(dur_ms) as talk_ms, sum(n_words)::bigint as words from turns group by 1, 2)
select call_id, speaker, turns, round(talk_ms / 1000.0::double, 2) as talk_s, round(talk_ms / (sum(talk_ms) over (partition by call_id))::double, 4) as ratio, words,
       case when talk_ms > 0 then round(60000.0::double * words / talk_ms, 1) end as wpm from g""")
def ag6_talk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.talk_time(fixtures.turns(spark, sf_dir))


@query("ag7_weighted_confidence", f"""with {fixtures.TURNS} select call_id, round(sum(c * greatest(dur_ms / 1000.0::double, 0.1)) / sum(greatest(dur_ms / 1000.0::double, 0.1)), 6) as confidence
from (select *, ((turn * 17) % 61) / 100.0::double as c from turns) group by 1""")
def ag7_weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.greatest(F.col("dur_ms") / 1000.0, F.lit(0.1))
    return fixtures.utterances(spark, sf_dir).groupBy("call_id").agg(F.round(F.sum(F.col("text_conf") * weight) / F.sum(weight), 6).alias("confidence"))


@query("ag8_longest_turn", f"with {fixtures.TURNS} select call_id, arg_max(turn, n_words * 100000 - turn) as turn, max(n_words) as n_words from turns group by 1")
def ag8_longest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.turns(spark, sf_dir).groupBy("call_id").agg(F.max_by("turn", F.struct(F.col("n_words"), -F.col("turn"))).alias("turn"), F.max("n_words").alias("n_words"))


@query("ag29_transcript_totals", f"""with {fixtures.TURNS} select call_id, sum(n_words)::bigint as words, count(*) as utterances, sum(n_words) < 5 as too_few, round(sum(dur_ms) / 1000.0::double, 2) as talk_s from turns group by 1""")
def ag29_transcript_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.turns(spark, sf_dir).groupBy("call_id").agg(F.sum("n_words").alias("words"), F.count(F.lit(1)).alias("utterances"), (F.sum("n_words") < 5).alias("too_few"), F.round(F.sum("dur_ms") / 1000.0, 2).alias("talk_s"))


@query("flt2_interval_overlap", f"with {fixtures.TURNS} select call_id, turn, start_ms, end_ms from turns where end_ms >= 10000 and start_ms <= 25000")
def flt2_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.turns(spark, sf_dir).where("end_ms >= 10000 and start_ms <= 25000").select("call_id", "turn", "start_ms", "end_ms")


@query("wn1_plan_windows", f"with {fixtures.WINDOWS} select * from windows")
def wn1_plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.windows(spark, sf_dir)


@query("wn2_embedding_windows", f"""with {fixtures.TURNS} select call_id, turn, start_ms + i * 1500 as e_start, least(start_ms + i * 1500 + 3000, end_ms) as e_end
from (select *, unnest(range(0, (dur_ms - 1500) // 1500 + 1)) as i from turns where dur_ms >= 1500)""")
def wn2_embedding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.plan_embedding_windows(fixtures.turns(spark, sf_dir), 3000, 1500, 1500)


@query("flt4_short_windows", f"with {fixtures.WINDOWS} select call_id, widx from windows where (w_end - w_start) * 16 >= 4000 and (call_id + widx) % 7 <> 0")
def flt4_short_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window stays with 4000 samples at 16 kHz and a level above the floor (here: one in seven is silent)."""
    return fixtures.windows(spark, sf_dir).where("(w_end - w_start) * 16 >= 4000 and (call_id + widx) % 7 <> 0").select("call_id", "widx")
