"""Queries over series of cells, turns and events: smoothing, trends, carry, blocks, calibration, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LABELS
from ..operators import fusion, series, windows
from . import fixtures
from .registry import query, table

KEYS = ["call_id", "speaker"]


def rounded(x: Column | str, digits: int) -> Column:
    """Rounding that two engines agree on: halves are pushed off the border first."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, digits)


def rounded_sql(x: str, digits: int) -> str:
    return f"round({x} + 1e-9::double, {digits})"


@query("wn4_text_on_grid", f"with {fixtures.CELLS} select call_id, speaker, cell, {rounded_sql('text_score', 6)} as text_score, text_frust from cells where text_score is not null")
def wn4_text_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cells(spark, sf_dir).where("text_score is not null").select(*KEYS, "cell", rounded("text_score", 6).alias("text_score"), "text_frust")


def _votes(k: int) -> str:
    parts = ["flag"]
    for j in range(1, k // 2 + 1):
        parts += [f"coalesce(lag(flag, {j}) over w, first_value(flag) over w)", f"coalesce(lead(flag, {j}) over w, last_value(flag) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following))"]
    return f"case when ({' + '.join(parts)}) * 2 > {k} then 1 else 0 end"


@query("wn6_label_smoothing", f"with e as (select *, case when value > 50 then 1 else 0 end as flag from events) select event_id, user_id, {_votes(3)} as s3, {_votes(5)} as s5 from e window w as (partition by user_id order by ts, event_id)")
def wn6_label_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("flag", (F.col("value") > 50).cast("int"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", "user_id", windows.median_smoothing("flag", order, 3).alias("s3"), windows.median_smoothing("flag", order, 5).alias("s5"))


@query("wn7_trailing_slices", f"""with {fixtures.CELLS}, ends as (select call_id, speaker, max(cell) + 1 as d from cells group by all),
steps as (select call_id, speaker, unnest(range(0, ceil((d + 10) / 10.0::double)::bigint)) as k from ends)
select call_id, speaker, k, count(*) as n, {rounded_sql('avg(conf)', 6)} as conf from steps join cells using (call_id, speaker) where t >= k * 10 - 60 and t < k * 10 + 1e-6 group by 1, 2, 3""")
def wn7_trailing_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.cells(spark, sf_dir)
    return series.trailing_slices(c, KEYS, 10, 60).groupBy(*KEYS, "k").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("conf"), 6).alias("conf"))


@query("wn8_ema_with_carry", f"""with recursive {fixtures.TURNS},
r as materialized (select call_id, row_number() over (partition by call_id order by turn) as k, turn, n_words::double as v, turn % 4 <> 0 as ok from turns),
e as (select call_id, k, turn, case when ok then v end as ema from r where k = 1
      union all select r.call_id, r.k, r.turn, case when not r.ok then e.ema when e.ema is null then r.v else 0.35::double * r.v + 0.65::double * e.ema end from e join r on r.call_id = e.call_id and r.k = e.k + 1)
select call_id, turn::double as turn, {rounded_sql('ema', 4)} as ema from e where ema is not null""")
def wn8_ema_with_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.turns(spark, sf_dir).select("call_id", "turn", F.col("n_words").cast("double").alias("v"), (F.col("turn") % 4 != 0).alias("ok"))
    return windows.ema_with_carry(t, ["call_id"], "turn", "v", "ok", 0.35).withColumn("ema", rounded("ema", 4))


_ISLANDS = f"""with {fixtures.CELLS}, g as (select call_id, speaker, cell // 2 as g, max(conf) as v from cells group by 1, 2, 3),
h as (select *, g - row_number() over (partition by call_id, speaker order by g) as run from g where v >= 0.35)"""


@query("wn10_hot_runs", f"{_ISLANDS} select call_id, speaker, min(g) * 2 as first_s, max(g) * 2 as last_s, {rounded_sql('max(v)', 6)} as v from h group by call_id, speaker, run having (max(g) - min(g)) * 2 >= 6")
def wn10_hot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixtures.cells(spark, sf_dir, texts=False).groupBy(*KEYS, F.floor(F.col("cell") / 2).alias("g")).agg(F.max("conf").alias("v"))
    found = series.hot_runs(g.where("v >= 0.35").withColumn("s", F.col("g") * 2), KEYS, "s", "v", 2, 6)
    return found.withColumn("v", rounded("v", 6))


@query("wn13_peaks")
def wn13_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of smoothed confidence by call and speaker: height .3, 45 cells apart, prominence .08."""
    order, whole = Window.partitionBy(*KEYS).orderBy("t"), Window.partitionBy(*KEYS)
    c = fixtures.cells(spark, sf_dir, texts=False).select(*KEYS, "t", windows.smooth("conf", order, whole, 10).alias("x"))
    return series.peaks(c, KEYS, "t", "x", 0.3, 45, 0.08)


@query("wn14_debounce")
def wn14_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.cells(spark, sf_dir, texts=False).where("conf > 0.4").select(*KEYS, "t", "conf")
    return windows.debounce(c, KEYS, "t", "conf", 45.0)


@query("wn15_jumps", f"""with {fixtures.CELLS}, d as (select *, conf - lag(conf) over (partition by call_id, speaker order by t) as d from cells)
select call_id, speaker, count(*) as n, {rounded_sql('coalesce(avg(case when d is not null then (abs(d) > 0.05)::int::double end), 0)', 6)} as jumps, {rounded_sql('stddev_pop(conf)', 6)} as spread from d group by 1, 2""")
def wn15_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.jumps(fixtures.cells(spark, sf_dir, texts=False), KEYS, "t", "conf", 0.05).select(*KEYS, "n", rounded("jumps", 6).alias("jumps"), rounded("spread", 6).alias("spread"))


@query("wn16_trend", f"""with {fixtures.CELLS}, b as (select *, min(t) over w as t0, max(t) over w as t1 from cells window w as (partition by call_id, speaker))
select call_id, speaker, {rounded_sql('case when count(*) >= 6 and max(t1 - t0) + 1 > 20 then regr_slope(conf, (t - t0) / greatest(t1 - t0, 1e-6)) else 0 end', 6)} as slope from b group by 1, 2""")
def wn16_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trend(fixtures.cells(spark, sf_dir, texts=False), KEYS, "t", "conf").withColumn("slope", rounded("slope", 6))


def _argmax_sql(where: str) -> str:
    means = ", ".join(f"avg(p[{i + 1}]) filter ({where})" for i in range(len(LABELS)))
    return f"{LABELS!r}[list_position([{means}], list_max([{means}]))]"


@query("wn17_first_and_last", f"""with {fixtures.CELLS}, b as (select *, row_number() over (partition by call_id, speaker order by t) as i, row_number() over (partition by call_id, speaker order by t desc) as j, count(*) over (partition by call_id, speaker) as n from cells)
select call_id, speaker, {_argmax_sql('i <= 30')} as initial_emotion, {_argmax_sql('j <= greatest(3, least(60, floor(0.2::double * n)))')} as final_emotion from b group by 1, 2""")
def wn17_first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.satisfaction import speaker_metrics

    return speaker_metrics(fixtures.cells(spark, sf_dir, texts=False), KEYS).select(*KEYS, "initial_emotion", "final_emotion")


@query("wn18_blocks")
def wn18_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of about a minute, cut at the longest silence within ten seconds of the aim."""
    return series.plan_blocks(fixtures.turns(spark, sf_dir), 60_000, 10_000)


@query("wn19_sessions", """with o as (select *, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by user_id order by ts, event_id) as gap from events),
s as (select *, sum(case when gap is null or gap > 3600000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from o)
select user_id, session, count(*) as n, epoch_us(min(ts)) // 1000 as start_ms, epoch_us(max(ts)) // 1000 as end_ms from s group by 1, 2""")
def wn19_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    new = F.col("ms") - F.lag("ms").over(order) > 3_600_000
    s = e.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))


@query("wn19_utterances")
def wn19_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all turns, as utterances: a new one with another speaker, 1.2 s of silence, or a full stop after 25 s."""
    t = fixtures.turns(spark, sf_dir)
    words = t.select("call_id", "speaker", "start_ms", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "word"))
    start = F.col("start_ms") + F.col("i") * 400
    return series.utterances(words.select("call_id", "speaker", start.alias("start_ms"), (start + 380).alias("end_ms"), F.concat(F.lit(" "), "word").alias("word")))


@query("wn20_frame_activity", """with f as (select user_id, event_id, epoch_us(ts) // 1000 as ms, (epoch_us(ts) // 1000) // 86400000 as block, value - 100 as db from events),
t as (select user_id, block, greatest(-42::double, quantile_cont(db, 0.1) + 10) as threshold from f group by 1, 2),
a as (select *, db > threshold as active, row_number() over (partition by user_id, block order by ms, event_id) as i from f join t using (user_id, block)),
r as (select *, i - row_number() over (partition by user_id, block, active order by ms, event_id) as run from a)
select user_id, block, min(ms) as start_ms, max(ms) as end_ms, count(*) as frames from r where active group by user_id, block, run having count(*) >= 2""")
def wn20_frame_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("value") - 100).alias("db"))
    return series.active_runs(e.withColumn("block", F.floor(F.col("ms") / 86_400_000)), ["user_id", "block"], -42.0, 10.0, 2)


def _tempered(p: str, t: float) -> str:
    return f"list_transform({p}, lambda x: pow(greatest(x, 1e-12::double), 1 / {t}::double))"


_ARRAY = ", ".join(f"{rounded_sql(f'q[{i + 1}]', 6)} as p_{x}" for i, x in enumerate(LABELS))


def _labelled(p: str) -> list[Column]:
    return [rounded(F.col(p)[i], 6).alias(f"p_{x}") for i, x in enumerate(LABELS)]


@query("mf1_temper", f"with {fixtures.EMISSIONS}, r as (select *, {_tempered('p', 7.5)} as z from emissions), s as (select *, list_transform(z, lambda x: x / list_sum(z)) as q from r) select call_id, widx, {_ARRAY} from s")
def mf1_temper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.emissions(spark, sf_dir).withColumn("q", fusion.temper(F.col("p"), 7.5)).select("call_id", "widx", *_labelled("q"))


_TEXT_P = "[" + ", ".join(f"(1 + (call_id + turn * {k + 2}) % 7)::double" for k in range(len(LABELS))) + "]"


@query("mf2_fuse", f"""with {fixtures.EMISSIONS}, a as (select *, {_TEXT_P} as raw_t from emissions), b as (select *, list_transform(raw_t, lambda x: x / list_sum(raw_t)) as x from a),
c as (select *, list_transform(range(1, 8), lambda i: 0.7::double * p[i] + 0.3::double * x[i]) as q,
  list_sort(list_transform(range(1, 8), lambda i: {{'v': p[i], 'i': i}}), 'DESC') as o from b)
select call_id, widx, {_ARRAY}, {rounded_sql("0.5::double * (case when list_position(p, list_max(p)) = list_position(x, list_max(x)) then 1 else 0 end) + 0.5::double * (x[o[1].i] + x[o[2].i])", 6)} as agreement from c""")
def mf2_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(*((1 + (F.col("call_id") + F.col("turn") * (k + 2)) % 7).cast("double") for k in range(len(LABELS))))
    e = fixtures.emissions(spark, sf_dir).withColumn("x", raw)
    both = e.withColumn("f", fusion.fuse(F.col("p"), F.col("x"), 0.7, 0.3))
    return both.select("call_id", "widx", *_labelled("f.p"), rounded("f.agreement", 6).alias("agreement"))


@query("mf6_cosine", f"""with c as (select label, list(m order by i) as m from (select label, i, avg(x) as m from (select label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by 1, 2) group by 1)
select vec_id, embeddings.label, {rounded_sql("1 - list_inner_product(embedding::double[], m) / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product(m, m)) + 1e-9::double)", 5)} as distance from embeddings join c on embeddings.label = c.label""")
def mf6_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine distance of each vector to the mean of its label."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    each = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return e.join(centre, "label").select("vec_id", "label", rounded(fusion.cosine_distance(F.col("v"), F.col("m")), 5).alias("distance"))


@query("af1_arrays", f"""select vec_id, list_position(embedding, list_max(embedding))::int as argmax, {rounded_sql("list_sum(list_transform(embedding[1:8], lambda x: x::double))", 5)} as head, {rounded_sql("list_inner_product(embedding::double[], list_reverse(embedding)::double[])", 5)} as mirrored from embeddings""")
def af1_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    total = F.aggregate(F.slice(v, 1, 8), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_position(v, F.array_max(v)).cast("int").alias("argmax"), rounded(total, 5).alias("head"), rounded(fusion.dot_arrays(v, F.reverse(v)), 5).alias("mirrored")
    )


_RIGHT = "((call_id + widx) % 3 = 0)::int"


@query("ag18_calibration_error", f"""with {fixtures.EMISSIONS}, b as (select ceil(conf * 10)::bigint as bin, conf, {_RIGHT} as ok from emissions where conf > 0),
g as (select bin, count(*) as n, avg(conf) as c, avg(ok) as a from b group by 1) select {rounded_sql("sum(n / (select count(*) from emissions)::double * abs(a - c))", 6)} as ece from g""")
def ag18_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.emissions(spark, sf_dir).withColumn("ok", ((F.col("call_id") + F.col("widx")) % 3 == 0).cast("int"))
    return fusion.calibration_error(e, "conf", "ok").select(rounded("ece", 6).alias("ece"))


_TRUTH = "(call_id + turn // 3) % 7 + 1"


@query("ag19_temperature", f"""with {fixtures.EMISSIONS}, g as (select 0.5::double + 0.25::double * unnest(range(0, 59)) as temp),
n as (select temp, avg(-ln(greatest(pow(greatest(p[{_TRUTH}], 1e-12), 1 / temp) / list_sum(list_transform(p, lambda x: pow(greatest(x, 1e-12), 1 / temp))), 1e-12))) as nll from emissions, g group by 1)
select temp as temperature, {rounded_sql('nll', 5)} as nll from n order by n.nll, temp limit 1""")
def ag19_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.emissions(spark, sf_dir).withColumn("truth", (F.col("call_id") + F.floor(F.col("turn") / 3)) % 7)
    return fusion.best_temperature(e, "p", "truth", [0.5 + 0.25 * i for i in range(59)]).withColumn("nll", rounded("nll", 5))


@query("ag20_interaction_satisfaction", f"""with {fixtures.TURNS}, s as (select call_id, speaker, avg((50 + (turn * 7 + call_id) % 41)::double) as score, arg_min((50 + (turn * 7 + call_id) % 41)::double, turn) as initial, arg_max((50 + (turn * 7 + call_id) % 41)::double, turn) as final from turns group by 1, 2)
select call_id, {rounded_sql('avg(initial)', 1)} as initial, {rounded_sql('avg(final)', 1)} as final, {rounded_sql('avg(score)', 1)} as score, {rounded_sql('avg(final) - avg(initial)', 1)} as variation,
  case when avg(final) - avg(initial) > 6 then 'improving' when avg(final) - avg(initial) < -6 then 'declining' else 'stable' end as trend from s group by 1 having count(*) = 2""")
def ag20_interaction_satisfaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.turns(spark, sf_dir).withColumn("v", (50 + (F.col("turn") * 7 + F.col("call_id")) % 41).cast("double"))
    s = t.groupBy(*KEYS).agg(F.avg("v").alias("score"), F.min_by("v", "turn").alias("initial"), F.max_by("v", "turn").alias("final"))
    return series.interaction_satisfaction(s).select("call_id", *(rounded(c, 1).alias(c) for c in ("initial", "final", "score", "variation")), "trend")


@query("ag21_analysis_quality", f"""with {fixtures.CELLS}, g as (select call_id, avg(conf) as conf, count(distinct speaker) as speakers, count(*)::double as covered, max(cell) + 1 as d from cells group by 1),
e as (select call_id, avg((conf >= 0.4::double)::int::double) as valid from emissions group by 1),
t as (select call_id, avg(((turn * 17) % 61) / 100.0::double) as heard, 1 - abs(2 * sum(case when speaker = 'SPEAKER_00' then dur_ms end)::double / sum(dur_ms) - 1) as even, avg((dur_ms >= 2000)::int::double) as whole from turns group by 1),
c as (select g.*, 100 * whole as audio, least(greatest(covered / d / 0.4::double, 0), 1) * 100 as speech, 100 * valid as segments, least(greatest((conf - 0.3::double) / 0.5::double, 0), 1) * 100 * case when call_id % 3 = 0 then 0.8::double else 1 end as model,
  100 * coalesce(even, 0) as diarization, 100 * heard as transcription from g join e using (call_id) join t using (call_id)),
q as (select call_id, (0.2::double * audio + 0.1::double * speech + 0.1::double * segments + 0.25::double * model + 0.15::double * transcription + case when speakers > 1 then 0.2::double * diarization else 0 end) / (0.8::double + case when speakers > 1 then 0.2::double else 0 end) as q from c)
select call_id, {rounded_sql("q", 3)} as quality, q < 60 as low from q""")
def ag21_analysis_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of a call's analysis from all six parts: turns of two seconds at least, speech, windows with a clear emotion,
    the model's confidence (calls of another language, every third one, count less), evenly shared talk, words' confidence."""
    g = fixtures.cells(spark, sf_dir).groupBy("call_id").agg(F.avg("conf").alias("conf"), F.count_distinct("speaker").alias("speakers"), F.count(F.lit(1)).alias("covered"), (F.max("cell") + 1).alias("duration"))
    e = fixtures.emissions(spark, sf_dir).groupBy("call_id").agg(F.avg((F.col("conf") >= 0.4).cast("double")).alias("valid"))
    first = F.sum(F.when(F.col("speaker") == "SPEAKER_00", F.col("dur_ms"))) / F.sum("dur_ms")
    t = fixtures.turns(spark, sf_dir).groupBy("call_id").agg(F.avg(((F.col("turn") * 17) % 61) / 100).alias("heard"), (1 - F.abs(2 * first - 1)).alias("even"), F.avg((F.col("dur_ms") >= 2000).cast("double")).alias("whole"))
    c = g.join(e, "call_id").join(t, "call_id")
    quality, low = series.analysis_quality(
        audio=100 * F.col("whole"), speech_ratio=F.col("covered") / F.col("duration"), valid_windows=F.col("valid"), model_confidence=F.col("conf"),
        diarization=F.when(F.col("speakers") > 1, 100 * F.coalesce("even", F.lit(0.0))), word_confidence=F.col("heard"), mismatch=F.col("call_id") % 3 == 0,
    )
    return c.select("call_id", rounded(quality, 3).alias("quality"), low.alias("low"))


@query("ag22_events_by_type", "select event_type, count(*) as n from events group by 1 order by n desc, event_type limit 4")
def ag22_events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(4)


_SUGGESTED = ", ".join(f"avg(p[{i + 1}])" for i in range(len(LABELS)))


@query("ag26_suggestion", f"""with {fixtures.EMISSIONS}, m as (select t.call_id, t.turn, [{_SUGGESTED}] as p from turns t join emissions e on e.call_id = t.call_id and e.speaker = t.speaker and e.w_end > t.start_ms and e.w_start < t.end_ms group by 1, 2)
select call_id, turn, {LABELS!r}[list_position(p, list_max(p))] as label from m""")
def ag26_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.intervals import interval_join

    t = fixtures.turns(spark, sf_dir).select(*KEYS, "turn", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    e = fixtures.emissions(spark, sf_dir).select(*KEYS, "p", F.col("w_start").alias("r_start"), F.col("w_end").alias("r_end"))
    met = interval_join(t, e, KEYS, 60_000).where("r_end > l_start and r_start < l_end")
    mean = met.groupBy("call_id", "turn").agg(F.array(*(F.avg(F.col("p")[i]) for i in range(len(LABELS)))).alias("p"))
    names = F.array(*map(F.lit, LABELS))
    return mean.select("call_id", "turn", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("label"))
