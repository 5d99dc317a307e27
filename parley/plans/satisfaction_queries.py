"""Queries of the satisfaction engine over the fixture cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FRUSTRATION, LABELS, TENSION, VALENCE
from ..operators import satisfaction as engine
from ..operators import windows
from . import fixtures
from .registry import query

KEYS = ["call_id", "speaker"]


def _dot(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"p[{i + 1}] * {weights[x]}::double" for i, x in enumerate(LABELS) if weights.get(x)) + ")"


def _components(source: str, keys: str, final: tuple[float, float, float], trend: float) -> str:
    return f"""v0 as (select *, {_dot(VALENCE)} as v, (1 + 0.5::double * (1 - p[2])) * (0.5::double + 0.5::double * conf) as a, row_number() over (partition by {keys} order by t) as i, count(*) over (partition by {keys}) as n,
       min(t) over (partition by {keys}) as t0, max(t) over (partition by {keys}) as t1 from {source}),
v1 as (select *, avg(v) over (partition by {keys} order by t rows between 15 preceding and 14 following) as wide, list(v) over (partition by {keys} order by t rows between unbounded preceding and unbounded following) as everything from v0),
v2 as (select * exclude (wide, everything), case when n >= 30 then wide else list_avg(everything[greatest(1, i - n // 2):least(n, i + n - 1 - n // 2)]) end as vs, v - lag(v) over (partition by {keys} order by t) as d from v1),
v3 as (select *, case when vs > 0.25 then 1 when vs < -0.25 then -1 else 0 end as sign, t >= t1 - least(greatest({final[0]}::double * (t1 - t0 + 1), {final[1]}), {final[2]}) as late, (t - t0) / greatest(t1 - t0, 1e-6) as tn from v2),
v4 as (select *, i - row_number() over (partition by {keys}, sign order by t) as run from v3),
v5 as (select *, count(*) over (partition by {keys}, sign, run) as length from v4),
g as (select {keys}, count(*) as n, sum(a * v) / sum(a) as signal,
  case when count(*) filter (late) >= 3 then sum(a * v) filter (late) / sum(a) filter (late) else sum(a * v) filter (i > n - 10) / sum(a) filter (i > n - 10) end as final_state,
  least(greatest(1.5::double * case when count(*) >= 6 and max(t1 - t0 + 1) > 20 then regr_slope(vs, tn) else 0.0 end, -1), 1) * {trend}::double as trend,
  least(greatest(1.5::double * (count(*) filter (sign = 1 and length >= 10) - count(*) filter (sign = -1 and length >= 10)) / count(*), -1), 1) as persistence,
  least(greatest(1 - stddev_pop(vs) / 0.5 - coalesce(avg(case when abs(d) > 0.5 then 1.0::double when d is not null then 0.0::double end), 0), 0), 1) as B,
  case when count(text_score) >= 3 then least(greatest(1.5::double * avg(text_score), -1), 1) end as text, case when count(tension) >= 3 then least(greatest(-2 * (avg(tension) - 0.5::double), -1), 1) end as prosody
  from v5 group by {keys}),
h as (select *, (2 * B - 1) * (0.5::double + 0.5::double * least(greatest(2 * signal, -1), 1)) as stability from g),
scored as (select *, least(greatest(50 + 50 * least(greatest(1.6::double * (signal + 1.2::double * final_state + trend + persistence + 0.3::double * stability + coalesce(0.4::double * text, 0) + coalesce(0.25::double * prosody, 0))
  / (4.5::double + case when text is null then 0 else 0.4::double end + case when prosody is null then 0 else 0.25::double end), -1), 1), 0), 100) as score from h)"""


@query("se_components", f"with {fixtures.CELLS}, {_components('cells', 'call_id, speaker', (0.2, 30, 300), 1.0)} select call_id, speaker, n, {', '.join(f'round({c} + 1e-9::double, 6) as {c}' for c in [*engine.COMPONENTS, 'B'])}, round(score, 3) as score from scored where n >= 3")
def se_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.components(fixtures.cells(spark, sf_dir), KEYS).where("n >= 3")
    return found.select(*KEYS, "n", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in [*engine.COMPONENTS, "B"]), F.round("score", 3).alias("score"))


def at_least_one(found: DataFrame) -> DataFrame:
    """Contributions of one point at least. A point in exact numbers comes out as 1 - 2e-15 or 1 + 1e-15 by the order of the
    sums; it counts as one in any order."""
    return found.where("abs(points) >= 1 - 1e-9D")


@query("se8_contributions", f"""with {fixtures.CELLS}, {_components('cells', 'call_id, speaker', (0.2, 30, 300), 1.0)},
w as (select *, 4.5::double + case when text is null then 0 else 0.4::double end + case when prosody is null then 0 else 0.25::double end as bottom from scored),
e as ({' union all '.join(f"select call_id, speaker, '{c}' as component, {c} as value, 50 * 1.6::double * {x}::double * {c} / bottom as points from w" for c, x in (('signal', 1.0), ('final_state', 1.2), ('trend', 1.0), ('persistence', 1.0), ('stability', 0.3), ('text', 0.4), ('prosody', 0.25)))})
select call_id, speaker, component, round(value + 1e-9::double, 4) as value, round(points + 1e-9::double, 2) as points from e where value is not null and abs(points) >= 1""")
def se8_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = at_least_one(engine.contributions(engine.components(fixtures.cells(spark, sf_dir), KEYS)))
    return found.withColumn("value", F.round(F.col("value") + 1e-9, 4)).withColumn("points", F.round(F.col("points") + 1e-9, 2))


TIMELINE = f"""{fixtures.CELLS},
sliced as (select cells.*, unnest(range(ceil((t - 1e-6) / 10)::bigint, floor((t + 60) / 10)::bigint + 1)) as k from cells),
{_components('sliced', 'call_id, speaker, k', (0.4, 5, 60), 0.5)},
ends as (select call_id, speaker, max(cell) + 1.0::double as duration from cells group by all),
steps as (select call_id, speaker, duration, unnest(range(0, ceil((duration + 10) / 10)::bigint)) as k from ends),
r as materialized (select steps.*, coalesce(n, 0) >= 3 as ok, score from steps left join scored using (call_id, speaker, k)),
ema as (select call_id, speaker, duration, k, case when ok then score end as ema from r where k = 0
        union all select r.call_id, r.speaker, r.duration, r.k, case when not r.ok then ema.ema when ema.ema is null then r.score else 0.35::double * r.score + (1 - 0.35::double) * ema.ema end
        from ema join r on r.call_id = ema.call_id and r.speaker = ema.speaker and r.k = ema.k + 1),
line as (select call_id, speaker, least(k * 10.0::double, duration) as t, ema as score from ema where ema is not null)"""


@query("se9_timeline", f"with recursive {TIMELINE} select call_id, speaker, t, round(score + 1e-9::double, 2) as score from line")
def se9_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.timeline(fixtures.cells(spark, sf_dir), KEYS).withColumn("score", F.round(F.col("score") + 1e-9, 2))


@query("se10_initial_final")
def se10_initial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.initial_and_final(fixtures.cells(spark, sf_dir), KEYS)
    return found.select(*KEYS, *(F.round(c, 2).alias(c) for c in ("initial", "final", "delta")), "trend")


@query("se11_confidence", f"""with {fixtures.CELLS}, g as (select call_id, speaker, count(*)::double as s, least(greatest((avg(conf) - 0.3::double) / 0.5::double, 0), 1) as m, count(text_score) / count(*)::double as x, case when count(agreement) > 0 then least(greatest(avg(agreement), 0), 1) else 0.5::double end as ag from cells group by all)
select call_id, speaker, round(least(greatest(0.35::double * m + 0.25::double * (case when s < 20 then 0.2::double * s / 20 else 0.4::double + 0.6::double * least(1.0::double, (s - 20) / 160) end) + 0.15::double * 0.7::double + 0.1::double * x + 0.15::double * ag, 0), 1) + 1e-9::double, 3) as confidence from g""")
def se11_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.confidence(fixtures.cells(spark, sf_dir), KEYS)


@query("se11_mismatch", f"""with {fixtures.CELLS}, g as (select call_id, speaker, count(*)::double as s, least(greatest((avg(conf) - 0.3::double) / 0.5::double, 0), 1) as m, count(text_score) / count(*)::double as x,
  case when count(agreement) > 0 then least(greatest(avg(agreement), 0), 1) else 0.5::double end as ag, count(agreement) / count(*)::double as cover from cells group by all)
select call_id, speaker, round(least(greatest((0.35::double * m + 0.25::double * (case when s < 20 then 0.2::double * s / 20 else 0.4::double + 0.6::double * least(1.0::double, (s - 20) / 160) end) + 0.15::double * 0.4::double + 0.1::double * x + 0.15::double * ag) * case when cover >= 0.5 then 0.85::double else 0.6::double end, 0), 1) + 1e-9::double, 3) as confidence from g""")
def se11_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.confidence(fixtures.cells(spark, sf_dir), KEYS, audio_quality=40.0, mismatch=True)


#: A stand-in for a model's prediction, so that both engines can tell what a mode makes of it.
_MODEL = "((call_id * 37) % 131) - 10"


@query("se12_calibrated", f"with {fixtures.CELLS}, {_components('cells', 'call_id, speaker', (0.2, 30, 300), 1.0)} select call_id, speaker, round(least(greatest(1.1::double * score - 3, 0), 100), 3) as score from scored")
def se12_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.components(fixtures.cells(spark, sf_dir), KEYS)
    return found.select(*KEYS, F.round(engine.final_score(calibration={"enabled": True, "a": 1.1, "b": -3.0}), 3).alias("score"))


@query("se12_modes", f"""with {fixtures.CELLS}, {_components('cells', 'call_id, speaker', (0.2, 30, 300), 1.0)}, m as (select *, case when call_id % 5 <> 0 then least(greatest(({_MODEL})::double, 0), 100) end as model from scored)
select call_id, speaker, round(score + 1e-9::double, 3) as rules, round(coalesce(model, score) + 1e-9::double, 3) as model, round(coalesce(0.3::double * model + 0.7::double * score, score) + 1e-9::double, 3) as hybrid,
  round(least(greatest(0.9::double * coalesce(0.5::double * model + 0.5::double * score, score) + 8, 0), 100) + 1e-9::double, 3) as calibrated from m""")
def se12_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.components(fixtures.cells(spark, sf_dir), KEYS)
    model = F.when(F.col("call_id") % 5 != 0, F.expr(_MODEL).cast("double"))
    modes = {"rules": engine.final_score(), "model": engine.final_score("model", model), "hybrid": engine.final_score("hybrid", model, 0.3), "calibrated": engine.final_score("hybrid", model, calibration={"enabled": True, "a": 0.9, "b": 8.0})}
    return found.select(*KEYS, *(F.round(x + 1e-9, 3).alias(name) for name, x in modes.items()))


_FRUST = f"((least(greatest({_dot(FRUSTRATION)}, 0), 1) + coalesce(0.35::double * least(greatest(2 * (tension - 0.5::double), 0), 1), 0) + coalesce(0.5::double * text_frust, 0)) / (1.0::double + case when tension is null then 0 else 0.35::double end + case when text_frust is null then 0 else 0.5::double end))"
_TENSE = f"((least(greatest({_dot(TENSION)}, 0), 1) + coalesce(0.35::double * tension, 0)) / (1.0::double + case when tension is null then 0 else 0.35::double end))"


@query("se14_indices", f"with {fixtures.CELLS} select call_id, speaker, cell, round({_FRUST}, 6) as frustration, round({_TENSE}, 6) as tension from cells")
def se14_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cells(spark, sf_dir).select(*KEYS, "cell", F.round(engine.frustration_index(), 6).alias("frustration"), F.round(engine.tension_index(), 6).alias("tension"))


def _means(where: str) -> str:
    return "[" + ", ".join(f"avg(p[{i + 1}]) {where}" for i in range(len(LABELS))) + "]"


_METRICS = ["frustration", "tension", "positive", "negative", "stability", "text_coverage", "agreement", "model_confidence"]


@query("se13_speaker_metrics", f"""with {fixtures.CELLS}, {_components('cells', 'call_id, speaker', (0.2, 30, 300), 1.0)},
o as (select *, row_number() over (partition by call_id, speaker order by t) as i, row_number() over (partition by call_id, speaker order by t desc) as j, count(*) over (partition by call_id, speaker) as n from cells),
e as (select call_id, speaker, {_means('')} as m, {_means('filter (i <= 30)')} as a, {_means('filter (j <= greatest(3, least(60, floor(0.2::double * n))))')} as z, avg({_FRUST}) as frustration, avg({_TENSE}) as tension,
  avg(p[1]) as positive, avg(p[3] + p[4] + p[5] + p[6]) as negative, count(*) as analyzed_s, count(agreement) / count(*)::double as text_coverage, avg(agreement) as agreement, avg(conf) as model_confidence from o group by 1, 2)
select call_id, speaker, {', '.join(f'{LABELS}[list_position({x}, list_max({x}))] as {name}' for x, name in (('m', 'dominant'), ('a', 'initial_emotion'), ('z', 'final_emotion')))}, analyzed_s, round(list_max(m) + 1e-9::double, 4) as most_probable,
  {', '.join(f'round({"B" if c == "stability" else c} + 1e-9::double, 4) as {c}' for c in _METRICS)} from e join (select call_id, speaker, B from scored) using (call_id, speaker)""")
def se13_speaker_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.speaker_metrics(fixtures.cells(spark, sf_dir), KEYS)
    return found.select(*KEYS, "dominant", "initial_emotion", "final_emotion", "analyzed_s", F.round(F.array_max("mean_probabilities") + 1e-9, 4).alias("most_probable"), *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in _METRICS))


def _feature_sql() -> str:
    p = [f"p[{LABELS.index(x) + 1}]" for x in engine.FEATURE_LABELS]
    first, last = "filter (i <= third)", "filter (i > n - third)"
    values = [f"avg({x})" for x in p] + [f"avg({x}) {first}" for x in p] + [f"avg({x}) {last}" for x in p] + [f"avg({x}) {last} - avg({x}) {first}" for x in p]
    values += [f"max({c})" for c in ("signal", "final_state", "trend", "persistence", "stability")]
    values += ["coalesce(avg(o.text_score), 0)", "coalesce(avg(o.tension), 0.5::double)", f"avg({_FRUST})", f"avg({_TENSE})", f"max({_FRUST})", "ln(1 + count(*)::double)"]
    return ", ".join(f"round({v} + 1e-9::double, 5) as f{i:02d}" for i, v in enumerate(values))


@query("se15_call_features", f"""with {fixtures.CELLS}, {_components('cells', 'call_id, speaker', (0.2, 30, 300), 1.0)},
o as (select *, greatest(1, n // 3) as third from (select *, row_number() over (partition by call_id, speaker order by t) as i, count(*) over (partition by call_id, speaker) as n from cells))
select call_id, speaker, {_feature_sql()} from o join (select call_id, speaker, signal, final_state, trend, persistence, stability from scored) using (call_id, speaker) group by 1, 2""")
def se15_call_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.call_features(fixtures.cells(spark, sf_dir), KEYS)
    return found.select(*KEYS, *(F.round(F.col("features")[i] + 1e-9, 5).alias(f"f{i:02d}") for i in range(39)))


@query("wn3_grid", f"with {fixtures.CELLS} select call_id, speaker, cell, {', '.join(f'round(p[{i + 1}], 6) as p_{x}' for i, x in enumerate(LABELS))}, round(conf, 6) as conf, round(tension, 6) as tension, round(agreement, 6) as agreement, round(text_score, 6) as text_score, text_frust from cells")
def wn3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.cells(spark, sf_dir)
    return c.select(*KEYS, "cell", *(F.round(F.col("p")[i], 6).alias(f"p_{x}") for i, x in enumerate(LABELS)), *(F.round(x, 6).alias(x) for x in ("conf", "tension", "agreement", "text_score")), "text_frust")


@query("wn5_smoothing", f"with {fixtures.CELLS} select call_id, speaker, cell, round(avg(tension) over (partition by call_id, speaker order by t rows between 1 preceding and 1 following), 6) as s3, round(avg(tension) over (partition by call_id, speaker order by t rows between 5 preceding and 4 following), 6) as s10 from cells qualify count(*) over (partition by call_id, speaker) >= 10")
def wn5_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, whole = Window.partitionBy(*KEYS).orderBy("t"), Window.partitionBy(*KEYS)
    c = fixtures.cells(spark, sf_dir, texts=False).withColumn("n", F.count(F.lit(1)).over(whole))
    s3, s10 = (F.round(windows.smooth("tension", order, whole, k), 6) for k in (3, 10))
    return c.select(*KEYS, "cell", "n", s3.alias("s3"), s10.alias("s10")).where("n >= 10").drop("n")


@query("wn9_runs", f"""with {fixtures.CELLS}, m as (select *, conf > 0.4 as hot, row_number() over (partition by call_id, speaker order by t) as i from cells), r as (select *, i - row_number() over (partition by call_id, speaker, hot order by t) as run from m)
select call_id, speaker, min(cell) as first, count(*) as length from r where hot group by call_id, speaker, run having count(*) >= 5""")
def wn9_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = windows.runs(fixtures.cells(spark, sf_dir, texts=False).withColumn("hot", F.col("conf") > 0.4), KEYS, "t", "hot").where("hot")
    return c.groupBy(*KEYS, "_run").agg(F.min("cell").alias("first"), F.count(F.lit(1)).alias("length")).where("length >= 5").drop("_run")


@query("wn11_mean_shift", f"""with {fixtures.CELLS} select call_id, speaker, cell, round(case when count(*) over a = 15 and count(*) over b = 15 then avg(conf) over a - avg(conf) over b else 0 end, 6) as shift from cells
window a as (partition by call_id, speaker order by t rows between current row and 14 following), b as (partition by call_id, speaker order by t rows between 15 preceding and 1 preceding)""")
def wn11_mean_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.cells(spark, sf_dir, texts=False).select(*KEYS, "cell", F.round(windows.mean_shift("conf", Window.partitionBy(*KEYS).orderBy("t"), 15), 6).alias("shift"))


@query("ag2_mean_probabilities", f"with {fixtures.CELLS} select label, round(avg(x), 6) as mean, count(*) as n from (select unnest({LABELS}) as label, unnest(p) as x from cells) group by 1")
def ag2_mean_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = fixtures.cells(spark, sf_dir, texts=False).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, LABELS)), "p")).alias("label", "x"))
    return each.groupBy("label").agg(F.round(F.avg("x"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
