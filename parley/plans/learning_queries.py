"""Queries of data sets, models, audio, plug-ins and streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plugins
from ..config import LABELS
from ..functions import text as tf
from ..operators import learning, series
from ..streaming import live
from . import fixtures
from .registry import query, table
from .series_queries import rounded, rounded_sql

SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.group_stratified_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", SHARES)


@query("ds2_group_split")
def ds2_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir)


@query("ds3_leaks", "select 0::bigint as leaking_groups, count(distinct o_custkey) as \"groups\" from orders")
def ds3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _split(spark, sf_dir).groupBy("o_custkey").agg(F.count_distinct("split").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("leaking_groups"), F.count(F.lit(1)).alias("groups"))


@query("ml1_boosted_trees")
def ml1_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten boosted trees of depth 3 on lineitem, three folds by order: the metrics of rows that were left out."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_orderkey")
    _, metrics = learning.train_regressor(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "l_orderkey", "boosted", folds=3, iterations=10)
    return spark.createDataFrame([tuple(metrics[c] for c in ("mae", "rmse", "r2", "pearson", "n", "cv"))], "mae double, rmse double, r2 double, pearson double, n long, cv string")


@query("ml1_ridge_folds")
def ml1_ridge_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.ridge_by_folds(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "l_orderkey")


@query("ml2_linear_calibration", f"""with p as (select l_extendedprice as real, 1500 * l_quantity as predicted from lineitem),
g as (select count(*) as n, least(greatest(regr_slope(real, predicted), 0.2), 3) as a, avg(real) as r, avg(predicted) as p, avg(abs(real - predicted)) as m from p)
select n, {rounded_sql('a', 6)} as a, {rounded_sql('r - a * p', 3)} as b, {rounded_sql('m', 3)} as mae_before from g""")
def ml2_linear_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("real"), (1500 * F.col("l_quantity")).alias("predicted"))
    return learning.linear_calibration(pairs, "real", "predicted").select("n", rounded("a", 6).alias("a"), rounded("b", 3).alias("b"), rounded("mae_before", 3).alias("mae_before"))


@query("ml3_two_voices")
def ml3_two_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.two_voices(table(spark, sf_dir, "embeddings"), "embedding")


@query("ag23_separation", f"""with v as (select label, embedding, sqrt(list_inner_product(embedding::double[], embedding::double[])) as length from embeddings where label in (0, 1)),
u as (select label, pos, sum(embedding[pos]::double / length) as s, avg(embedding[pos]::double) as c from v, range(1, 65) as r(pos) group by all),
n as (select label, count(*)::double as n from v group by 1),
g as (select sum(case when a.label = 0 and b.label = 1 then a.c * b.c end) as cc, sum(case when a.label = 0 and b.label = 0 then a.c * a.c end) as c0, sum(case when a.label = 1 and b.label = 1 then a.c * a.c end) as c1,
  sum(case when a.label = 0 and b.label = 1 then a.s * b.s end) as s01, sum(case when a.label = 0 and b.label = 0 then a.s * a.s end) as s0, sum(case when a.label = 1 and b.label = 1 then a.s * a.s end) as s1 from u a join u b using (pos)),
m as (select g.*, x.n as n0, y.n as n1 from g, n x, n y where x.label = 0 and y.label = 1)
select (n0 + n1)::bigint as n, {rounded_sql('cc / (sqrt(c0 * c1) + 1e-9)', 5)} as similarity, {rounded_sql('((s0 - n0) / (n0 * (n0 - 1)) + (s1 - n1) / (n1 * (n1 - 1))) / 2 - s01 / (n0 * n1)', 5)} as gap, {rounded_sql('least(n0, n1) / (n0 + n1)', 5)} as minor_share from m""")
def ag23_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The separation of two given clusters: labels 0 and 1 of the embeddings."""
    rows = table(spark, sf_dir, "embeddings").where("label in (0, 1)").select(F.col("label").alias("cluster"), "embedding")
    found = learning.separation(rows, "embedding", "cluster")
    return found.select("n", *(rounded(c, 5).alias(c) for c in ("similarity", "gap", "minor_share")))


@query("jn15_reconcile")
def jn15_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty vectors are a call's chunks."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("call_id"), "vec_id", "embedding")
    return series.reconcile(v, ["call_id"], "vec_id", "embedding")


@query("au2_audio_quality", f"""with g as (select user_id, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) as snr, avg((value > 150)::int::double) as clipping, -avg(value) as level, avg((value > 20)::int::double) as speech, 8000.0::double + 1000 * (user_id % 9) as rate from events group by 1)
select user_id, {rounded_sql('''100 * (0.35::double * least(greatest((snr - 10) / 20, 0), 1) + 0.15::double * (1 - least(greatest(clipping / 0.05::double, 0), 1)) + 0.15::double * (case when level between -30 and -12 then 1.0::double
  else least(greatest(1 - least(abs(level + 30), abs(level + 12)) / 25, 0), 1) end) + 0.2::double * least(greatest(speech / 0.45::double, 0), 1) + 0.15::double * least(greatest((rate - 8000) / 8000, 0), 1))''', 4)} as quality from g""")
def au2_audio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An events user stands for a recording, values for levels."""
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.9)))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(
        (p[1] - p[0]).alias("snr"), F.avg((F.col("value") > 150).cast("double")).alias("clipping"), (-F.avg("value")).alias("level"), F.avg((F.col("value") > 20).cast("double")).alias("speech")
    )
    rate = 8000.0 + 1000 * (F.col("user_id") % 9)
    return g.select("user_id", rounded(learning.audio_quality(F.col("snr"), F.col("clipping"), F.col("level"), F.col("speech"), rate), 4).alias("quality"))


@query("au5_sample_validation", """select doc_id, sha1(coalesce(text, '')) as fingerprint, case when text is null then 'corrupt' when length(text) < 40 then 'too_short' when length(text) > 20000 then 'too_long' else 'ok' end as verdict from documents""")
def au5_sample_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    verdict = F.when(F.col("text").isNull(), "corrupt").when(n < 40, "too_short").when(n > 20000, "too_long").otherwise("ok")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("fingerprint"), verdict.alias("verdict"))


@query("ud1_model_plugin")
def ud1_model_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An emotion model as an iterator UDF: it is loaded once a worker; the stand-in takes softmax over text features."""

    @F.pandas_udf("array<double>")
    def model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.random.default_rng(11).normal(size=(26, len(LABELS)))
        for texts in batches:
            counts = np.array([[t.count(chr(97 + c)) for c in range(26)] for t in texts.fillna("").str.lower()], float).reshape(-1, 26)
            logits = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) @ weights
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            yield pd.Series(list(e / e.sum(axis=1, keepdims=True)))

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(model("text"), lambda x: F.round(x, 6)).alias("p"))


@query("ud1_spans_table_function")
def ud1_spans_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by a table function: one row in, its spans out."""

    @F.udtf(returnType="entity: string, start: int, end: int")
    class Spans:
        def eval(self, text: str):
            yield from tf.pii_spans(text or "")

    spark.udtf.register("pii_spans", Spans)
    return spark.sql("select conv_id, turn, entity, start, end from {t}, lateral pii_spans(text)", t=table(spark, sf_dir, "conversations"))


@query("ud1_plugins")
def ud1_plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What plug-ins that are registered by name make of every turn: the label of its text and its personal data."""
    turns = table(spark, sf_dir, "conversations").withColumn("clean", tf.norm(F.col("text")))
    labels = plugins.apply(turns, "text_analyzer", "lexicon", ["clean"], ["conv_id", "turn"], "label string", lambda plug, row: [(plug.analyze(row[0])[4],)])
    found = plugins.apply(turns, "pii_detector", "rules", ["text"], ["conv_id", "turn"], "entity string", lambda plug, row: [(e,) for e, _, _ in plug.spans(row[0] or "")])
    entities = found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_entities"))
    return labels.join(entities, ["conv_id", "turn"], "left").na.fill({"n_entities": 0})


@query("ud1_grouped_aggregate", f"select event_type, {rounded_sql('sqrt(avg(value * value))', 4)} as rms from events group by 1")
def ud1_grouped_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square by built-in aggregates; a grouped UDF would bring a whole group to one task."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(rounded(F.sqrt(F.avg(F.col("value") * F.col("value"))), 4).alias("rms"))


@query("ud2_custom_labels", "select event_id, case event_type when 'purchase' then 1.0::double when 'error' then -1.0::double else 0.0::double end as weight from events")
def ud2_custom_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = F.create_map(F.lit("purchase"), F.lit(1.0), F.lit("error"), F.lit(-1.0))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(weights, F.col("event_type")), F.lit(0.0)).alias("weight"))


@query("dm6_config_merge", "select event_id, coalesce(json_extract_string(props, '$.k')::int, 7) as k, 5 as hop from events")
def dm6_config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of an event over defaults, as maps: a key that the override lacks keeps its default."""
    default = F.create_map(F.lit("k"), F.lit(7), F.lit("hop"), F.lit(5))
    own = F.coalesce(F.from_json("props", "map<string,int>"), F.create_map().cast("map<string,int>"))
    merged = F.map_zip_with(default, own, lambda k, a, b: F.coalesce(b, a))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(merged, "k").alias("k"), F.element_at(merged, "hop").alias("hop"))


@query("dm1_stage_rebuild", f"with {fixtures.TURNS} select call_id, turn, case when call_id % 2 = 0 then 2 else 1 end as run from turns")
def dm1_stage_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a second run replace their rows of the first one, as sources.tables.replace_partitions() does in a table."""
    first = fixtures.turns(spark, sf_dir).select("call_id", "turn", F.lit(1).alias("run"))
    again = first.where("call_id % 2 = 0").withColumn("run", F.lit(2))
    return first.join(again.select("call_id").distinct(), "call_id", "left_anti").unionByName(again)


@query("sx1_stage_batches", "select event_type, count(*) as n from events group by 1")
def sx1_stage_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that runs batch by batch over a stream of files and may run again."""
    rows = live.into_table(spark, live.read_events(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type"), "stage")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sx5_windows", f"select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, {rounded_sql('sum(value)', 3)} as value from events group by 1, 2")
def sx5_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = live.with_open(spark, live.windows(live.read_events(spark, f"{sf_dir}/events.parquet")), "windows", live.open_windows)
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded("value", 3).alias("value"))


@query("sx5_sessions", """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '1 hour' then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as number from e)
select user_id, min(ts) as start, max(ts) + interval '1 hour' as "end", count(*) as n from s group by user_id, number""")
def sx5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions, those that are open when the files end too."""
    found = live.with_open(spark, live.sessions(live.read_events(spark, f"{sf_dir}/events.parquet")), "sessions", live.open_sessions)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("sx5_running_mean")
def sx5_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = live.into_table(spark, live.running_mean(live.read_events(spark, f"{sf_dir}/events.parquet")), "ema", "update")
    return found.groupBy("user_id").agg(F.max_by("n", "batch").alias("n"), F.round(F.max_by("ema", "batch"), 4).alias("ema"))


@query("sx3_progress")
def sx3_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events stand for reports on a stage: their time in minutes, their value for the progress."""
    reports = live.read_events(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("call_id"), F.col("event_type").alias("stage"), (F.unix_micros("ts") / 60e6).alias("at"), F.col("value").cast("double").alias("pct"))
    return live.into_table(spark, live.throttled_progress(reports), "progress").drop("batch")
