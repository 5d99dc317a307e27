"""Queries of sources and sinks (uploads, manifests, sealed files, byte ranges, cached results), of names and levels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import levels
from ..sources import manifest, store
from ..sources.tables import write_csv
from ..streaming.live import shared_folder
from .registry import query, table
from .series_queries import rounded, rounded_sql


@query("src3_upload_ingest", """select doc_id, case when n = 0 then 'extension' when n > 3 then 'too_large' when length(coalesce(text, '')) = 0 then 'empty' when n = 3 then 'too_long' end as error,
  sha256(coalesce(text, '')) as file_hash from (select *, doc_id % 5 as n from documents)""")
def src3_upload_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a file: its number decides on name, size and duration."""
    n = F.col("doc_id") % 5
    name = F.concat(F.lit("call "), F.col("doc_id").cast("string"), F.when(n == 0, ".txt").otherwise(".WAV"))
    size = F.when(n > 3, F.lit(5 << 30)).otherwise(F.length(F.coalesce("text", F.lit(""))).cast("long"))
    seconds = F.when(n == 3, 50_000.0).otherwise(60.0)
    return table(spark, sf_dir, "documents").select("doc_id", store.upload_error(name, size, seconds).alias("error"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"))


@query("src4_manifest_rows", """with m as (select case when o_orderkey % 11 = 0 then 'audio is outside of the folder' when o_orderkey % 7 = 0 then 'emotion is not known' when o_totalprice > 400000 then 'satisfaction is no number from 0 to 100'
  when o_orderkey % 13 = 0 then 'time is not readable' when o_orderkey % 17 = 0 then 'end is not after start' end as error, 60 * (o_orderkey % 50) + 7 as s from orders)
select error, count(*) as n, sum(s)::double as seconds from m group by error""")
def src4_manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a CSV manifest and read again: rows and seconds by error."""
    k = F.col("o_orderkey")
    start = F.format_string("%02d:07", (k % 50).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.when(k % 11 == 0, "../").otherwise("audio/"), k.cast("string"), F.lit(".wav")).alias("audio"), F.col("o_custkey").cast("string").alias("speaker"),
        F.when(k % 7 == 0, "bored").otherwise(" Happy ").alias("emotion"), (F.col("o_totalprice") / 4000).cast("string").alias("satisfaction"),
        start.alias("start"), F.when(k % 13 == 0, "soon").when(k % 17 == 0, "3").otherwise("2:00:00").alias("end"), F.lit('es, "mx"').alias("language"),
    )
    path = shared_folder(spark, f"manifest-{uuid.uuid4().hex}")
    write_csv(rows, path)
    return manifest.read_manifest(spark, path).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum("start_s").alias("seconds"))


@query("snk6_stage_cache", """select doc_id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'second ' || doc_id else 'first ' || doc_id end as value from documents where doc_id is not null""")
def snk6_stage_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a stage are put, some of them again, some files are purged; all are asked for."""
    path = shared_folder(spark, f"cache-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    keys = docs.select("doc_id", (F.col("doc_id") % 2).alias("org_id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("file_hash"), F.lit("emotion").alias("stage"), store.config_hash(F.lit("v1"), F.lit(5.0)).alias("config_hash"))
    store.cache_put(keys.withColumn("value", F.concat(F.lit("first "), F.col("doc_id").cast("string"))), path)
    store.cache_put(keys.where("doc_id % 3 = 1").withColumn("value", F.concat(F.lit("second "), F.col("doc_id").cast("string"))), path)
    store.cache_purge(keys.where("doc_id % 3 = 0"), path)
    return store.cache_get(keys, path).select("doc_id", "value")


@query("snk7_sealed_ranges", "select doc_id, substring(text, 901, 700) as part from documents where doc_id is not null and length(text) > 900 and octet_length(encode(text)) = length(text)")
def snk7_sealed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ASCII letters sealed in chunks of 512 bytes; a range over three chunks is opened."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and length(text) > 900 and octet_length(text) = length(text)")
    sealed = store.seal(docs, "doc_id", "text", "secret", 512)
    return store.read_range(sealed, "doc_id", 900, 700, "secret", 512).select("doc_id", F.decode("content", "UTF-8").alias("part"))


@query("snk8_byte_ranges", """with d as (select doc_id, octet_length(encode(text))::bigint as n, doc_id % 4 as k from documents where text is not null)
select doc_id, (case when k = 3 then 200 when (k = 0 and n > 100) or (k = 1 and n > 50) or (k = 2 and n > 0) then 206 else 416 end)::int as status,
  case when k = 3 then 0 when k = 0 and n > 100 then 100 when k = 1 and n > 50 then 50 when k = 2 and n > 0 then greatest(n - 80, 0) end as first,
  case when k = 3 then n - 1 when k = 0 and n > 100 then least(199, n - 1) when k = 1 and n > 50 then n - 1 when k = 2 and n > 0 then n - 1 end as last from d""")
def snk8_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.element_at(F.array(*map(F.lit, ["bytes=100-199", "bytes=50-", "bytes=-80", "pages=1-2"])), (F.col("doc_id") % 4 + 1).cast("int"))
    found = store.byte_range(header, F.octet_length("text").cast("long"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", found.alias("r")).select("doc_id", F.col("r.status").cast("int").alias("status"), F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


@query("prj3_error_codes", """select page_id, case when page_id % 3 = 0 then null when len(string_split(code, ':')) >= 3 then array_to_string(string_split(code, ':')[3:], ':')
  when starts_with(code, 'audio_processing') then 'The audio could not be processed.' else 'The analysis could not be finished.' end as message
from (select page_id, case page_id % 5 when 0 then 'audio_processing:x' when 1 then 'stage' else 'stage:' || url end as code from pages)""")
def prj3_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    code = F.when(n % 5 == 0, "audio_processing:x").when(n % 5 == 1, "stage").otherwise(F.concat(F.lit("stage:"), F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", labels.error_message(F.when(n % 3 == 0, "READY").otherwise("ERROR"), code).alias("message"))


@query("sf7_label_slugs", "select p_partkey, lower(replace(trim(p_type), ' ', '_')) as slug, regexp_full_match(lower(replace(trim(p_type), ' ', '_')), '[a-z_][a-z0-9_]*') as identifier, ['angry', 'happy', 'calm_voice'][p_partkey % 3 + 1] as emotion from part")
def sf7_label_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = labels.slug(F.col("p_type"))
    said = F.element_at(F.array(*map(F.lit, [" Anger", "JOY ", "Calm voice"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("slug"), labels.is_identifier(name).alias("identifier"), labels.emotion(said).alias("emotion"))


@query("sf8_interpretation", """select event_id, case when s < 0 or s > 100 then 'unknown' when s <= 20 then 'very_low' when s <= 40 then 'low' when s <= 60 then 'neutral' when s <= 80 then 'good' else 'high' end as level,
  case when value >= 75 then 'high' when value >= 50 then 'medium' else 'low' end as confidence from (select event_id, value, round_even(value, 0) as s from events)""")
def sf8_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", labels.interpretation(F.col("value")).alias("level"), labels.confidence_level(F.col("value") / 100).alias("confidence"))


@query("ag10_levels", f"""with p as (select event_type, quantile_cont(value - 100, 0.1) as p10, quantile_cont(value - 100, 0.5) as p50, quantile_cont(value - 100, 0.9) as p90 from events group by 1)
select event_type, {', '.join(f"{rounded_sql(c, 5)} as {n}" for c, n in (('max(p10)', 'noise_floor'), ('max(p50)', '"median"'), ('max(p90)', 'speech_level'), ('max(p90 - p10)', 'snr'), ('avg((value - 100 < greatest(-50, p90 - 35))::int::double)', 'silence_ratio'), ('avg((value >= 150)::int::double)', 'clipping_ratio')))}, count(*) as frames
from events join p using (event_type) group by 1""")
def ag10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event type stands for a recording, values less 100 for frame levels."""
    frames = table(spark, sf_dir, "events").select("event_type", (F.col("value") - 100).alias("db"), "value")
    found = levels.frame_levels(frames, ["event_type"], "db", F.col("value") >= 150)
    return found.select("event_type", *(rounded(c, 5).alias(c) for c in ("noise_floor", "median", "speech_level", "snr", "silence_ratio", "clipping_ratio")), "frames")


@query("ag11_channel_layout", f"""with f as (select l_suppkey % 50 as k, l_quantity::double as a, (case when l_suppkey % 2 = 0 then l_quantity::double else l_extendedprice::double end) as b, -(l_quantity::double) * 1.5::double as da, case when l_suppkey % 3 = 0 then -70.0::double else (l_tax * 400)::double - 65 end as db from lineitem),
p as (select k, quantile_cont(da, 0.95) as pa, quantile_cont(db, 0.95) as pb from f group by 1),
g as (select k, coalesce(corr(a, b), 0) as r, avg(x) as xa, avg(y) as ya, sum(x * y) / greatest(1, least(sum(x), sum(y))) as o from (select f.*, (da > greatest(-55, pa - 25) and da > -60)::int::double as x, (db > greatest(-55, pb - 25) and db > -60)::int::double as y from f join p using (k)) group by 1)
select k, {rounded_sql('r', 4)} as correlation, {rounded_sql('xa', 4)} as active_left, {rounded_sql('ya', 4)} as active_right, {rounded_sql('o', 4)} as overlap_ratio,
  case when abs(r) > 0.55 then 'correlated channels' when least(xa, ya) < 0.03 then 'a channel with hardly any voice' when o > 0.3 then 'both channels active at once' else 'one speaker a channel' end as reason from g""")
def ag11_channel_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity").cast("double")
    other = F.when(F.col("l_suppkey") % 2 == 0, quantity).otherwise(F.col("l_extendedprice").cast("double"))
    level = F.when(F.col("l_suppkey") % 3 == 0, -70.0).otherwise((F.col("l_tax") * 400).cast("double") - 65)
    frames = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), quantity.alias("a"), other.alias("b"), (-quantity * 1.5).alias("da"), level.alias("db"))
    found = levels.channel_layout(frames, ["k"], "a", "b", "da", "db")
    return found.select("k", *(rounded(c, 4).alias(c) for c in ("correlation", "active_left", "active_right", "overlap_ratio")), "reason")


@query("ag28_calibration_pairs", f"""with p as (select o_orderkey, case when o_orderkey % 9 <> 0 then o_totalprice::double end as real, (o_custkey + o_totalprice / 2)::double as predicted from orders),
g as (select count(*) as n, least(greatest(regr_slope(real, predicted), 0.2), 3) as a, avg(real) as r, avg(predicted) as q from p where real is not null)
select n, 1.0::double as current_a, 0.0::double as current_b, {rounded_sql('a', 5)} as proposed_a, {rounded_sql('r - a * q', 3)} as proposed_b, n >= 30 as enough,
  (select sum(o_orderkey)::bigint from (select o_orderkey from p where real is not null order by 1 limit 500)) as first_pairs from g""")
def ag28_calibration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice").cast("double"))
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", real.alias("real"), (F.col("o_custkey") + F.col("o_totalprice") / 2).cast("double").alias("predicted"))
    found = levels.calibration_status(pairs, "real", "predicted", "o_orderkey")
    first = F.aggregate("pairs", F.lit(0).cast("long"), lambda a, x: a + x["o_orderkey"])
    return found.select("n", "current_a", "current_b", rounded("proposed_a", 5).alias("proposed_a"), rounded("proposed_b", 3).alias("proposed_b"), "enough", first.alias("first_pairs"))


@query("ds4_stats", f"""with o as (select *, ['train', 'validation', 'test'][o_orderkey % 3 + 1] as split from orders),
c as (select string_agg(v || '=' || n, ',' order by v) as classes from (select o_orderpriority as v, count(*) as n from o group by 1)), s as (select string_agg(v || '=' || n, ',' order by v) as splits from (select split as v, count(*) as n from o group by 1))
select (select count(*) from o) as samples, (select count(distinct o_custkey) from o) as groups, {rounded_sql('(select sum(o_totalprice)::double from o)', 2)} as duration, (select count(*) from o where o_totalprice < 1000) as issues, classes, splits from c, s""".replace(" as groups", ' as "groups"'))
def ds4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.element_at(F.array(*map(F.lit, ["train", "validation", "test"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    found = levels.dataset_stats(table(spark, sf_dir, "orders").withColumn("split", split), "o_custkey", "o_orderpriority", "o_totalprice", "split", F.col("o_totalprice") < 1000)
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("samples", "groups", rounded(F.col("duration").cast("double"), 2).alias("duration"), "issues", shown("classes").alias("classes"), shown("splits").alias("splits"))
