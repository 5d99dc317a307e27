"""Queries of archives, versioned data sets and stages that are taken up again."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import requests
from ..sources import archives, blocks, versions
from ..streaming import live, stages
from .registry import query, table


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of ZIP archives that hold every document as a text file; those of odd ids under a name that leads out of the
    folder."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    z.writestr(f"../{doc}.txt" if doc % 2 else f"texts/{doc}.txt", text or "")
            yield pd.DataFrame({"path": [f"{batch['doc_id'].iloc[0]}.zip"], "content": [out.getvalue()]})

    folder = live.shared_folder(spark, "archives")
    made = table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(each, "path string, content binary")
    return blocks.save_files(made, folder).select(F.col("path").alias("archive"))


@query("src9_archive_members", """select case when doc_id % 2 = 1 then '../' || doc_id || '.txt' else 'texts/' || doc_id || '.txt' end as name, strlen(coalesce(text, ''))::bigint as size,
case when doc_id % 2 = 1 then null else sha256(coalesce(text, '')) end as digest, case when doc_id % 2 = 1 then 'unsafe_name' end as error from documents""")
def src9_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the archives; names that lead out of the folder are refused one by one."""
    listed = archives.entries(spark, spark.createDataFrame([(r.archive,) for r in _archives(spark, sf_dir).collect()], "archive string"))
    return archives.read_members(listed).select("name", "size", F.sha2("content", 256).alias("digest"), "error")


@query("dm4_dataset_versions", """with v as (select unnest([1, 2]) as version), p as (select version, p_partkey, p_brand, case when version = 2 and p_size < 10 then -1.0::double else p_retailprice end as price
from part, v where not (version = 2 and p_size > 45))
select version, case version when 2 then 1 end as parent, p_brand, count(*) as n, round(sum(price), 2) as price from p group by all""")
def dm4_dataset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as version 1; a clone, in which small parts get another price and large ones go; both versions read."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    kept = versions.VersionedSet(spark, live.shared_folder(spark, "versions"), "p_partkey", parts.schema, buckets=16)
    first = kept.create(parts)
    kept.freeze(first)
    second = kept.clone(first)
    kept.change(second, parts.where("p_size < 10").withColumn("p_retailprice", F.lit(-1.0)), parts.where("p_size > 45"))
    both = [kept.read(v).select(F.lit(v).alias("version"), F.lit(kept.parent(v)).cast("int").alias("parent"), "*") for v in (first, second)]
    return both[0].union(both[1]).groupBy("version", "parent", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("sx1_stage_run", "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def sx1_stage_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through two stages in four batches; the second stage fails at first, and the second run does it alone."""
    tried: list[int] = []

    def second(rows: DataFrame) -> DataFrame:
        tried.append(1)
        if len(tried) <= 4:
            raise RuntimeError("not yet")
        return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))

    run = stages.StageRun(spark, live.shared_folder(spark, "stages"), {"keep": lambda df: df.select("o_orderkey", "o_orderstatus", "o_totalprice"), "sum": second}, "o_orderkey", 4)
    orders = table(spark, sf_dir, "orders")
    run.run(orders)
    run.run(orders)
    return run.results("sum").groupBy("o_orderstatus").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


def stage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports: a user is a call, five days are a stage, the kind of event decides what is reported."""
    events = live.read_events(spark, f"{sf_dir}/events.parquet")
    kinds = F.create_map(*(F.lit(x) for x in ("view", "start", "click", "start", "purchase", "complete", "error", "fail", "login", "done")))
    day = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 5).cast("int")
    return events.select(
        F.col("user_id").alias("call_id"), F.try_element_at(F.array(*map(F.lit, stages.STAGES)), day + 1).alias("stage"),
        F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("done")).alias("kind"), (F.col("event_id") % 50).alias("done"), F.lit(50).alias("total"), F.col("ts").alias("at"), F.col("event_type").alias("error"),
    )


@query("sx1_stage_states")
def sx1_stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a call's stages, with stages that were silent for a day failed by a timer."""
    found = live.into_table(spark, stages.stage_states(stage_reports(spark, sf_dir), silence=86_400.0), "stages")
    return found.drop("batch").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("flt3_sample_search", """select doc_id, lang as emotion from documents left join labels using (doc_id) where source = (select min(source) from documents) and (length(text) < 200 or text is null or quality is null)""")
def flt3_sample_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples, their source for a split and their language for an emotion: those of one split with issues."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    issues = F.array_compact(F.array(F.when(F.length("text") < 200, "too_short"), F.when(F.col("text").isNull(), "corrupt"), F.when(F.col("quality").isNull(), "unlabelled")))
    samples = docs.join(labels, "doc_id", "left").select("doc_id", F.col("source").alias("split"), F.col("lang").alias("emotion"), issues.alias("issues"))
    first = docs.agg(F.min("source")).first()[0]
    return requests.sample_filters(samples, split=first, with_issues=True).select("doc_id", "emotion")


@query("flt8_request_reasons", """with r as (select c_custkey, c_acctbal / 100 as satisfaction, (c_custkey % 250)::int - 5 as page_size, (c_custkey % 7)::int - 1 as page, substr(c_name, 1, (c_custkey % 20)::int) as name,
  (c_custkey % 11 - 1) / 10.0::double as train, (c_custkey % 5) / 10.0::double as validation from customer),
e as (select c_custkey, list_filter([case when name is null or trim(name) = '' then 'name.missing' end, case when satisfaction < 0 then 'satisfaction.low' when satisfaction > 100 then 'satisfaction.high' end,
  case when page < 1 then 'page.low' end, case when page_size < 1 then 'page_size.low' when page_size > 200 then 'page_size.high' end, case when length(name) < 2 then 'name.length.low' when length(name) > 200 then 'name.length.high' end,
  case when train < 0 then 'split.negative' end, case when train <= 0 or validation <= 0 then 'split.empty' end, case when train + validation <= 0 then 'split.sum' end], lambda x: x is not null) as errors from r)
select c_custkey, array_to_string(errors, ',') as errors from e where len(errors) > 0""")
def flt8_request_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests; those that are refused, with all that is wrong."""
    key = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 100).alias("satisfaction"), ((key % 250).cast("int") - 5).alias("page_size"), ((key % 7).cast("int") - 1).alias("page"), F.expr("substring(c_name, 1, cast(c_custkey % 20 as int))").alias("name"),
        ((key % 11 - 1) / 10).alias("train"), ((key % 5) / 10).alias("validation"),
    )
    return requests.checked(asked, ["name"])[1].select("c_custkey", F.array_join("errors", ",").alias("errors"))
