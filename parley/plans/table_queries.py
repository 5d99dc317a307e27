"""Queries over the driver's tables: search, dashboards, data sets, metrics, registry. SQL throughout; where both engines
read the same text it is written once."""

from __future__ import annotations

from .registry import sql_query

# --- sources and sinks -----------------------------------------------------------------------------------------------

sql_query("src5_tenant_scan", "select c_custkey, c_name, c_acctbal from {customer} where c_nationkey = 7")
sql_query("src6_json_scan", """select event_id, get_json_object(props, '$.k') as k from {events}""", """select event_id, json_extract_string(props, '$.k') as k from {events}""")
sql_query("snk5_manifest_export", "select concat('audio/', cast(o_orderkey as string), '.wav') as audio, o_custkey as speaker, o_orderpriority as emotion, round(o_totalprice / 5000, 2) as satisfaction, 0 as start from {orders}",
          "select concat('audio/', cast(o_orderkey as varchar), '.wav') as audio, o_custkey as speaker, o_orderpriority as emotion, round(o_totalprice / 5000, 2) as satisfaction, 0 as start from {orders}")
# --- filters and projections -----------------------------------------------------------------------------------------

sql_query("flt1_call_search", """select o_orderkey, c_name, o_totalprice from {orders} join {customer} on o_custkey = c_custkey
where (lower(c_name) like '%customer#0000001%' or lower(coalesce(o_orderpriority, '')) like '%urgent%') and o_orderstatus = 'O' and o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-01-01' + interval 1 day
and o_totalprice between 50000 and 250000 and (c_acctbal >= 1000 or o_totalprice >= 100000) and (c_acctbal <= 8000 or o_totalprice <= 200000)""")
sql_query("flt3_sample_filters", "select o_orderkey, o_orderpriority from {orders} where o_orderstatus <> 'P' and o_orderpriority = '1-URGENT' and (o_totalprice > 200000 or o_totalprice < 20000)")
sql_query("flt5_hallucinations", "select doc_id from {documents} where not (n_chars % 100 > 85 and n_chars % 37 > 18)")
sql_query("flt6_privacy_gate", "select d.doc_id from {documents} d left semi join (select doc_id from {labels} where quality = 1) l on d.doc_id = l.doc_id", "select d.doc_id from {documents} d where exists (select 1 from {labels} l where quality = 1 and l.doc_id = d.doc_id)")
sql_query("flt7_org_isolation", "select c_nationkey as org_id, count(*) as calls, round(avg(c_acctbal), 4) as balance from {customer} where c_nationkey in (3, 4) group by 1")
sql_query("flt8_request_validation", """select d.doc_id, case when n_chars < 50 then 'text too short' when n_chars > 10000 then 'text too long' when lang not in ('en', 'es') then 'language' when coalesce(toxic, 0) = 1 then 'rejected' end as reason
from {documents} d left join {labels} l on d.doc_id = l.doc_id""")
sql_query("prj1_json_defaults", "select event_id, coalesce(get_json_object(props, '$.speakers.count'), '0') as speakers, coalesce(get_json_object(props, '$.k'), 'none') as k from {events}", "select event_id, coalesce(json_extract_string(props, '$.speakers.count'), '0') as speakers, coalesce(json_extract_string(props, '$.k'), 'none') as k from {events}")
sql_query("prj4_progress", """select event_id, round(lo + (hi - lo) * pct / 100, 1) as progress from (select event_id, event_type, event_id % 101 as pct from {events}) e
join (values ('click', 0.0D, 15.0D), ('view', 15.0D, 30.0D), ('purchase', 30.0D, 55.0D), ('signup', 55.0D, 85.0D), ('logout', 85.0D, 100.0D)) as s(event_type, lo, hi) using (event_type)""",
          """select event_id, round(lo + (hi - lo) * pct / 100, 1) as progress from (select event_id, event_type, event_id % 101 as pct from {events}) e
join (values ('click', 0.0::double, 15.0::double), ('view', 15.0, 30.0), ('purchase', 30.0, 55.0), ('signup', 55.0, 85.0), ('logout', 85.0, 100.0)) as s(event_type, lo, hi) using (event_type)""")
sql_query("prj5_person_names", "select s_suppkey, concat('Person ', cast(cast(regexp_extract(s_name, '([0-9]+)$', 1) as bigint) + 1 as string)) as person from {supplier}", "select s_suppkey, concat('Person ', cast(cast(regexp_extract(s_name, '([0-9]+)$', 1) as bigint) + 1 as varchar)) as person from {supplier}")

# --- joins -----------------------------------------------------------------------------------------------------------

sql_query("jn1_lookup", "select o_orderkey, c_name, l_linenumber from {lineitem} join {orders} on l_orderkey = o_orderkey left join {customer} on o_custkey = c_custkey where l_quantity > 45")
sql_query("jn11_anti", "select d.doc_id from {documents} d left anti join {labels} l on d.doc_id = l.doc_id", "select d.doc_id from {documents} d where not exists (select 1 from {labels} l where l.doc_id = d.doc_id)")
sql_query("jn12_duplicates_exist", "with d as (select doc_id, sha2(text, 256) as h from {documents}), g as (select h, count(*) as n from d group by h) select doc_id, n > 1 as duplicate from d join g on d.h <=> g.h", "select doc_id, n > 1 as duplicate from (select doc_id, count(*) over (partition by sha256(text)) as n from {documents})")
sql_query("jn13_orphans", "select p_partkey from {part} left anti join (select distinct l_partkey from {lineitem} where l_quantity > 10) on p_partkey = l_partkey", "select p_partkey from {part} where p_partkey not in (select l_partkey from {lineitem} where l_quantity > 10)")
sql_query("jn14_model_resolution", """select c_custkey, coalesce(own, everyone, 'builtin') as model from {customer}
left join (select o_custkey, max_by(o_orderpriority, struct(o_orderdate, o_orderkey)) as own from {orders} where o_orderstatus = 'F' group by 1) on c_custkey = o_custkey
cross join (select max_by(o_orderpriority, struct(o_orderdate, o_orderkey)) as everyone from {orders} where o_orderstatus = 'F')""",
          """select c_custkey, coalesce(own, everyone, 'builtin') as model from {customer}
left join (select o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as own from {orders} where o_orderstatus = 'F' group by 1) on c_custkey = o_custkey
cross join (select arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as everyone from {orders} where o_orderstatus = 'F')""")

# --- aggregates ------------------------------------------------------------------------------------------------------

sql_query("ag1_dashboard_totals", """select count(*) as total, sum(case when o_orderstatus = 'F' then 1 else 0 end) as analyzed, sum(case when o_orderstatus = 'P' then 1 else 0 end) as processing,
round(avg(case when o_orderstatus = 'F' then o_totalprice end), 1) as price, round(avg(o_custkey), 1) as customer from {orders}""",
          """select count(*) as total, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as analyzed, sum(case when o_orderstatus = 'P' then 1 else 0 end)::bigint as processing,
round(avg(case when o_orderstatus = 'F' then o_totalprice end), 1) as price, round(avg(o_custkey), 1) as customer from {orders}""")
sql_query("ag3_dominant_histogram", "select event_type, count(*) as n from {events} group by 1")
sql_query("ag4_daily_evolution", "select cast(ts as date) as day, round(avg(value), 4) as score, count(*) as n from {events} group by 1")
_BIN = "case when value <= 20 then '0-20' when value <= 40 then '21-40' when value <= 60 then '41-60' when value <= 80 then '61-80' when value <= 1e9 then '81-100' end"
sql_query("ag5_fixed_bins", f"""select bin, coalesce(n, 0) as n from (values ('0-20'), ('21-40'), ('41-60'), ('61-80'), ('81-100')) as b(bin)
left join (select {_BIN} as bin, count(*) as n from {{events}} group by 1) using (bin)""")
sql_query("ag9_robust_baseline", """select user_id, round(m, 6) as med, round(greatest(1.4826D * percentile(abs(value - m), 0.5D), 0.001D), 6) as scale from (select *, percentile(value, 0.5D) over (partition by user_id) as m from {events}) group by user_id, m having count(*) >= 3""",
          """select user_id, round(m, 6) as med, round(greatest(1.4826::double * quantile_cont(abs(value - m), 0.5), 0.001), 6) as scale from (select *, quantile_cont(value, 0.5) over (partition by user_id) as m from {events}) group by user_id, m having count(*) >= 3""")
sql_query("ag12_distribution", "select o_orderpriority, o_orderstatus, count(*) as n from {orders} group by 1, 2")
sql_query("ag13_imbalance", """select round(max(n) / sum(n), 6) as top_share, max(n) / sum(n) > 0.5 or (count(*) > 1 and max(n) / greatest(min(n), 1e-9) > 8) as imbalanced from (select event_type, cast(count(*) as double) as n from {events} group by 1)""")
sql_query("ag14_class_weights", "select label, round(w / avg(w) over (), 6) as weight from (select o_orderpriority as label, sum(count(*)) over () / cast(count(*) * count(*) over () as double) as w from {orders} group by 1)")
_PAIRS = "p as (select case when toxic = 1 then 'toxic' else 'ordinary' end as truth, case when n_chars % 5 = 0 then 'toxic' else 'ordinary' end as guess from {documents} join {labels} using (doc_id))"
sql_query("ag15_confusion", f"with {_PAIRS}, k as (select truth, guess, count(*) as n from p group by 1, 2), l as (select truth as label from k union select guess from k) select a.label as truth, b.label as guess, coalesce(k.n, 0) as n from l a cross join l b left join k on k.truth = a.label and k.guess = b.label")
# The data are summed up to pairs of labels first; only these meet the labels.
_CLASS = f"""{_PAIRS}, k as (select truth, guess, cast(count(*) as double) as n from p group by 1, 2),
u as (select truth as label, case when truth = guess then n else 0 end as tp, 0 as guessed, n as support from k union all select guess, 0, n, 0 from k),
c as (select label, sum(tp) as tp, sum(guessed) as guessed, sum(support) as support from u group by label),
m as (select label, support, coalesce(tp / nullif(guessed, 0), 0) as prec, coalesce(tp / nullif(support, 0), 0) as rec, tp from c),
f as (select *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) as f1 from m)"""
sql_query("ag16_class_metrics", f"with {_CLASS} select label, round(prec, 6) as prec, round(rec, 6) as rec, round(f1, 6) as f1, support from f")
sql_query("ag16_overall_metrics", f"with {_CLASS} select round(sum(tp) / sum(support), 6) as accuracy, round(avg(case when support > 0 then f1 end), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from f")
sql_query("ag17_regression_metrics", """with e as (select l_extendedprice as y, l_quantity * 1500.0 as p from {lineitem})
select round(avg(abs(y - p)), 4) as mae, round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round(1 - sum((y - p) * (y - p)) / greatest(var_pop(y) * count(*), 1e-9), 6) as r2, round(corr(y, p), 6) as pearson, count(*) as n from e""",
          """with e as (select l_extendedprice as y, l_quantity * 1500.0::double as p from {lineitem})
select round(avg(abs(y - p)), 4) as mae, round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round(1 - sum((y - p) * (y - p)) / greatest(var_pop(y) * count(*), 1e-9), 6) as r2, round(corr(y, p), 6) as pearson, count(*) as n from e""")
sql_query("ag23_centroids", "select label, pos, round(avg(x), 5) as x from (select label, posexplode(embedding) as (pos, x) from {embeddings}) group by 1, 2", "select label, (pos - 1)::int as pos, round(avg(embedding[pos]::double), 5) as x from {embeddings}, range(1, 65) as r(pos) group by 1, 2")
sql_query("ag24_distinct_groups", "select count(distinct coalesce(nullif(o_orderpriority, '5-LOW'), cast(o_custkey as string))) as n_groups, count(distinct o_custkey) as customers from {orders}", "select count(distinct coalesce(nullif(o_orderpriority, '5-LOW'), cast(o_custkey as varchar))) as n_groups, count(distinct o_custkey) as customers from {orders}")
sql_query("ag25_language_vote", """with s as (select source, lang, cast(count(*) as double) as n from {documents} group by 1, 2), t as (select *, n / sum(n) over (partition by source) as share, row_number() over (partition by source order by n desc, lang) as rank from s)
select source, case when max(case when rank = 1 then share end) < 0.6 and max(case when lang = 'es' then share end) >= 0.15 then 'es' else max(case when rank = 1 then lang end) end as lang, round(max(case when rank = 1 then share end), 6) as confidence from t group by source""")
sql_query("ag27_rollup", "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from {orders} group by rollup (o_orderstatus, o_orderpriority)")
sql_query("ag27_cube_having", "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by cube (o_orderstatus, o_orderpriority) having count(*) > 100")
sql_query("ag30_extrema", "select user_id, max(value) as peak, max_by(event_id, struct(value, -event_id)) as peak_at, min(value) as least, min_by(event_id, struct(value, event_id)) as least_at from {events} group by 1", "select user_id, max(value) as peak, arg_max(event_id, (value, -event_id)) as peak_at, min(value) as least, arg_min(event_id, (value, event_id)) as least_at from {events} group by 1")
sql_query("ag31_confusion_rows", f"with {_PAIRS} select truth, guess, round(count(*) / cast(sum(count(*)) over (partition by truth) as double), 6) as share from p group by 1, 2")

# --- windows over rows -----------------------------------------------------------------------------------------------

sql_query("wn21_ranking", """select o_orderkey, rank() over w as rnk, dense_rank() over w as dense, ntile(4) over w as quarter, round(percent_rank() over w, 6) as pct, round(cume_dist() over w, 6) as cume, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second
from {orders} window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
          """select o_orderkey, (rank() over w)::int as rnk, (dense_rank() over w)::int as dense, (ntile(4) over w)::int as quarter, round(percent_rank() over w, 6) as pct, round(cume_dist() over w, 6) as cume, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second
from {orders} window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
sql_query("wn21_range_frame", "select l_orderkey, l_linenumber, round(sum(l_extendedprice) over (partition by l_orderkey order by l_quantity range between 5 preceding and current row), 2) as s from {lineitem}")
sql_query("wn22_down_sampling", """select user_id, bucket, min(value) as low, max(value) as high, min_by(event_id, struct(ts, event_id)) as first, max_by(event_id, struct(ts, event_id)) as last from (select *, cast(ts as date) as bucket from {events}) group by 1, 2""",
          """select user_id, bucket, min(value) as low, max(value) as high, arg_min(event_id, (ts, event_id)) as first, arg_max(event_id, (ts, event_id)) as last from (select *, cast(ts as date) as bucket from {events}) group by 1, 2""")
sql_query("wn12_drawdown", """select event_id, round(value - (min(value) over w), 6) as rise, round((max(value) over w) - value, 6) as fall, round(value - lag(value, 3) over (partition by user_id order by ts, event_id), 6) as jump from {events} window w as (partition by user_id order by ts, event_id rows between 12 preceding and current row)""")

# --- sorts, sets, changes --------------------------------------------------------------------------------------------

sql_query("so1_page", "select o_orderkey, o_totalprice, (select count(*) from {orders} where o_orderstatus = 'O') as total from {orders} where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 20 offset 40")
sql_query("so2_recent", "select o_orderkey, o_orderdate from {orders} order by o_orderdate desc, o_orderkey limit 8")
sql_query("so3_top_per_group", "select l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as r from {lineitem}) where r <= 2")
sql_query("so4_factors", "select l_orderkey, l_linenumber, round(l_extendedprice / 1000 - 30, 1) as points, l_extendedprice / 1000 - 30 > 0 as positive, rank() over (partition by l_orderkey order by abs(l_extendedprice / 1000 - 30) desc, l_linenumber) as place from {lineitem} where abs(l_extendedprice / 1000 - 30) >= 1",
          "select l_orderkey, l_linenumber, round(l_extendedprice / 1000 - 30, 1) as points, l_extendedprice / 1000 - 30 > 0 as positive, (rank() over (partition by l_orderkey order by abs(l_extendedprice / 1000 - 30) desc, l_linenumber))::int as place from {lineitem} where abs(l_extendedprice / 1000 - 30) >= 1")
sql_query("so5_latest_version", "select p_brand, max_by(p_name, struct(p_size, p_partkey)) as name, max(p_size) as version from {part} group by 1", "select p_brand, arg_max(p_name, (p_size, p_partkey)) as name, max(p_size) as version from {part} group by 1")
sql_query("st1_ordered_union", "select doc_id, array_join(array_distinct(concat(array(lang, source), array(source, 'x', lang))), ',') as warnings from {documents}", "select doc_id, concat_ws(',', lang, source, 'x') as warnings from {documents}")
sql_query("st2_union", "select conv_id, turn, 'left' as channel from {conversations} where role = 'user' union all select conv_id, turn, 'right' from {conversations} where role = 'assistant'")
sql_query("st3_key_sets", "select n_nationkey as k, 'both' as kind from {nation} intersect select c_nationkey, 'both' from {customer} union all (select n_nationkey, 'unused' from {nation} except select s_nationkey, 'unused' from {supplier})")
sql_query("dm2_partial_delete", "select d.doc_id, d.source from {documents} d left anti join (select doc_id from {labels} where quality = 0) l on d.doc_id = l.doc_id", "select d.doc_id, d.source from {documents} d where d.doc_id not in (select doc_id from {labels} where quality = 0)")
sql_query("dm3_retention", "select o_orderkey from {orders} where not (o_orderdate + interval 365 day < timestamp '1996-01-01')")
sql_query("dm4_version_clone", "select p_partkey, p_brand, max(p_size) over (partition by p_brand) + 1 as version, false as frozen from {part}")
sql_query("dm5_schema_evolution", "select doc_id, lang, cast(null as string) as topic from {documents} where doc_id % 2 = 0 union all select doc_id, lang, source as topic from {documents} where doc_id % 2 = 1", "select doc_id, lang, cast(null as varchar) as topic from {documents} where doc_id % 2 = 0 union all select doc_id, lang, source as topic from {documents} where doc_id % 2 = 1")
sql_query("dm7_activation", "select o_orderkey, o_custkey, case when o_orderkey = max(o_orderkey) over (partition by o_custkey) then 'PRODUCTION' when o_orderstatus = 'F' then 'ARCHIVED' else 'READY' end as status, row_number() over (partition by o_custkey order by o_orderkey) as version from {orders}",
          "select o_orderkey, o_custkey, case when o_orderkey = max(o_orderkey) over (partition by o_custkey) then 'PRODUCTION' when o_orderstatus = 'F' then 'ARCHIVED' else 'READY' end as status, (row_number() over (partition by o_custkey order by o_orderkey))::int as version from {orders}")

# --- scalars ---------------------------------------------------------------------------------------------------------

sql_query("sf5_clock_to_seconds", "select event_id, aggregate(split(date_format(ts, 'HH:mm:ss'), ':'), 0D, (a, x) -> a * 60 + cast(x as double)) as seconds from {events}", "select event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::double as seconds from {events}")
sql_query("sf6_clock_format", "select event_id, format_string('%02d:%02d', cast(floor(abs(value) / 60) as bigint), cast(floor(abs(value)) as bigint) % 60) as mmss from {events}", "select event_id, format('{{:02d}}:{{:02d}}', floor(abs(value) / 60)::bigint, floor(abs(value))::bigint % 60) as mmss from events".replace("{{", "{").replace("}}", "}"))
sql_query("sf10_truncation", "select doc_id, substring(text, 1, 180) as t180, size(split(trim(text), '\\\\s+')) >= 3 as enough from {documents}", "select doc_id, substring(text, 1, 180) as t180, len(regexp_split_to_array(trim(text), '\\s+')) >= 3 as enough from {documents}")
sql_query("mf3_language_match", "select doc_id, case when substring(lang, 1, 2) = 'es' then 0.7D else 0.35D end as audio_weight, case when substring(lang, 1, 2) = 'es' then 0.3D else 0.65D end as text_weight from {documents}", "select doc_id, case when substring(lang, 1, 2) = 'es' then 0.7::double else 0.35::double end as audio_weight, case when substring(lang, 1, 2) = 'es' then 0.3::double else 0.65::double end as text_weight from {documents}")
sql_query("mf4_squashing", "select event_id, round(least(greatest(value / 50, -1), 1), 6) as clipped, round(tanh(value / 50), 6) as squashed, round(1 / (1 + exp(-1.2 * value / 50)), 6) as logistic, round(ln(1 + abs(value)), 6) as logged from {events}")
sql_query("mf5_decibels", "select user_id, round(10 * log10(avg(value * value) + 1e-12), 5) as db from {events} group by 1")
sql_query("mf7_tension", """with b as (select user_id, m, greatest(1.4826D * percentile(abs(value - m), 0.5D), 0.001D) as s from (select *, percentile(value, 0.5D) over (partition by user_id) as m from {events}) group by user_id, m)
select event_id, round(1 / (1 + exp(-1.2D * (0.9D * (value - m) / s + 0.3D * (value / 2 - m) / s))), 6) as tension from {events} join b using (user_id)""",
          """with b as (select user_id, m, greatest(1.4826::double * quantile_cont(abs(value - m), 0.5), 0.001) as s from (select *, quantile_cont(value, 0.5) over (partition by user_id) as m from {events}) group by user_id, m)
select event_id, round(1 / (1 + exp(-1.2::double * (0.9::double * (value - m) / s + 0.3::double * (value / 2 - m) / s))), 6) as tension from {events} join b using (user_id)""")
sql_query("jf1_json", "select event_id, to_json(named_struct('event_type', event_type, 'user_id', user_id)) as j from {events}", "select event_id, to_json({'event_type': event_type, 'user_id': user_id})::varchar as j from events")
sql_query("dt1_dates", "select event_id, date_format(ts, 'yyyy-MM-dd') as day, date_add(cast(ts as date), 30) as retention, cast(ts as date) + interval 1 day > date '2024-01-10' as late from {events}", "select event_id, strftime(ts, '%Y-%m-%d') as day, (cast(ts as date) + 30)::date as retention, cast(ts as date) + interval 1 day > date '2024-01-10' as late from {events}")
sql_query("hf1_fingerprints", "select doc_id, sha2(text, 256) as h256, md5(text) as h128 from {documents}", "select doc_id, sha256(text) as h256, md5(text) as h128 from {documents}")

# --- data sets -------------------------------------------------------------------------------------------------------

sql_query("ds1_validation", """with d as (select doc_id, quality, toxic, n_chars % 131 as satisfaction, sha2(text, 256) as h from {documents} left join {labels} using (doc_id)),
g as (select h, min(doc_id) as first from d group by h)
select doc_id, concat_ws(',', case when quality is null then 'missing_label' end, case when satisfaction > 100 then 'out_of_range' end, case when quality = 1 and satisfaction < 15 then 'inconsistent' end, case when toxic = 1 and satisfaction > 90 then 'inconsistent' end, case when doc_id > first then 'duplicate' end) as issues from d join g on d.h <=> g.h""",
          """with d as (select doc_id, quality, toxic, n_chars % 131 as satisfaction, row_number() over (partition by sha256(text) order by doc_id) as copy from {documents} left join {labels} using (doc_id))
select doc_id, concat_ws(',', case when quality is null then 'missing_label' end, case when satisfaction > 100 then 'out_of_range' end, case when quality = 1 and satisfaction < 15 then 'inconsistent' end, case when toxic = 1 and satisfaction > 90 then 'inconsistent' end, case when copy > 1 then 'duplicate' end) as issues from d""")
sql_query("ds5_feedback_import", "select l.doc_id, l.toxic from {labels} l left anti join (select doc_id from {documents} where lang = 'en') d on l.doc_id = d.doc_id", "select l.doc_id, l.toxic from {labels} l where l.doc_id not in (select doc_id from {documents} where lang = 'en')")
sql_query("ds6_sampling_weights", "select doc_id, round(1 / cast(n as double), 8) as weight from {labels} l join (select toxic, count(*) as n from {labels} group by 1) g on l.toxic <=> g.toxic", "select doc_id, round(1 / cast(count(*) over (partition by toxic) as double), 8) as weight from labels")
sql_query("tr3_model_comparison", f"with {_PAIRS} select guess, count(*) as n, round(avg(case when truth = guess then 1.0D else 0.0D end), 6) as accuracy from p group by 1".replace("1.0D", "cast(1 as double)").replace("0.0D", "cast(0 as double)"))
sql_query("tr4_early_stop", """with h as (select user_id as run, epoch, f1, max(f1) over (partition by user_id order by epoch rows between unbounded preceding and 1 preceding) as best from (select user_id, row_number() over (partition by user_id order by event_id) as epoch, value as f1 from {events})),
g as (select *, case when best is null or f1 > best + 1e-6 then 1 else 0 end as better from h), i as (select *, sum(better) over (partition by run order by epoch) as grp from g), b as (select *, row_number() over (partition by run, grp order by epoch) - 1 as bad from i)
select run, min(case when bad >= 3 then epoch end) as stop_epoch, max(f1) as best_f1 from b group by 1""",
          """with h as (select user_id as run, epoch, f1, max(f1) over (partition by user_id order by epoch rows between unbounded preceding and 1 preceding) as best from (select user_id, (row_number() over (partition by user_id order by event_id))::int as epoch, value as f1 from {events})),
g as (select *, case when best is null or f1 > best + 1e-6 then 1 else 0 end as better from h), i as (select *, sum(better) over (partition by run order by epoch) as grp from g), b as (select *, row_number() over (partition by run, grp order by epoch) - 1 as bad from i)
select run, min(case when bad >= 3 then epoch end) as stop_epoch, max(f1) as best_f1 from b group by 1""")
