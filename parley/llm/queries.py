"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_messages, format_chats
from .clustering import DIMENSIONS, cluster_vectors
from .decontaminate import contamination
from .importance import importance_sample
from .language_id import identify_languages
from .licenses import license_scan
from .line_dedup import duplicate_lines
from .mixing import LANGUAGES, TOPICS, mix
from .near_dedup import near_duplicates
from .shared import read
from .substring_dedup import drop_repeats
from .token_counts import token_counts
from .topk import top_k
from .toxicity import toxicity

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = f"""
with d as (select doc_id, {_ALNUM_WORDS} as w from documents),
b as (select item_id, {_ALNUM_WORDS} as w from benchmark),
bw as (select distinct item_id, len(w[i:i + 9]) as size, array_to_string(w[i:i + 9], ' ') as gram
       from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
sizes as (select distinct size from bw),
dw as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as gram
       from (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as i from d, sizes)),
hits as (select doc_id, i, dw.size, item_id from dw join bw using (gram)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + size - 1)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the dropped line numbers, comma-joined."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    found = lines.join(duplicate_lines(docs), "doc_id", "left")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, threshold="17/20")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP6_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
      from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations"))


#: The same for turns of plain text; turns that are JSON objects (tool calls and results) are tested by brute force.
OP7_SQL = """
with m as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
           where conv_id is not null and turn is not null),
j as (select conv_id, turn // 1000 as part, turn, role, text, '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' as json from m)
select conv_id, part, count(*) as n_messages, 0::bigint as n_calls, 0::bigint as n_results, 0::bigint as n_linked, 0::bigint as n_moved,
       0::bigint as n_invalid, '[' || string_agg(json, ',' order by turn, role, json) || ']' as messages
from j group by conv_id, part
"""


def tool_call_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats made of orders, one a customer: each order is a call of a tool and its result, which stands before its call
    if the order is finished; the arguments of urgent ones have a wrong type."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("conv_id"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey").cast("string")
    limit = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit('"many"')).otherwise((F.col("o_orderkey") % 100).cast("string"))
    call = F.concat(F.lit('{"tool_calls":[{"id":"c'), key, F.lit('","name":"search","arguments":{"query":"'), "o_orderpriority", F.lit('","limit":'), limit, F.lit("}}]}"))
    result = F.concat(F.lit('{"tool_call_id":"c'), key, F.lit('","content":"found"}'))
    turn = 3 * F.col("o_orderkey").cast("long")
    early = F.when(F.col("o_orderstatus") == "F", -2).otherwise(1)
    turns = F.array(*(F.struct(t.alias("turn"), F.lit(role).alias("role"), text.alias("text")) for t, role, text in ((turn, "assistant", call), (turn + early, "tool", result))))
    messages = chat_messages(orders.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.*"))
    return messages.select("conv_id", "turn", "place", F.col("depth").cast("int"), "moved", "role", "n_calls", "n_invalid", "is_result", "linked", "json")


TOOL_CALL_SQL = """
with o as (select distinct o_custkey, o_orderkey, o_orderstatus = 'F' as early, o_orderpriority = '1-URGENT' as wrong, o_orderpriority from orders)
select o_custkey as conv_id, 3 * o_orderkey::bigint as turn, 3 * o_orderkey::bigint as place, 0::int as depth, false as moved, 'assistant' as role,
       1::bigint as n_calls, (case when wrong then 1 else 0 end)::bigint as n_invalid, false as is_result, false as linked,
       '{"content":"","role":"assistant","tool_calls":[{"arguments":{"limit":' || (case when wrong then '"many"' else (o_orderkey % 100)::varchar end)
       || ',"query":"' || o_orderpriority || '"},"id":"c' || o_orderkey || '","name":"search"}]}' as json from o
union all
select o_custkey, 3 * o_orderkey::bigint + (case when early then -2 else 1 end), 3 * o_orderkey::bigint + (case when early then 0 else 1 end),
       (case when early then 1 else 0 end)::int, early, 'tool', 0, 0, true, true,
       '{"content":"found","role":"tool","tool_call_id":"c' || o_orderkey || '"}' from o
"""


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), limit=512)


#: Equal shares for the sources; languages and length bands as given.
MIX_TARGETS = {"source": None, "lang": LANGUAGES, "topic": TOPICS}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), MIX_TARGETS)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), F.round("residual", 6).alias("residual"), "sampled")


def _mix_sql(sweeps: int = 12, rate: float = 0.5) -> str:
    given = {"source": "1.0::double", "lang": _case("lang", LANGUAGES), "topic": _case("topic", TOPICS)}
    steps, last = [], "c0"
    total = "(select sum(tokens) from cells)::double"
    shares = {}
    for d, named in given.items():
        present = f"(select sum(s) from (select distinct {d}, {named} as s from cells where tokens > 0))"
        rest = f"(1 - coalesce((select sum(tokens) from cells where {named} is null), 0) / {total})"
        shares[d] = f"coalesce({named} / {present} * {rest}, sum(tokens) over (partition by {d}) / {total})"
    for sweep in range(sweeps):
        for i, d in enumerate(given):
            name = f"c{3 * sweep + i + 1}"
            part = f"sum(w * tokens) over (partition by {d})"
            steps.append(f"{name} as materialized (select source, lang, topic, tokens, case when {part} > 0 then w * {shares[d]} * {total} / {part} else 0 end as w from {last})")
            last = name
    return f"""
with d as (select doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::bigint as n_tokens from documents),
t as (select *, case when n_tokens < 150 then 'brief' when n_tokens < 600 then 'medium' else 'long' end as topic from d),
cells as materialized (select source, lang, topic, sum(n_tokens)::bigint as tokens from t group by all),
c0 as (select *, case when tokens > 0 then 1.0::double else 0.0::double end as w from cells),
{", ".join(steps)},
gap as (select round(coalesce(greatest({", ".join(f"max(g_{d})" for d in given)}), 0), 6) as residual from (select {", ".join(f"abs(sum(w * tokens) over (partition by {d}) / sum(w * tokens) over () - {shares[d]}) as g_{d}" for d in given)} from {last} where tokens > 0)),
p as (select source, lang, topic, w, least(1.0::double, {rate}::double * w) as p from {last})
select doc_id, t.source, t.lang, t.topic, n_tokens, round(w, 6) as weight, round(p, 6) as probability, residual,
       ('0x' || substr(md5('mix-' || doc_id), 1, 8))::bigint / 4294967296.0::double < p as sampled
from t cross join gap join p on t.source is not distinct from p.source and t.lang is not distinct from p.lang and t.topic = p.topic
"""


def _case(column: str, shares: dict[str, float]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}::double" for k, v in shares.items()) + " end"


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(read(spark, sf_dir, "documents"), n=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
v as materialized (select r, i, md5_number(array_to_string(w[i:i + 34], ' ')) as g from (select r, w, unnest(generate_series(1, len(w) - 34)) as i from d where len(w) >= 35)),
again as (select r, i from v join (select g from v group by g having count(*) > 1) using (g)),
gone as (select r, list(distinct p) as p from (select r, unnest(generate_series(i, i + 34)) as p from again) group by r),
kept as (select d.doc_id, d.w, coalesce(p, []) as p, [x for x, i in d.w if not list_contains(coalesce(p, []), i)] as k from d left join gone using (r))
select doc_id, len(w)::bigint as n_words, len(p)::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""


def op12_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), most=1, buckets=10_000, seed=2024, percent=10, least_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB has no crc32, so its table for each byte is worked out first, and words are folded byte by byte.
OP12_SQL = f"""
with recursive bits as (select i, 0 as step, i::bigint as c from range(256) as t(i)
  union all select i, step + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from bits where step < 8),
t as materialized (select list(c order by i) as t from bits where step = 8),
d as materialized (select row_number() over () as r, doc_id, {_ALNUM_WORDS} as w from documents),
b as materialized (select {_ALNUM_WORDS} as w from benchmark),
known as (select distinct unnest(w) as word from (select w from d union all select w from b)),
hexed as (select word, hex(encode(word)) as x from known),
crc as materialized (select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i::int + 1, 2))::bigint)),
  lambda c, byte: xor(c // 256, t[xor(c, byte) % 256 + 1])), 4294967295::bigint) % 10000 as bucket from hexed, t),
dw as materialized (select r, bucket from (select r, unnest(w) as word from d) join crc using (word)),
s as (select bucket, count(*) as s from dw group by 1),
tt as (select bucket, count(*) as t from (select unnest(w) as word from b) join crc using (word) group by 1),
g as materialized (select k as bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select count(*) from dw) + 10000) / ((coalesce(s, 0) + 1.0::double) * (coalesce((select sum(t) from tt), 0)::double + 10000))))::bigint as gain
  from range(10000) as x(k) left join s on s.bucket = k left join tt on tt.bucket = k),
m as (select r, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from dw join g using (bucket) group by r),
h as (select d.doc_id, len(w) as words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h from d left join m using (r)),
scored as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from h),
o as (select *, words >= 20 and doc_id is not null as may, row_number() over (partition by words >= 20 and doc_id is not null order by score desc, doc_id) as place, sum((words >= 20 and doc_id is not null)::int) over () as n from scored)
select doc_id, n_features::bigint as n_features, weight, score, case when may and place <= 10 * n // 100 then place end::bigint as rank from o
"""


def op13_cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


def _cluster_sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    steps = []
    for number in range(rounds + 1):
        steps.append(f"""near{number} as materialized (select r, min({{'d': list_sum([(q[i] - c[i]) * (q[i] - c[i]) for i in range(1, {DIMENSIONS + 1})])::bigint, 'k': k}}) as m from v, c{number} group by r)""")
        if number < rounds:
            steps.append(f"""mean{number} as (select k, list(x order by i) as c from (select m.k as k, i, floor(sum(q[i])::hugeint / count(*))::bigint as x from near{number} join v using (r), range(1, {DIMENSIONS + 1}) as t(i) group by all) group by k),
c{number + 1} as materialized (select k, coalesce(mean{number}.c, c{number}.c) as c from c{number} left join mean{number} using (k))""")
    return f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by o, q) - 1 as k, q as c from (select sha256('{seed}:' || vec_id) as o, q from v where vec_id is not null order by o, q limit {k})),
{", ".join(steps)}
select vec_id, m.k::int as cluster, m.d as distance, (sum(m.d) over (partition by m.k))::bigint as cluster_inertia, (sum(m.d) over ())::bigint as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from near{rounds} join v using (r) join c{rounds} on c{rounds}.k = m.k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_line_dedup": op2_line_dedup,
        "op3_near_dedup": op3_near_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_language_id": op5_language_id,
        "op6_top_k": op6_top_k,
        "op7_chat_format": op7_chat_format,
        "tool_call_chats": tool_call_chats,
        "op8_token_counts": op8_token_counts,
        "op9_mixing": op9_mixing,
        "op10_license_scan": op10_license_scan,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_importance_sample": op12_importance_sample,
        "op13_cluster_vectors": op13_cluster_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op6_top_k": OP6_SQL, "op7_chat_format": OP7_SQL, "tool_call_chats": TOOL_CALL_SQL, "op9_mixing": _mix_sql(), "op11_substring_dedup": OP11_SQL, "op12_importance_sample": OP12_SQL, "op13_cluster_vectors": _cluster_sql()}
