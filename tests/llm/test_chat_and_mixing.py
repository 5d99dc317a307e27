"""Chat formatting, mixing and the corpus pipeline."""

from __future__ import annotations

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm.chat import chat_messages, format_chats
from parley.llm.decontaminate import contamination
from parley.llm.mixing import LANGUAGES, TOPICS, largest_error, mix, rake
from parley.llm.queries import MIX_TARGETS

from .test_pairs import brute_near, docs_of

TURNS = "conv_id long, turn long, role string, text string"


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def answer(i, text):
    return json.dumps({"tool_call_id": i, "content": text})


def test_tool_calls_are_linked_ordered_and_checked(spark):
    rows = [
        (1, 0, "user", 'what is "this"?'),
        (1, 1, "tool", answer("a", "42")),
        (1, 2, "assistant", call(("a", "calculator", {"expression": "6*7"}), ("b", "search", {"query": "x", "limit": "ten"}))),
        (1, 3, "tool", answer("b", "none")),
        (1, 4, "tool", answer("zzz", "lost")),
        (1, 5, "assistant", call(("c", "weather", {"days": 2, "city": "Rome"}), ("d", "unknown", {}), ("e", "calculator", {"expression": "1", "more": 1}), (None, "calculator", {"expression": "1"}))),
    ]
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as place", "2 as calls", "3 as json")
    by = {r["turn"]: r for r in chat_messages(frame).collect()}
    assert (by[1]["place"], by[1]["moved"], by[1]["linked"]) == (2, True, True)
    assert (by[3]["place"], by[3]["linked"], by[4]["linked"], by[4]["is_result"]) == (3, True, False, True)
    assert (by[2]["n_calls"], by[2]["n_invalid"], by[5]["n_calls"], by[5]["n_invalid"]) == (2, 1, 4, 3)
    out = format_chats(frame).first()
    messages = json.loads(out["messages"])
    assert [m["content"] for m in messages] == ['what is "this"?', "", "42", "none", "lost", ""]
    assert (out["n_messages"], out["n_calls"], out["n_results"], out["n_linked"], out["n_moved"], out["n_invalid"]) == (6, 6, 3, 2, 1, 4)
    assert messages[5]["tool_calls"][0] == {"arguments": {"city": "Rome", "days": 2}, "id": "c", "name": "weather"}
    assert '{"arguments":{"city":"Rome","days":2},"id":"c","name":"weather"}' in out["messages"]


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 1, "user", "x"), (2, None, "user", "x"), (3, 5, "user", "{broken"), (3, 6, "user", "[1]"), (3, 6, "user", "{}"), (4, 2500, "user", "y " * 40_000), (4, 1, "tool", answer("q", "a")), (4, 2500, "assistant", call(("q", "search", None)))]
    frame = spark.createDataFrame(rows, TURNS)
    found = {(r["conv_id"], r["part"]): r for r in format_chats(frame).collect()}
    assert set(found) == {(1, 0), (3, 0), (4, 2)} and found[1, 0]["messages"] == '[{"content":"","role":"unknown"}]'
    assert json.loads(found[3, 0]["messages"])[0]["content"] == "{broken" and found[3, 0]["n_messages"] == 3
    assert found[4, 2]["n_moved"] == 1 and found[4, 2]["n_invalid"] == 1
    assert format_chats(frame.limit(0)).count() == 0


def brute_order(turns):
    """Places, level by level, of (turn, answers, call ids) with distinct turns."""
    first = {}
    for turn, _, ids in sorted(turns):
        for i in ids:
            first.setdefault(i, turn)
    answers = {turn: a for turn, a, _ in turns}
    caller = {t: first[a] for t, a in answers.items() if a in first}
    out = {}
    for t in answers:
        path = [t]
        while path[-1] in caller and caller[path[-1]] not in path:
            path.append(caller[path[-1]])
        if path[-1] in caller:
            out[t] = (t, 0)
            continue
        place, depth = path[-1], 0
        for x in reversed(path[:-1]):
            place, depth = (x, 0) if x > place else (place, depth + 1)
        out[t] = (place, depth)
    return out


def test_order_of_chains_circles_and_repeated_ids(spark):
    import random

    rng = random.Random(11)
    rows, expected = [(1000, 5, "assistant", call(("a", "search", {"query": "x"}))), (1000, 3, "tool", json.dumps({"tool_call_id": "a", "tool_calls": [{"id": "b", "name": "search"}]})), (1000, 4, "tool", answer("b", "y"))], {}
    for conv in range(40):
        turns = []
        for turn in rng.sample(range(100), 12):
            turns.append((turn, rng.choice("abcdefghz") if rng.random() < 0.7 else None, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 2))]))
        rows += [(conv, t, "tool", json.dumps({"tool_call_id": a, "tool_calls": [{"id": i, "name": "search", "arguments": {"query": "q"}} for i in ids]})) for t, a, ids in turns]
        expected |= {(conv, t): x for t, x in brute_order(turns).items()}
    expected |= {(1000, 5): (5, 0), (1000, 3): (5, 1), (1000, 4): (5, 2)}
    got = {(r["conv_id"], r["turn"]): (r["place"], r["depth"]) for r in chat_messages(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == expected


def test_nested_schemas(spark):
    good = {"title": "t", "kind": "call", "guests": ["a", "b"], "place": {"city": "Rome", "room": 3}}
    cases = [(good, 0), ({"title": "t", "kind": "call"}, 0), (good | {"kind": "party"}, 1), (good | {"guests": ["a", 1]}, 1), (good | {"guests": "a"}, 1), (good | {"guests": []}, 0), (good | {"place": {"room": 3}}, 1), (good | {"place": {"city": "Rome", "floor": 1}}, 1), (good | {"place": {"city": "Rome", "room": "3"}}, 1), ({"kind": "call"}, 1)]
    rows = [(i, 0, "assistant", call(("x", "calendar", a))) for i, (a, _) in enumerate(cases)]
    got = {r["conv_id"]: r["n_invalid"] for r in chat_messages(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {i: n for i, (_, n) in enumerate(cases)}


# Mixing


def test_sampled_shares_do_not_hang_on_a_tiny_source(spark):
    texts = [(i, "w " * (50 + 97 * i % 900)) for i in range(4000)]
    docs = docs_of(spark, texts).selectExpr("doc_id", "text", "case when doc_id = 0 then 'tiny' when doc_id % 3 = 0 then 'a' else 'b' end as source", "element_at(array('en', 'de', 'es', 'fr', null), cast(doc_id % 5 + 1 as int)) as lang", "1 as _weight", "2 as of_weight", "3 as _topic")
    found = mix(docs, {"source": {"a": 0.5, "b": 0.5}, "lang": LANGUAGES})
    assert {"_weight", "of_weight", "_topic"} <= set(found.columns) and found.count() == 4000
    rows = [r for r in found.collect() if r["sampled"]]
    total = sum(r["n_tokens"] for r in rows)
    assert 0.45 < total / sum(len(t.split()) for _, t in texts) < 0.52
    share = sum(r["n_tokens"] * r["weight"] / r["probability"] for r in rows if r["source"] == "a") / sum(r["n_tokens"] * r["weight"] / r["probability"] for r in rows)
    assert share == pytest.approx(0.5, abs=0.03)
    none = sum(r["n_tokens"] for r in rows if r["lang"] is None) / total
    assert none == pytest.approx(0.2, abs=0.03)


def test_sweeps_of_the_query_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = mix(docs, MIX_TARGETS)
    cells = mixed.groupBy(*MIX_TARGETS).agg({"n_tokens": "sum", "weight": "max"}).toDF(*MIX_TARGETS, "tokens", "weight")
    assert largest_error(cells, MIX_TARGETS) < 1e-3


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([(s, lang, t, 100 + 37 * i) for i, (s, lang, t) in enumerate((s, lang, t) for s in "abc" for lang in LANGUAGES for t in TOPICS)], "source string, lang string, topic string, tokens long")
    rows = rake(cells, MIX_TARGETS, 30).collect()
    total = sum(r["weight"] * r["tokens"] for r in rows)
    for d, target in (("source", dict.fromkeys("abc", 1 / 3)), ("lang", LANGUAGES), ("topic", TOPICS)):
        share = defaultdict(float)
        for r in rows:
            share[r[d]] += r["weight"] * r["tokens"] / total
        assert share == pytest.approx(target, abs=1e-6)


def test_mix_edges(spark):
    docs = docs_of(spark, [(i, "some words here " * (1 + i % 9)) for i in range(300)] + [(None, "words"), (500, None), (501, ""), (5, "some words here"), (502, "w " * 50_000)])
    odd = docs.selectExpr("*", "1 as weight", "2 as sampled", "3 as tokens", "4 as _weight0")
    found = mix(odd, MIX_TARGETS)
    rows = found.collect()
    assert len(rows) == 305 and len(set(found.columns)) == len(found.columns)
    by = {r["doc_id"]: r for r in rows}
    assert not by[None]["sampled"] and by[500]["n_tokens"] == 0 and all(0 <= (r["probability"] or 0) <= 1 for r in rows)
    assert sum(r["sampled"] for r in rows) > 0
    assert sorted(r["doc_id"] or 0 for r in mix(odd, MIX_TARGETS).where("sampled").collect()) == sorted(r["doc_id"] for r in rows if r["sampled"])
    assert mix(odd.limit(0), MIX_TARGETS).count() == 0


def test_a_topic_of_the_documents_is_used_and_unmatched_targets_are_refused(spark):
    docs = docs_of(spark, [(i, "some words here " * (1 + i % 9)) for i in range(400)]).selectExpr("*", "case when doc_id % 4 = 0 then 'a' else 'b' end as topic", "7 as residual")
    found = mix(docs, {"topic": {"a": 0.5, "b": 0.5}}, rate=0.5)
    share = {r["topic"]: r["w"] for r in found.groupBy("topic").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("w")).collect()}
    assert set(share) == {"a", "b"} and share["a"] == pytest.approx(share["b"], rel=1e-6)
    assert [r["residual"] for r in found.select("residual").distinct().collect()] == [pytest.approx(0, abs=1e-9)]
    given = mix(docs, {"topic": {"x": 0.5, "y": 0.5}}, topic=F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y"))
    assert {r["topic"] for r in given.select("topic").distinct().collect()} == {"x", "y"}
    with pytest.raises(ValueError, match="no value of topic"):
        mix(docs, {"topic": {"brief": 0.5, "long": 0.5}})
    # Two marginals that can't both be met leave a gap, and it is told.
    odd = docs.selectExpr("doc_id", "text", "topic", "topic as source")
    assert mix(odd, {"topic": {"a": 0.5, "b": 0.5}, "source": {"a": 0.9, "b": 0.1}}).first()["residual"] == pytest.approx(0.4, abs=0.01)


def test_values_without_a_target_keep_their_share(spark):
    cells = spark.createDataFrame([("en", 600), ("de", 200), ("pl", 150), (None, 50)], "lang string, tokens long")
    got = {r["lang"]: r["weight"] * r["tokens"] / 1000 for r in rake(cells, {"lang": LANGUAGES}).collect()}
    assert got == pytest.approx({"en": 0.8 * 2 / 3, "de": 0.8 / 3, "pl": 0.15, None: 0.05}, abs=1e-6)


# Pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).checkpoint()
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "near_dedup":
            sets = brute_near([(r["doc_id"], r["text"]) for r in before.collect()], 5, 4, 5)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, (_, _, kept) in sets.items() if kept)
        if name == "decontaminate":
            dirty = {r["doc_id"] for r in contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r["contaminated"]}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - dirty
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    final = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "weight", "probability"} <= set(final.columns) and 0 < final.count() <= sizes[-1]


def test_pipeline_edges(spark):
    docs = docs_of(spark, [(None, None), (1, None), (2, ""), (3, "a\n" * 30_000), (3, "a\n" * 30_000)] + [(i, f"this is the plain text of document number {i} with words\nand a second line {i}") for i in range(10, 40)]).withColumnRenamed("n_chars", "n_tokens")
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, "/root/testdata/sf0.001").checkpoint()
        assert kept.count() <= table.count()


def test_stages_are_five_named_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mixing"] and corpus_pipeline.ORACLE_SQL is None
