"""What chat formatting reads to link calls and results."""

from __future__ import annotations

from parley.llm import chat


def test_texts_are_not_parsed_for_each_branch_that_links_them(spark, monkeypatch):
    plans, cut = [], chat.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower())
        return cut(df)

    monkeypatch.setattr(chat, "cut", seen)
    call, answer = '{"tool_calls":[{"id":"%s","name":"search","arguments":{"query":"x"}}]}', '{"tool_call_id":"%s","content":"y"}'
    both = '{"tool_call_id":"a","tool_calls":[{"id":"b","name":"search","arguments":{"query":"x"}}]}'
    rows = [(1, 0, "tool", answer % "b"), (1, 1, "tool", both), (1, 2, "assistant", call % "a"), (1, 3, "user", "plain"), (2, 0, "tool", answer % "c"), (2, 1, "assistant", call % "c")]
    found = chat.chat_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r["conv_id"], r["turn"], r["place"], r["depth"], r["linked"]) for r in found.collect())
    assert got == [(1, 0, 2, 2, True), (1, 1, 2, 1, True), (1, 2, 2, 0, False), (1, 3, 3, 0, False), (2, 0, 1, 1, True), (2, 1, 1, 0, False)]
    assert plans and not any("variant" in p or "parsejson" in p for p in plans)
