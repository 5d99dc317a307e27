"""Calls with very many turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import intervals, series
from parley.plans import fixtures, text_queries


def test_no_frame_runs_to_the_end_of_a_call(spark):
    said = [("a", 1000), ("c", 10), ("b", 500), ("c", 10), ("a", 900), ("d", 5), ("b", 400)]
    rows = [(1, s, i, 10_000 * i, 10_000 * i + d) for i, (s, d) in enumerate(said)] + [(2, "x", 0, 0, 1), (2, "y", 1, 5, 900), (2, "x", 2, 2000, 2001)]
    found = intervals.reduce_to_two(spark.createDataFrame(rows, "call_id long, speaker string, turn long, start_ms long, end_ms long"))
    assert [r["label"] for r in found.where("call_id = 1").orderBy("turn").collect()] == ["P1", "P1", "P2", "P2", "P1", "P1", "P2"]
    assert [(r["label"], r["n_speakers"]) for r in found.where("call_id = 2").orderBy("turn").collect()] == [("P1", 1)] * 3  # the first turn looks ahead
    plan = found._jdf.queryExecution().analyzed().toString().lower()
    assert "currentrow$(), unboundedfollowing$()" not in plan and "0, unboundedfollowing" not in plan


def test_seconds_are_dealt_by_the_number_of_turns(spark, tmp_path, monkeypatch):
    rows = [(c, t, ("user", "assistant")[t % 2], "word " * (1 + (c + t) % 40)) for c in range(60) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(fixtures, "TURNS_A_TASK", 20)
    plain = fixtures.cells(spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).collect()
    assert len({r["part"] for r in plain}) > 8  # of 13; a call's seconds are all in one
    assert len({(r["call_id"], r["part"]) for r in plain}) == len({r["call_id"] for r in plain}) == 60
    without = fixtures.cells(spark, str(tmp_path), texts=False).collect()
    assert {(r["call_id"], r["speaker"], r["cell"], r["conf"], r["tension"]) for r in plain} == {(r["call_id"], r["speaker"], r["cell"], r["conf"], r["tension"]) for r in without}
    assert {r["text_score"] for r in without} == {None} != {r["text_score"] for r in plain}


def test_flat_series_are_not_searched_for_peaks(spark):
    rows = [(k, float(t), 0.9 if k == 3 and t in (4, 12) else 0.1) for k in range(6) for t in range(20)]
    frame = spark.createDataFrame(rows, "k long, t double, v double").repartition(3)
    found = series.peaks(frame, ["k"], "t", "v", 0.5, 1)
    assert sorted(map(tuple, found.collect())) == [(3, 4.0, 0.9), (3, 12.0, 0.9)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 0.5" in plan and "FlatMapGroupsInArrow" in plan


def test_texts_are_redacted_in_small_batches(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.unset(n)
    docs = spark.createDataFrame([(1, "call 600123456 or a@b.com")], "doc_id long, text string")
    assert "a@b.com" not in text_queries.redacted(docs, "text").first()["text"]
    assert int(spark.conf.get(names[0])) <= 1000 and 0 < int(spark.conf.get(names[1])) <= 8 << 20
    for n, value in zip(names, before, strict=True):
        spark.conf.set(n, value)
