"""The satisfaction operators on hand-made cells, against plain formulas; streams of several batches; evidence."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.config import LABELS
from parley.operators import events, learning, satisfaction, windows
from parley.streaming import live

CELL = "call_id long, speaker string, cell long, t double, p array<double>, conf double, tension double, agreement double, text_score double, text_frust double"


def cells_of(spark, n, call=1, **more):
    rows = []
    for i in range(n):
        raw = [1.0 + (i * 7 + k * 3) % 11 + (20 if (i // 12) % 7 == k else 0) for k in range(len(LABELS))]
        p = [x / sum(raw) for x in raw]
        one = {"tension": (i % 10) / 10, "agreement": None, "text_score": None, "text_frust": None} | {k: f(i) for k, f in more.items()}
        rows.append((call, "a", i, i + 0.5, p, max(p), one["tension"], one["agreement"], one["text_score"], one["text_frust"]))
    return spark.createDataFrame(rows, CELL), rows


def test_features_are_39_numbers_by_formula(spark):
    frame, rows = cells_of(spark, 50, text_score=lambda i: 0.2 if i % 2 else None)
    got = satisfaction.call_features(frame, ["call_id", "speaker"]).first()["features"]
    parts = satisfaction.components(frame, ["call_id", "speaker"]).first()
    order = [LABELS.index(x) for x in ("angry", "disgust", "fear", "happy", "neutral", "sad", "surprise")]

    def mean(some):
        return [sum(r[4][k] for r in some) / len(some) for k in order]

    first, last = mean(rows[:16]), mean(rows[-16:])
    assert len(got) == 39
    assert got[:28] == pytest.approx(mean(rows) + first + last + [b - a for a, b in zip(first, last, strict=True)])
    assert got[28:33] == pytest.approx([parts[c] for c in ("signal", "final_state", "trend", "persistence", "stability")])
    assert got[33] == pytest.approx(0.2) and got[34] == pytest.approx(sum(r[6] for r in rows) / 50) and got[38] == pytest.approx(math.log(51))
    assert got[37] >= got[35] > 0


def test_modes_and_calibration(spark):
    frame, _ = cells_of(spark, 40)
    found = satisfaction.components(frame, ["call_id"])
    none, model = F.lit(None).cast("double"), F.lit(140.0)
    row = found.select(
        "score", satisfaction.final_score().alias("rules"), satisfaction.final_score("model", model).alias("model"), satisfaction.final_score("model", none).alias("without"),
        satisfaction.final_score("hybrid", F.lit(20.0), 0.25).alias("hybrid"), satisfaction.final_score(calibration={"enabled": True, "a": 0.0, "b": 120.0}).alias("high"),
    ).first()
    assert row["rules"] == row["score"] == row["without"] and row["model"] == 100 and row["high"] == 100
    assert row["hybrid"] == pytest.approx(0.25 * 20 + 0.75 * row["score"])
    with pytest.raises(ValueError):
        satisfaction.final_score("magic")


def test_agreement_moves_the_confidence(spark):
    def confidence(agreement, mismatch=False):
        return satisfaction.confidence(cells_of(spark, 60, agreement=agreement)[0], ["call_id"], mismatch=mismatch).first()["confidence"]

    assert confidence(lambda i: 1.0) > confidence(lambda i: None) > confidence(lambda i: 0.0)
    assert confidence(lambda i: 0.5, True) == pytest.approx(0.85 * confidence(lambda i: 0.5), abs=2e-3)
    assert confidence(lambda i: None, True) == pytest.approx(0.6 * confidence(lambda i: None), abs=2e-3)
    metrics = satisfaction.speaker_metrics(cells_of(spark, 60, agreement=lambda i: 0.25 if i % 3 else None)[0], ["call_id"]).first()
    assert metrics["agreement"] == pytest.approx(0.25) and metrics["text_coverage"] == pytest.approx(2 / 3) and metrics["analyzed_s"] == 60


@pytest.mark.parametrize("n", [5, 6, 9, 10, 11, 40])
def test_smoothing_of_short_and_long_series(spark, n):
    values = [((i * 37) % 17) / 3 for i in range(n)]
    frame = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k long, t long, x double")
    got = [r["x"] for r in windows.smooth_all(frame, ["k"], "t", ["x"], 10).orderBy("t").collect()]
    k = min(10, n)
    expected = []
    for i in range(n):
        part = values[max(0, i - k // 2) : i + k - k // 2]
        expected.append(sum(part) / len(part))
    assert got == pytest.approx(expected)


def test_shifts_need_two_windows_and_a_cell(spark):
    def found(n):
        rows = [(1, "a", i + 0.5, 0.9 if i < n // 2 else -0.9, 0.8) for i in range(n)]
        return [r["type"] for r in events.shifts(spark.createDataFrame(rows, "call_id long, speaker string, t double, v double, local double")).collect()]

    assert found(60) == [] and found(62) == ["emotional_shift"]


def test_evidence_of_events(spark):
    said = [(1, "a", 1, "far", 0, 1000, 0.9, 0.9), (1, "a", 2, "near " * 80, 95_000, 97_000, 0.1, 0.7), (1, "a", 3, "mood", 110_000, 112_000, -0.8, 0.1), (1, "a", 4, "flat", 101_000, 102_000, 0.0, 0.05), (1, "b", 5, "other", 100_000, 101_000, 0.3, 0.9), (1, "a", 6, "long one", 20_000, 190_000, 0.2, 0.3)]
    utterances = spark.createDataFrame(said, "call_id long, speaker string, turn long, text string, start_ms long, end_ms long, text_score double, text_frust double")
    found = spark.createDataFrame([(1, "a", 100.0, "anger_peak"), (1, "a", 100.0, "positive_peak"), (1, None, 100.0, "possible_conflict"), (2, "a", 5.0, "recovery")], "call_id long, speaker string, t double, type string")
    got = {r["type"]: [(x["text"][:8], x["start"], x["weight"]) for x in r["evidence"]] for r in events.evidence(found, utterances).collect()}
    assert got["anger_peak"] == [("near nea", 95.0, 0.7), ("long one", 20.0, 0.3)]
    assert got["positive_peak"] == [("mood", 110.0, 0.8), ("long one", 20.0, 0.2)]
    assert [x[0] for x in got["possible_conflict"]] == ["other", "near nea"] and got["recovery"] == []


def test_separation_is_that_of_all_pairs(spark):
    rows = [(k, [math.cos(a + 0.1 * i), math.sin(a + 0.1 * i), 0.2 * i]) for k, a, n in ((0, 0.0, 5), (1, 1.5, 3)) for i in range(n)]
    got = learning.separation(spark.createDataFrame(rows, "k int, v array<double>"), "v", "k").first()

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    groups = [[v for k, v in rows if k == g] for g in (0, 1)]
    intra = [sum(cosine(a, b) for i, a in enumerate(g) for b in g[:i]) / (len(g) * (len(g) - 1) / 2) for g in groups]
    inter = sum(cosine(a, b) for a in groups[0] for b in groups[1]) / 15
    centres = [[sum(x) / len(g) for x in zip(*g, strict=True)] for g in groups]
    assert got["gap"] == pytest.approx(sum(intra) / 2 - inter) and got["similarity"] == pytest.approx(cosine(*centres), abs=1e-6)
    assert got["n"] == 8 and got["minor_share"] == pytest.approx(3 / 8)
    one = learning.separation(spark.createDataFrame(rows[:6], "k int, v array<double>"), "v", "k").first()
    assert (one["similarity"], one["gap"]) == (1.0, 0.0)


def test_complete_mode_reads_the_newest_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 20:02d}:{i % 60:02d}:00", i % 3, float(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts")).withColumn("event_type", F.lit("x"))
    source = str(tmp_path / "events")
    for part in (frame.where("event_id < 100"), frame.where("event_id >= 100")):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = live.into_table(spark, live.windows(stream), "windows", "complete")
    assert found.agg(F.sum("n")).first()[0] == 200
    sessions = live.into_table(spark, live.sessions(stream), "sessions", "complete")
    assert sessions.agg(F.sum("n")).first()[0] == 200


def test_progress_is_throttled_across_batches(spark, tmp_path):
    rows = [(i % 3, "vad" if i % 2 else "asr", i * 0.4, float((i * 7) % 130 - 10) if i % 5 else float(i % 101)) for i in range(240)] + [(1, "vad", None, 5.0), (1, "vad", 99.0, None)]
    frame = spark.createDataFrame(rows, "call_id long, stage string, at double, pct double")
    source = str(tmp_path / "reports")
    for part in (frame.where("at < 40"), frame.where("at >= 40 or at is null")):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = sorted((r["call_id"], r["stage"], r["at"], r["pct"]) for r in live.into_table(spark, live.throttled_progress(stream), "progress").collect())
    expected, last = [], {}
    for call, stage, at, pct in sorted((r for r in rows if None not in r), key=lambda r: r[2]):
        pct = min(100.0, max(0.0, pct))
        then, before = last.get((call, stage), (0.0, -1.0))
        if pct >= 100 or at - then >= 1.5 or abs(pct - before) >= 2:
            last[call, stage] = (at, pct)
            expected.append((call, stage, at, round(pct, 1)))
    assert got == sorted(expected) and 0 < len(got) < 240


def test_windows_and_sessions_over_several_batches_with_bounded_state(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").orderBy("ts")
    rows = [(r["event_id"], r["ts"], r["user_id"], r["event_type"], r["value"]) for r in events.collect()]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for i in range(6):
        part = rows[i * len(rows) // 6 : (i + 1) * len(rows) // 6]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    whole = spark.createDataFrame(rows, schema)
    held = []

    def noted(of_state):
        def read(state):
            held.append(state.count())
            return of_state(state)

        return read

    found = live.with_open(spark, live.windows(stream()), "windows", noted(live.open_windows)).collect()
    expected = whole.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).collect()
    shown = lambda rows: sorted((r["start"], r["event_type"], r["n"], round(r["value"], 6)) for r in rows)
    assert shown(found) == shown(expected)
    found = live.with_open(spark, live.sessions(stream()), "sessions", noted(live.open_sessions)).collect()
    expected = whole.groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))
    # Thirty minutes of lateness and an hour of width: nothing else is kept.
    assert held[0] <= 3 * 5 and held[1] <= whole.where(F.col("ts") > F.lit(rows[-1][1]) - F.expr("interval 150 minutes")).count()


def test_timeline_is_that_of_components_over_slices(spark):
    """The matrix of slices against the windows of components() over copies of the cells."""
    from parley.operators import satisfaction
    from parley.operators.series import trailing_slices

    keys = ["call_id", "speaker"]
    rng = np.random.default_rng(4)
    rows = []
    for call in range(12):
        at = 0
        for _ in range(int(rng.integers(1, 260))):
            at += 1 if rng.random() < 0.93 else int(rng.integers(2, 90))
            p = rng.dirichlet(np.ones(7) * (0.4 if call % 2 else 3))
            rows.append((call, "A", at, at + 0.5, [float(x) for x in p], float(p.max()), float(rng.random()) if rng.random() < 0.5 else None, float(rng.uniform(-1, 1)) if rng.random() < 0.3 and call % 3 else None))
    cells = spark.createDataFrame(rows, "call_id long, speaker string, cell long, t double, p array<double>, conf double, tension double, text_score double").checkpoint()
    sliced = trailing_slices(cells, keys, 10.0, 60.0)
    scored = satisfaction.components(sliced, [*keys, "k"], final=(0.4, 5, 60), trend_factor=0.5)
    ends = {r["call_id"]: r["d"] for r in cells.groupBy("call_id").agg((F.max("cell") + 1).alias("d")).collect()}
    by = {(r["call_id"], r["k"]): (r["n"], r["score"]) for r in scored.collect()}
    expected = []
    for call, duration in ends.items():
        ema = None
        for k in range(-(-(duration + 10) // 10)):
            n, score = by.get((call, k), (0, None))
            if n >= 3:
                ema = score if ema is None else 0.35 * score + 0.65 * ema
            if ema is not None:
                expected.append((call, min(10.0 * k, float(duration)), round(ema, 8)))
    got = [(r["call_id"], r["t"], round(r["score"], 8)) for r in satisfaction.timeline(cells, keys).collect()]
    assert sorted(got) == sorted(expected) and len(got) > 100
