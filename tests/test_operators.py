"""Operators against hand-made cases and plain loops."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley import config
from parley.functions import lexicon
from parley.functions import text as tf
from parley.operators import events, intervals, learning, series, windows
from parley.sources import audio, tables
from parley.streaming import live

TURNS = "call_id long, turn long, speaker string, start_ms long, end_ms long"


def test_interaction_of_three_turns(spark):
    t = spark.createDataFrame([(1, 0, "S0", 0, 10_000), (1, 1, "S1", 8_000, 15_000), (1, 2, "S0", 25_000, 30_000)], TURNS)
    row = intervals.interaction(t).first()
    assert (row["overlaps"], row["overlap_ms"], row["long_silences"], row["longest_silence_ms"]) == (1, 2000, 1, 10_000)
    assert [(r["turn_a"], r["turn_b"]) for r in intervals.overlaps(t).collect()] == [(0, 1)]


def test_windows_of_an_hour(spark):
    t = spark.createDataFrame([(1, 0, "S0", 0, 3_600_000), (2, 0, "S0", 0, 900), (3, 0, "S0", 0, 5_000)], TURNS)
    rows = sorted((r["call_id"], r["w_start"], r["w_end"]) for r in windows.plan_windows(t, 5000, 2500, 1000).collect())
    hour = [r for r in rows if r[0] == 1]
    assert len(hour) >= 1439 and hour[-1][2] == 3_600_000 and {b[1] - a[1] for a, b in zip(hour, hour[1:], strict=False)} == {2500}
    assert [r for r in rows if r[0] > 1] == [(3, 0, 5000)]


def test_peaks_by_hand():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 0.5, 0, 3, 0])
    assert series.find_peaks(x, 0, 1).tolist() == [1, 4, 7, 9]
    assert series.find_peaks(x, 1, 1).tolist() == [1, 4, 9]
    assert series.find_peaks(x, 0, 4).tolist() == [4, 9]
    assert series.find_peaks(x, 0, 1, 1.0).tolist() == [1, 4, 9]
    assert series.find_peaks(np.zeros(5), 0, 1).tolist() == [] and series.find_peaks(np.array([1.0, 2.0]), 0, 1).tolist() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=30))
def test_peaks_are_local_maxima(values):
    x = np.array(values, float)
    expected = []
    i = 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            expected.append((i + j) // 2)
        i = j + 1
    assert series.find_peaks(x, -1, 1).tolist() == expected


def test_debounce_keeps_the_largest(spark):
    rows = [(1, float(t), v) for t, v in ((0, 0.5), (30, 0.9), (60, 0.8), (80, 0.7), (200, 0.1))]
    found = windows.debounce(spark.createDataFrame(rows, "k int, t double, v double"), ["k"], "t", "v", 45.0)
    assert sorted(r["t"] for r in found.collect()) == [30, 80, 200]


def test_blocks_are_cut_in_the_longest_silence(spark):
    t = spark.createDataFrame([(1, 0, "A", 0, 590_000), (1, 1, "A", 596_000, 1_190_000), (1, 2, "A", 1_195_000, 1_800_000), (2, 0, "A", 0, 600_000)], TURNS)
    rows = [(r["call_id"], r["b_start"], r["b_end"]) for r in series.plan_blocks(t, 600_000, 30_000).orderBy("call_id", "block").collect()]
    assert rows == [(1, 0, 593_000), (1, 593_000, 1_192_500), (1, 1_192_500, 1_800_000), (2, 0, 600_000)]


def test_utterances(spark):
    words = [("A", 0, 300, " Hola"), ("A", 300, 500, ","), ("A", 500, 900, " sí"), ("B", 900, 1200, " Bien"), ("B", 2600, 2900, " Adiós")]
    frame = spark.createDataFrame([(1, *w) for w in words], "call_id long, speaker string, start_ms long, end_ms long, word string")
    assert [(r["speaker"], r["text"]) for r in series.utterances(frame).orderBy("utterance").collect()] == [("A", "Hola, sí"), ("B", "Bien"), ("B", "Adiós")]


def sentiment(text, sign="reference"):
    """The same by a plain loop over matches."""
    clean = re.sub(r"\s+", " ", re.sub(r"[^\w\s'¿?¡!]", " ", text.lower().translate(str.maketrans("áéíóúüñ", "aeiouun")))).strip()
    if len(clean.split()) < 2:
        return 0.0, 0.0, 0.0, 0.0, "neutral"
    courtesies = [m.span() for p in lexicon.POLITENESS for m in re.finditer(p, clean)]
    f = pos = 0.0
    cues = 0
    for p, w in lexicon.FRUSTRATION:
        for _ in re.finditer(p, clean):
            f = min(1.0, max(f, w) + (0.15 if cues else 0))
            cues += 1
    for p, w in lexicon.POSITIVE:
        for m in re.finditer(p, clean):
            if any(a <= m.start() and m.end() <= b for a, b in courtesies):
                continue
            cues += 1
            if set(clean[: m.start()].split()[-3:]) & set(lexicon.NEGATORS):
                f = max(f, 0.5 * w)
            else:
                pos = max(pos, w)
    tokens, lex = clean.split(), 0.0
    for i, x in enumerate(tokens):
        no = bool(set(tokens[max(0, i - 3) : i]) & set(lexicon.NEGATORS))
        if x in lexicon.NEGATIVE_WORDS:
            lex += (1 if sign == "reference" else -1) * (-0.2 if no else 0.4)
        elif x in lexicon.POSITIVE_WORDS:
            lex += -0.3 if no else 0.25
    lex /= max(3.0, len(tokens) ** 0.5)
    score, evidence = math.tanh(1.2 * (pos - f) + lex), cues + min(abs(lex), 1)
    return score, min(1.0, 0.25 + 0.25 * evidence) if evidence > 0.2 else 0.15, f, pos, "positive" if score > 0.2 else "negative" if score < -0.2 else "neutral"


SENTENCES = [
    "Gracias por llamar, ¿en qué le puedo ayudar?", "Estoy harta, llevo tres días esperando y nadie me ayuda", "Muchas gracias, el problema quedó resuelto, excelente atención",
    "No me ayudó para nada", "Have a great day", "this is great, thank you so much", "terrible, the worst; I am fed up and angry", "no fue muy amable", "ok", "", "it is not good and it never works, wrong again",
    "nunca me llaman y siempre lo mismo, es inaceptable, pésima atención", "Que tenga un excelente día", "the issue is resolved, very helpful",
]


@pytest.mark.parametrize("sign", ["reference", "corrected"])
def test_sentiment_is_the_plain_loop(spark, sign):
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(SENTENCES)], "i int, s string")
    for r in frame.select("i", tf.lexicon_sentiment(F.col("s"), sign).alias("x")).select("i", "x.*").collect():
        score, confidence, f, pos, label = sentiment(SENTENCES[r["i"]], sign)
        if len(tf.re.findall(r"\S+", SENTENCES[r["i"]])) < 2:
            assert r["label"] == "neutral" and r["score"] == 0
            continue
        assert (r["score"], r["confidence"], r["frustration"], r["resolution"]) == pytest.approx((score, confidence, f, pos), abs=1e-4), SENTENCES[r["i"]]
        assert r["label"] == label


def test_personal_data():
    said = "Me llamo Ana López, mi correo es ana.lopez@example.com y mi teléfono 55 1234 5678"
    assert [e for e, _, _ in tf.pii_spans(said)] == ["PERSON", "EMAIL", "PHONE"]
    assert tf.redact(said) == "Me llamo [PERSONA], mi correo es [CORREO] y mi teléfono [TELEFONO]"
    assert tf.luhn("4539578763621486") and not tf.luhn("4539578763621487") and tf.redact("") == ""


def test_repeats_collapse(spark):
    rows = spark.createDataFrame([("si si si si si ya",), ("no no no",), ("a b a b a b a b",)], "s string").select(tf.collapse_repeats(F.col("s")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["si ya", "no no no", "a b"]


def test_regression_and_calibration(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    rows = [(i // 3, *map(float, v), float(50 + 10 * v[0] - 5 * v[1] + rng.normal())) for i, v in enumerate(x)]
    found = learning.ridge_by_folds(spark.createDataFrame(rows, "g long, a double, b double, c double, y double"), ["a", "b", "c"], "y", "g").collect()
    assert len(found) == 3 and sum(r["n"] for r in found) == 120 and all(r["mae"] < 8 and r["r2"] > 0.6 for r in found)
    pairs = spark.createDataFrame([(2.0 * p + 3, float(p)) for p in range(10)] + [(None, 1.0)], "r double, p double")
    row = learning.linear_calibration(pairs, "r", "p").first()
    assert (row["n"], row["a"], row["b"]) == (10, 2.0, 3.0) and learning.linear_calibration(pairs.limit(2), "r", "p").first()["a"] == 1.0


def test_reconcile(spark):
    v = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9], [1.0, 0.05]]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "c long, i long, v array<double>")
    assert [r["speaker"] for r in series.reconcile(rows, ["c"], "i", "v").orderBy("i").collect()] == [0, 0, 1, 1, 0]


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([(1, "a"), (2, "a")], [(2, "b")], [(2, "b")]):
        tables.replace_partitions(spark.createDataFrame(rows, "call_id long, v string"), path, "call_id")
    assert sorted((r["call_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]


def test_streams(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    mean = live.into_table(spark, live.running_mean(live.read_events(spark, path)), "mean", "update")
    expected = {}
    for r in sorted(spark.read.parquet(path).collect(), key=lambda r: (r["ts"], r["event_id"])):
        last = expected.get(r["user_id"])
        expected[r["user_id"]] = r["value"] if last is None else 0.35 * r["value"] + 0.65 * last
    assert {r["user_id"]: r["ema"] for r in mean.collect()} == pytest.approx(expected)


def test_config():
    assert config.validate(config.DEFAULTS) == []
    bad = config.deep_merge(config.DEFAULTS, {"segmentation": {"window": 50, "hop": 60}, "satisfaction": {"scale": 0}, "mode": "x", "ranges": {"a": (2, 1)}})
    assert len(config.validate(bad)) == 5 and config.DEFAULTS["segmentation"]["window"] == 5.0
    assert config.deep_merge(config.DEFAULTS, config.difference(config.DEFAULTS, bad)) == bad and config.difference(bad, bad) == {}


def test_events_have_known_kinds(spark):
    from parley.plans import QUERIES

    kinds = {r["type"] for r in QUERIES["ev6_critical_events"](spark, "/root/testdata/sf0.001").select("type").distinct().collect()}
    assert kinds <= {"frustration_peak", "anger_peak", "positive_peak", "emotional_shift", "recovery", "deterioration", "satisfaction_jump", "positive_ending", "negative_ending", "possible_conflict"}
    assert events.COLUMNS[:2] == ["call_id", "speaker"]
