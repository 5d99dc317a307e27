"""Findings of round 4: sound that is heard where it is made, and what it is compared with."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parley.operators import diarization
from parley.plans import QUERIES, audio_queries
from parley.sources import audio


@pytest.fixture()
def talks(tmp_path):
    texts = [" ".join(f"word{(7 * i + j) % 40}" for j in range(5 * i % 70)) for i in range(24)] + [None, ""]
    # Long words: of these texts, one at a time becomes sound.
    texts += [" ".join(f"{i}" * 7_000 for _ in range(k)) for i in range(30) for k in (3, 4, 6)]
    n = len(texts)
    rows = {"conv_id": [i // 9 for i in range(n)], "turn": list(range(n)), "role": [("user", "assistant")[i % 2] for i in range(n)], "text": texts}
    pq.write_table(pa.table(rows), tmp_path / "conversations.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["au3_prosody", "au4_augmentation", "au5_audio_validation", "wn20_speech_segments", "src1_audio_probe", "src2_audio_windows", "src2_audio_blocks"])
def test_samples_stay_where_they_are_made(spark, talks, name):
    """Samples are some hundred times their text: none is a column that the JVM copies."""
    found = QUERIES[name](spark, talks)
    assert "samples#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0


def rows_of(df):
    # NaN is null here: neither equals itself.
    return sorted(tuple(repr(None if x != x else x) for x in row) for row in df.collect())


def test_augmented_figures_are_those_of_the_samples(spark, talks):
    made = audio.augment(audio_queries.samples(spark, talks), {"speed_range": (0.95, 1.05), "pitch_semitones": 1.0}, audio_queries.RATE)
    plain = made.select("id", F.size("samples").alias("n"), F.round(F.array_max("samples"), 4).alias("peak"))
    assert rows_of(QUERIES["au4_augmentation"](spark, talks)) == rows_of(plain)


def plain_pitches(x, rate, low, high, hop, size=1024, threshold=0.1):
    """Differences of each frame at each lag, as they are defined."""
    x, half, out = np.pad(x, size // 2), size // 2, []
    most, least = min(int(np.ceil(rate / low)), half - 1), max(2, int(rate / high))
    for at in range(0, len(x) - size + 1, hop):
        d = np.array([((x[at : at + half] - x[at + k : at + k + half]) ** 2).sum() for k in range(most + 2)])
        normal = d[1:] * np.arange(1, most + 2) / np.maximum(np.cumsum(d[1:]), 1e-12)  # of lag 1 on
        dips = [k for k in range(least, most + 1) if normal[k - 1] <= normal[k - 2] and normal[k - 1] < normal[k] and normal[k - 1] < threshold]
        k = dips[0] if dips else least + int(normal[least - 1 : most].argmin())
        a, b, c = normal[k - 2 : k + 1]
        curve = a - 2 * b + c
        out.append(rate / (k + (np.clip(0.5 * (a - c) / curve, -1, 1) if abs(curve) > 1e-12 else 0)))
    return np.array(out)


@pytest.mark.parametrize(("rate", "hop"), [(8000, 128), (16000, 256), (44100, 705), (8000, 100)])
def test_pitches_against_differences(rate, hop):
    rng = np.random.default_rng(3)
    x = np.concatenate([audio.tone(180.0, 0.7, rate), np.zeros(rate // 4), audio.tone(90.0, 0.5, rate) + 0.05 * rng.standard_normal(rate // 2)]).astype(float)
    assert np.allclose(audio.pitches(x, rate, 65, 500, hop), plain_pitches(x, rate, 65, 500, hop), atol=1e-5)
    assert np.allclose(audio.pitches(np.zeros(rate), rate, 65, 500, hop), plain_pitches(np.zeros(rate), rate, 65, 500, hop))


def test_features_equal_those_of_stored_sound(spark, talks):
    stored = diarization.window_features(audio_queries.speech(spark, talks))
    made = audio_queries.heard(spark, talks, diarization.feature_rows, diarization.FEATURES)
    assert "samples#" in stored._jdf.queryExecution().optimizedPlan().toString() and "samples#" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(made) == rows_of(stored) and made.count() > 0
