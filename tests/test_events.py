"""Values of critical events against plain loops over the same cells."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from parley.config import DEFAULTS, FRUSTRATION, LABELS, VALENCE
from parley.operators import events, satisfaction, series
from parley.plans import fixtures

SF = "/root/testdata/sf0.001"
E = DEFAULTS["events"]
KEYS = ["call_id", "speaker"]


@pytest.fixture(scope="module")
def tables(spark):
    cells = fixtures.cells(spark, SF).checkpoint()
    line = satisfaction.timeline(cells, KEYS).checkpoint()
    by = defaultdict(list)
    for r in cells.collect():
        by[r["call_id"], r["speaker"]].append(r)
    lines = defaultdict(list)
    for r in line.collect():
        lines[r["call_id"], r["speaker"]].append((r["t"], r["score"]))
    return cells, line, {k: sorted(v, key=lambda r: r["t"]) for k, v in by.items()}, {k: sorted(v) for k, v in lines.items()}


def smoothed(x, k=10):
    k = min(k, len(x))
    return np.array([np.mean(x[max(0, i - k // 2) : i + k - k // 2]) for i in range(len(x))])


def frustration(r):
    audio = min(1.0, sum(w * r["p"][LABELS.index(x)] for x, w in FRUSTRATION.items()))
    top, bottom = audio, 1.0
    if r["tension"] is not None:
        top, bottom = top + 0.35 * min(1.0, max(0.0, 2 * (r["tension"] - 0.5))), bottom + 0.35
    if r["text_frust"] is not None:
        top, bottom = top + 0.5 * r["text_frust"], bottom + 0.5
    return top / bottom


def apart(found, least):
    kept = []
    for t, v in sorted(found, key=lambda x: (-x[1], x[0])):
        if all(abs(t - u) >= least for u, _ in kept):
            kept.append((t, v))
    return kept


def shown(rows):
    return sorted((r["call_id"], r["speaker"], r["type"], round(r["t"], 3), round(r["severity"], 6), round(r["confidence"], 6)) for r in rows)


def test_peaks_and_shifts(spark, tables):
    cells, _, by, _ = tables
    found = events.indices(cells)
    peaks, shifts = [], []
    for (call, speaker), rows in by.items():
        if len(rows) < 5:
            continue
        t, local = [r["t"] for r in rows], smoothed([r["conf"] for r in rows])
        at = {x: i for i, x in enumerate(t)}
        for kind, x in (("frustration", [frustration(r) for r in rows]), ("anger", [r["p"][LABELS.index("angry")] for r in rows]), ("positive", [r["p"][0] for r in rows])):
            x = smoothed(x)
            top = apart([(t[i], x[i]) for i in series.find_peaks(x, E[kind], 45, 0.08)], 45.0)
            peaks += [(call, speaker, f"{kind}_peak", round(s, 3), round(v, 6), round(0.5 * v + 0.5 * local[at[s]], 6)) for s, v in top]
        if len(rows) > 60:
            v = np.array([sum(w * r["p"][LABELS.index(x)] for x, w in VALENCE.items() if x in LABELS) for r in rows])
            d = np.array([abs(v[i : i + 30].mean() - v[i - 30 : i].mean()) if i >= 30 and i + 30 <= len(v) else 0.0 for i in range(len(v))])
            top = apart([(t[i], d[i]) for i in series.find_peaks(d, E["shift"], 45)], 45.0)
            shifts += [(call, speaker, "emotional_shift", round(s, 3), round(min(1.0, x), 6), round(0.5 * min(1.0, x) + 0.5 * local[at[s]], 6)) for s, x in top]
    assert shown(events.emotion_peaks(found).collect()) == sorted(peaks) and peaks
    assert shown(events.shifts(found).collect()) == sorted(shifts)


def test_moves_of_the_timeline(spark, tables):
    cells, line, by, lines = tables
    expected = []
    for (call, speaker), points in lines.items():
        rows = by[call, speaker]
        if len(points) < 4 or len(rows) < 5:
            continue
        t, s = [p[0] for p in points], [p[1] for p in points]
        local = smoothed([r["conf"] for r in rows])
        moves = {"recovery": [], "deterioration": [], "satisfaction_jump": []}
        for i in range(len(t)):
            past = s[max(0, i - 12) : i + 1]
            moves["recovery"].append((t[i], s[i] - min(past)))
            moves["deterioration"].append((t[i], max(past) - s[i]))
            if i >= 3:
                moves["satisfaction_jump"].append((t[i], abs(s[i] - s[i - 3])))
        kept = {k: apart([(x, v) for x, v in found if v >= E["jump" if k == "satisfaction_jump" else "recovery"]], 120.0) for k, found in moves.items()}
        others = [x for k in ("recovery", "deterioration") for x, _ in kept[k]]
        kept["satisfaction_jump"] = [(x, v) for x, v in kept["satisfaction_jump"] if all(abs(x - o) >= 60 for o in others)]
        for k, found in kept.items():
            for x, v in found:
                i = min(range(len(rows)), key=lambda j: (abs(rows[j]["t"] - x), rows[j]["t"]))
                expected.append((call, speaker, k, round(x, 3), round(min(1.0, v / 50), 6), round(0.4 + 0.5 * local[i], 6)))
    got = shown(events.timeline_moves(line, events.indices(cells)).collect())
    assert got == sorted(expected) and got


def test_initial_and_final_scores(spark, tables):
    cells, _, by, _ = tables
    got = {(r["call_id"], r["speaker"]): r for r in satisfaction.initial_and_final(cells, KEYS).collect()}
    for key, rows in list(by.items())[:6]:
        t0, t1 = rows[0]["t"], rows[-1]["t"]
        for name, part in (("initial", [r for r in rows if t0 - 1 <= r["t"] < t0 + 60]), ("final", [r for r in rows if t1 - 60 <= r["t"] < t1 + 1])):
            frame = spark.createDataFrame(part, cells.schema)
            score = satisfaction.components(frame, KEYS, final=(0.4, 5, 60), trend_factor=0.5).first()["score"]
            assert (got[key][name] is None) == (len(part) < 3) and (len(part) < 3 or got[key][name] == pytest.approx(score))


def test_executive_summary(spark):
    from parley.operators.narrative import executive_summary

    speakers = spark.createDataFrame(
        [(1, "SPEAKER_01", "sad", "happy", 62.5, 0.8, "improving", "Persona 2"), (1, "SPEAKER_00", "angry", None, 40.4, 0.5, "declining", "Persona 1 (Cliente)"), (2, "SPEAKER_00", "odd", "neutral", 99.5, 0.1, "stable", "x")],
        "call_id long, speaker string, initial_emotion string, final_emotion string, score double, confidence double, trend string, name string",
    )
    interaction = spark.createDataFrame([(1, 40.0, 55.5, 15.5), (2, 1.0, 2.0, 1.0)], "call_id long, initial double, final double, variation double")
    found = [(1, 9.0, "recovery"), (1, 1.0, "anger_peak"), (1, 2.0, "anger_peak"), (1, 3.0, "positive_ending"), (1, 4.0, "other"), (1, 5.0, "deterioration")]
    events_ = spark.createDataFrame(found, "call_id long, t double, type string")
    got = {r["call_id"]: r["summary"] for r in executive_summary(speakers, interaction, events_).collect()}
    end = " Estos resultados son estimaciones de un modelo y no constituyen una afirmación definitiva sobre el estado de los participantes; se recomienda revisión humana de los momentos críticos."
    said = "Durante la llamada, {} presentó una evolución emocional desde {} como señal inicial predominante hacia {} en el tramo final; el modelo estima una satisfacción de {:.0f}/100 (confianza {}) y una tendencia {}."
    assert got[2] == said.format("la persona", "odd", "neutralidad", 99.5, "baja", "estable") + end
    assert got[1] == (
        said.format("Persona 1 (Cliente)", "enojo", "sin dato", 40.4, "moderada", "negativa") + " " + said.format("Persona 2", "tristeza", "alegría", 62.5, "alta", "positiva")
        + f" A nivel de interacción, la satisfacción estimada pasó de {40.0:.0f} a {55.5:.0f} (variación {15.5:+.0f})."
        + " Se detectaron 6 momentos destacados: pico de enojo (2), final positivo (1), other (1), deterioro emocional (1)." + end
    )
