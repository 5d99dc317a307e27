"""Steps over all calls that make no more rows than these have cells."""

from __future__ import annotations

from parley.operators import events


def test_conflicts_of_a_call_with_a_very_long_silence(spark):
    """A grid over the silence would have a billion points a speaker."""
    late = 2e9
    rows = [(call, s, base + i + 0.5, x) for call, speakers in ((1, "ab"), (2, "a"), (3, "abc")) for s, x in zip(speakers, (0.9, 0.6, 0.8)) for base in (0.0, late) for i in range(12)]
    found = spark.createDataFrame(rows, "call_id long, speaker string, t double, tension_i double")
    overlaps = spark.createDataFrame([(1, 2000, 3000)], "call_id long, at_ms long, overlap_ms long")
    got = sorted((r["call_id"], r["t"], r["t_end"], round(r["severity"], 6), round(r["confidence"], 6)) for r in events.conflicts(found, overlaps).collect())
    # To the last point that is six seconds from a cell (of a call's end: none beyond it).
    assert got == [(1, 2.0, 16.0, 0.7, 0.64), (1, late - 4, late + 10, 0.6, 0.64)]
