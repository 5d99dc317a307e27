"""Timelines of many keys a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from parley.operators import satisfaction


def test_timelines_of_many_keys_are_those_of_each_key(monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for call in range(30):
        for speaker in ("a", "b"):
            for cell in np.flatnonzero(rng.random(rng.integers(1, 200)) < rng.choice([0.1, 0.6, 1.0])).tolist() or [0]:
                rows.append((call, speaker, cell + 0.5, cell, rng.normal() / 3, rng.random(), rng.choice([None, 0.3, -0.4]), rng.choice([None, 0.2, 0.9])))
    schema = pa.schema([("call_id", pa.int64()), ("speaker", pa.string()), ("t", pa.float64()), ("cell", pa.int64()), ("v", pa.float64()), ("a", pa.float64()), ("text_score", pa.float64()), ("tension", pa.float64())])

    def batch(part: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    def lines(batches: list) -> list:
        return [tuple(r.values()) for b in satisfaction._lines(["call_id", "speaker"])(iter(batches)) for r in b.to_pylist()]

    each = [x for key in sorted({r[:2] for r in rows}) for x in lines([batch([r for r in rows if r[:2] == key])])]
    assert lines([batch(rows)]) == each and len(each) > 200
    monkeypatch.setattr(satisfaction, "_CELLS_AT_ONCE", 7)
    assert lines([batch(rows[i : i + 5]) for i in range(0, len(rows), 5)]) == each
    assert lines([]) == []
