"""Cases of the third round's findings."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa

from parley.llm.line_dedup import duplicate_lines
from parley.operators import fusion
from parley.plans.satisfaction_queries import at_least_one
from parley.streaming import stages


def test_a_point_is_one_in_any_order_of_its_sum(spark):
    rows = [(1, 0.9999999999999984), (2, 1.0000000000000002), (3, -0.9999999999999993), (4, 0.99999), (5, None)]
    assert {r["call_id"] for r in at_least_one(spark.createDataFrame(rows, "call_id long, points double")).collect()} == {1, 2, 3}


def test_temperature_of_odd_rows_is_that_of_a_plain_loop(spark):
    rows = [(1, [0.7, 0.2, 0.1], 0), (2, [0.1, 0.6, 0.3], 2), (3, [0.0, 1.0, 0.0], 0), (4, [], 0), (5, None, 1), (6, [0.5, 0.5], None), (7, [0.5, None, 0.5], 1), (8, [0.2, 0.8], 5)]
    grid, nll = [0.5, 1.0, 3.0], {}
    for t in grid:
        losses = []
        for _, p, truth in rows:
            q = [max(x or 0.0, 1e-12) ** (1 / t) for x in p or []]
            losses.append(-math.log(max(q[truth] / sum(q), 1e-12) if truth is not None and truth < len(q) else 1e-12))
        nll[t] = sum(losses) / len(losses)
    df = spark.createDataFrame(rows, "id long, p array<double>, truth int")
    found = fusion.best_temperature(df, "p", "truth", grid).first()
    best = min(grid, key=nll.get)
    assert found["temperature"] == best and abs(found["nll"] - nll[best]) < 1e-12
    none = fusion.best_temperature(df.limit(0), "p", "truth", grid).first()
    assert none["nll"] is None


def test_a_batch_of_rows_is_one_row_of_sums():
    batch = pa.RecordBatch.from_arrays([pa.array([[0.5, 0.5]] * 1000), pa.array([1] * 1000, pa.int32())], names=["p", "truth"])
    (sums,) = fusion._losses([1.0, 2.0])(iter([batch]))
    assert sums.num_rows == 1 and sums.column(0).to_pylist() == [1000]


class CountedStates:
    """A map state that counts how often it is asked."""

    def __init__(self):
        self.rows, self.asked = {}, 0

    def getValue(self, key):
        self.asked += 1
        return self.rows[key]

    def containsKey(self, key):
        self.asked += 1
        return key in self.rows

    def updateValue(self, key, row):
        self.asked += 1
        self.rows[key] = row

    def iterator(self):
        self.asked += 1
        return iter(list(self.rows.items()))


class Timers:
    def listTimers(self):
        return iter(())

    def registerTimer(self, at):
        pass


def test_state_of_a_call_is_not_asked_for_each_of_its_reports():
    machine = stages.StageMachine(["a", "b"], 1_000_000)
    machine.known, machine.handle = CountedStates(), Timers()
    rows = [("a", "start", 0, 0)] + [("a", "done", i, 300) for i in range(1, 300)] + [("a", "complete", 0, 0), ("b", "start", 0, 0)]
    reports = pd.DataFrame([(s, k, d, n, i, None) for i, (s, k, d, n) in enumerate(rows)], columns=["stage", "kind", "done", "total", "at_us", "error"])
    (found,) = machine.handleInputRows((7,), iter([reports[:150], reports[150:]]), None)
    assert len(found) == 302 and found.iloc[-2][["stage", "status", "done"]].tolist() == ["a", "COMPLETED", 299]
    assert machine.known.rows == {("a",): ("COMPLETED", 299, 300, 1, 300), ("b",): ("RUNNING", 0, 0, 1, 301)}
    assert machine.known.asked <= 4


def test_lines_that_repeat_their_runs_are_compared(spark):
    from .llm.test_pairs import brute_lines, docs_of

    words = ["la"] * 60
    edited = [*words[:30], "lo", *words[31:]]
    # Runs that come often can fill the smallest ones of a line, and leave it one run to share.
    texts = [(i, " ".join(x)) for i, x in enumerate((words, edited))]
    for i, (a, b, c) in enumerate((("one", "two", "three"), ("red", "green", "blue"), ("up", "down", "left"), ("north", "south", "east"), ("cat", "dog", "cow"), ("tea", "milk", "salt"))):
        line = [*[a] * 40, b, c, *[a] * 40]
        texts += [(10 + 2 * i, " ".join(line)), (11 + 2 * i, " ".join([*line[:20], "x", *line[21:], "y"]))]
    expected = brute_lines(texts)
    assert len(expected) == 7
    assert {r["doc_id"]: r["dropped"] for r in duplicate_lines(docs_of(spark, texts)).collect()} == expected
