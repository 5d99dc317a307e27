"""Stages of a call as a state machine, live and in batches.

`stage_states` follows reports of many calls as a stream: one state a call, timers for stages that fall silent.
`StageRun` does the stages' work batch by batch; what is done is kept as whole result folders, so a run that breaks off,
or a stage that fails, is taken up again with the open batches only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The stages of a call, in order.
STAGES = ["audio_processing", "diarization", "transcription", "emotion_analysis", "satisfaction", "report"]
STATES = "call_id long, stage string, status string, done long, total long, attempt int, at timestamp, error string"
#: Reports: start and fail of a stage, done of a batch (done of total so far), complete.
KINDS = ["start", "done", "complete", "fail"]


def allowed(status: str, kind: str) -> str | None:
    """The status after a report, None if it changes nothing: a stage is started once, or again after it has failed."""
    if kind == "start":
        return "RUNNING" if status in ("PENDING", "FAILED") else None
    if status != "RUNNING":
        return None
    return {"done": "RUNNING", "complete": "COMPLETED", "fail": "FAILED"}.get(kind)


class StageMachine(StatefulProcessor):
    """One call's stages: a map of stage to (status, done, total, attempt, last report)."""

    def __init__(self, stages: list[str], silence_ms: int):
        self.stages, self.silence_ms = stages, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("stages", "stage string", "status string, done long, total long, attempt int, at long")

    def _load(self) -> None:
        """The call's stages in memory: one reading of the state for all its reports, and not several for each."""
        self.now = {tuple(k)[0]: tuple(v) for k, v in self.known.iterator()}
        self.changed: set[str] = set()

    def _keep(self) -> None:
        for stage in sorted(self.changed):
            self.known.updateValue((stage,), self.now[stage])

    def _stage(self, stage: str) -> tuple[str, int, int, int, int]:
        return self.now.get(stage, ("PENDING", 0, 0, 0, 0))

    def _put(self, call: Any, stage: str, row: tuple, error: str | None) -> tuple:
        self.now[stage] = row
        self.changed.add(stage)
        status, done, total, attempt, at = row
        return (call, stage, status, done, total, attempt, at, error)

    def _silent(self, call: Any, until: int) -> list[tuple]:
        """Stages that run and had no report for too long before `until` (microseconds)."""
        found = []
        for stage, (status, done, total, attempt, at) in sorted(self.now.items()):
            if status == "RUNNING" and until - at >= 1000 * self.silence_ms:
                found.append((stage, ("FAILED", done, total, attempt, at + 1000 * self.silence_ms)))
        return [self._put(call, stage, row, "silent") for stage, row in found]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        call, out = key[0], []
        self._load()
        reports = pd.concat(list(rows)).sort_values(["at_us", "stage", "kind"], kind="stable")
        for r in reports.itertuples(index=False):
            at = int(r.at_us)
            out += self._silent(call, at)
            place = self.stages.index(r.stage) if r.stage in self.stages else -1
            if place < 0 or any(self._stage(s)[0] != "COMPLETED" for s in self.stages[:place]):
                continue  # no such stage, or one before it isn't complete
            status, done, total, attempt, _ = self._stage(r.stage)
            after = allowed(status, r.kind)
            if after is None:
                continue
            if r.kind == "start":
                attempt += 1  # what is done stays: the work goes on from there
            if r.kind == "done":
                done, total = max(done, int(r.done)), int(r.total)
            out.append(self._put(call, r.stage, (after, done, total, attempt, at), r.error if r.kind == "fail" else None))
        self._keep()
        running = [self._stage(s)[4] for s in self.stages if self._stage(s)[0] == "RUNNING"]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if running:
            self.handle.registerTimer(min(running) // 1000 + self.silence_ms)
        yield _rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._load()
        out = self._silent(key[0], 1000 * expiredTimerInfo.getExpiryTimeInMs())
        self._keep()
        yield _rows(out)

    def close(self) -> None:
        pass


def _rows(found: list[tuple]) -> pd.DataFrame:
    rows = pd.DataFrame(found, columns=["call_id", "stage", "status", "done", "total", "attempt", "at", "error"])
    return rows.assign(at=pd.to_datetime(rows["at"], unit="us"))


def stage_states(reports: DataFrame, stages: list[str] | None = None, silence: float = 600.0, late: str = "1 minute") -> DataFrame:
    """A stream of reports(call_id, stage, kind, done, total, at, error) -> a row for each change: STATES.

    A stage is PENDING, RUNNING after its start, COMPLETED or FAILED; it starts when all before it are COMPLETED, and again
    after FAILED, with what is done kept and attempt counted. Reports that don't fit (a stage that isn't running, a kind
    unknown) change nothing; neither do reports without a call, a stage or a time. A stage without a report for `silence`
    seconds of the reports' own time is FAILED with the error silent. Reports later than `late` are left out.
    """
    spark = reports.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    named = reports.where("call_id is not null and stage is not null and at is not null").select(
        F.col("call_id").cast("long").alias("call_id"), "stage", "kind", F.coalesce("done", F.lit(0)).cast("long").alias("done"), F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), F.col("error").cast("string").alias("error"),
    )
    machine = StageMachine(stages or STAGES, int(1000 * silence))
    return named.withWatermark("at", late).groupBy("call_id").transformWithStateInPandas(machine, STATES, "append", "eventtime")


Work = Callable[[DataFrame], DataFrame]


class StageRun:
    """Stages over batches of calls, kept below a shared folder: <stage>/batch=<number> holds a batch's result.

    A batch's result is written aside and moved to its place as a whole, so result and checkpoint are one. `run` returns
    the status of every stage and batch; `results` reads a stage. A stage that raises leaves its batch FAILED with the
    error, and later stages of this batch PENDING; other batches go on. Running again does what isn't COMPLETED.
    """

    def __init__(self, spark: SparkSession, folder: str, stages: dict[str, Work], key: str = "call_id", batches: int = 8):
        self.spark, self.folder, self.stages, self.key, self.batches = spark, folder, stages, key, batches
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str) -> Any:
        return self._hadoop.Path("/".join((self.folder, *parts)))

    def completed(self, stage: str, batch: int) -> bool:
        return self._files.exists(self._path(stage, f"batch={batch}", "_SUCCESS"))

    def results(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{stage}")

    def run(self, calls: DataFrame) -> DataFrame:
        """stage, batch, status, error of all; calls are dealt to batches by a hash of their key."""
        for number in range(self.batches):
            rows = calls.where(F.pmod(F.xxhash64(self.key), F.lit(self.batches)) == number)
            for stage, work in self.stages.items():
                if not self.completed(stage, number) and not self._done(stage, number, work, rows):
                    break
                rows = self.spark.read.parquet(f"{self.folder}/{stage}/batch={number}")
        return self.status()

    def _done(self, stage: str, number: int, work: Work, rows: DataFrame) -> bool:
        aside = f"_aside/{stage}-{number}-{uuid.uuid4().hex}"
        try:
            work(rows).write.parquet(f"{self.folder}/{aside}")
        except Exception as error:  # whatever a stage raises is its failure, not that of the run
            self._note(stage, number, str(error).strip().splitlines()[0][:500] if str(error).strip() else type(error).__name__)
            self._files.delete(self._path(aside), True)
            return False
        self._files.mkdirs(self._path(stage))
        self._files.delete(self._path(stage, f"batch={number}"), True)  # what a broken move may have left
        if not self._files.rename(self._path(aside), self._path(stage, f"batch={number}")):
            self._note(stage, number, "the result could not be moved to its place")
            return False
        self._files.delete(self._path("_failed", f"{stage}-{number}"), False)
        return True

    def _note(self, stage: str, number: int, error: str) -> None:
        out = self._files.create(self._path("_failed", f"{stage}-{number}"), True)
        out.writeBytes(json.dumps(error))  # ASCII
        out.close()

    def _error(self, stage: str, number: int) -> str | None:
        path = self._path("_failed", f"{stage}-{number}")
        if not self._files.exists(path):
            return None
        return json.loads(self.spark.read.text(str(path.toString()), wholetext=True).first()[0])

    def status(self) -> DataFrame:
        """One row for each stage and batch; the driver holds no more than these."""
        rows = []
        for number in range(self.batches):
            for stage in self.stages:
                error = None if self.completed(stage, number) else self._error(stage, number)
                rows.append((stage, number, "COMPLETED" if self.completed(stage, number) else "FAILED" if error is not None else "PENDING", error))
        return self.spark.createDataFrame(rows, "stage string, batch int, status string, error string")
