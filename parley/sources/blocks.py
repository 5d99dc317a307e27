"""Long PCM files read by byte range: a data source whose partitions are ranges of a file, and reads of single windows.

A task opens its file, seeks, and holds one block at a time, so memory follows the length of a block and not of the
file, and one file of many hours is read by many tasks. Conditions on path and offset_s leave out files, ranges and
blocks before any sample is read.
"""

from __future__ import annotations

import bisect
import contextlib
import itertools
import struct
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any, BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a file that make a range, unless the option `rangeBytes` says otherwise.
RANGE = 64 << 20
#: Tasks to which more ranges are dealt by their bytes, bytes that opening a file counts there, bytes of samples in a batch.
TASKS, OPENING, BATCH = 500, 64 << 10, 4 << 20
SCHEMA = "path string, offset_s double, sample_rate int, channel int, samples array<float>"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str) -> Any:
    filesystem, inner = located(path)
    return filesystem.open_input_file(inner)


@dataclass(frozen=True)
class Pcm:
    """How the samples of a WAV file lie: the first byte, bytes a frame (all channels), frames, and what they are."""

    begin: int
    frame: int
    frames: int
    rate: int
    channels: int
    kind: str

    @property
    def seconds(self) -> float:
        return self.frames / self.rate

    def decode(self, data: bytes) -> np.ndarray:
        """Frames x channels between -1 and 1."""
        if self.kind == "u1":
            x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
        elif self.kind == "i3":
            raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
        elif self.kind[0] == "i":
            x = (np.frombuffer(data, f"<{self.kind}") / float(1 << 8 * int(self.kind[1]) - 1)).astype(np.float32)
        else:
            x = np.frombuffer(data, f"<{self.kind}").astype(np.float32)
        return x.reshape(-1, self.channels)

    def read(self, file: BinaryIO, first: int, frames: int) -> np.ndarray:
        """Frames from `first` on, as far as there are any."""
        first = min(max(first, 0), self.frames)
        frames = min(max(frames, 0), self.frames - first)
        file.seek(self.begin + first * self.frame)
        data = file.read(frames * self.frame)
        return self.decode(data[: len(data) // self.frame * self.frame])


def wav_layout(file: BinaryIO, size: int) -> Pcm:
    """The layout of a WAV file; ValueError if it is none. A data chunk that claims nothing or more than the file has, as streams
    leave it, ends with the file."""
    file.seek(0)
    head = file.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("no WAVE header")
    at, form = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            form = file.read(min(length, 40))
        elif name == b"data":
            if form is None or len(form) < 16:
                raise ValueError("samples before their format")
            code, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", form[:16])
            if code == 0xFFFE and len(form) >= 26:
                code = struct.unpack("<H", form[24:26])[0]
            kind = {(1, 8): "u1", (1, 16): "i2", (1, 24): "i3", (1, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((code, bits))
            if kind is None or not channels or not rate or frame != channels * bits // 8:
                raise ValueError(f"samples of format {code} with {bits} bits")
            return Pcm(at + 8, frame, min(length or size, size - at - 8) // frame, rate, channels, kind)
        at += 8 + length + length % 2
    raise ValueError("no samples")


@dataclass
class Range:
    path: str
    size: int
    begin: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads: those of very many small files are too many for a task each."""

    ranges: list[Range]

    @property
    def path(self) -> str:
        return self.ranges[0].path


class PcmReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.seconds = float(options.get("blockseconds", 300))
        self.bytes = int(options.get("rangebytes", RANGE))
        self.least, self.most, self.paths = 0.0, float("inf"), None
        if self.seconds <= 0 or self.bytes <= 0:
            raise ValueError("blockSeconds and rangeBytes must be positive")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of offset_s and names of paths narrow what is read; all conditions are checked again by Spark."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("offset_s",):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.least = max(self.least, f.value)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.most = min(self.most, f.value)
            elif column == ("path",) and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = named if self.paths is None else self.paths & named
            yield f

    def partitions(self) -> list[Ranges]:
        filesystem, inner = located(self.path)
        info = filesystem.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        files = [(prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.extension.lower() == "wav"]
        ranges = [Range(path, size, at, min(size, at + self.bytes)) for path, size in sorted(files) if self.paths is None or path in self.paths for at in range(0, size, self.bytes)]
        weights = [r.end - r.begin + OPENING for r in ranges]
        share, held = max(1, sum(weights) // TASKS), 0
        packed: list[Ranges] = []
        for r, weight in zip(ranges, weights, strict=True):
            # With few ranges each one is more than a share.
            if not packed or held + weight > share:
                packed.append(Ranges([]))
                held = 0
            packed[-1].ranges.append(r)
            held += weight
        return packed

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        """The blocks that begin in the ranges, one row a channel. A file without samples that can be read has no row."""
        held: list[tuple] = []
        weight = 0
        for row in self.rows(partition):
            held.append(row)
            weight += row[4].nbytes
            if weight >= BATCH:
                yield _batch(held)
                held, weight = [], 0
        if held:
            yield _batch(held)

    def rows(self, partition: Ranges) -> Iterator[tuple]:
        """read() by single rows of SCHEMA."""
        for path, ranges in itertools.groupby(partition.ranges, key=lambda r: r.path):
            with opened(path) as file:
                yield from self._blocks(file, path, list(ranges))

    def _blocks(self, file: Any, path: str, ranges: list[Range]) -> Iterator[tuple]:
        try:
            pcm = wav_layout(file, ranges[0].size)
        except ValueError:
            return
        block = max(1, int(self.seconds * pcm.rate))
        # A block belongs to the range that holds the byte of its first sample.
        starts = range(0, pcm.frames, block)
        for r in ranges:
            first = bisect.bisect_left(starts, r.begin, key=lambda s: pcm.begin + s * pcm.frame)
            first = max(first, bisect.bisect_left(starts, self.least, key=lambda s: s / pcm.rate))
            for start in starts[first:]:
                if pcm.begin + start * pcm.frame >= r.end or start / pcm.rate > self.most:
                    break
                x = pcm.read(file, start, block)
                for c in range(x.shape[1]):
                    yield path, start / pcm.rate, pcm.rate, c, x[:, c]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "offset_s", "sample_rate", "channel", "samples"])


class PcmBlocks(DataSource):
    """spark.read.format("pcm_blocks").load(path): the blocks of the WAV files at or below a path. Options: blockSeconds
    (300) and rangeBytes. Paths are those of a local or shared folder or a URI that Arrow's file systems know."""

    @classmethod
    def name(cls) -> str:
        return "pcm_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> PcmReader:
        return PcmReader({k.lower(): v for k, v in self.options.items()})


def read_blocks(spark: SparkSession, path: str, seconds: float = 300.0, range_bytes: int = RANGE) -> DataFrame:
    """path, offset_s, sample_rate, channel, samples (-1 to 1) of each block and channel, with conditions pushed down."""
    spark.dataSource.register(PcmBlocks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("pcm_blocks").option("blockSeconds", seconds).option("rangeBytes", range_bytes).load(path)


@contextlib.contextmanager
def passing_files(contents: Iterable[tuple[str, bytes]]) -> Iterator[str]:
    """A folder of this task's own with files of these names and contents, gone when they have been read."""
    with tempfile.TemporaryDirectory() as folder:
        for name, content in contents:
            Path(folder, name).write_bytes(content)
        yield folder


def blocks_of(contents: Iterable[tuple[str, bytes]], seconds: float = 300.0, range_bytes: int = RANGE) -> Iterator[tuple]:
    """Rows of SCHEMA as read_blocks() has them, of files that a task has at hand: they are written, read by range and removed, so
    that the disk holds those of one call at a time."""
    with passing_files(contents) as folder:
        reader = PcmReader({"path": folder, "blockseconds": str(seconds), "rangebytes": str(range_bytes)})
        for partition in reader.partitions():
            yield from reader.rows(partition)


def window_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of windows with samples, as read_windows() has them; windows of a file should lie together."""

    def one(file: Any, pcm: Pcm, start: float, end: float, channel: Any) -> np.ndarray | None:
        start = max(0.0, start)
        x = pcm.read(file, int(start * pcm.rate), int((end - start) * pcm.rate))
        if pd.isna(channel):
            return x.mean(axis=1)
        return x[:, int(channel)] if 0 <= channel < pcm.channels else None

    path, file, pcm = None, None, None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.path != path:
                if file is not None:
                    file.close()
                path, file, pcm = row.path, None, None
                try:
                    file = opened(path)
                    pcm = wav_layout(file, file.size())
                except (OSError, ValueError, AttributeError):
                    pcm = None
            known = pcm is not None and not pd.isna(row.start) and not pd.isna(row.end)
            out.append(one(file, pcm, row.start, row.end, row.channel) if known else None)
        yield batch.assign(samples=out)
    if file is not None:
        file.close()


def read_windows(windows: DataFrame) -> DataFrame:
    """windows(path, start, end, channel) -> the same with samples, read from where they lie and from nowhere else.

    start counts as 0 if it is negative; int((end - start) * rate) samples are read, fewer at the end of the file. A null
    channel is the mean of all. samples is null if the file can't be read, has no such channel, or a bound is null.
    """
    asked = windows.select("path", *(F.col(c).cast(t).alias(c) for c, t in (("start", "double"), ("end", "double"), ("channel", "int"))))
    # Windows of a file lie together, in order; a file with very many of them is still dealt to several tasks.
    return asked.repartitionByRange("path", "start").sortWithinPartitions("path", "start").mapInPandas(window_rows, "path string, start double, end double, channel int, samples array<float>")


def save_files(contents: DataFrame, folder: str) -> DataFrame:
    """Write contents(path, content) below a folder that all share; path and size of each. A file is written under another
    name first, so a task that runs again replaces it whole."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, inner = located(folder)
        filesystem.create_dir(inner, recursive=True)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with filesystem.open_output_stream(f"{inner}/.{path}.part") as out:
                    out.write(content)
                filesystem.move(f"{inner}/.{path}.part", f"{inner}/{path}")
            yield pd.DataFrame({"path": [f"{folder}/{p}" for p in batch["path"]], "size": [len(c) for c in batch["content"]]})

    return contents.select("path", "content").mapInPandas(each, "path string, size long")
