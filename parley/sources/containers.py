"""What the headers of audio containers tell: duration, rate, channels, codec. No sample is decoded.

Each walker reads through `read(at, n)`, a few kilobytes at a time, so files are probed by ranges wherever they lie.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import opened, wav_layout

Read = Callable[[int, int], bytes]
FIELDS = ["duration", "sample_rate", "channels", "bitrate", "codec", "container"]
PROBED = "path string, duration double, sample_rate int, channels int, bitrate long, codec string, container string, error string"

#: Fixed values of the MPEG audio standards: kbit/s of layer III by index for version 1 and for versions 2 and 2.5,
#: sample rates by index for version 1 (halved and quartered for the others), sample rates of AAC by index.
MP3_KBPS = {1: [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
MP3_RATES = [44100, 48000, 32000]
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350]


class _File:
    """What wav_layout reads from, over read(at, n)."""

    def __init__(self, read: Read):
        self.get, self.at = read, 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        data = self.get(self.at, n)
        self.at += len(data)
        return data


def _wav(read: Read, size: int) -> dict[str, Any]:
    pcm = wav_layout(_File(read), size)
    names = {"u1": "pcm_u8", "i2": "pcm_s16le", "i3": "pcm_s24le", "i4": "pcm_s32le", "f4": "pcm_f32le", "f8": "pcm_f64le"}
    return {"duration": pcm.seconds, "sample_rate": pcm.rate, "channels": pcm.channels, "bitrate": 8 * pcm.frame * pcm.rate, "codec": names[pcm.kind], "container": "wav"}


def _flac(read: Read, size: int) -> dict[str, Any]:
    info = read(8, 34)
    packed = int.from_bytes(info[10:18], "big")  # 20 bits of rate, 3 of channels, 5 of depth, 36 of samples
    rate, channels, samples = packed >> 44, (packed >> 41 & 7) + 1, packed & (1 << 36) - 1
    if not rate:
        raise ValueError("no sample rate")
    return {"duration": samples / rate, "sample_rate": rate, "channels": channels, "codec": "flac", "container": "flac"}


def _ogg(read: Read, size: int) -> dict[str, Any]:
    page = read(0, 27 + 255 + 64)
    serial, packet = page[14:18], page[27 + page[26] :]
    skipped = 0
    if packet[:7] == b"\x01vorbis":
        channels, rate, ticks, codec = packet[11], struct.unpack("<I", packet[12:16])[0], struct.unpack("<I", packet[12:16])[0], "vorbis"
    elif packet[:8] == b"OpusHead":
        channels, skipped, rate, ticks, codec = packet[9], struct.unpack("<H", packet[10:12])[0], 48000, 48000, "opus"
    else:
        raise ValueError("no Vorbis or Opus stream")
    if not ticks:
        raise ValueError("no sample rate")
    # The last page of the stream says how many samples there are; a page has 65,307 bytes at most.
    at = size
    while at > 0:
        begin = max(0, at - 65_536)
        tail = read(begin, at - begin + 27)
        found = tail.rfind(b"OggS", 0, at - begin + 4)
        while found >= 0:
            granule = struct.unpack("<q", tail[found + 6 : found + 14].ljust(8, b"\xff"))[0]
            if tail[found + 14 : found + 18] == serial and granule >= 0:
                return {"duration": max(0, granule - skipped) / ticks, "sample_rate": rate, "channels": channels, "codec": codec, "container": "ogg"}
            found = tail.rfind(b"OggS", 0, found)
        at = begin
    raise ValueError("no last page")


def _mp3_frame(head: bytes) -> tuple[int, int, int, int, int] | None:
    """(version, kbit/s, rate, channels, bytes) of a layer III frame header."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2, 0: 4}.get(head[1] >> 3 & 3)  # 4 stands for 2.5
    layer, kbps, rate = head[1] >> 1 & 3, head[2] >> 4, head[2] >> 2 & 3
    if version is None or layer != 1 or kbps in (0, 15) or rate == 3:
        return None
    kbps, rate = MP3_KBPS[min(version, 2)][kbps - 1], MP3_RATES[rate] // version
    samples = 1152 if version == 1 else 576
    return version, kbps, rate, 1 if head[3] >> 6 == 3 else 2, samples // 8 * kbps * 1000 // rate + (head[2] >> 1 & 1)


def _mp3(read: Read, size: int) -> dict[str, Any]:
    at = _after_id3(read)
    head = read(at, 65_536)
    for i in range(len(head) - 4):
        frame = _mp3_frame(head[i : i + 4])
        following = frame and (head[i + frame[4] : i + frame[4] + 4] or read(at + i + frame[4], 4))
        if frame and (at + i + frame[4] >= size or _mp3_frame(following)):
            break
    else:
        raise ValueError("no MPEG frame")
    version, kbps, rate, channels, length = frame
    begin = at + i
    side = (17 if channels == 1 else 32) if version == 1 else (9 if channels == 1 else 17)
    first = read(begin, 4 + 32 + 24)
    tag, samples = first[4 + side : 4 + side + 4], 1152 if version == 1 else 576
    frames = None
    if tag in (b"Xing", b"Info") and struct.unpack(">I", first[8 + side : 12 + side])[0] & 1:
        frames = struct.unpack(">I", first[12 + side : 16 + side])[0]
    elif first[36:40] == b"VBRI":
        frames = struct.unpack(">I", first[50:54])[0]
    end = size - 128 if read(size - 128, 3) == b"TAG" else size
    duration = frames * samples / rate if frames else (end - begin) * 8 / (1000 * kbps)  # one bit rate all through
    return {"duration": duration, "sample_rate": rate, "channels": channels, "codec": "mp3", "container": "mp3"}


def _after_id3(read: Read) -> int:
    head = read(0, 10)
    if head[:3] != b"ID3" or len(head) < 10:
        return 0
    return 10 + (head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9])


def _adts(read: Read, size: int) -> dict[str, Any]:
    """All frame headers are walked, as nothing else tells how many there are."""
    at, frames, rate, channels, held, held_at = _after_id3(read), 0, 0, 0, b"", 0
    while at + 7 <= size:
        if not held_at <= at <= held_at + len(held) - 7:
            held, held_at = read(at, 65_536), at
        head = held[at - held_at : at - held_at + 7]
        if len(head) < 7 or head[0] != 0xFF or head[1] & 0xF6 != 0xF0:
            break
        length = (head[3] & 3) << 11 | head[4] << 3 | head[5] >> 5
        index = head[2] >> 2 & 15
        if length < 7 or index >= len(AAC_RATES):
            break
        if not frames:
            rate, channels = AAC_RATES[index], (head[2] & 1) << 2 | head[3] >> 6
        frames += 1 + (head[6] & 3)
        at += length
    if not frames:
        raise ValueError("no AAC frame")
    return {"duration": frames * 1024 / rate, "sample_rate": rate, "channels": channels, "codec": "aac", "container": "adts"}


def _boxes(read: Read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the MP4 boxes between two places; begin is that of their contents."""
    while at + 8 <= end:
        length, name = struct.unpack(">I4s", read(at, 8))
        begin = at + 8
        if length == 1:
            length, begin = struct.unpack(">Q", read(begin, 8))[0], begin + 8
        length = end - at if length == 0 else length
        if length < begin - at or at + length > end:
            return
        yield name, begin, at + length
        at += length


def _mp4(read: Read, size: int) -> dict[str, Any]:
    def inner(span: tuple[int, int], name: bytes) -> tuple[int, int]:
        return next(((b, e) for n, b, e in _boxes(read, *span) if n == name), (0, 0))

    movie = inner((0, size), b"moov")
    for name, begin, end in _boxes(read, *movie):
        media = inner((begin, end), b"mdia") if name == b"trak" else (0, 0)
        kind = inner(media, b"hdlr")
        if media == (0, 0) or read(kind[0] + 8, 4) != b"soun":
            continue
        header = inner(media, b"mdhd")
        data = read(header[0], 36)
        ticks, length = struct.unpack(">IQ", data[20:32]) if data[0] == 1 else struct.unpack(">II", data[12:20])
        table = inner(inner(inner(media, b"minf"), b"stbl"), b"stsd")
        entry = read(table[0] + 8, 36)
        channels, rate = struct.unpack(">H", entry[24:26])[0], struct.unpack(">I", entry[32:36])[0] >> 16
        codec = {b"mp4a": "aac", b"alac": "alac", b"Opus": "opus", b"fLaC": "flac"}.get(entry[4:8], entry[4:8].decode("latin-1").strip())
        if not ticks:
            raise ValueError("no time scale")
        return {"duration": length / ticks, "sample_rate": rate or ticks, "channels": channels, "codec": codec, "container": "mp4"}
    raise ValueError("no sound track")


def probe_ranges(read: Read, size: int) -> dict[str, Any]:
    """FIELDS of an audio file that is read by ranges; ValueError if it is none or its duration is unknown or 0."""
    head = read(0, 12)
    tagged = read(_after_id3(read), 4) if head[:3] == b"ID3" else head[:4]
    try:
        if head[:4] in (b"RIFF", b"RF64"):
            found = _wav(read, size)
        elif head[:4] == b"fLaC":
            found = _flac(read, size)
        elif head[:4] == b"OggS":
            found = _ogg(read, size)
        elif head[4:8] == b"ftyp":
            found = _mp4(read, size)
        elif len(tagged) > 1 and tagged[0] == 0xFF and tagged[1] & 0xF6 == 0xF0:
            found = _adts(read, size)
        else:
            found = _mp3(read, size)
    except (struct.error, IndexError) as error:
        raise ValueError("cut off") from error
    if not found["duration"] > 0:
        raise ValueError("no duration")
    return {"bitrate": int(8 * size / found["duration"]), **found}


def probe_bytes(content: bytes) -> dict[str, Any]:
    return probe_ranges(lambda at, n: content[max(at, 0) : max(at, 0) + n], len(content))


def _rows(paths: list[str], probed: Callable[[int], dict[str, Any]]) -> pd.DataFrame:
    rows = []
    for i, path in enumerate(paths):
        try:
            rows.append({"path": path, **probed(i), "error": None})
        except (ValueError, OSError) as error:
            rows.append({"path": path, "error": str(error) or "unreadable"})
    frame = pd.DataFrame(rows, columns=["path", *FIELDS, "error"], dtype=object)
    return frame.astype({"duration": "float64", "sample_rate": "Int32", "channels": "Int32", "bitrate": "Int64"})


def probe_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """PROBED of batches with path and content."""
    for batch in batches:
        held = batch["content"].tolist()
        yield _rows(batch["path"].tolist(), lambda i, held=held: probe_bytes(held[i] or b""))


def probe(contents: DataFrame) -> DataFrame:
    """contents(path, content) -> path, FIELDS and error: why a file can't be used, null if it can. Null content is none."""
    return contents.select("path", "content").mapInPandas(probe_rows, PROBED)


def probe_files(spark: SparkSession, path: str) -> DataFrame:
    """The same for the files below a path, of which only headers and ends are read."""

    def ranged(name: str) -> dict[str, Any]:
        with opened(name) as file:
            return probe_ranges(lambda at, n: file.read_at(min(n, max(0, file.size() - max(at, 0))), max(at, 0)), file.size())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = batch["path"].tolist()
            yield _rows(paths, lambda i, paths=paths: ranged(paths[i]))

    # Paths only: the file source doesn't read contents that nobody asks for.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin("mp3", "wav", "m4a", "aac", "flac", "ogg")).mapInPandas(each, PROBED)
