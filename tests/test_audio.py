"""Audio: block and window reads, container headers, prosody, augmentation, validation, the cepstral diarizer, chunks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import signal
from parley.operators import diarization
from parley.sources import audio, blocks, containers

RATE = 16000


def wav(x: np.ndarray, rate: int = RATE, kind: str = "i2") -> bytes:
    """A WAV file of frames x channels, with a chunk before its samples."""
    x = x if x.ndim == 2 else x[:, None]
    size = int(kind[1])
    if kind == "i3":
        data = (np.round(x * ((1 << 23) - 1)).astype("<i4")).tobytes()
        data = b"".join(data[i : i + 3] for i in range(0, len(data), 4))
    elif kind == "u1":
        data = np.round(x * 127 + 128).astype(np.uint8).tobytes()
    elif kind[0] == "i":
        data = np.round(x * ((1 << 8 * size - 1) - 1)).astype(f"<{kind}").tobytes()
    else:
        data = x.astype(f"<{kind}").tobytes()
    code, channels = 3 if kind[0] == "f" else 1, x.shape[1]
    form = struct.pack("<HHIIHH", code, channels, rate, rate * channels * size, channels * size, 8 * size)
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    folder = tmp_path_factory.mktemp("recordings")
    rng = np.random.default_rng(0)
    signals = {"stereo": rng.uniform(-0.9, 0.9, (RATE * 7 + 123, 2)), "mono": rng.uniform(-0.9, 0.9, (RATE * 3, 1))}
    for name, x in signals.items():
        (folder / f"{name}.wav").write_bytes(wav(x))
    (folder / "broken.wav").write_bytes(b"RIFFxxxx")
    (folder / "other.txt").write_bytes(b"no sound")
    return folder, {n: np.round(x * 32767).astype("<i2").astype(np.float32) / 32768 for n, x in signals.items()}


@pytest.mark.parametrize("range_bytes", [10_000, 100_000, 1 << 30])
def test_blocks_cover_each_file_once_however_it_is_cut(spark, recordings, range_bytes):
    folder, signals = recordings
    rows = blocks.read_blocks(spark, str(folder), 1.25, range_bytes).collect()
    for name, x in signals.items():
        for channel in range(x.shape[1]):
            found = sorted((r["offset_s"], r["samples"]) for r in rows if r["path"].endswith(f"{name}.wav") and r["channel"] == channel)
            assert [at for at, _ in found] == [1.25 * i for i in range(len(found))]
            assert np.array_equal(np.concatenate([s for _, s in found]).astype(np.float32), x[:, channel])
    assert {r["path"].rsplit("/")[-1] for r in rows} == {"stereo.wav", "mono.wav"}


def test_conditions_reach_the_reader(spark, recordings):
    folder, _ = recordings
    found = blocks.read_blocks(spark, str(folder), 1.0, 50_000).where("offset_s >= 2 and offset_s < 4")
    assert sorted((r["path"].rsplit("/")[-1], r["offset_s"], r["channel"]) for r in found.collect()) == [("mono.wav", 2, 0), *(("stereo.wav", t, c) for t in (2, 3) for c in (0, 1))]
    reader = blocks.PcmReader({"path": str(folder), "blockseconds": "1", "rangebytes": "50000"})
    every = reader.partitions()
    assert len(every) > 8  # one file is many partitions
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    list(reader.pushFilters([GreaterThan(("offset_s",), 2.0), LessThan(("offset_s",), 3.5), EqualTo(("path",), str(folder / "mono.wav"))]))
    assert {p.path for p in reader.partitions()} == {str(folder / "mono.wav")} and (reader.least, reader.most) == (2.0, 3.5)


def test_memory_follows_the_block_not_the_file(tmp_path):
    import tracemalloc

    def peak(minutes: int) -> int:
        path = tmp_path / f"{minutes}.wav"
        with path.open("wb") as out:
            out.write(wav(np.zeros((0, 2)))[:-4] + struct.pack("<I", minutes * 60 * 8000 * 4))
            for _ in range(minutes):
                out.write(bytes(60 * 8000 * 4))
        reader = blocks.PcmReader({"path": str(path), "blockseconds": "30"})
        tracemalloc.start()
        n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 2 * minutes
        return most

    assert peak(60) < 1.2 * peak(6) + 2e6


def test_windows_equal_slices(spark, recordings):
    folder, signals = recordings
    asked = [("stereo", -1.0, 0.5, 1), ("stereo", 2.25, 3.0, None), ("mono", 2.9, 5.0, 0), ("mono", 1.0, 1.0, 0), ("mono", 9.0, 10.0, 0), ("stereo", 1.0, 2.0, 7), ("absent", 0.0, 1.0, None), ("mono", None, 1.0, 0)]
    rows = [(str(folder / f"{n}.wav"), a, b, c) for n, a, b, c in asked]
    found = blocks.read_windows(spark.createDataFrame(rows, "path string, start double, end double, channel int")).collect()
    assert len(found) == len(asked)
    for r in found:
        name = r["path"].rsplit("/")[-1][:-4]
        if name == "absent" or r["channel"] == 7 or r["start"] is None:
            assert r["samples"] is None
            continue
        x, start = signals[name], max(0.0, r["start"])
        part = x[int(start * RATE) : int(start * RATE) + int((r["end"] - start) * RATE)]
        expected = part.mean(axis=1) if r["channel"] is None else part[:, r["channel"]]
        assert np.allclose(r["samples"], expected)


@pytest.mark.parametrize(("kind", "codec", "close"), [("u1", "pcm_u8", 0.02), ("i2", "pcm_s16le", 1e-4), ("i3", "pcm_s24le", 1e-6), ("i4", "pcm_s32le", 1e-6), ("f4", "pcm_f32le", 1e-6), ("f8", "pcm_f64le", 1e-6)])
def test_kinds_of_samples(tmp_path, kind, codec, close):
    x = np.random.default_rng(1).uniform(-0.9, 0.9, (500, 2))
    path = tmp_path / "a.wav"
    path.write_bytes(wav(x, 8000, kind))
    with blocks.opened(str(path)) as file:
        pcm = blocks.wav_layout(file, file.size())
        assert np.abs(pcm.read(file, 0, 1000) - x).max() < close
    assert containers.probe_bytes(path.read_bytes()) == {"duration": 500 / 8000, "sample_rate": 8000, "channels": 2, "bitrate": 16 * 8000 * int(kind[1]), "codec": codec, "container": "wav"}


def flac(samples: int) -> bytes:
    packed = 44100 << 44 | 1 << 41 | 15 << 36 | samples
    return b"fLaC" + b"\x80\0\0\x22" + bytes(10) + packed.to_bytes(8, "big") + bytes(16) + bytes(1000)


def ogg_page(packet: bytes, granule: int, serial: int = 7) -> bytes:
    return b"OggS\0\0" + struct.pack("<qIII", granule, serial, 0, 0) + bytes([1, len(packet)]) + packet


def mp3_frames(n: int, first: bytes = b"") -> bytes:
    """128 kbit/s at 44.1 kHz, two channels: 417 bytes a frame."""
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    return (frame[:36] + first + frame[36 + len(first) :] if first else frame) + frame * (n - 1)


def adts(n: int) -> bytes:
    """16 kHz, one channel, 100 bytes a frame."""
    return (b"\xff\xf1" + bytes([1 << 6 | 8 << 2, 1 << 6 | 100 >> 11, 100 >> 3 & 255, (100 & 7) << 5 | 31, 0xFC]) + bytes(93)) * n


def box(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + name + body


def m4a(ticks: int, length: int, media: bytes = b"soun", wide: bool = False) -> bytes:
    header = struct.pack(">B3xQQIQ", 1, 0, 0, ticks, length) if wide else struct.pack(">B3xIIII", 0, 0, 0, ticks, length)
    entry = struct.pack(">I4s6xH8xHHHHI", 36, b"mp4a", 1, 2, 16, 0, 0, 22050 << 16)
    track = box(b"trak", box(b"mdia", box(b"mdhd", header, bytes(4)), box(b"hdlr", bytes(8) + media + bytes(12)), box(b"minf", box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry)))))
    return box(b"ftyp", b"M4A \0\0\0\0") + box(b"mdat", bytes(5000)) + box(b"moov", box(b"mvhd", bytes(100)), track)


ID3 = b"ID3\x04\0\0\0\0\x01\x48" + bytes(200)
CONTAINERS = {
    "flac": (flac(441_000), 10.0, 44100, 2, "flac", "flac"),
    "vorbis": (ogg_page(b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 1, 22050, 0, 0, 0, 0xB8, 1), 0) + bytes(300_000) + ogg_page(b"x", 99, 8) + ogg_page(b"end", 66_150) + ogg_page(b"x", 5, 8), 3.0, 22050, 1, "vorbis", "ogg"),
    "opus": (ogg_page(b"OpusHead\x01\x02" + struct.pack("<HIhB", 312, 16000, 0, 0), 0) + ogg_page(b"end", 48_312), 1.0, 48000, 2, "opus", "ogg"),
    "mp3": (mp3_frames(100), 41_700 * 8 / 128_000, 44100, 2, "mp3", "mp3"),
    "mp3_tagged": (ID3 + mp3_frames(50) + b"TAG" + bytes(125), 20_850 * 8 / 128_000, 44100, 2, "mp3", "mp3"),
    "mp3_counted": (mp3_frames(10, b"Xing" + struct.pack(">II", 1, 2000)), 2000 * 1152 / 44100, 44100, 2, "mp3", "mp3"),
    "mp3_vbri": (mp3_frames(10, b"VBRI" + bytes(10) + struct.pack(">I", 500)), 500 * 1152 / 44100, 44100, 2, "mp3", "mp3"),
    "adts": (adts(1000), 64.0, 16000, 1, "aac", "adts"),
    "m4a": (m4a(1000, 12_500), 12.5, 22050, 2, "aac", "mp4"),
    "m4a_wide": (m4a(48000, 96_000, wide=True), 2.0, 22050, 2, "aac", "mp4"),
}


def test_containers(spark, tmp_path):
    bad = {"empty": b"", "noise": bytes(range(256)) * 20, "cut": flac(9)[:20], "video": m4a(1000, 5, b"vide"), "silent": flac(0), "text": b"just some words"}
    names = {name: f"{name}.{'m4a' if c[5] == 'mp4' else 'aac' if c[5] == 'adts' else c[5]}" for name, c in CONTAINERS.items()} | {name: f"{name}.mp3" for name in bad}
    data = {name: c[0] for name, c in CONTAINERS.items()} | bad
    for name, file in names.items():
        (tmp_path / file).write_bytes(data[name])
    (tmp_path / "left.txt").write_bytes(flac(9))
    held = {r["path"]: r for r in containers.probe(spark.createDataFrame([(n, bytearray(d)) for n, d in data.items()] + [("null", None)], "path string, content binary")).collect()}
    ranged = {r["path"].rsplit("/")[-1]: r for r in containers.probe_files(spark, str(tmp_path)).collect()}
    assert set(ranged) == {names[n] for n in names if n != "empty"}  # the file source skips empty files
    for name, (_, seconds, rate, channels, codec, container) in CONTAINERS.items():
        for r in (held[name], ranged[names[name]]):
            assert (r["sample_rate"], r["channels"], r["codec"], r["container"], r["error"]) == (rate, channels, codec, container, None), name
            assert r["duration"] == pytest.approx(seconds) and (codec == "flac" or r["bitrate"] == int(8 * len(data[name]) / r["duration"]))
    assert all(held[n]["error"] and held[n]["duration"] is None for n in [*bad, "null"])


def test_mel_filters_and_cosine_transform_against_sums():
    rate, size, mels = 16000, 512, 40
    found = signal.mel_filters(rate, size, mels)
    points = [float(signal.mel_to_hz(m)) for m in np.linspace(0, float(signal.hz_to_mel(rate / 2)), mels + 2)]
    for m in range(mels):
        a, b, c = points[m : m + 3]
        for k in range(0, size // 2 + 1, 7):
            f = k * rate / size
            height = (f - a) / (b - a) if a <= f <= b else (c - f) / (c - b) if b < f <= c else 0.0
            assert found[m, k] == pytest.approx(2 / (c - a) * height, abs=1e-12)
    x = np.random.default_rng(0).normal(size=40)
    for k, y in enumerate(signal.cosine_transform(40, 24) @ x):
        direct = sum(v * np.cos(np.pi * k * (2 * i + 1) / 80) for i, v in enumerate(x)) * np.sqrt((1 if k == 0 else 2) / 40)
        assert y == pytest.approx(direct)
    assert float(signal.mel_to_hz(signal.hz_to_mel(3333.0))) == pytest.approx(3333.0) and float(signal.hz_to_mel(1000.0)) == pytest.approx(15.0)


def test_slopes_and_centroid():
    line = np.outer(np.arange(20.0), [1.0, -3.0])
    assert np.allclose(signal.slopes(line), [[1.0, -3.0]] * 20) and not signal.slopes(line[:5]).any()
    tone = np.abs(np.fft.rfft(signal.hann(512) * np.sin(2 * np.pi * 2000 * np.arange(512) / RATE)))[None, :]
    assert signal.centroid(tone, RATE)[0] == pytest.approx(2000, abs=1) and signal.centroid(np.zeros((1, 257)), RATE)[0] == 0


def voice(seconds: float, f0: float, formants: list[float], seed: int, rate: int = RATE) -> np.ndarray:
    """Harmonics under an envelope with peaks at the formants, with a little vibrato and noise."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * rate)) / rate
    phase = 2 * np.pi * np.cumsum(f0 * (1 + 0.02 * np.sin(2 * np.pi * 4 * t + seed))) / rate
    out = np.zeros(len(t))
    for k in range(1, int(3800 / f0)):
        out += sum(np.exp(-(((k * f0 - f) / 150) ** 2)) for f in formants) * np.sin(k * phase)
    return 0.3 * out / np.abs(out).max() + 0.002 * rng.normal(size=len(t))


LOW, HIGH = (110.0, [500.0, 1500.0]), (230.0, [900.0, 2800.0])


@pytest.fixture(scope="module")
def spoken(spark):
    """Call 1: two voices in turn, 4 s each with pauses; call 2: one voice; call 3: a second of speech; call 4: two voices in
    two blocks."""
    rows, segments = [], []

    def add(call: int, voices: list[tuple[int, tuple]], offset: float = 0.0) -> None:
        at, parts = 0.0, []
        for i, (_, (f0, formants)) in enumerate(voices):
            parts += [voice(4.0, f0, formants, 10 * call + i), np.zeros(int(0.5 * RATE))]
            segments.append((call, int(1000 * (offset + at)), int(1000 * (offset + at + 4))))
            at += 4.5
        rows.append((call, offset, RATE, np.concatenate(parts).astype(np.float32).tolist()))

    order = [0, 1, 0, 1, 1, 0]
    add(1, [(v, (LOW, HIGH)[v]) for v in order])
    add(2, [(0, LOW)] * 5)
    rows.append((3, 0.0, RATE, voice(1.2, *LOW, 3).astype(np.float32).tolist()))
    segments.append((3, 0, 1200))
    add(4, [(0, LOW), (1, HIGH), (1, HIGH)])
    add(4, [(1, HIGH), (0, LOW), (0, LOW)], 13.5)
    rows.append((5, 0.0, RATE, None))
    return spark.createDataFrame(rows, "call_id long, offset_s double, sample_rate int, samples array<float>"), spark.createDataFrame(segments, "call_id long, start_ms long, end_ms long"), order


def test_two_voices_apart_and_one_whole(spark, spoken):
    found, segments, order = spoken
    turns, decisions = diarization.diarize(found, segments, cut=lambda df: df.checkpoint())
    by = {r["call_id"]: r for r in decisions.collect()}
    assert by[1]["voices"] == 2 and by[1]["silhouette"] >= 0.25 and by[1]["separation"] >= 1.3 and by[1]["quality"] <= 60
    assert by[2]["voices"] == 1 and by[2]["reason"] == "no second voice" and by[2]["quality"] == 100
    assert by[3]["reason"] == "too little speech" and by[4]["voices"] == 2 and set(by) == {1, 2, 3, 4}
    rows = {c: sorted((r["start_ms"], r["end_ms"], r["speaker"]) for r in turns.where(F.col("call_id") == c).collect()) for c in by}
    truth = [(4500 * i, 4500 * i + 4000, order[i]) for i in range(len(order))]
    grid = np.arange(0, 27_000, 100)
    at = lambda spans, t: next((int(str(s)[-1]) for a, b, s in spans if a <= t < b), -1)
    both = [(at(truth, t), at(rows[1], t)) for t in grid if at(truth, t) >= 0 and at(rows[1], t) >= 0]
    assert np.mean([a == b for a, b in both]) > 0.85
    assert [r[2] for r in rows[2]] == ["SPEAKER_00"] and rows[2][0][0] == 0 and rows[2][-1][1] == 22_000
    assert [r[2] for r in rows[4]] == [f"SPEAKER_0{v}" for v in (0, 1, 1, 1, 0, 0)]


def test_hints_decide(spark, spoken):
    found, segments, _ = spoken
    hints = spark.createDataFrame([(1, 1), (2, 2)], "call_id long, speakers int")
    turns, decisions = diarization.diarize(found, segments, hints, cut=lambda df: df.checkpoint())
    by = {r["call_id"]: r for r in decisions.collect()}
    assert by[1]["voices"] == 1 and by[1]["reason"] == "asked for" and by[2]["voices"] == 2 and by[2]["forced"]
    assert {r["speaker"] for r in turns.where("call_id = 1").collect()} == {"SPEAKER_00"}


def test_silhouette_against_loops():
    rng = np.random.default_rng(5)
    rows, labels = rng.normal(size=(40, 3)), (rng.random(40) < 0.4).astype(int)
    total = 0.0
    for i in range(40):
        mean = {k: np.mean([np.linalg.norm(rows[i] - rows[j]) for j in range(40) if j != i and labels[j] == k]) for k in (0, 1)}
        own, other = mean[labels[i]], mean[1 - labels[i]]
        total += (other - own) / max(own, other)
    assert diarization.silhouette(rows, labels) == pytest.approx(total / 40)
    assert diarization.cluster_stats(rows, np.array([1] + [0] * 39)) == (0.0, 0.0, 0.0)


def test_speech_segments(spark):
    x = np.concatenate([np.zeros(RATE), audio.tone(200, 1.0), np.zeros(RATE // 10), audio.tone(200, 0.5), np.zeros(RATE), audio.tone(200, 0.1), np.zeros(RATE)])
    rows = spark.createDataFrame([(1, 10.0, RATE, (x + 1e-4).tolist()), (2, 0.0, RATE, [0.0] * RATE), (3, 0.0, RATE, None)], "call_id long, offset_s double, sample_rate int, samples array<float>")
    found = [(r["call_id"], r["start_ms"], r["end_ms"]) for r in audio.speech_segments(rows, ["call_id"]).collect()]
    assert len(found) == 1 and found[0][0] == 1 and abs(found[0][1] - 11_000) <= 30 and abs(found[0][2] - 12_600) <= 30


def test_chunks_own_every_moment_once(spark):
    rng = np.random.default_rng(7)
    calls = [(1, 0), (2, 999), (3, 10_000), (4, 10_001), (5, 9_000 * 4 + 500), (6, 123_456), (7, None)]
    frame = spark.createDataFrame(calls, "call_id long, duration_ms long")
    chunks = diarization.plan_chunks(frame, 10_000, 1_001).checkpoint()
    by = {}
    for r in chunks.orderBy("call_id", "chunk").collect():
        by.setdefault(r["call_id"], []).append(r)
    for call, length in calls[:-1]:
        found = by[call]
        assert found[0]["own_from_ms"] == 0 and found[-1]["own_until_ms"] == length == found[-1]["end_ms"]
        assert all(a["own_until_ms"] == b["own_from_ms"] for a, b in zip(found, found[1:], strict=False))
        assert all(c["start_ms"] <= c["own_from_ms"] <= c["own_until_ms"] <= c["end_ms"] <= c["start_ms"] + 10_000 for c in found)
    assert 7 not in by
    turns = []
    for call, length in calls[2:-1]:
        for speaker in "AB":
            at = 0
            while (at := at + int(rng.integers(200, 3000))) < length - 500:
                end = min(length, at + int(rng.integers(200, 15_000)))
                turns.append((call, speaker, at, end))
                at = end
    seen = [(c, r["chunk"], s, max(a, r["start_ms"]) - r["start_ms"], min(b, r["end_ms"]) - r["start_ms"]) for c, s, a, b in turns for r in by[c] if min(b, r["end_ms"]) > max(a, r["start_ms"])]
    owned = diarization.owned_turns(spark.createDataFrame(seen, "call_id long, chunk long, speaker string, start_ms long, end_ms long"), chunks, 0)
    assert sum(r["end_ms"] - r["start_ms"] for r in owned.collect()) == sum(b - a for _, _, a, b in turns)
    joined = sorted((r["call_id"], r["speaker"], r["start_ms"], r["end_ms"]) for r in diarization.joined_turns(owned).collect())
    assert joined == sorted(turns)
    with pytest.raises(ValueError, match="overlap"):
        diarization.plan_chunks(frame, 10, 10)


def fundamental(x: np.ndarray, rate: int = RATE) -> float:
    return float(np.median(audio.pitches(x, rate, 65, 500, 256)[4:-4]))


@pytest.mark.parametrize("f0", [80.0, 150.0, 220.0, 440.0])
def test_pitch_of_tones(f0):
    assert fundamental(audio.tone(f0, 0.5)) == pytest.approx(f0, rel=0.01)


def test_prosody_values():
    rng = np.random.default_rng(2)
    t = np.arange(RATE) / RATE
    glide = 0.5 * np.sin(2 * np.pi * np.cumsum(150 + 150 * t) / RATE)
    found = audio.window_prosody(np.concatenate([glide, np.zeros(RATE)]))
    assert found["pause_ratio"] == pytest.approx(0.5, abs=0.02) and found["rms_db"] == pytest.approx(-9.0, abs=0.3) and found["energy_std_db"] < 1.5
    assert found["f0_mean"] == pytest.approx(225, rel=0.03) and found["f0_std"] > 25
    assert found["f0_range_st"] == pytest.approx(12 * np.log2(285 / 165), rel=0.15)  # the outer twentieths are trimmed twice
    assert audio.window_prosody(np.zeros(100)) == {} and "f0_mean" not in audio.window_prosody(np.zeros(RATE))
    noisy = audio.window_prosody(np.concatenate([audio.tone(200, 0.5), 0.05 * audio.tone(200, 0.5)]) + 1e-5 * rng.normal(size=RATE))
    assert noisy["energy_std_db"] == pytest.approx(13, abs=1)  # half 26 dB quieter


@pytest.mark.parametrize("factor", [0.95, 1.05, 1.5])
def test_speed_changes_length_and_pitch(factor):
    found = audio.change_speed(audio.tone(200, 1.0), factor)
    assert len(found) == round(RATE / factor) and fundamental(found) == pytest.approx(200 * factor, rel=0.01)
    assert np.abs(found).max() == pytest.approx(0.5, abs=0.05)


@pytest.mark.parametrize("semitones", [-3.0, -1.0, 1.0, 4.0])
def test_pitch_changes_and_length_stays(semitones):
    found = signal.shift_pitch(voice(1.0, 150.0, [500.0], 1), semitones, RATE)
    assert len(found) == RATE and fundamental(found) == pytest.approx(150 * 2 ** (semitones / 12), rel=0.02)


@pytest.mark.parametrize("factor", [0.7, 1.3])
def test_stretching_keeps_the_pitch(factor):
    found = signal.stretch(voice(1.0, 150.0, [500.0], 1), factor, RATE)
    assert len(found) == round(RATE * factor) and fundamental(found) == pytest.approx(150, rel=0.02)


def test_noise_gain_and_mask():
    rng, x = np.random.default_rng(0), np.asarray(audio.tone(200, 1.0), float)
    noise = audio.add_noise(x, 20.0, rng) - x
    assert 10 * np.log10(np.mean(x * x) / np.mean(noise * noise)) == pytest.approx(20, abs=0.3)
    assert np.abs(audio.change_gain(x, 12.0)).max() == 1.0 and np.allclose(audio.change_gain(x, -6.0), x * 10 ** (-0.3))
    masked = audio.time_mask(x, 0.3, RATE, rng)
    gone = np.flatnonzero((masked == 0) & (np.abs(x) > 1e-3))
    assert 0.04 * RATE < gone[-1] - gone[0] < 0.3 * RATE and len(masked) == len(x) and np.array_equal(audio.time_mask(x[:500], 0.3, RATE, rng), x[:500])


def test_augmentation_keeps_limits_and_is_repeatable(spark):
    wild = {"noise_snr_db": (-10.0, 0.0), "gain_db": (-90.0, 90.0), "time_mask_seconds": 5.0, "speed_range": (0.1, 9.0), "pitch_semitones": 24.0}
    x = np.asarray(voice(1.5, 150.0, [500.0], 1), float)
    lengths = set()
    for seed in range(40):
        found = audio.augmented(x, RATE, wild, np.random.default_rng(seed))
        lengths.add(len(found))
        assert 0.95 * len(x) - 1 <= len(x) ** 2 / len(found) <= 1.06 * len(x)
        assert fundamental(found) == pytest.approx(150, rel=0.13)
    assert len(lengths) > 3  # some are faster, some slower
    rows = spark.createDataFrame([(i, x.tolist()) for i in range(6)] + [(7, []), (8, None)], "id long, samples array<float>")
    first, again = ({r["id"]: r["samples"] for r in audio.augment(rows, wild).collect()} for _ in range(2))
    assert first == again and first[7] == [] and first[8] is None and len({tuple(v) for k, v in first.items() if k < 6}) > 1


def test_samples_are_validated(spark):
    x = (0.3 * np.sin(2 * np.pi * 200 * np.arange(24_000) / RATE)).tolist()
    rows = [(1, x, "happy"), (2, x, "happy"), (3, x[:2000], "sad"), (4, [0.0] * 24_000, "sad"), (5, x, None), (6, None, "sad"), (7, [], "sad"), (8, [*x[:-1], float("nan")], "sad"), (9, (x * 21)[: 31 * RATE], " ")]
    found = {r["id"]: r for r in audio.validate_samples(spark.createDataFrame(rows, "id long, samples array<float>, label string")).collect()}
    assert {i: set(r["issues"]) for i, r in found.items()} == {1: set(), 2: {"duplicate"}, 3: {"too_short"}, 4: {"no_voice"}, 5: {"unlabelled", "duplicate"}, 6: {"corrupt"}, 7: {"too_short", "corrupt"}, 8: {"corrupt"}, 9: {"too_long", "unlabelled"}}
    assert found[1]["ok"] and not found[2]["ok"] and found[1]["duration"] == 1.5 and found[1]["rms_db"] == pytest.approx(-13.5, abs=0.1) and found[6]["fingerprint"] is None
    assert zlib.crc32(found[1]["fingerprint"].encode()) == zlib.crc32(found[2]["fingerprint"].encode())
