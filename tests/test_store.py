"""Manifests, sealed files, byte ranges and cached results on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parley.sources import manifest, store
from parley.sources.tables import write_csv


def test_manifest_rows_and_errors(spark, tmp_path):
    lines = [
        "﻿Audio,speaker,emotion,satisfaction,start,end,extra",
        'a.wav,"Ann, B",HAPPY,80,1:30,00:02:00,x',
        "/etc/a.wav,,sad,,,,",
        "b/../../a.wav,,sad,,,,",
        ",,sad,,,,",
        "a.wav,,joyful,,,,",
        "a.wav,,,,,,",
        "a.wav,,,101,,,",
        "a.wav,,,many,,,",
        "a.wav,,sad,,1:x,,",
        "a.wav,,sad,,10,10,",
        "lost.wav,,sad,,,,",
        "a.wav,,,55.5,83.5,,",
    ]
    path = tmp_path / "m.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    known = spark.createDataFrame([("a.wav",)], "audio string")
    found = manifest.read_manifest(spark, str(path), known)
    rows = {r["row"]: r for r in found.collect()}
    assert rows[2]["speaker"] == "Ann, B" and rows[2]["emotion"] == "happy" and (rows[2]["start_s"], rows[2]["end_s"], rows[2]["error"]) == (90.0, 120.0, None)
    assert [rows[i]["error"] for i in range(3, 13)] == ["audio is outside of the folder"] * 2 + ["audio is missing", "emotion is not known", "neither emotion nor satisfaction"] + ["satisfaction is no number from 0 to 100"] * 2 + ["time is not readable", "end is not after start", "audio is not found"]
    assert rows[13]["error"] is None and rows[13]["start_s"] == 83.5 and rows[13]["satisfaction_n"] == 55.5
    report = manifest.import_report(found, most=3).first()
    assert (report["imported"], report["error_count"], [e["row"] for e in report["errors"]]) == (2, 10, [3, 4, 5])


def test_numbers_go_on_across_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("audio,emotion\n" + "".join(f"f{i}_{j}.wav,sad\n" for j in range(4)))
    rows = manifest.read_manifest(spark, str(tmp_path)).collect()
    assert sorted(r["row"] for r in rows) == list(range(2, 14))


@pytest.mark.parametrize("start,length", [(0, 5), (3, 9), (8, 8), (15, 100), (40, 3)])
def test_sealed_ranges(spark, start, length):
    data = {1: bytes(range(40)), 2: b"short", 3: b"", 4: bytes([0, 255, 10, 0] * 5)}
    frame = spark.createDataFrame([*data.items(), (5, None)], "id long, content binary")
    sealed = store.seal(frame, "id", "content", "secret", 8)
    assert sealed.where("id = 3").count() == 1 and sealed.where("id = 5").count() == 0
    got = {r["id"]: bytes(r["content"]) for r in store.read_range(sealed, "id", start, length, "secret", 8).collect()}
    for i, content in data.items():
        assert got.get(i, b"") == content[start : start + length]


def test_a_sealed_chunk_opens_at_its_place_only(spark):
    sealed = store.seal(spark.createDataFrame([(1, b"0123456789abcdef")], "id long, content binary"), "id", "content", "secret", 8)
    for other, secret in ((sealed.withColumn("part", 1 - F.col("part")), "secret"), (sealed.withColumn("id", F.lit(2)), "secret"), (sealed, "wrong")):
        with pytest.raises(Exception):  # noqa: B017
            store.read_range(other, "id", 0, 4, secret, 8).collect()


def test_byte_ranges(spark):
    cases = {("bytes=0-9", 100): (206, 0, 9), ("bytes=90-200", 100): (206, 90, 99), ("bytes=5-", 100): (206, 5, 99), ("bytes=-7", 100): (206, 93, 99), ("bytes=-700", 100): (206, 0, 99), ("bytes=100-", 100): (416, None, None), ("bytes=9-3", 100): (416, None, None), ("bytes=-", 100): (200, 0, 99), (None, 100): (200, 0, 99), ("bytes=0-1", 0): (416, None, None), ("bytes=-5", 0): (416, None, None)}
    frame = spark.createDataFrame(list(cases), "h string, n long")
    got = {(r["h"], r["n"]): tuple(r["r"]) for r in frame.select("h", "n", store.byte_range(F.col("h"), F.col("n")).alias("r")).collect()}
    assert got == cases


def test_cache_by_organisation(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "org_id long, file_hash string, stage string, config_hash string, value string"
    store.cache_put(spark.createDataFrame([(1, "aa1", "vad", "c", "x"), (1, None, "vad", "c", "lost"), (2, "aa1", "vad", "c", "other")], schema), path)
    store.cache_put(spark.createDataFrame([(1, "aa1", "vad", "c", "newer"), (1, "aa2", "vad", "c", "y")], schema), path)
    asked = spark.createDataFrame([(1, "aa1", "vad", "c"), (1, "aa2", "vad", "c"), (1, "aa2", "vad", "d"), (2, "aa1", "vad", "c"), (3, "aa1", "vad", "c")], "org_id long, file_hash string, stage string, config_hash string")

    def values():
        return [r["value"] for r in store.cache_get(asked, path).orderBy("org_id", "file_hash", "config_hash").collect()]

    assert values() == ["newer", "y", None, "other", None]
    store.cache_purge(asked.where("org_id = 1 and file_hash = 'aa1'"), path)
    assert values() == [None, "y", None, "other", None]
    store.cache_put(spark.createDataFrame([(1, "aa1", "vad", "c", "again")], schema), path)
    assert values()[0] == "again"


def test_uploads(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"123")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in store.read_uploads(spark, str(tmp_path)).collect()}
    assert {k: r["error"] for k, r in rows.items()} == {"a.wav": None, "b.txt": "extension"}
    assert rows["a.wav"]["file_hash"].startswith("a665a459") and rows["b.txt"]["file_hash"] is None


def test_upload_errors(spark):
    cases = [("x.MP3", 5, 60.0, None), ("x", 5, 60.0, "extension"), ("a.mp3/x.exe", 5, 60.0, "extension"), (None, 5, 60.0, "extension"), ("x.ogg", 0, 60.0, "empty"), ("x.ogg", None, 60.0, "empty"), ("x.ogg", 5 << 30, 60.0, "too_large"), ("x.ogg", 5, None, "not_audio"), ("x.ogg", 5, 43_201.0, "too_long")]
    frame = spark.createDataFrame([(i, n, s, d) for i, (n, s, d, _) in enumerate(cases)], "i int, name string, size long, seconds double")
    got = [r["e"] for r in frame.orderBy("i").select(store.upload_error(F.col("name"), F.col("size"), F.col("seconds")).alias("e")).collect()]
    assert got == [c[3] for c in cases]


def test_csv_begins_with_a_mark(spark, tmp_path):
    write_csv(spark.createDataFrame([("é", 'say "x"')], "a string, b string").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa,b\n") and "é" in part.read_text("utf-8")


def test_redaction_is_that_of_the_plain_function_on_every_text(spark):
    from parley.functions import text as tf
    from parley.plans.text_queries import redacted

    said = ["Call me at 555 123 4567", "nothing to see", None, "", "mi correo es ana.b@x.org", "ana arroba correo punto com", "le habla Juan Pérez", "DNI ABCDE12", "Dr. House", "one two three four five six seven", "card 4539 5787 6362 1486", "vivo en calle Mayor 12"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    texts = said + [r["text"] for r in docs.collect()]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r["i"]: r["text"] for r in redacted(frame, "text").collect()}
    assert got == {i: tf.redact(t or "") for i, t in enumerate(texts)}
    assert sum(got[i] != t for i, t in enumerate(said) if t) == 9
    odd = {r["i"]: r["text"] for r in redacted(frame, "text", F.col("i") % 2 == 1).collect()}
    assert odd[0] == said[0] and odd[5] == got[5]


def test_documents_of_calls_hold_all_parts(spark):
    import json

    from parley.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["snk2_json_export"](spark, sf).collect()
    said = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").where("role in ('user', 'assistant')").collect():
        said.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
    assert {r["call_id"] for r in rows} == set(said)
    for r in rows:
        document = json.loads(r["document"])
        assert set(document) == {"call_id", "call", "speakers", "segments", "transcription", "emotions", "satisfaction", "events", "model", "interaction", "confidence", "config", "redacted", "exported_at", "notice"}
        assert document["redacted"] is False and document["exported_at"] == "2024-02-01T00:00:00Z" and 0 <= document["confidence"]["speakers"] <= 1 and "overlaps" in document["interaction"]
        assert sorted(x["text"] for x in document["transcription"]) == sorted(t for _, t in said[r["call_id"]])
        assert [x["start"] for x in document["segments"]] == sorted(x["start"] for x in document["segments"])
        assert all(abs(sum(x["probabilities"]) - 1) < 1e-3 for x in document["emotions"]) and len(document["segments"]) == r["n_segments"]
        assert {s["speaker"] for s in document["satisfaction"]} <= {s["speaker"] for s in document["speakers"]}
    assert any(json.loads(r["document"])["satisfaction"][0]["timeline"] for r in rows if json.loads(r["document"])["satisfaction"])


def test_documents_of_calls_are_redacted_on_request(spark):
    from parley.operators import exports

    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    calls = one("call_id long", (1,), (2,))
    said = one("call_id long, speaker string, turn long, start_ms long, end_ms long, text string, text_redacted string, text_conf double", (1, "A", 0, 0, 1, "I am Ann", "I am [X]", 0.5), (1, "A", 1, 2, 3, "plain", None, 0.5))
    speakers = one("call_id long, speaker string, turns long, talk_s double, ratio double", (1, "A", 2, 0.1, 1.0))
    segments = one("call_id long, speaker string, turn long, start_ms long, end_ms long", (1, "A", 0, 0, 1))
    emotions = one("call_id long, speaker string, widx long, w_start long, w_end long, p array<double>, conf double", (1, "A", 0, 0, 1, [1.0], 1.0))
    line = one("call_id long, speaker string, t double, score double", (1, "A", 0.0, 50.0))
    model = one("call_id long, name string", (1, "m"))
    for redact, texts in ((True, ["I am [X]", "plain"]), (False, ["I am Ann", "plain"])):
        rows = {r["call_id"]: r for r in exports.call_documents(calls, speakers, segments, said, emotions, line.select("call_id", "speaker"), line, line.select("call_id", "t", F.lit("x").alias("type")), {}, model=model, redact=redact).collect()}
        assert [x["text"] for x in rows[1]["transcription"]] == texts and rows[1]["redacted"] is redact and rows[1]["model"]["name"] == "m"
        assert rows[2]["transcription"] == [] and rows[2]["model"] is None and rows[2]["exported_at"][-1] == "Z" and rows[1]["interaction"] is None


def test_uploads_are_hashed_by_pieces(spark, tmp_path, monkeypatch):
    import hashlib

    data = bytes(range(256)) * 90_000  # three pieces of 8 MB
    (tmp_path / "long.wav").write_bytes(data)
    (tmp_path / "short.mp3").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"x")
    found = {r["path"].rsplit("/")[-1]: r for r in store.read_uploads(spark, str(tmp_path)).collect()}
    assert found["long.wav"]["file_hash"] == hashlib.sha256(data).hexdigest() and found["long.wav"]["size"] == len(data)
    assert found["short.mp3"]["file_hash"] == hashlib.sha256(b"x").hexdigest() and (found["notes.txt"]["file_hash"], found["notes.txt"]["error"]) == (None, "extension")


def test_cues_of_a_text():
    from parley.functions import text as tf

    score, confidence, frustration, resolution, label, cues = tf.lexicon_signals("ya estoy cansado de llamar y nadie me soluciona nada")
    assert score < -0.3 and label == "negative" and ("frustration", "cansado de") in cues and ("frustration", "nadie me") in cues
    assert frustration == min(1.0, 0.9 + 0.15 * (len(cues) - 1)) and resolution == 0 and confidence == min(1.0, round(0.25 + 0.25 * len(cues), 4))
    assert abs(tf.lexicon_signals("gracias por llamar ¿en que puedo ayudarle?")[0]) < 0.15
    assert tf.lexicon_signals("no me ayudo en nada")[5] == [("negated_positive", "no me ayudo")] and tf.lexicon_signals("no me ayudo en nada")[0] <= 0
    happy = tf.lexicon_signals("muchas gracias quedo resuelto excelente servicio")
    assert happy[0] > 0.3 and [t for t, _ in happy[5]] == ["resolution"] * len(happy[5]) and len(tf.lexicon_signals("perfecto " * 50)[5]) == 8
    assert tf.lexicon_signals(None) == tf.lexicon_signals("hola") == (0.0, 0.0, 0.0, 0.0, "neutral", [])


def test_requests_and_samples(spark):
    from parley.operators import requests

    nan = float("nan")
    rows = [(1, 50.0, 1, 10, "Ann", 0.7, 0.3), (2, -1.0, 0, 500, "A", -0.1, 0.5), (3, 101.0, 1, 200, None, 0.0, 0.0), (4, nan, None, None, " ", 0.5, 0.5)]
    asked = spark.createDataFrame(rows, "id long, satisfaction double, page int, page_size int, name string, train double, validation double")
    fine, refused = requests.checked(asked, ["name"])
    assert [r["id"] for r in fine.collect()] == [1] and fine.columns == asked.columns
    assert {r["id"]: r["errors"] for r in refused.collect()} == {
        2: ["satisfaction.low", "page.low", "page_size.high", "name.length.low", "split.negative", "split.empty"],
        3: ["name.missing", "satisfaction.high", "split.empty", "split.sum"],
        4: ["name.missing", "satisfaction.high", "name.length.low"],
    }
    samples = spark.createDataFrame([(1, "train", "sad", ["x"]), (2, "train", "sad", []), (3, "test", "sad", None), (4, None, None, ["y"])], "id long, split string, emotion string, issues array<string>")
    ids = lambda **k: sorted(r["id"] for r in requests.sample_filters(samples, **k).collect())
    assert ids() == [1, 2, 3, 4] and ids(split="train") == [1, 2] and ids(with_issues=True) == [1, 4] and ids(with_issues=False) == [2, 3] and ids(emotion="sad", with_issues=True) == [1]


def test_plugins(spark):
    from parley import plugins

    assert plugins.names("text_analyzer") == ["lexicon"] and plugins.build("text_analyzer", "lexicon") is plugins.build("text_analyzer", "lexicon", {})
    assert plugins.build("text_analyzer", "lexicon", {"sign": "corrected"}).sign == "corrected"
    for kind, name, error in (("text_analyzer", "absent", "no text_analyzer"), ("painter", "x", "no painter")):
        with pytest.raises(ValueError, match=error):
            plugins.build(kind, name)
    with pytest.raises(ValueError, match="plug-in point"):
        plugins.register("painter", "x", dict)
    plugins.register("transcriber", "broken", lambda config: object())
    with pytest.raises(TypeError, match="lacks words"):
        plugins.build("transcriber", "broken")
    assert plugins.build("voice_detector", "energy").segments([0.0] * 8000 + [0.3, -0.3] * 4000 + [0.0] * 8000, 16000)[0] == pytest.approx((0.5, 1.0), abs=0.04)
    rows = spark.createDataFrame([(1, "my name is Ann Lee, call 555 123 4567"), (2, None), (3, "nothing")], "id long, text string")
    found = plugins.apply(rows, "pii_detector", "rules", ["text"], ["id", "text"], "entity string, start int", lambda plug, row: [(e, s) for e, s, _ in plug.spans(row[0] or "")])
    assert sorted((r["id"], r["entity"]) for r in found.collect()) == [(1, "PERSON"), (1, "PHONE")] and found.columns == ["id", "text", "entity", "start"]
