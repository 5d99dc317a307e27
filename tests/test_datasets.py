"""Archives, versioned data sets, stage runs and stage states."""

from __future__ import annotations

import datetime
import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.sources import archives, versions
from parley.streaming import live, stages


@pytest.fixture
def packed(tmp_path):
    rng = np.random.default_rng(0)
    members = {"a/one.txt": b"hello " * 500, "b/noise.bin": rng.bytes(300_000), "empty": b"", "ü/ñ.txt": "ä".encode() * 9}
    hostile = ["../out.txt", "/etc/passwd", "C:\\x.txt", "a/../../b", "..\\up.txt", "ok/..hidden/../../x"]
    fine = ["..hidden", "a..b/c..", "dir/.x"]
    for i in range(2):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.mkdir("folder")
            for name, data in members.items():
                z.writestr(name if i == 0 else f"second/{name}", data, zipfile.ZIP_DEFLATED if i == 0 else zipfile.ZIP_STORED)
            for name in hostile + fine if i == 0 else []:
                z.writestr(name, b"x")
    broken = (tmp_path / "0.zip").read_bytes()
    at = broken.find(b"b/noise.bin") + 500
    (tmp_path / "bent.zip").write_bytes(broken[:at] + bytes([broken[at] ^ 255]) + broken[at + 1 :])
    (tmp_path / "none.zip").write_bytes(b"PK nothing")
    return tmp_path, members, hostile, fine


def test_members_are_read_and_hostile_names_refused(spark, packed):
    folder, members, hostile, fine = packed
    paths = spark.createDataFrame([(str(folder / n),) for n in ("0.zip", "1.zip", "none.zip", "absent.zip")] + [(None,)], "archive string")
    listed = archives.entries(spark, paths).checkpoint()
    rows = {(r["archive"].rsplit("/")[-1], r["name"]): r for r in archives.read_members(listed).collect()}
    for name, data in members.items():
        for key in (("0.zip", name), ("1.zip", f"second/{name}")):
            assert bytes(rows[key]["content"]) == data and rows[key]["size"] == len(data) and rows[key]["error"] is None
    assert all(rows["0.zip", n]["error"] == "unsafe_name" and rows["0.zip", n]["content"] is None for n in hostile)
    assert all(rows["0.zip", n]["error"] is None for n in fine)
    assert {k[0]: r["error"] for k, r in rows.items() if k[1] is None} == {"none.zip": "unreadable", "absent.zip": "unreadable"}
    assert len(rows) == 2 * len(members) + len(hostile) + len(fine) + 2


def test_damaged_members_and_manifest(spark, packed):
    folder, members, _, _ = packed
    listed = archives.entries(spark, spark.createDataFrame([(str(folder / "bent.zip"),)], "archive string"))
    found = archives.read_members(listed).checkpoint()
    assert {r["name"] for r in found.where("error = 'damaged'").collect()} == {"b/noise.bin"}
    manifest = spark.createDataFrame([("a/one.txt", "x"), ("a/one.txt", "y"), ("b/noise.bin", "z"), ("nowhere", "w"), ("../out.txt", "v")], "audio string, label string")
    got = {r["label"]: (r["error"], r["content"] and bytes(r["content"])) for r in archives.import_rows(found, manifest).collect()}
    assert got == {"x": (None, members["a/one.txt"]), "y": (None, members["a/one.txt"]), "z": ("damaged", None), "w": ("missing", None), "v": ("unsafe_name", None)}


def test_bombs_and_encryption(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("bomb", bytes(5_000_000))
        z.writestr("locked", b"secret")
    data = bytearray(out.getvalue())
    directory = data.find(b"PK\x01\x02")
    data[directory + 24 : directory + 28] = (1000).to_bytes(4, "little")  # says that it is small
    second = data.find(b"PK\x01\x02", directory + 4)
    data[second + 8] |= 1
    (tmp_path / "x.zip").write_bytes(bytes(data))
    found = {r["name"]: r for r in archives.read_members(archives.entries(spark, spark.createDataFrame([(str(tmp_path / "x.zip"),)], "archive string"))).collect()}
    assert found["bomb"]["error"] == "damaged" and found["bomb"]["content"] is None and found["locked"]["error"] == "encrypted"
    assert len(archives._inflated(zlib.compress(bytes(5_000_000))[2:], 1000)) == 1001


def test_a_change_in_a_clone_leaves_the_old_version(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(100)] + [(None, "nobody")], "id long, v string")
    kept = versions.VersionedSet(spark, str(tmp_path / "set"), "id", rows.schema, buckets=8)
    assert kept.versions() == []
    one = kept.create(rows)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "set/data").rglob("*.parquet")}
    before = files()
    two = kept.clone(one)
    assert (one, two) == (1, 2) and files() == before and kept.parent(two) == 1 and kept.parent(one) is None
    read = lambda v: sorted(map(tuple, kept.read(v).collect()), key=repr)
    assert read(two) == read(one)
    kept.change(two, spark.createDataFrame([(5, "new"), (500, "added")], rows.schema), spark.createDataFrame([(7,), (9999,)], "id long"))
    expected = {i: f"v{i}" for i in range(100)} | {5: "new", 500: "added"}
    del expected[7]
    assert read(two) == sorted([*expected.items(), (None, "nobody")], key=repr) and read(one) == sorted(map(tuple, rows.collect()), key=repr)
    assert before.items() <= files().items()  # what there was is as it was
    kept.freeze(two)
    with pytest.raises(versions.Frozen):
        kept.change(two, deletes=spark.createDataFrame([(1,)], "id long"))
    three = kept.clone(two)
    kept.change(three, deletes=kept.read(three).select("id"))
    assert read(three) == [(None, "nobody")] and kept.versions() == [1, 2, 3] and kept.frozen(two) and not kept.frozen(three)
    with pytest.raises(ValueError, match="exists"):
        kept._commit(2, [(None, None, None, False)])


def test_only_touched_buckets_are_written(spark, tmp_path):
    rows = spark.range(1000).withColumn("v", F.lit("x"))
    kept = versions.VersionedSet(spark, str(tmp_path), "id", rows.schema, buckets=16)
    version = kept.clone(kept.create(rows))
    kept.change(version, spark.createDataFrame([(3, "y")], rows.schema))
    data = [r.data for r in kept._manifest(version) if r.bucket is not None]
    assert len(data) == 16 and sorted(map(data.count, set(data))) == [1, 15]


def test_a_failed_stage_stays_failed_and_a_second_run_does_the_open_batches(spark, tmp_path):
    calls = spark.range(40).withColumnRenamed("id", "call_id")
    broken, done = {"on": True}, []

    def double(df):
        done.append("double")
        return df.withColumn("x", F.col("call_id") * 2)

    def fragile(df):
        done.append("fragile")
        if broken["on"] and df.where("call_id = 17").count():
            raise ValueError("call 17 can't be read\nmore")
        return df.withColumn("y", F.col("x") + 1)

    def lazy(df):
        done.append("lazy")
        # Fails when the result is written, not when it is planned.
        return df.withColumn("z", F.when(F.col("call_id") == 3, F.raise_error(F.lit("call 3"))).otherwise(F.col("y"))) if broken["on"] else df.withColumn("z", F.col("y"))

    run = stages.StageRun(spark, str(tmp_path / "run"), {"double": double, "fragile": fragile, "lazy": lazy}, batches=4)
    status = {(r["stage"], r["batch"]): (r["status"], r["error"]) for r in run.run(calls).collect()}
    bad = {r[0]: r[1] for r in calls.select("call_id", F.pmod(F.xxhash64("call_id"), F.lit(4))).collect()}
    b17, b3 = bad[17], bad[3]
    assert status["fragile", b17] == ("FAILED", "call 17 can't be read") and status["lazy", b17] == ("PENDING", None)
    assert status["lazy", b3][0] == "FAILED" if b3 != b17 else True
    assert all(status["double", b] == ("COMPLETED", None) for b in range(4)) and done.count("double") == 4
    assert run.results("double").count() == 40 and run.results("fragile").where("call_id = 17").isEmpty()
    assert stages.StageRun(spark, run.folder, run.stages, batches=4).status().where("status = 'FAILED'").count() == len({b17, b3})

    broken["on"] = False
    done.clear()
    assert run.run(calls).where("status <> 'COMPLETED'").isEmpty()
    assert done.count("double") == 0 and done.count("fragile") == 1 and done.count("lazy") == len({b17, b3})
    assert sorted(r["z"] for r in run.results("lazy").collect()) == sorted(2 * i + 1 for i in range(40))
    done.clear()
    run.run(calls)
    assert not done


def machine(reports, silence, names):
    """The same by a plain loop over a call's reports in order of time; what is silent at the very end stays."""
    state, out = {}, []
    get = lambda s: state.get(s, ["PENDING", 0, 0, 0, 0.0])
    for at, stage, kind, done, total, error in sorted(reports, key=lambda r: (r[0], r[1], r[2])):
        for s in sorted(state):
            if state[s][0] == "RUNNING" and at - state[s][4] >= silence:
                state[s][0], state[s][4] = "FAILED", state[s][4] + silence
                out.append((s, *state[s][:4], state[s][4], "silent"))
        if stage not in names or any(get(s)[0] != "COMPLETED" for s in names[: names.index(stage)]):
            continue
        status, d, n, attempt, _ = get(stage)
        if kind == "start" and status in ("PENDING", "FAILED"):
            state[stage] = ["RUNNING", d, n, attempt + 1, at]
        elif kind in ("done", "complete", "fail") and status == "RUNNING":
            state[stage] = [{"done": "RUNNING", "complete": "COMPLETED", "fail": "FAILED"}[kind], max(d, done) if kind == "done" else d, total if kind == "done" else n, attempt, at]
        else:
            continue
        out.append((stage, *state[stage][:4], at, error if kind == "fail" else None))
    return out


def test_stage_states_over_several_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    zero, names = datetime.datetime(2024, 1, 1), ["a", "b"]
    reports, at = {c: [] for c in range(6)}, 0.0
    for _ in range(300):
        at += float(rng.integers(1, 40))
        kind = str(rng.choice(["start", "start", "done", "complete", "fail", "odd"]))
        reports[int(rng.integers(6))].append((at, str(rng.choice(["a", "a", "b", "c"])), kind, int(rng.integers(1, 9)), 9, "bad"))
    rows = sorted((t, c, s, k, d, n, e) for c, found in reports.items() for t, s, k, d, n, e in found)
    schema = "call_id long, stage string, kind string, done long, total long, at timestamp, error string"
    for number, part in enumerate(np.array_split(np.arange(len(rows)), 5)):
        some = [(rows[i][1], *rows[i][2:6], zero + datetime.timedelta(seconds=rows[i][0]), rows[i][6]) for i in part]
        spark.createDataFrame([*some, (None, "a", "start", 1, 9, some[-1][5], None), (0, "a", "start", 1, 9, None, None)], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    found = live.into_table(spark, stages.stage_states(stream, names, silence=300.0, late="1 second"), "states").collect()
    got = {c: sorted((r["stage"], r["status"], r["done"], r["total"], r["attempt"], (r["at"] - zero).total_seconds(), r["error"]) for r in found if r["call_id"] == c) for c in reports}
    for call, mine in reports.items():
        expected = machine(mine, 300.0, names)
        assert set(expected) <= set(got[call]), call
        # Timers may fail a stage after the call's own last report; nothing else is more than the loop has.
        assert all(x[6] == "silent" for x in set(got[call]) - set(expected))
    assert any(r["error"] == "silent" for r in found) and any(r["attempt"] > 1 for r in found)
