"""Sources, sinks, streams and helpers on small inputs: nulls, torn lines, late frames, empty inputs."""

import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.sources import config, readers, sinks
from voxlake.streaming import stateful

ROW = "id long, duration double, text string"


def lines(path, rows):
    path.write_text("".join(r + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_json_lines_in_three_modes(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", ['{"id": 1, "duration": 2.5, "text": "x"}', "", '{"id": 2', '{"id": "x"}', '{"id": 3, "duration": 1}'])
    rows = readers.jsonl_tolerant(spark, path, ROW).cache()
    assert rows.where(f"{readers.BAD} IS NOT NULL").count() == 2 and rows.count() == 4
    assert {r["id"] for r in readers.jsonl(spark, path, ROW).collect()} >= {1, 3}
    with pytest.raises(Exception, match="bad line"):
        readers.jsonl_strict(spark, path, ROW).collect()
    negative = lines(tmp_path / "b.jsonl", ['{"id": 1, "duration": -1}'])
    with pytest.raises(Exception, match="bad duration"):
        readers.jsonl_strict(spark, negative, ROW, "duration").collect()
    good = lines(tmp_path / "c.jsonl", ['{"id": 1, "duration": 0}', '{"id": 2}'])
    assert readers.jsonl_strict(spark, good, ROW, "duration").count() == 2


def test_sinks_guard_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0, None), (2, 3.0, "y")], ROW)
    path = str(tmp_path / "m")
    assert sinks.append_jsonl(rows, path) == 0 and sinks.append_jsonl(rows, path) == 2
    (tmp_path / "m" / "part-torn.json").write_text('{"id": \n')
    with pytest.raises(Exception, match="bad line"):
        sinks.append_jsonl(rows, path)
    sinks.write_jsonl(rows, path)
    assert readers.jsonl_strict(spark, path, ROW).count() == 2
    sheet = str(tmp_path / "s")
    sinks.review_sheet(rows, sheet, ["verdict"])
    sinks.review_sheet(rows, sheet, ["verdict"])  # nothing was answered
    sinks.review_sheet(rows, sheet, ["verdict"])
    (tmp_path / "s" / "part-x.csv").write_text("id,duration,text,verdict\n1,2,x,yes\n")
    with pytest.raises(ValueError, match="answers"):
        sinks.review_sheet(rows, sheet, ["verdict"])
    assert json.loads(sinks.report(rows.agg(F.count("*").alias("n")), str(tmp_path / "r"))) == {"n": 2}
    with pytest.raises(ValueError, match="finite"):
        sinks.report(rows.agg(F.lit(float("nan")).alias("x")), str(tmp_path / "r"))
    assert sinks.content_hash(rows) == sinks.content_hash(rows.orderBy(F.desc("id")).select("text", "id", "duration"))
    assert sinks.content_hash(rows) != sinks.content_hash(rows.unionByName(rows))
    assert sinks.content_hash(rows.limit(0))


def test_folders_and_csv_with_a_mark(spark, tmp_path):
    for i, consent in enumerate((True, False, None)):
        folder = tmp_path / f"s{i}"
        folder.mkdir()
        (folder / "meta.json").write_text(json.dumps({"consent": consent}))
        lines(folder / "turns.jsonl", ['{"turn": 1}', '{"turn": 2}'])
        lines(folder / "mos.jsonl", ['{"mos": 4}'])
    sessions, turns, ratings = readers.session_folders(spark, str(tmp_path), "consent boolean", "turn long", "mos long")
    assert (sessions.count(), turns.count(), ratings.count()) == (1, 2, 1)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.csv").write_text("﻿a,b\n1,2\n", encoding="utf-8")
    assert readers.csv(spark, str(tmp_path / "c")).columns == ["a", "b"]
    samples = spark.createDataFrame([("t1", "p", 1.0), ("t1", "q", 2.0), ("t2", "p", 9.0)], "stamp string, pid string, mib double")
    roles = spark.createDataFrame([("p", "llm"), ("q", "asr")], "pid string, role string")
    got = readers.memory_peaks(samples, roles).first()
    assert (got["samples"], got["stack"], got["peak"]) == (2, 3.0, {"llm": 9.0, "asr": 2.0})


def test_audio_and_frames(spark, tmp_path):
    t = np.arange(8_000) / 8_000
    x = (0.5 * np.sin(2 * np.pi * 440 * t) * 32767).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8_000), w.writeframes(np.repeat(x, 2).tobytes())
    (tmp_path / "b.wav").write_bytes(b"no audio")
    got = {r["path"][-5:]: r for r in readers.audio(spark, str(tmp_path)).collect()}
    assert got["b.wav"]["samples"] is None and got["a.wav"]["seconds"] == 1.0
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert np.abs(np.array(got["a.wav"]["samples"])[200:-200] - want[200:-200]).max() < 0.02
    samples = struct.pack("<320h", *range(320))
    rows = [("s", struct.pack("<I", 7) + samples), ("s", struct.pack("<If", 8, 0.5) + samples), ("s", b"xx"), ("s", None)]
    found = readers.frames(spark.createDataFrame(rows, "session string, data binary")).collect()
    assert [(r["seq"], r["playback"], r["fault"]) for r in found] == [(7, None, None), (8, 0.5, None), (None, None, "2 bytes"), (None, None, "0 bytes")]
    assert found[0]["samples"][:3] == [0, 1, 2]


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text('{"data_dir": "x", "list": [{"path": "y"}, 1], "url_path": "s3://b/c", "name": "z", "file": "/abs"}')
    got = config.absolute(config.load(str(tmp_path / "a.json")), "/root_")
    assert got == {"data_dir": "/root_/x", "list": [{"path": "/root_/y"}, 1], "url_path": "s3://b/c", "name": "z", "file": "/abs"}
    (tmp_path / "b.json").write_text("[1]")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "b.json"))


def test_machines():
    def run(machine, values):
        m = machine()
        return [e for e in (m.step(v) for v in values) if e], m.flush()

    assert run(stateful.Endpointer, [0.6, 0.2, 0.6, 0.6, *[0.4] * 3, *[0.1] * 8]) == (["start", "end"], None)
    assert run(stateful.Endpointer, [0.6, 0.6, *[0.1] * 8, 0.6, 0.6]) == (["start", "drop", "start"], "disconnected")
    assert run(stateful.Provisional, [0.6, 0.1, 0.1, 0.1, 0.5, *[0.1] * 8]) == (["provisional", "retracted", "provisional", "final"], None)
    assert run(stateful.HoldBack, [0.6, 0.6, 0.6, 0.1, 0.1, 0.6]) == (["released", "discarded"], "discarded")


def test_silent_sessions_are_flushed(spark, tmp_path):
    schema = "key long, seq long, p double, ts timestamp"
    for i, rows in enumerate(([(1, 1, 0.9, 0), (1, 2, 0.9, 1), (2, 1, 0.9, 1), (None, 5, 0.1, 1)], [(1, 1, 0.9, 2), (3, 1, 0.0, 4_000)], [(3, 2, 0.0, 8_000)])):
        df = spark.createDataFrame([(k, s, p, t) for k, s, p, t in rows], "key long, seq long, p double, t long")
        df.select("key", "seq", "p", F.timestamp_seconds(F.col("t") + 1_000).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    out = stateful.sessions(stream, stateful.Endpointer, timeout_ms=60_000)
    how = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at"))
    how.trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r["key"], r["event"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "disconnected"), (1, "start")]
