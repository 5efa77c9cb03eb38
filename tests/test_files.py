"""Recordings by byte ranges, and files that are there whole or not at all."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from fieldscope.operators.signals import to_blocks
from fieldscope.sources import recordings, sessions, sinks, wav, writers


def plan_of(blocks):
    return blocks._jdf.queryExecution().executedPlan().toString()


def test_a_file_of_three_gigabytes(spark, tmp_path):
    path, frames = str(tmp_path / "long.wav"), 750_000_000
    head = recordings._head(2, frames // 2, 48000.0, True)
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + 4 * frames)
        f.seek(len(head) + 8 * (frames // 2 - 5))
        f.write(np.arange(10, dtype="<i4").tobytes())
    assert os.path.getsize(path) > 2.9e9 and recordings.file_frames(spark, [path]).first().frames == frames // 2
    blocks = recordings.read_recording(spark, "r", [path], 48000)
    end = frames / 2 / 48000
    got = recordings.read_region(blocks, 48000, 48000.0, end - 6 / 48000, end + 3, channel=1).collect()
    assert [x * (1 << 31) for r in got for x in r.samples][-5:] == [1, 3, 5, 7, 9] and {r.channel for r in got} == {1}
    assert blocks.where("block = 3").agg(F.sum(F.size("samples"))).first()[0] == 2 * 48000


def test_only_the_wanted_bytes_are_read(tmp_path, monkeypatch):
    x = np.random.default_rng(0).uniform(-0.9, 0.9, (1000, 3))
    files = []
    for i, (a, b) in enumerate(((0, 430), (430, 431), (431, 1000))):
        path = str(tmp_path / f"{i}.wav")
        with open(path, "wb") as f:
            f.write(recordings.wav_bytes(x[a:b], 100.0))
        files.append({"path": path} | wav.file_form(path))
    bytes_read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def read_at(self, n, at):
            bytes_read.append(n)
            return self.file.read_at(n, at)

        def close(self):
            self.file.close()

    class Store:
        def open_input_file(self, name):
            return Counted(open_file(name))

    open_file = wav.fs.LocalFileSystem().open_input_file
    monkeypatch.setattr(wav, "store_of", lambda path: (Store(), path))
    reader = wav.WavReader({"recordings": json.dumps({"r": files, "s": files[:1]}), "length": "64", "partition_bytes": str(3 * 64 * 12)})
    rest = list(reader.pushFilters([GreaterThanOrEqual(("block",), 5), LessThan(("block",), 9), In(("channel",), (0, 2)), EqualTo(("recording_id",), "r"), kept := EqualTo(("start_frame",), 1)]))
    assert rest == [kept]
    parts = reader.partitions()
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert sum(bytes_read) == 4 * 64 * 12 and len(parts) == 2 and {r["channel"] for r in rows} == {0, 2}
    for r in rows:
        assert np.allclose(r["samples"], x[r["start_frame"] : r["start_frame"] + 64, r["channel"]], atol=1e-9) and r["start_frame"] == 64 * r["block"]
    few = wav.WavReader({"recordings": json.dumps({"r": files}), "length": "64"})
    list(few.pushFilters([In(("block",), (15, 2, 3, 99))]))
    assert [(p.first, p.last) for p in few.partitions()] == [(2, 4), (15, 16)]
    assert [len(r["samples"]) for p in few.partitions() for b in few.read(p) for r in b.to_pylist() if r["channel"] == 0] == [64, 64, 40]


def test_filters_reach_the_files(spark, tmp_path):
    x = np.random.default_rng(1).uniform(-0.9, 0.9, (500, 2))
    for n in "ab":
        (tmp_path / f"{n}.wav").write_bytes(recordings.wav_bytes(x, 50.0))
    blocks = recordings.read_recordings(spark, {n: [str(tmp_path / f"{n}.wav")] for n in "ab"}, 32)
    assert blocks.count() == 2 * 2 * 16
    got = recordings.read_region(blocks, 32, 50.0, 1.0, 3.0, 1).where("recording_id = 'b'")
    assert "Filter (" not in plan_of(got).replace("Filter ((start_frame", "")
    values = np.concatenate([r.samples for r in sorted(got.collect(), key=lambda r: r.start_frame)])
    assert np.allclose(values, x[50:151, 1], atol=1e-9)
    assert recordings.read_region(blocks, 32, 50.0, -5, 0.0, 0).agg(F.sum(F.size("samples"))).first()[0] == 2
    assert recordings.read_region(blocks, 32, 50.0, 100, 200).collect() == []


def test_forms_of_files(spark, tmp_path):
    x = np.random.default_rng(2).uniform(-0.9, 0.9, (50, 2))
    pcm = lambda bits, data: b"RIFF\0\0\0\0WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 100, 200 * bits // 8, 2 * bits // 8, bits) + b"data" + struct.pack("<I", len(data)) + data
    files = {
        "8": (pcm(8, np.round(x * 128 + 128).astype(np.uint8).tobytes()), 1e-2), "16": (pcm(16, np.round(x * 32768).astype("<i2").tobytes()), 1e-4),
        "24": (pcm(24, b"".join(int(v).to_bytes(3, "little", signed=True) for v in np.round(x * (1 << 23)).ravel())), 1e-6), "float": (recordings.wav_bytes(3 * x, 100.0), 1e-6),
    }
    for name, (data, least) in files.items():
        (tmp_path / name).write_bytes(data)
        got = recordings.read_recording(spark, name, [str(tmp_path / name)], 7).collect()
        have = np.concatenate([r.samples for r in sorted(got, key=lambda r: r.block) if r.channel == 1])
        assert np.allclose(have, (3 if name == "float" else 1) * x[:, 1], atol=least)
    (tmp_path / "cut").write_bytes(files["16"][0][:-90])
    cut = recordings.file_frames(spark, [str(tmp_path / "cut"), str(tmp_path / "absent"), str(tmp_path / "16")]).orderBy("part").collect()
    assert [r.frames for r in cut] == [27, None, 50]
    long = recordings._head(1, 1 << 31, 10.0, False)
    assert wav.wav_form(lambda at, n: long[at : at + n], len(long) + (1 << 33))["frames"] == 1 << 31
    with pytest.raises(ValueError, match="different kinds"):
        recordings.read_recording(spark, "r", [str(tmp_path / "16"), str(tmp_path / "24")], 7)
    blocks = recordings.read_recording(spark, "r", [str(tmp_path / "16")], 7)
    (tmp_path / "16").write_bytes(files["16"][0][:-90])
    with pytest.raises(Exception, match="frames are missing"):
        blocks.collect()


def test_spans_are_written_in_place(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = {"quiet": rng.uniform(-0.9, 0.9, (700, 2)), "loud": rng.uniform(-3, 3, (700, 1))}
    rows = [(r, c, i, float(v)) for r, a in x.items() for c in range(a.shape[1]) for i, v in enumerate(a[:, c])]
    blocks = to_blocks(spark.createDataFrame(rows, "recording_id string, channel int, frame long, value double"), 64)
    folder = str(tmp_path / "out")
    assert recordings.export_spans(blocks, folder, 100, 555, 50.0) == ["loud.wav", "quiet.wav"]
    for r, a in x.items():
        raw = open(f"{folder}/{r}.wav", "rb").read()
        assert recordings.wav_header(raw)["float"] == (r == "loud") and np.allclose(recordings.wav_samples(raw), a[100:555], atol=1e-6)
    before = open(f"{folder}/quiet.wav", "rb").read()
    for first, last, rate in ((600, 701, 50.0), (0, 10, 44.1), (5, 5, 50.0)):
        with pytest.raises(ValueError):
            recordings.export_spans(blocks, folder, first, last, rate)
    holes = blocks.where("not (recording_id = 'quiet' and channel = 0 and block = 4)")
    with pytest.raises(ValueError):
        recordings.export_spans(holes, folder, 0, 700, 50.0)
    assert open(f"{folder}/quiet.wav", "rb").read() == before and sorted(os.listdir(tmp_path)) == ["out"]


def test_a_failed_task_leaves_the_old_files(spark, tmp_path):
    folder = str(tmp_path / "f")
    good = spark.createDataFrame([("a.txt", b"one"), ("a.txt", b" two"), ("b/c.txt", b"three")], "name string, content binary").coalesce(1)
    sinks.write_files(good, folder)
    assert open(f"{folder}/a.txt").read() == "one two" and open(f"{folder}/b/c.txt").read() == "three"
    bad = spark.range(2).selectExpr("'a.txt' as name", "cast(raise_error('lost') as binary) as content")
    torn = spark.createDataFrame([("a.txt", b"1"), ("d.txt", b"2"), ("a.txt", b"3")], "name string, content binary").coalesce(1)
    apart = spark.range(0, 2, 1, 2).selectExpr("'a.txt' as name", "cast('x' as binary) as content")
    outside = spark.createDataFrame([("../x", b"1")], "name string, content binary")
    short = spark.createDataFrame([("a.txt", 2, b"1")], "name string, offset long, content binary")
    for rows, options in ((bad, {}), (torn, {}), (apart, {}), (outside, {}), (short, {"sizes": {"a.txt": 9}})):
        with pytest.raises(Exception):  # noqa: B017, PT011
            sinks.write_files(rows, folder, **options)
        assert open(f"{folder}/a.txt").read() == "one two" and sorted(os.listdir(folder)) == ["a.txt", "b"] and os.listdir(tmp_path) == ["f"]
    placed = spark.createDataFrame([("p", 4, b"5678"), ("p", 0, b"1234")], "name string, offset long, content binary").repartition(2)
    sinks.write_files(placed, folder, sizes={"p": 8}, remove=["a.txt", "none"], keep=["b/c.txt", "a.txt"])
    assert open(f"{folder}/p").read() == "12345678" and sorted(os.listdir(folder)) == ["a.damaged.txt", "b", "p"]
    sinks.write_files(good, folder, whole=True, extra={"x.yaml": "k: 1\n"})
    assert sorted(os.listdir(folder)) == ["a.txt", "b", "x.yaml"] and os.listdir(tmp_path) == ["f"]


LABELS = "recording_id string, category string, kind string, channel int, t0 double, t1 double, f0 double, f1 double, note string, outline array<struct<t:double,f:double>>"


def test_label_files_round_trip(spark, tmp_path):
    rows = [
        ("r1", "pulse", "span", 0, 3.0000004, 5.5, 100.0, 900.1234, 'a, "b"', [(3.0, 100.0), (4.0, 200.5), (5.0, 100.0)]), ("r1", "call", "point", None, 1.25, None, None, None, "two\nlines", None),
        ("r1", "wish", "point", 2, 0.5, None, None, None, None, None), ("r2", "pulse", "span", 1, 2.0, 3.0, None, None, " spaces ", None), ("r2", "härte", "point", None, 1.0, None, 5.0, 6.0, "", None),
    ]
    labels, folder = spark.createDataFrame(rows, LABELS), str(tmp_path)
    (tmp_path / "gone-labels.csv").write_text("x")
    writers.write_labels(labels, folder, ["r1", "r2", "gone"], ["wish"])
    assert sorted(os.listdir(folder)) == ["r1-labels.csv", "r2-labels.csv"]
    raw = (tmp_path / "r1-labels.csv").read_bytes().decode()
    assert raw.startswith(",".join(sessions.LABEL_COLUMNS) + '\r\ncall,point,,1.250000,,,,"two\nlines",\r\npulse,span,0,3.000000,5.500000,100.000,900.123,"a, ""b""",3.000000 100.000;')
    back, problems = sessions.read_labels(spark, f"{folder}/r1-labels.csv")
    got = sorted(tuple(r) for r in back.select("category", "kind", "channel", "t0", "t1", "f0", "f1", "note").collect())
    assert got == [("call", "point", None, 1.25, None, None, None, "two\nlines"), ("pulse", "span", 0, 3.0, 5.5, 100.0, 900.123, 'a, "b"')] and problems.first().dropped == 0
    assert [tuple(p) for r in back.where("category = 'pulse'").collect() for p in r.outline] == [(3.0, 100.0), (4.0, 200.5), (5.0, 100.0)]
    for _ in range(2):
        writers.write_labels(labels.where("recording_id = 'r2'"), folder, ["r1", "r2"], damaged=["r1", "r2"])
    assert sorted(os.listdir(folder)) == ["r1-labels.damaged.csv", "r2-labels.csv", "r2-labels.damaged.1.csv", "r2-labels.damaged.csv"]
    for options in ({"blocked": ["r2"]}, {"recordings": ["r1"]}):
        with pytest.raises(ValueError):
            writers.write_labels(labels.where("recording_id = 'r2'"), folder, **({"recordings": ["r1", "r2"]} | options))


def test_detections_as_labels(spark, tmp_path):
    boxes = spark.createDataFrame([("r", 1, 0.9, 3, 2.0, 3.0, 10.0, 20.0), ("r", 0, 0.25, None, 1.0, 1.5, 5.0, 6.0), ("r", 0, 0.2, 1, 0.0, 1.0, 5.0, 6.0)], "recording_id string, cls int, score double, channel int, t0 double, t1 double, f0 double, f1 double")
    writers.write_detections(boxes, str(tmp_path), ["r"], ["chirp", "rise"], 0.25, "-auto")
    assert (tmp_path / "r-labels.csv").read_text().splitlines()[1:] == ["chirp-auto,span,,1.000000,1.500000,5.000,6.000,score=0.2500,", "rise-auto,span,3,2.000000,3.000000,10.000,20.000,score=0.9000,"]


def test_training_set_files(spark, tmp_path):
    size, folder = 4, str(tmp_path / "set")
    tiles = spark.createDataFrame([("a", 0, "train"), ("a", 8, "val"), ("b", 0, None)], "rec string, s0 long, split string")
    images = spark.createDataFrame([("a", 0, bytes(range(16))), ("a", 8, bytes(16)), ("b", 0, bytes(16))], "recording_id string, s0 long, image binary")
    lines = spark.createDataFrame([("a", 0, 2, "1 0.5 0.5 0.1 0.1"), ("a", 0, 1, "0 0.2 0.2 0.1 0.1"), ("a", 8, 3, None)], "rec string, s0 long, uid int, line string")
    os.makedirs(f"{folder}/images/train")
    open(f"{folder}/images/train/stale.png", "w").close()
    writers.write_dataset(tiles, images, lines, folder, ["fish #3", "x"], size)
    have = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)
    assert have == ["data.yaml", "images/train/a_000000000000.png", "images/val/a_000000000008.png", "labels/train/a_000000000000.txt", "labels/val/a_000000000008.txt"]
    assert open(f"{folder}/labels/train/a_000000000000.txt").read() == "0 0.2 0.2 0.1 0.1\n1 0.5 0.5 0.1 0.1\n" and open(f"{folder}/labels/val/a_000000000008.txt").read() == ""
    raw = open(f"{folder}/images/train/a_000000000000.png", "rb").read()
    at = raw.index(b"IDAT")
    pixels = zlib.decompress(raw[at + 4 : at + 4 + struct.unpack(">I", raw[at - 4 : at])[0]])
    assert b"".join(pixels[i + 1 : i + 5] for i in range(0, 20, 5)) == bytes(range(16))
    assert 'val: images/val\nnames:\n  0: "fish #3"\n  1: "x"\n' in open(f"{folder}/data.yaml").read()
    writers.write_dataset(tiles.where("split = 'train'"), images, lines, folder, ["x"], size)
    assert "val: images/train" in open(f"{folder}/data.yaml").read() and not os.path.exists(f"{folder}/images/val")
