"""Bundles, digests, track arrays and registries on files written on the fly."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from fieldscope.functions import registry
from fieldscope.sources import bundles, recordings


def test_metadata_and_discovery(spark, tmp_path):
    (tmp_path / "a_metadata.toml").write_text('[alignment]\nrecording = "x/one.wav"\nrate = 48000\nframes = 30\nchannel = true\nvalidated = true\nfiles_frames = [10, 20]\nsha256s = ["a"]\n')
    (tmp_path / "b_metadata.toml").write_text('[alignment]\nrecording = "two.wav"\nrate = 1.5\nvalidated = "yes"\nfile_frames = 7\nframes = 8\n')
    (tmp_path / "c_metadata.toml").write_text('[alignment]\nrecording = "two.wav"\n')
    (tmp_path / "d_metadata.toml").write_text("not = [toml")
    meta = bundles.read_session_meta(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1][0]: r for r in meta.collect()}
    assert (got["a"].recording, got["a"].rate, got["a"].channel, got["a"].validated, got["a"].problems) == ("one.wav", 48000.0, None, True, ["digests and frames differ in number"])
    assert got["b"].validated is None and got["b"].problems == ["validated is no truth value", "file frames do not add up"]
    assert got["d"].problems == ["unreadable"]
    found = bundles.discover_bundles(meta, spark.createDataFrame([("/data/one.wav",), ("two.wav",), ("three.wav",)], "recording string"))
    assert {r.recording: (r.path is not None, r.n) for r in found.collect()} == {"/data/one.wav": (True, 1), "two.wav": (False, 2), "three.wav": (False, 0)}


def test_digests_and_tracks(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"abc")
    (tmp_path / "y.wav").write_bytes(b"def")
    declared = spark.createDataFrame([(str(tmp_path / "x.wav"), hashlib.sha256(b"abc").hexdigest().upper()), (str(tmp_path / "y.wav"), None)], "path string, sha256 string")
    assert {r.path[-5:]: r.same for r in bundles.verify_sha256(spark, declared).collect()} == {"x.wav": True, "y.wav": None}
    folder = tmp_path / "s1"
    folder.mkdir()
    for name, x in (("fund_v", np.array([5.0, 6.0])), ("idx_v", np.array([1, 0])), ("ident_v", np.array([3.0, np.nan])), ("times", np.array([0.0, 0.5]))):
        np.save(folder / f"{name}.npy", x)
    rows = bundles.read_tracks(spark, {"first": str(folder)})
    assert sorted(tuple(r) for r in rows.collect()) == [("first", 0, 1, 5.0, 3, 0.5), ("first", 1, 0, 6.0, None, 0.0)]
    variants = spark.createDataFrame([("first", 1, "other", 9)], "session_id string, row long, variant string, ident long")
    assert {r.row: r.ident for r in bundles.apply_variant(rows, variants, "other").collect()} == {0: None, 1: 9}


def test_recordings_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/store"
    bundles.replace_recordings(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "recording_id string, v int"), path)
    bundles.replace_recordings(spark.createDataFrame([("a", 7)], "recording_id string, v int"), path)
    assert sorted((r.recording_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 3)]


def test_registries(spark):
    registry.ANALYZERS |= {"top": lambda p: p["value"].max(), "broken": lambda p: 1 / 0}
    pairs = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 5.0), (2, 0.0, 1.0)], "region long, t double, value double")
    got = {(r.region, r.analyzer): (r.value, r.error is None) for r in registry.analyze(pairs, ["top", "broken"]).collect()}
    assert got == {(1, "top"): (5.0, True), (1, "broken"): (None, False), (2, "top"): (1.0, True), (2, "broken"): (None, False)}
    registry.denoiser("twice", 1)(lambda c, by: c.withColumn("power", F.col("power") * by))
    registry.denoiser("plus", 2)(lambda c: c.withColumn("power", F.col("power") + 1))
    assert registry.denoise(spark.createDataFrame([(1.0,)], "power double"), {"plus": {}, "twice": {"by": 3}}).first().power == 4.0
    labels = spark.createDataFrame([(1, 0.0, 1.0, 2.0, 3.0), (2, 0.0, None, None, None)], "label_id long, t0 double, t1 double, f0 double, f1 double")
    assert [tuple(r) for r in registry.refine_labels(labels, lambda p: p.assign(t1=p["t1"] + 1)).collect()] == [(1, 0.0, 2.0, 2.0, 3.0)]


def test_written_tracks_and_overviews(spark, tmp_path):
    kind = "session_id string, row long, k long, f double, ident long, t double"
    a = [("s1", 0, 0, 1.0, 3, 0.0), ("s1", 1, 1, 1.5, None, 0.1), ("s2", 0, 0, 2.0, 4, 0.0)]
    store = f"{tmp_path}/tracks"
    assert {r.session_id for r in bundles.write_tracks(spark.createDataFrame(a, kind), store).collect()} == {"s1", "s2"}
    b = [("s1", 0, 0, 1.0, 9, 0.0), ("s1", 1, 1, 1.5, 9, 0.1)]
    assert bundles.write_tracks(spark.createDataFrame(b, kind), store).collect() == []  # only ids are new
    back = {(r.session_id, r.row): r.ident for r in bundles.read_written_tracks(spark, store).collect()}
    assert back == {("s1", 0): 9, ("s1", 1): 9, ("s2", 0): 4}
    files = spark.createDataFrame([("r", "a.wav", 10), ("r", "b.wav", 20), ("q", "c.wav", 5)], "recording_id string, path string, frames long")
    keys = {r.recording_id: r.key for r in bundles.file_set_key(files).collect()}
    stored = spark.createDataFrame([("r", keys["r"], 32, 0), ("r", keys["r"], 64, 0), ("q", "old", 32, 0)], "recording_id string, key string, step int, channel int")
    assert [(r.recording_id, r.step) for r in bundles.usable_overviews(stored, files, 32).collect()] == [("r", 32)]
    two = spark.createDataFrame([("r", 2)], "recording_id string, channels int")
    assert bundles.usable_overviews(stored, files, 64, two).count() == 0


def test_equal_names_in_two_folders(spark, tmp_path):
    for folder, n in (("a", 5), ("b", 7)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.wav").write_bytes(recordings.wav_bytes(np.zeros((n, 1)), 10.0))
    paths = [f"{tmp_path}/b/1.wav", f"file://{tmp_path}/a/1.wav"]
    assert [(r.part, r.frames) for r in sorted(recordings.file_frames(spark, paths).collect(), key=lambda r: r.part)] == [(0, 7), (1, 5)]
    assert recordings.read_recording(spark, "x", paths, 6).selectExpr("sum(size(samples)) n").first().n == 12
    told = [(p, hashlib.sha256((tmp_path / f / "1.wav").read_bytes()).hexdigest().upper() if f == "b" else None) for p, f in zip(paths, "ba", strict=True)]
    assert {r.path: r.same for r in bundles.verify_sha256(spark, spark.createDataFrame(told, "path string, sha256 string")).collect()} == {paths[0]: True, paths[1]: None}
