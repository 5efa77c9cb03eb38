"""The overview store: what changed is computed, what did not is not read; and outlines cut at rectangles."""

import os

import numpy as np
from pyspark.sql import functions as F

from fieldscope.functions import polygons
from fieldscope.operators.activity import minmax_levels
from fieldscope.sources import overviews


def test_only_what_changed_is_computed(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(3, 2, 200))
    rows = [(f"r{r}", c, i, float(v)) for r in range(3) for c in range(2) for i, v in enumerate(x[r, c])]
    samples = spark.createDataFrame(rows, "recording_id string, channel int, frame long, value double")
    channels = spark.createDataFrame([(f"r{r}", 2) for r in range(3)], "recording_id string, channels long")
    read, store = [], str(tmp_path / "store")

    def compute(ids):
        read.append(sorted(r.recording_id for r in ids.collect()))
        return minmax_levels(samples.join(ids, "recording_id", "left_semi"), ["recording_id", "channel"], 8, 3)

    def files(*named):
        return spark.createDataFrame(list(named), "recording_id string, path string, frames long")

    def refresh(*named):
        return overviews.refresh(spark, store, files(*named), channels, 3, compute)

    assert overviews.serve(spark, store, files(("r0", "a.wav", 200)), 1).collect() == []
    assert refresh(("r0", "a.wav", 200), ("r1", "b.wav", 200)) == ["r0", "r1"]
    assert refresh(("r0", "a.wav", 200), ("r1", "b.wav", 200)) == [] and len(os.listdir(f"{store}/manifests")) == 1
    assert refresh(("r0", "a.wav", 200), ("r1", "b.wav", 200), ("r2", "c.wav", 200)) == ["r2"]
    now = (("r0", "a.wav", 200), ("r0", "a2.wav", 5), ("r2", "c.wav", 200))  # r0 has one file more, r1 is gone
    before = overviews.serve(spark, store, files(*now), 1).select("recording_id").distinct().collect()
    assert {r.recording_id for r in before} == {"r2"}
    assert refresh(*now) == ["r0"] and read == [["r0", "r1"], ["r2"], ["r0"]]
    got = overviews.serve(spark, store, files(*now), 10).collect()
    assert {(r.recording_id, r.level, r.step) for r in got} == {("r0", 1, 16), ("r2", 1, 16)} and len(got) == 2 * 2 * 13
    for r in got:
        part = x[int(r.recording_id[1]), r.channel, 16 * r.bin : 16 * r.bin + 16]
        assert (r.minimum, r.maximum) == (part.min(), part.max())
    assert overviews.serve(spark, store, files(*now), 1000).collect() == []
    # a recording of which the store lacks a channel is stale, and a failed computation leaves the store as it was
    three = spark.createDataFrame([("r0", 3), ("r2", 2)], "recording_id string, channels long")
    assert [r.recording_id for r in overviews.stale_recordings(spark, store, files(*now), 3, three).collect()] == ["r0"]
    pointer = open(f"{store}/CURRENT").read()
    try:
        overviews.refresh(spark, store, files(("r9", "z.wav", 1)), channels, 3, lambda ids: ids.select(F.raise_error(F.lit("no such file"))))
    except Exception:  # noqa: BLE001
        pass
    assert open(f"{store}/CURRENT").read() == pointer


def test_outlines(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = [(0, square), (1, [(-5.0, 4.0), (5.0, 4.0), (5.0, 6.0), (-5.0, 6.0)]), (2, [(20.0, 20.0), (30.0, 20.0), (25.0, 30.0)]), (3, [(1.0, 1.0), (2.0, 2.0)]), (4, None), (5, []), (6, [(5.0, -5.0), (15.0, 5.0), (5.0, 15.0), (-5.0, 5.0)])]
    frame = spark.createDataFrame(rows, "i int, p array<struct<t:double,f:double>>")
    cut = {r.i: None if r.c is None else [tuple(q) for q in r.c] for r in frame.select("i", polygons.clip_polygon(F.col("p"), 0, 8, 2, 9).alias("c")).collect()}
    area = lambda ps: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ps, ps[1:] + ps[:1], strict=True))) / 2
    assert area(cut[0]) == 56 and area(cut[1]) == 10 and cut[2] == [] and cut[3] == [] and cut[5] == [] and not cut[4]
    assert all(0 <= t <= 8 and 2 <= f <= 9 for ps in cut.values() for t, f in ps or [])
    inside = np.array([[abs(t - 5) + abs(f - 5) <= 10 for t in np.arange(0.05, 8, 0.1)] for f in np.arange(2.05, 9, 0.1)])
    assert abs(area(cut[6]) - inside.sum() * 0.01) < 0.2
    held = {r.i: r.c and [tuple(q) for q in r.c] for r in frame.select("i", polygons.clamp_polygon(F.col("p"), 8.0, 9.0).alias("c")).collect()}
    assert held[1] == [(0, 4), (5, 4), (5, 6), (0, 6)] and held[2] == [(8, 9)] * 3 and held[4] is None and held[5] == []
