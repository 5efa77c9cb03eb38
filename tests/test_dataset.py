"""Training sets, grids and track edits against plain Python."""

from collections import Counter

import numpy as np
import pytest

from fieldscope.functions import tiles as kernels
from fieldscope.operators import boxes, dataset, edits, layers, signals, tracks

TRACKS = "session long, row long, ident long, k long, f double, t double"


def _tracks(spark, seed=3, n=400):
    rng = np.random.default_rng(seed)
    rows = [(s, i, int(rng.integers(0, 6)) if rng.random() > 0.1 else None, int(k), float(rng.uniform(100, 110)), float(k)) for s in (0, 1) for i, k in enumerate(np.sort(rng.integers(0, 120, n)))]
    return rows, spark.createDataFrame(rows, TRACKS)


def test_sessions_never_meet(spark):
    rows, frame = _tracks(spark)
    one = {s: frame.where(f"session = {s}").drop("session") for s in (0, 1)}
    for both, single in (
        (tracks.track_stats(frame, ["session"]), lambda f: tracks.track_stats(f)), (tracks.local_median_losers(frame, 5, ["session"]), lambda f: tracks.local_median_losers(f, 5)),
        (tracks.cross_issues(frame, 1.0, keys=["session"]), lambda f: tracks.cross_issues(f, 1.0)), (tracks.highpass(frame, 3, ["session"]), lambda f: tracks.highpass(f, 3)),
        (edits.merge_ids(frame, [1, 2], 1, keys=["session"]), lambda f: edits.merge_ids(f, [1, 2], 1)), (tracks.track_breaks(frame, 1, ["session"]), lambda f: tracks.track_breaks(f, 1)),
    ):
        for s in (0, 1):
            mine = single(one[s])
            got = both.where(f"session = {s}").select(*mine.columns)
            assert got.exceptAll(mine).count() == 0 and mine.exceptAll(got).count() == 0


def test_edge_matches_are_the_greedy_ones(spark):
    rng = np.random.default_rng(1)
    left = [(s, i, float(rng.uniform(0, 30))) for s in (0, 1) for i in range(25)]
    right = [(s, 100 + i, float(rng.uniform(0, 30))) for s in (0, 1) for i in range(25)]
    want = set()
    for s in (0, 1):
        used = set()
        for d, a, b in sorted((abs(f - g), a, b) for x, a, f in left for y, b, g in right if x == y == s and abs(f - g) <= 2):
            if a not in used and b not in used:
                used |= {a, b}
                want.add((s, a, b))
    kind = "session long, ident long, f double"
    got = edits.edge_matches(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), 2.0, ["session"])
    assert {(r.session, r.left, r.right) for r in got.collect()} == want and len(want) > 20


def test_replace_span_stitches_both_edges(spark):
    old = [(0, i, ident, k, 100.0 + 10 * ident, float(k)) for i, (ident, k) in enumerate((ident, k) for ident in (1, 2) for k in range(30))]
    new = [(0, i, ident, k, f, float(k)) for i, (ident, k, f) in enumerate([(7, k, 110.2) for k in range(10, 20)] + [(8, k, 150.0) for k in range(10, 15)] + [(9, k, 119.9) for k in range(15, 20)])]
    out = edits.replace_span(spark.createDataFrame(old, TRACKS), spark.createDataFrame(new, TRACKS), 10, 20, 1.0, 3, ["session"]).collect()
    assert len(out) == 80 and len({r.row for r in out}) == 80
    assert all(r.ident is None for r in out if r.row < 60 and 10 <= r.k < 20)
    assert {(r.ident, r.f) for r in out if r.row >= 60} == {(1, 110.2), (3, 150.0), (2, 119.9)}  # the second edge names what the first did not


def test_merge_lanes_is_the_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 2)), i, int(rng.integers(0, 2)), 0.5, float(t := rng.uniform(0, 60)), float(t + rng.uniform(1, 8)), float(f := rng.uniform(0, 5)), float(f + rng.uniform(2, 6))) for i in range(120)]
    frame = spark.createDataFrame(rows, "rec int, uid long, cls int, score double, t0 double, t1 double, f0 double, f1 double")

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[6], b[6])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[5] - a[4]) * (a[7] - a[6]) + (b[5] - b[4]) * (b[7] - b[6]) - w * h)

    kept = []
    for r in sorted(rows, key=lambda r: (r[4], r[5], r[1])):
        if not any(o[0] == r[0] and o[2] == r[2] and iou(o, r) > 0.5 for o in kept):
            kept.append(r)
    assert {r.uid for r in dataset.merge_lanes(frame, width=5.0).collect()} == {r[1] for r in kept} and len(kept) < len(rows)
    assert boxes.nms(frame.limit(0)).count() == 0


def test_tile_pictures(spark):
    rng = np.random.default_rng(4)
    n, spec = 300, kernels.TileSpec(50.0, 16, 6, 12, 1, 8, size=10, representation="whitened", reduction="mean")
    signal = rng.standard_normal((2, n))
    rows = [("a", c, i, float(signal[c, i])) for c in range(2) for i in range(n)]
    blocks = signals.to_blocks(spark.createDataFrame(rows, "recording_id string, channel int, frame long, value double"), 32)
    tiles = spark.createDataFrame([("a", s, n) for s in (0, 77, 260)], "recording_id string, s0 long, total long")
    got = {r.s0: np.frombuffer(r.image, np.uint8).reshape(10, 10) for r in dataset.render_tiles(blocks, tiles, spec, 32).collect()}
    for s0 in (0, 77, 260):
        padded = np.concatenate([np.zeros((2, 100)), signal, np.zeros((2, 100))], axis=1)
        power = np.zeros((12, 7))
        window = np.hanning(17)[:-1]
        for frame in range(12):
            at = 100 + s0 - (16 - 6) // 2 + frame * 6
            spectrum = np.abs(np.fft.rfft(padded[:, at : at + 16] * window, axis=1)) ** 2
            power[frame] = spectrum[:, 1:8].mean(axis=0) / ((window**2).sum() * 50)
        fine = np.repeat(np.repeat(power, 10, axis=0), 10, axis=1).reshape(10, 12, 10, 7).mean(axis=(1, 3))  # 12 x 7 drawn at 120 x 70, then averaged
        db = 10 * np.log10(fine + 1e-20)
        columns = -(-min(max(n - s0, 6), 72) * 10 // 72)
        want = np.clip(np.clip((db - np.median(db[:columns], axis=0) + 6) / 46, 0, 1) * 255 + 0.5, 0, 255)
        assert np.abs(got[s0].astype(int) - want.T[::-1].astype(int)).max() <= 1
    masked = dataset.render_tiles(blocks, tiles.where("s0 = 0"), spec, 32, spark.createDataFrame([("a", 0, 2, 6, 0, 10)], "recording_id string, s0 long, x0 int, x1 int, y0 int, y1 int")).collect()[0]
    image = np.frombuffer(masked.image, np.uint8).reshape(10, 10)
    assert (image[:, 2:6] == got[0][:, 2:6]).all() and image[:, :2].max() <= np.median(got[0][:, 2:6])
    assert np.allclose(kernels.area_weights(7, 3).sum(axis=1), 1)


@pytest.mark.parametrize("every", [0, 2, 5])
def test_split_keeps_the_held_out_apart(spark, every):
    rng = np.random.default_rng(6)
    tiles = sorted({(r, int(s)) for r in range(3) for s in rng.integers(0, 40000, 60)})
    frame = spark.createDataFrame([(r, s, i % 4 == 0) for i, (r, s) in enumerate(tiles)], "rec int, s0 long, has_event boolean")
    lengths = spark.createDataFrame([(r, 500) for r in range(3)], "rec int, length long")
    got = {(r.rec, r.s0): r.split for r in dataset.split_tiles(frame, lengths, every).collect()}
    held = [t for t, s in got.items() if s == "val"]
    assert set(got) == set(tiles) and bool(held) == (every > 0)
    assert all(s != "train" or all(r != v or abs(s0 - w) >= 500 for v, w in held) for (r, s0), s in got.items())
    assert dataset.split_tiles(frame.limit(0), lengths).count() == 0


def test_label_lines(spark):
    made = spark.createDataFrame([(1, 5, 2, 1.0, 3.0, 20.0, 60.0), (1, 6, 0, 9.5, 12.0, 0.0, 50.0)], "rec int, uid long, cls int, t0 double, t1 double, f0 double, f1 double")
    tile = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.0, 100.0)], "rec int, s0 long, t0 double, t1 double, f0 double, f1 double")
    got = {r.uid: r.line for r in dataset.tile_labels(made, tile, 10.0, 64).collect()}
    assert got == {5: "2 0.200000 0.600000 0.200000 0.400000", 6: None}  # the second lies on the tile by a fifth


def test_sessions_without_tables(spark):
    pulses = spark.createDataFrame([(1, 0, "volley", None, 1.0, None), (1, 1, None, None, 2.0, None)], "session long, row long, pulse_type string, match_status string, recording_time_s double, detected_time_s double")
    loaded = layers.load_session({"pulses": pulses, "trials": None}, ["session"])
    assert [(r.kind, r["rows"], r.unlayered) for r in loaded["counts"].collect()] == [("pulses", 2, 1)] and loaded["spans"] is None
    assert [r.series for r in loaded["marks"].collect()] == ["observed"]  # without any statement all count as observed
    assert [r.warning for r in loaded["warnings"].collect()] == ["pulses of an unknown type"]


def test_power_on_frames_and_pipeline(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2, 200))
    rows = [("a", c, i, float(x[c, i])) for c in range(2) for i in range(200)]
    blocks = signals.to_blocks(spark.createDataFrame(rows, "recording_id string, channel int, frame long, value double"), 64)
    frames = spark.createDataFrame([("a", 0, -3), ("a", 1, 50), ("a", 2, 168), ("a", 3, 169)], "recording_id string, k long, start long")
    got = {(r.k, r.bin): (r.power, r.per_channel) for r in signals.power_on_frames(blocks, frames, 100.0, 32, 10.0, 40.0, 64).collect()}
    assert got[0, 5][0] is None and got[3, 5][0] is None and {b for _, b in got} == set(range(4, 13))
    window = np.hanning(32)
    want = 2 * np.abs(np.fft.rfft(x[:, 50:82] * window, axis=1)[:, 5]) ** 2 / ((window**2).sum() * 100)
    assert np.allclose(got[1, 5][1], want) and np.isclose(got[1, 5][0], want.sum())
    plain = signals.band_filter(blocks, 100.0, 5.0, 30.0)
    piped = signals.filter_pipeline(blocks, 100.0, False, 5.0, 30.0)
    assert piped.exceptAll(plain).count() == 0 and signals.filter_pipeline(blocks, 100.0, True, 5.0).count() == blocks.count()


def test_gaussian_smoothing(spark):
    rng = np.random.default_rng(9)
    db = rng.uniform(-80, 0, (9, 7))
    db[2, 3] = -np.inf
    rows = [("a", 0, c, b, float(db[c, b])) for c in range(9) for b in range(7)]
    cells = spark.createDataFrame(rows, "recording_id string, channel int, col long, bin int, db double")
    weights = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    weights /= weights.sum()
    want = np.where(np.isfinite(db), db, -200)
    for axis in (1, 0):
        padded = np.pad(want, [(4, 4) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = np.apply_along_axis(lambda v: np.convolve(v, weights, mode="valid"), axis, padded)
    got = {(r.col, r.bin): r.smooth for r in signals.gaussian_smooth(cells, 1.0).collect()}
    assert len(got) == 63 and all(abs(got[c, b] - want[c, b]) < 1e-9 for c in range(9) for b in range(7))


def test_replace_span_case_by_case(spark):
    def run(old, new, k0=10, k1=20, near=3):
        rows = [(0, i, ident, k, f, float(k)) for i, (ident, k, f) in enumerate(old)]
        snippet = [(0, i, ident, k, f, float(k)) for i, (ident, k, f) in enumerate(new)]
        out = edits.replace_span(spark.createDataFrame(rows, TRACKS), spark.createDataFrame(snippet, TRACKS), k0, k1, 1.0, near, ["session"]).collect()
        assert not any(n > 1 for n in Counter((r.ident, r.k) for r in out if r.ident is not None).values())
        return {(r.ident, r.k) for r in out if r.row < len(old)}, {(r.ident, r.k) for r in out if r.row >= len(old)}

    line = lambda ident, ks, f=100.0: [(ident, k, f) for k in ks]
    # a track that begins near frames or more after the edge is not the one before it
    assert run(line(1, range(10)), line(7, range(13, 20)))[1] == {(2, k) for k in range(13, 20)}
    assert run(line(1, range(10)), line(7, range(12, 20)))[1] == {(1, k) for k in range(12, 20)}
    # one id on the left and another on the right: the right one goes on under the left one's id, unless that has rows there itself
    assert run(line(1, range(10)) + line(2, range(20, 30)), line(7, range(10, 20)))[0] == {(1, k) for k in [*range(10), *range(20, 30)]}
    kept, added = run(line(1, [*range(10), 29], 100.2) + line(2, range(20, 30)), line(7, range(10, 20)))
    assert (2, 25) in kept and (1, 29) in kept and {i for i, _ in added} == {1}
    # two tracks, of which the right one may take the left one's id only where they share no frame
    assert run(line(1, [*range(10), *range(20, 25)]), line(7, range(10, 14)) + line(8, range(15, 20)))[1] == {(1, k) for k in [*range(10, 14), *range(15, 20)]}
    assert {i for i, _ in run(line(1, [*range(10), *range(20, 25)]), line(7, range(10, 16)) + line(8, range(15, 20), 100.5))[1]} == {1, 2}
    # the detection that is farther from its track loses its id
    old, new = line(1, range(10)), [*line(7, range(10, 20)), (7, 12, 104.0)]
    assert run(old, new)[1] == {(1, k) for k in range(10, 20)} | {(None, 12)}
    other = spark.createDataFrame([(5, 0, 3, 11, 50.0, 11.0)], TRACKS)
    fresh = edits.replace_span(spark.createDataFrame([(0, 0, 1, 3, 100.0, 3.0)], TRACKS), other, 10, 20, 1.0, 3, ["session"])
    assert sorted(tuple(r)[:4] for r in fresh.collect()) == [(0, 0, 1, 3), (5, 0, 0, 11)]
    assert edits.replace_span(other.limit(0).drop("session"), other.drop("session"), 10, 20, 1.0).collect()[0].ident == 0
    with pytest.raises(ValueError):
        edits.replace_span(other, other, 10, 11, 1.0, 3, ["session"])


def test_edits_keep_one_row_an_id_and_frame(spark):
    rows = spark.createDataFrame([(0, i, 1, k, 100.0, float(k)) for i, k in enumerate(range(10))], TRACKS)
    new = spark.createDataFrame([(0, 100, 1, 12, 103.0, 12.0), (0, 101, 1, 12, 100.5, 12.0), (0, 102, 1, 5, 100.0, 5.0), (0, 103, None, 5, 90.0, 5.0), (0, 104, None, 6, float("nan"), 6.0), (3, 105, None, 1, 80.0, 1.0)], TRACKS)
    added = edits.add_rows(rows, new, ["session"]).where("row >= 100").collect()
    assert sorted((r.row, r.ident) for r in added) == [(101, 1), (103, 2), (105, 0)]
    variant = rows.selectExpr("session", "row", "4L as ident").unionByName(spark.createDataFrame([(0, 50, 4)], "session long, row long, ident long"))
    twice = rows.unionByName(spark.createDataFrame([(0, 50, None, 3, 100.2, 3.0)], TRACKS))
    told = {r.row: r.new for r in edits.apply_ident(twice, variant, ["session"]).collect()}
    assert told == {i: 4 for i in range(10)}  # row 50 would be the second in its frame and stays without an id


def test_tile_blocks_of_a_dense_recording(spark):
    rng = np.random.default_rng(3)
    tiles = spark.createDataFrame([(r, int(s)) for r in (0, 1) for s in sorted(set(rng.integers(0, 3000 * (r + 1), 150)))], "rec int, s0 long")
    lengths = spark.createDataFrame([(0, 11), (1, 7)], "rec int, length long")
    walked, doubled = ({(r.rec, r.s0): r.block for r in dataset.tile_blocks(tiles, lengths, big).collect()} for big in (10**6, 0))
    assert walked == doubled and len(walked) == tiles.count() and len(set(walked.values())) > 20
    for (rec, s0), block in walked.items():
        assert 0 <= s0 - block < dataset.BLOCK_TILES * (11, 7)[rec]
