"""Greedy, recursive and spectral operators against plain loops."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.functions import kernels, scalars
from fieldscope.operators import boxes, joins, signals, tracks, windows
from fieldscope.operators.scans import carried_states


def random_boxes(rng, n):
    return [(int(rng.integers(0, 2)), i, int(rng.integers(0, 2)), float(rng.integers(0, 30)) / 30, float(t), float(t + rng.uniform(1, 20)), float(f), float(f + rng.uniform(5, 40))) for i in range(n) for t, f in [(rng.uniform(0, 150), rng.uniform(0, 60))]]


def iou(a, b):
    both = max(0, min(a[5], b[5]) - max(a[4], b[4])) * max(0, min(a[7], b[7]) - max(a[6], b[6]))
    union = (a[5] - a[4]) * (a[7] - a[6]) + (b[5] - b[4]) * (b[7] - b[6]) - both
    return both / union if union else 0.0


SCHEMA = "rec long, uid long, cls int, score double, t0 double, t1 double, f0 double, f1 double"


def test_nms_is_the_greedy_loop(spark):
    rows = random_boxes(np.random.default_rng(0), 160)
    kept = []
    for b in sorted(rows, key=lambda r: (-r[3], r[1])):
        if all(k[0] != b[0] or k[2] != b[2] or iou(k, b) <= 0.2 for k in kept):
            kept.append(b)
    for big in (boxes.BIG, 0, 40):  # in calls, in rounds, and both
        got = boxes.nms(spark.createDataFrame(rows, SCHEMA), 0.2, 25.0, big=big).collect()
        assert {r.uid for r in got} == {b[1] for b in kept} and len(kept) < len(rows)


def test_match_events_is_the_greedy_loop(spark):
    rng = np.random.default_rng(1)
    found, truth = random_boxes(rng, 80), random_boxes(rng, 60)
    used, want = set(), {}
    for b in sorted(found, key=lambda r: (-r[3], r[1])):
        fit = [(abs((b[4] + b[5]) / 2 - (t[4] + t[5]) / 2), (t[4] + t[5]) / 2, t[1]) for t in truth if t[1] not in used and t[0] == b[0] and t[2] == b[2] and min(b[7], t[7]) > max(b[6], t[6])]
        fit = [x for x in fit if x[0] <= 4]
        want[b[1]] = min(fit)[2] if fit else None
        if fit:
            used.add(want[b[1]])
    matched = boxes.match_events(spark.createDataFrame(found, SCHEMA), spark.createDataFrame(truth, SCHEMA), 4.0)
    assert {r.uid: r.truth_uid for r in matched.collect()} == want
    s = boxes.scores_of(matched, len(truth)).first()
    tp = sum(v is not None for v in want.values())
    assert (s.tp, s.fp, s.fn) == (tp, 80 - tp, 60 - tp) and abs(s.f1 - 2 * tp / 140) < 1e-12
    best = boxes.best_threshold(matched, spark.createDataFrame(found, SCHEMA), 60).first()
    scores = {b[1]: round(b[3], 3) for b in found}
    f1 = {c: 2 * sum(want[u] is not None for u in scores if scores[u] >= c) / (sum(v >= c for v in scores.values()) + 60) for c in set(scores.values())}
    assert abs(best.f1 - max(f1.values())) < 1e-12 and abs(f1[best.cut] - best.f1) < 1e-12


def test_cover_windows(spark):
    rows = random_boxes(np.random.default_rng(2), 90)
    want = {}
    for rec in (0, 1):
        end, w0 = -math.inf, None
        for b in sorted((r for r in rows if r[0] == rec), key=lambda r: (r[4], r[1])):
            if b[5] > end:
                w0 = b[4] - 3.0
                end = w0 + 30.0
            want[b[1]] = w0
    got = {r.uid: r.w0 for r in windows.cover_windows(spark.createDataFrame(rows, SCHEMA), 30.0).collect()}
    assert got == pytest.approx(want)


def samples(spark, x, rate=1.0):
    return spark.createDataFrame([("r", c, i, float(v)) for c in range(len(x)) for i, v in enumerate(x[c])], "recording_id string, channel int, frame long, value double")


def flat(blocks):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.channel, r.start_frame)):
        out.setdefault(r.channel, []).extend(r.samples)
    return out


def test_filter_does_not_depend_on_blocks(spark):
    x = np.random.default_rng(3).normal(size=(2, 300))
    rows = samples(spark, x)
    got = [flat(signals.band_filter(signals.to_blocks(rows, n).repartition(k), 100.0, 5.0, 30.0)) for n, k in ((300, 1), (64, 4), (50, 7))]
    direct = [kernels.SectionFilter(kernels.butterworth(2, 100.0, 5.0, 30.0))._slow(x[c], np.zeros(4))[0] for c in (0, 1)]
    for g in got:
        for c in (0, 1):
            assert np.allclose(g[c], direct[c], atol=1e-12)
    assert signals.band_filter(signals.to_blocks(rows, 64), 100.0, None, 50.0).count() == 10


@pytest.mark.parametrize("hp,lp", [(None, 1000.0), (300.0, None), (300.0, 3000.0)])
def test_butterworth_cutoffs(hp, lp):
    s = kernels.butterworth(2, 20000.0, hp, lp)
    level = lambda f: 20 * math.log10(abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for z in [np.exp(-2j * np.pi * f / 20000)] for b0, b1, b2, _, a1, a2 in s])))
    for f in (hp, lp):
        assert f is None or abs(level(f) + 3.0103) < 1e-3
    assert len(kernels.butterworth(2, 20000.0, 1.0, 10000.0)) == 0


def test_spectrogram_and_blocks(spark):
    x = np.random.default_rng(4).normal(size=(1, 200))
    rows = samples(spark, x)
    want = kernels.power_columns(x[0], 0, (200 - 16) // 8 + 1, 16, 8, 100.0)
    for n in (16, 40, 200):
        got = sorted(signals.spectrogram(signals.to_blocks(rows, n), 100.0, 16, 8, n).collect(), key=lambda r: r.col)
        assert [r.col for r in got] == list(range(len(want))) and np.allclose([r.power for r in got], want)
    tone = np.sin(2 * np.pi * 25 * np.arange(200) / 100)
    power = kernels.power_columns(tone, 0, 5, 16, 8, 100.0)
    assert (power.argmax(axis=1) == 4).all()


def test_clicks_go_and_the_rest_stays(spark):
    rate, rng = 4000, np.random.default_rng(5)
    t = np.arange(3 * rate) / rate
    clean = 1e-3 * rng.normal(size=len(t)) + 0.2 * np.sin(2 * np.pi * 300 * t)
    x = clean.copy()
    for at in (0.7, 2.1):
        i = int(at * rate)
        x[i : i + 12] += 0.8 * np.exp(-np.arange(12) / 2)
    out = signals.clean_clicks(signals.to_blocks(samples(spark, [x]), 2 * rate), rate)
    y = np.array(flat(out)[0])
    assert np.abs(y - clean).max() < 0.05 < np.abs(x - clean).max() and (y != x).mean() < 0.05


def test_rings_and_runs():
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.standard_normal(200))
    ring = kernels.closed_ring(x, 60)
    assert (ring[:200] == x).all() and np.abs(np.diff(np.append(ring[199:], x[0]))).max() < 3 * np.abs(np.diff(x)).max()
    label, size = kernels.run_labels(np.array([1, 1, 0, 1, 0, 0, 1, 1, 1], bool))
    assert label.tolist() == [1, 1, 0, 2, 0, 0, 3, 3, 3] and size.tolist() == [3, 2, 1, 3]
    assert abs(kernels.vertex(np.array([-1.0]), np.array([0.0]), np.array([-0.5]))[0] - 1 / 6) < 1e-12


def test_ridge_follows_a_line():
    p = np.random.default_rng(6).gamma(2, size=(60, 100))
    freqs, line = np.arange(100.0), 40 + 10 * np.sin(np.arange(60) / 10)
    for k in range(60):
        p[k] += 200 * np.cos(np.clip((freqs - line[k]) / 3, -1, 1) * np.pi / 2) ** 4
    f, _ = kernels.ridge(p, freqs, line - 8, line + 8, np.arange(60) * 0.5, channels=2)
    assert np.nanmax(np.abs(f - line)) < 0.3 and np.isfinite(f).mean() > 0.95
    p[20] = np.nan
    assert np.isnan(kernels.ridge(p, freqs, line - 8, line + 8, np.arange(60) * 0.5)[0][20])


def test_value_in_force_keeps_nulls_and_ties(spark):
    series = spark.createDataFrame([(0, 1, 1.0, 5.0), (0, 2, 2.0, None), (0, 3, 2.0, 7.0), (0, 4, 9.0, None)], "key long, row long, t double, value double")
    asked = spark.createDataFrame([(0, i, t) for i, t in enumerate((0.5, 1.0, 1.5, 2.0, 8.9, 9.0, 30.0))] + [(1, 99, 3.0)], "key long, q long, t double")
    for width in (1.0, 4.0, 1000.0):
        got = {r.q: (None if r.held is None else r.held.value, r.held is not None) for r in joins.value_in_force(asked, series, ["key"], width).collect()}
        assert got == {0: (None, False), 1: (5.0, True), 2: (5.0, True), 3: (7.0, True), 4: (7.0, True), 5: (None, True), 6: (None, True), 99: (None, False)}


def test_islands_do_not_depend_on_buckets(spark):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 2)), i, float(t), float(t + rng.uniform(-5, 12))) for i in range(150) for t in [rng.uniform(0, 400)]]
    frame = spark.createDataFrame(rows, "key long, row long, t0 double, t1 double")
    got = [sorted(tuple(r) for r in joins.merge_spans(frame, ["key"], 1.5, width).collect()) for width in (3.0, 50.0, 1e6)]
    assert got[0] == got[1] == got[2]


def test_scalars(spark):
    one = spark.createDataFrame([("1:02:03.5",), ("59",), ("1:60",), ("x",), ("61:00",), (None,)], "s string").select(scalars.parse_time(F.col("s")).alias("v")).collect()
    assert [r.v for r in one] == [3723.5, 59.0, None, None, 3660.0, None]
    levels = spark.createDataFrame([(1.0,), (0.0,), (1e-20,), (float("nan"),), (None,)], "p double").select(scalars.decibel(F.col("p")).alias("v")).collect()
    assert levels[0].v == 0 and levels[1].v == levels[2].v == -math.inf and math.isnan(levels[3].v) and levels[4].v is None
    assert scalars.channel_list("0,2-5, 9") == [0, 2, 3, 4, 5, 9]


def test_harmonics_of_long_overlaps_vary_alike(spark):
    rng = np.random.default_rng(8)
    frames = np.arange(200)
    base = 300 + rng.normal(0, 0.2, 200) + frames * 0.0005
    made = {1: base, 2: 2 * base + rng.normal(0, 0.02, 200), 3: 3 * (300 + frames * 0.0005) + rng.normal(0, 0.2, 200), 4: np.full(200, 1000.0), 5: np.full(200, 2000.0)}
    made[6], made[7] = 2000 + rng.normal(0, 0.2, 30), 4000 + rng.normal(0, 0.2, 30)  # short: judged by the offset alone
    rows = [(i * 1000 + k, i, int(k), float(v), k * 0.25) for i, f in made.items() for k, v in enumerate(f) if not (i == 2 and k % 9 == 4)]
    frame = spark.createDataFrame(rows, "row long, ident long, k long, f double, t double")
    found = tracks.harmonic_candidates(frame, 4.0)
    near = {(r.lo, r.hi, r.h) for r in tracks.judge_harmonics(frame, found, 12.0, frame_s=None).collect()}
    got = {(r.lo, r.hi, r.h): r for r in tracks.judge_harmonics(frame, found, 12.0, frame_s=0.25).collect()}
    assert {(1, 2, 2), (1, 3, 3), (4, 5, 2), (6, 7, 2)} <= near  # frequencies lie close
    assert set(got) & {(1, 2, 2), (1, 3, 3), (4, 5, 2), (6, 7, 2)} == {(1, 2, 2), (6, 7, 2)}
    assert got[6, 7, 2].corr is None
    f = {(i, k): v for _, i, k, v, _ in rows}
    common = [k for k in range(200) if (2, k) in f]
    high = [[h * f[i, k] - np.median([h * f[i, j] for j in common if abs(j - k) <= 60]) for k in common] for i, h in ((1, 2), (2, 1))]
    assert abs(got[1, 2, 2].corr - np.corrcoef(*high)[0, 1]) < 1e-9


def test_the_floor_is_the_same_along_a_chunk():
    rng = np.random.default_rng(5)
    power = rng.exponential(1.0, 1003)
    power[200:260] *= 1e4
    floor = kernels.tonal_floor(power, 10, 7, 0.2)
    medians = np.median(power[:1000].reshape(100, 10), axis=1)
    padded = np.concatenate([[medians[0]] * 3, medians, [medians[-1]] * 3])
    want = [sorted(padded[c : c + 7])[1] for c in range(100)]
    assert len(floor) == 1003 and all((floor[10 * c : 10 * c + 10] == want[c]).all() for c in range(100)) and (floor[1000:] == want[99]).all()


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_states_are_carried_by_a_tree(spark, fan):
    rng = np.random.default_rng(6)
    turn = np.array([[0.9, 0.2], [-0.1, 0.8]])
    transition = lambda n: np.linalg.matrix_power(turn, n)
    rows = [(r, int(b), int(rng.integers(1, 5)), rng.normal(size=2).tolist()) for r in ("a", "b", None) for b in sorted(rng.choice(40, 23, replace=False))]
    want, state, last = {}, None, "none"
    for r, b, n, end in rows:
        state = np.zeros(2) if r != last else state
        want[r, b], last = state, r
        state = state @ transition(n) + np.array(end)
    got = carried_states(spark.createDataFrame(rows, "k string, block long, n long, state array<double>"), ["k"], transition, 2, fan).collect()
    assert len(got) == len(want) and all(np.allclose(r.state, want[r.k, r.block], atol=1e-12) for r in got)
    assert carried_states(spark.createDataFrame([], "k string, block long, n long, state array<double>"), ["k"], transition, 2, fan).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_a_dense_recording_is_covered_by_doubling(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(r[0], r[1], 0, 0.5, round(r[4] * (0.2 + 0.4 * seed), 1), round(r[4] * (0.2 + 0.4 * seed), 1) + r[5] - r[4], *r[6:]) for r in random_boxes(rng, 200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    spans = spark.createDataFrame([(0, 3.0, 60.0), (1, 0.0, 1e4)], "rec int, first double, last double").selectExpr("cast(rec as " + frame.schema["rec"].dataType.simpleString() + ") as rec", "first", "last")
    for more in ({"spans": spans} if seed else {},):
        walked = {r.uid: r.w0 for r in windows.cover_windows(frame, 5.0, **more).collect()}
        doubled = {r.uid: r.w0 for r in windows.cover_windows(frame, 5.0, **more, big=0).collect()}
        assert len(walked) == len(rows) and doubled == walked and len(set(walked.values())) > 5


def test_blind_windows_avoid_what_is_reviewed(spark):
    candidates = spark.createDataFrame([(1, i, 0, 0.3, 10.0 * i, 10.0 * i + 2, 0.0, 1.0) for i in range(23)] + [(2, 100, 0, 0.3, 5.0, 6.0, 0.0, 1.0), (3, 101, 0, 0.3, 5.0, 6.0, 0.0, 1.0)], "rec long, uid long, cls int, score double, t0 double, t1 double, f0 double, f1 double")
    spans = spark.createDataFrame([(1, 0.0, 240.0), (2, 0.0, 50.0), (3, 0.0, 2.0)], "rec long, first double, last double")
    rects = spark.createDataFrame([(1, 20.0, 120.0), (1, 100.0, 200.0), (2, -5.0, 500.0)], "rec long, t0 double, t1 double")
    ranked = windows.rank_windows(windows.cover_windows(candidates, 8.0, None, spans), candidates, 0.25)
    for seed in range(2):
        out = windows.with_blind(ranked, candidates, spans, rects, 8.0, seed).collect()
        assert {r.rec: sum(x.blind for x in out if x.rec == r.rec) for r in out} == {1: 4, 2: 1, 3: 1}
        assert sorted(r.place for r in out if r.rec == 1) == list(range(27)) and [r.place for r in sorted(out, key=lambda r: r.place) if r.rec == 1 and r.blind] == [4, 10, 16, 22]
        for r in out:
            if r.blind:
                assert not (r.rec == 1 and 20 <= r.w0 + 4 <= 200) and 0 <= r.w0 <= max({1: 240, 2: 50, 3: 2}[r.rec] - 8, 0)
                assert r.n == sum(r.w0 <= c.t0 and c.t1 <= r.w0 + 8 for c in candidates.where(f"rec = {r.rec}").collect())
    kind = "rec long, finished long"
    picks = {n: {r.rec: r.blind for r in windows.pick_window(windows.with_blind(ranked, candidates, spans, rects, 8.0), spark.createDataFrame([(1, n), (2, n)], kind)).collect()} for n in (4, 10)}
    assert picks == {4: {1: True, 2: True}, 10: {1: False, 2: False}}


def _alike(spark):
    """Tracks 1, 3, 5, 8 with copies: 2 of 1, 4 of 3, and 6 and 7 of 5, which is so low that it meets its copies."""
    rng = np.random.default_rng(3)
    base = 300 + rng.normal(0, 0.2, 40)
    made = {1: base, 3: 2 * base, 5: np.full(40, 1.5), 8: 3 * base + rng.normal(0, 2.0, 40)}
    made |= {2: made[1], 4: made[3], 6: made[5], 7: made[5]}
    rows = [(i * 1000 + k, i, k, float(v), k * 0.25) for i, f in made.items() for k, v in enumerate(f)]
    return spark.createDataFrame(rows, "row long, ident long, k long, f double, t double"), made


def test_ids_that_are_alike_meet_as_every_other(spark):
    frame, made = _alike(spark)
    want = {}
    for lo, a in made.items():
        for hi, b in made.items():
            for h in (2, 3, 4, 5):
                off = (b - h * a)[np.abs(b - h * a) <= 4 * math.sqrt(1 + h * h)]
                if lo != hi and len(off):
                    want[lo, hi, h] = (len(off), np.median(off))
    got = {(r.lo, r.hi, r.h): (r.n, r.offset) for r in tracks.harmonic_candidates(frame, 4.0).collect()}
    assert set(got) == set(want) and (5, 6, 2) in got and (6, 5, 2) in got and (2, 4, 2) in got
    assert all(got[p][0] == n and abs(got[p][1] - off) < 1e-9 for p, (n, off) in want.items())
    each = tracks.best_per_harmonic(tracks.judge_harmonics(frame, tracks.harmonic_candidates(frame, 4.0), 12.0, frame_s=None))
    best = tracks.find_harmonics(frame, 4.0, 12.0)
    assert sorted(best.select(*each.columns).collect(), key=str) == sorted(each.collect(), key=str)
    assert {(r.hi, r.lo) for r in best.collect()} >= {(3, 1), (4, 1), (5, 6), (6, 5), (7, 5)}


def test_pairs_of_ids_are_not_shuffled(spark):
    frame, _ = _alike(spark)
    plan = tracks.harmonic_candidates(frame, 4.0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and not re.search(r"hashpartitioning\([^)]*\bh#", plan)
    classes = tracks.track_classes(tracks.one_per_frame(frame).select("ident", "k", "f"))
    assert {r.ident: (r.like, r.many) for r in classes.collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2), 5: (5, 3), 6: (5, 3), 7: (5, 3), 8: (8, 1)}


def test_ids_near_points_of_one_place_and_of_several(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 5, float(t), float(f)) for i, (t, f) in enumerate(zip(rng.integers(0, 60, 80), rng.integers(0, 20, 80), strict=True))]
    points = [(1, 10.0, 5.0), (2, 10.0, 5.0), (2, 10.0, 5.0), (3, 30.0, 8.0), (3, 50.0, 8.0), (4, 200.0, 5.0), (5, None, 5.0)]
    want = {}
    for q in (1, 2, 3, 4, 5):
        best = {}
        for row, ident, t, f in rows:
            for d2 in [(t - a) ** 2 + (f - b) ** 2 for p, a, b in points if p == q and a is not None]:
                if d2 <= 36:
                    best[ident] = min(best.get(ident, (d2, row)), (d2, row))
        for place, (m, ident) in enumerate(sorted((m, i) for i, m in best.items()), 1):
            want[q, place] = (ident, m[1], m[0])
    found = tracks.nearest_of_id(spark.createDataFrame(rows, "row long, ident long, t double, f double"), spark.createDataFrame(points, "q long, t_q double, f_q double"), 1.0, 1.0, 6.0)
    got = found.collect()
    assert {(r.q, r.place): (r.ident, r.row, r.d2) for r in got} == want and len(got) == len(want)
    alone = tracks.nearest_of_id(spark.createDataFrame(rows, "row long, ident long, t double, f double"), spark.createDataFrame(points[:1], "q long, t_q double, f_q double"), 1.0, 1.0, 6.0)
    assert not re.search(r"hashpartitioning\([^)]*ident#", alone._jdf.queryExecution().executedPlan().toString())  # pairs are not shuffled
