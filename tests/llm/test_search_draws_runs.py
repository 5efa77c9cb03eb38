"""Top-k search, importance resampling and periodic runs against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldscope.llm import periodic, resample, topk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_checksums_of_spans():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    starts = rng.integers(0, 4000, 700)
    ends = starts + np.concatenate([rng.integers(1, 70, 600), rng.integers(1, 1000, 100)])
    want = [zlib.crc32(data[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
    assert resample.span_crcs(data, starts, ends).tolist() == want
    assert resample.span_crcs(data, starts[:0], ends[:0]).tolist() == []
    big = rng.integers(0, 256, 3_000_000, dtype=np.uint8)
    assert resample.span_crcs(big, np.array([0, 5]), np.array([3_000_000, 6])).tolist() == [zlib.crc32(big.tobytes()), zlib.crc32(big[5:6].tobytes())]


TEXTS = ["The cat, the CAT sat.", None, "", " .,! ", "Ärger über Öl 42 x", "a" * 200 + " b " + "ü" * 90, "one", "x y z " * 400, "İstanbul K ǅ"]


@pytest.mark.parametrize("n", [(1, 1), (2, 3), (1, 4)])
def test_features_are_hashed_runs_of_words(n):
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in TEXTS]
    for lo, hi, words, rows, found in resample.feature_blocks(pa.array(TEXTS), *n, 997):
        assert (lo, hi) == (0, len(TEXTS))
        for i, text in enumerate(low):
            w = WORD.findall(text)
            want = [zlib.crc32(" ".join(w[j : j + k]).encode()) % 997 for k in range(n[0], n[1] + 1) for j in range(len(w) - k + 1)]
            assert words[i] == len(w) and Counter(found[rows == i].tolist()) == Counter(want)


def drawn_by_hand(rows, target, percent, min_words, buckets=10_000, seed=2024):
    def features(text):
        return [zlib.crc32(w.encode()) % buckets for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]

    s, t = Counter(b for _, x in rows for b in features(x)), Counter(b for x in target for b in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((k for k in range(len(out)) if out[k][1] >= min_words), key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0))
    rank = {k: r + 1 for r, k in enumerate(order[: len(order) * percent // 100])}
    return sorted((*map(str, r), str(rank.get(k))) for k, r in enumerate(out))


def test_resampling_by_plain_python(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(80)] + ["Ünder", "ß"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 40)))) for i in range(150)]
    rows += [(None, "w1 " * 25), (500, None), (501, ""), (502, "..."), *[(7000, "w3 w4 " * 15)] * 60, (7000, "w9 " * 30)]
    target = [" ".join(vocabulary[:20]) * 5, None, "w3 w3"]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, score int, n int, bucket string")
    of = spark.createDataFrame([(t, 9) for t in target], "text string, n int")
    for percent, least in ((10, 20), (50, 5), (100, 0), (10, 1000)):
        got = resample.resample(docs, of, percent, least).collect()
        assert sorted((*map(str, (r.doc_id, r.n_features, r.weight, r.score)), str(r["rank"])) for r in got) == drawn_by_hand(rows, target, percent, least)
    assert resample.resample(docs.limit(0), of).collect() == []
    assert resample.resample(docs, of.limit(0)).count() == len(rows)
    kept = resample.draw_documents(docs, of, percent=50)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in resample.resample(docs, of, 50).collect() if r["rank"]}


def nearest_by_hand(rows, is_query, k):
    def whole(v):
        return None if not v or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * x) for x in v]

    table = [(i, whole(v)) for i, v in rows if i is not None and whole(v)]
    asked = {}
    for i, v in rows:
        if i is not None and whole(v) and is_query(i):
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, v in asked.items():
        q = whole(v)
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, x, strict=True)))), j) for j, x in table if j != i and len(x) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [16, 1024])
def test_top_k_by_plain_python(spark, block_rows):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 8))
    rows = [(i, (centre[i % 6] + 0.1 * rng.standard_normal(8)).tolist() if i % 3 else rng.standard_normal(8).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)] + [(2000 + i, [0.0] * 8) for i in range(5)]
    rows += [(3000, None), (3001, []), (3002, [float("nan")] * 8), (3003, [None] + [1.0] * 7), (3004, [float("inf")] * 8), (None, rows[1][1]), (3020, [1.0, 2.0]), (3021, [2.0, 1.0]), (3040, [1.0, 2.0, 3.0])]
    rows += [(20, rows[30][1]), (20, rows[31][1]), (41, rows[20][1]), (41, rows[20][1])]
    frame = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, rank string, width int")
    asked = topk.F.col("vec_id") % 20 == 0
    got = topk.top_k(frame, asked, k=5, block_rows=block_rows, pivots=6)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == nearest_by_hand(rows, lambda i: i % 20 == 0, 5)
    assert topk.top_k(frame.limit(0), asked).collect() == [] and topk.top_k(frame, topk.F.lit(False)).collect() == []


def test_top_k_beyond_doubles(spark):
    rows = [(i, [2.0**30 + i, -(2.0**29) + 3 * i, 1e15 if i % 7 == 0 else 1.0]) for i in range(60)] + [(80, [1e300, 1.0, -1e300]), (81, [1e300, 2.0, 1e300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, topk.F.col("vec_id") % 20 == 0, k=4, block_rows=16, pivots=4)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == nearest_by_hand(rows, lambda i: i % 20 == 0, 4)


def test_bounds_are_no_lower_than_products():
    rng = np.random.default_rng(9)
    x = np.floor(64 * rng.standard_normal((300, 16)))
    pivots = topk.choose_pivots(x[:50], 12)
    far = topk.distances(x, pivots)
    assert (topk.upper_bounds(x[:40], far[:40], x, far) >= x[:40] @ x.T).all()


def test_transform_and_its_inverse():
    rng = np.random.default_rng(2)
    for size in (2, 8, 64, 1024):
        x = rng.integers(0, periodic.PRIME, (size, 3)).astype(np.uint64)
        assert (periodic.inverse(periodic.transform(x)) == x).all()
    a, b = rng.integers(0, 1000, 5), rng.integers(0, 1000, 9)
    pad = lambda v: np.concatenate([v, np.zeros(16 - len(v), v.dtype)]).astype(np.uint64)[:, None]
    product = periodic.inverse(periodic._reduced(periodic.transform(pad(a)) * periodic.transform(pad(b))))[:, 0]
    assert product[:13].tolist() == np.convolve(a, b).tolist()


def test_blocks_that_occur_again():
    rng = np.random.default_rng(4)
    for b, first, last in ((2, 1, 6), (4, 7, 14), (8, 15, 30), (64, 127, 254)):
        words = rng.integers(0, 2, 600).astype(np.int64)
        words[300:500] = words[100:300]
        starts = np.arange(0, 600 - b - first, b)
        at, d = periodic.matches(words, starts, np.full(len(starts), 600), b, first, last)
        want = {(s, x) for s in starts.tolist() for x in range(first, last + 1) if s + x + b <= 600 and (words[s : s + b] == words[s + x : s + x + b]).all()}
        assert want == set(zip(at.tolist(), d.tolist(), strict=True))


def runs_by_hand(w, least=12):
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def test_runs_by_plain_python():
    rng = np.random.default_rng(8)
    texts = []
    for k in range(260):
        n = int(rng.integers(0, 260))
        w = rng.integers(0, [2, 3, 5, 40][k % 4], n)
        if n and k % 3 == 0:
            a = int(rng.integers(0, n))
            p = 1 + (n - a) // int(rng.integers(2, 12))
            w = np.array([w[i if i < a else a + (i - a) % p] for i in range(n)])
        if n > 40 and k % 5 == 0:
            w[n // 2 :] = 1
        texts.append(w.tolist())
    texts += [[1] * 300, [1, 2] * 150, [1, 2, 3] * 4, [1, 2, 3, 4, 5, 6] * 2, [1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5], [7] * 11, [7] * 12, ([1, 2] * 10 + [3]) * 4, []]
    bounds = np.cumsum([0] + [len(t) for t in texts])
    start, end, period = periodic.find_runs(np.concatenate([np.array(t, np.int64) for t in texts]), bounds)
    got = [[] for _ in texts]
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
        i = int(np.searchsorted(bounds, s, side="right")) - 1
        got[i].append((s - int(bounds[i]), e - s, q))
    for text, runs in zip(texts, got, strict=True):
        assert sorted(runs) == runs_by_hand(text)


def test_runs_of_a_long_text():
    rng = np.random.default_rng(6)
    w = np.concatenate([rng.integers(0, 500, 3000), np.tile(rng.integers(0, 500, 4001), 3), [5] * 6000, rng.integers(0, 500, 200)])
    runs = set(zip(*(x.tolist() for x in periodic.find_runs(w, np.array([0, len(w)]))), strict=True))
    assert any(q == 4001 and e - s >= 12003 for s, e, q in runs) and any(q == 1 and e - s >= 6000 for s, e, q in runs) and len(runs) < 5


def test_longest_blocks_take_more_windows(monkeypatch):
    monkeypatch.setattr(periodic, "LONGEST_BLOCK", 4)
    rng = np.random.default_rng(7)
    for n in (90, 170):
        w = np.tile(rng.integers(0, 30, n), 3)[: 2 * n + 9]
        got = sorted((int(s), int(e - s), int(q)) for s, e, q in zip(*periodic.find_runs(w, np.array([0, len(w)])), strict=True))
        assert got == runs_by_hand(w.tolist()) and got


def test_collapsed_texts(spark):
    rows = [(1, "a  b " * 9 + "c"), (2, None), (3, ""), (4, " \t\n"), (5, "x y  z"), (6, "Ä x " * 20), (7, "q " * 5 + "w " * 30), (None, "k " * 12), (7, "q " * 5 + "w " * 30), (8, "tail\x1c" * 3 + " u v" * 8)]
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(rows, got, strict=True):
        w = [x.decode() for x in (text or "").encode().split()]
        runs = runs_by_hand(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone))
    short = periodic.collapse(docs)
    assert short.columns == docs.columns and [r.text for r in short.collect()] == [r.collapsed if r.runs else t for r, (_, t) in zip(got, rows, strict=True)]
    assert periodic.periodic_runs(docs.limit(0)).collect() == [] and periodic.collapse(docs.limit(0)).collect() == []
