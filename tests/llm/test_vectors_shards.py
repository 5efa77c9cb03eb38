"""Vectors, components, resharding and the pipeline against plain Python."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from fieldscope.llm import shards, vectors
from fieldscope.llm.common import shared_path
from fieldscope.llm.components import connected_components


def brute(rows, cut):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, dtype=np.float32).astype(np.float64)
        return v / np.sqrt((v * v).sum())

    u = [unit(v) if label is not None and i is not None else None for i, v, label in rows]
    links, root = [0] * len(rows), {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if u[a] is not None and u[b] is not None and rows[a][2] == rows[b][2] and len(u[a]) == len(u[b]) and u[a] @ u[b] >= cut:
                links[a] += 1
                links[b] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return sorted((r[0], links[i], find(r[0])) for i, r in enumerate(rows) if r[0] is not None)


@pytest.mark.parametrize("tile", [8, 1024])
def test_near_duplicate_vectors(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + 0.03 * (i // 24) * rng.standard_normal(16)).tolist() if i % 5 else rng.standard_normal(16).tolist(), i % 3 if i % 11 else None) for i in range(160)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [None] + [1.0] * 15, 1), (205, [float("inf")] * 16, 1), (206, rows[1][1], 1), (207, rows[1][1], 1), (208, [1.0, 2.0], 1), (209, [2.0, 4.0], 1), (None, rows[1][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as rep", "1 as n_links")
    got = vectors.near_duplicates(frame, 0.98, miss=1e-9, tile_rows=tile).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == brute(rows, 0.98)
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert vectors.near_duplicates(frame.limit(0)).collect() == []


def test_tables_follow_size_and_cut():
    for largest in (1, 500, 10**5, 10**8):
        bits, tables = vectors.plan_tables(largest, 0.98, 1e-4)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 1e-4


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(300, i) for i in range(301, 360)] + [(5, 5), (None, 3), (7, None), (9, 8), (8, 9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 300 for i in range(300, 360)}, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_min_cost_flow_moves_the_least():
    rng = np.random.default_rng(2)
    for _ in range(60):
        supply = rng.integers(0, 50, int(rng.integers(1, 6))).tolist()
        n = int(rng.integers(1, 6))
        capacity = shards.even_capacities(sum(supply), n)
        flow = shards.min_cost_flow(supply, capacity, [[int(i != j) for j in range(n)] for i in range(len(supply))])
        assert [sum(r) for r in flow] == supply
        assert all(sum(r[j] for r in flow) <= capacity[j] for j in range(n))
        moved = sum(f for i, r in enumerate(flow) for j, f in enumerate(r) if i != j)
        assert moved == sum(max(0, s - (capacity[i] if i < n else 0)) for i, s in enumerate(supply))
    # a cost where the cheapest way must be taken back: both sources want the same sink
    assert shards.min_cost_flow([1, 1], [1, 1], [[0, 1], [0, 5]]) == [[0, 1], [1, 0]]


def test_reshard(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("abcdé "), int(rng.integers(0, 60)))) if i % 7 else f"copy {i % 3}", i) for i in range(600)] + [(600, None, 1), (601, "", 1), (None, "nameless", 1), (5, "twice", 1), (5, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    old = docs.selectExpr("*", "cast(pmod(crc32(coalesce(text, '')), 5) as int) as old_shard")
    plan = shards.plan_shards(old, 7, blocks=256)
    out = shards.reshard(old, plan, shared_path(spark, "s")).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.text) for r in out) == Counter((d, t) for d, t, _ in rows)
    loads = Counter()
    for r in out:
        loads[int(r.shard)] += size(r.text)
    assert max(loads.values()) - min(loads[j] for j in range(7)) <= 130
    for j in range(7):
        assert sorted(r.slot for r in out if int(r.shard) == j) == list(range(sum(int(r.shard) == j for r in out)))
    where = {}
    for r in out:
        assert where.setdefault(r.text or "", int(r.shard)) == int(r.shard)
    moved = sum(size(r.text) for r in out if int(r.shard) != zlib.crc32((r.text or "").encode()) % 5)
    assert moved == plan.moved_bytes <= plan.least_bytes + 7 * 130
    one = spark.createDataFrame([(i, "hot " * 30) for i in range(300)] + [(1000 + i, f"t{i}") for i in range(50)], "doc_id long, text string").selectExpr("*", "0 as old_shard")
    spread = Counter(int(r.shard) for r in shards.reshard(one, shards.plan_shards(one, 4), shared_path(spark, "s")).collect())
    assert max(spread.values()) < 200  # a group that is larger than a shard is split
    none = old.limit(0)
    assert shards.reshard(none, shards.plan_shards(none, 3), shared_path(spark, "s")).collect() == []


def test_reshard_splits_only_texts_larger_than_a_shard(spark):
    rows = [(i, "hot " * 30) for i in range(300)] + [(1000 + i, f"copies of text {i % 40}") for i in range(400)] + [(2000 + i, "half a shard " * 3) for i in range(120)]
    old = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as old_shard")
    for blocks in (1, 2):
        plan = shards.plan_shards(old, 6, blocks=blocks)
        out = shards.reshard(old, plan, shared_path(spark, "split")).collect()
        assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
        places, loads = {}, Counter()
        for r in out:
            places.setdefault(r.text, set()).add(int(r.shard))
            loads[int(r.shard)] += len(r.text) + 1
        assert len(places.pop("hot " * 30)) > 1
        assert all(len(p) == 1 for p in places.values())
        assert [loads[j] for j in range(6)] == plan.shard_bytes and max(loads.values()) < 1.5 * sum(loads.values()) / 6


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(6)
    words = "the of and erin thal onder stal rebin kor vant ulmo serif quon delta mira tolk hest wyn parn osk".split()
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words, 30)) + f" u{i}"
        if i % 4 == 0:
            text = text.upper() + "!!"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    item = " ".join(f"q{j}" for j in range(14))
    rows += [(200 + i, rows[1][1] + (" x" if i % 2 else ""), "en", "src1", 1) for i in range(6)] + [(300, "the of " + item + " and", "en", "src0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == names
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert len({i for i in kept[0] if i < 160 and i % 4 == 0}) <= 2 and len({i for i in kept[0] if i < 160 and i % 4}) >= 115
    assert kept[1] == kept[0] - set(range(200, 206))  # copies of document 1, which stays
    assert kept[2] == kept[1] - {300}
    assert kept[3] <= kept[2] and 0 < len(kept[3]) < len(kept[2])
    assert kept[4] == kept[3]
