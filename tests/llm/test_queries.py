"""Every opN query, and the pipeline, at the smallest size: the rows of its SQL where it has any, else one row for each that is to be judged."""

import os
import zlib

import numpy as np
import pytest

import __spark_entry__
from fieldscope.llm import langid, registry, urls
from fieldscope.llm.common import shared_path

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, tmp_path, name):
    registry.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    if name not in registry.ORACLES:
        of, key = {"op1_url_filter": ("pages", "page_id")}.get(name, ("documents", "doc_id"))
        a, b = f"SELECT {key} FROM '{tmp_path}/out/*.parquet'", f"SELECT {key} FROM {of}"
    else:
        columns = ", ".join(f'"{c}"' for c in spark.read.parquet(f"{tmp_path}/out").columns)
        a, b = f"SELECT {columns} FROM '{tmp_path}/out/*.parquet'", f"SELECT {columns} FROM ({registry.ORACLES[name]})"
    assert con.sql(f"{a} EXCEPT ALL {b}").fetchall()[:3] == [] and con.sql(f"{b} EXCEPT ALL {a}").fetchall()[:3] == []


def test_all_are_registered():
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and len(registry.QUERIES) == 13


def test_shards_by_plain_python(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op4_min_cost_reshard"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        raw, r = (d.text or "").encode(), rows[d.doc_id]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    of_text = {}
    for d in docs:
        of_text.setdefault(d.text, set()).add(rows[d.doc_id].shard)
    assert all(len(s) == 1 for s in of_text.values())
    for shard in range(16):
        assert sorted(r.slot for r in rows.values() if r.shard == shard) == list(range(sum(r.shard == shard for r in rows.values())))


def test_languages_by_plain_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in langid.predict(docs.selectExpr("*", "1 as lang_pred", "2 as score"), model).collect()}
    for d in docs.limit(60).collect():
        if d.text is None or not any(ch.isalpha() for ch in d.text):
            continue
        data = np.frombuffer(d.text.encode(), np.uint8)
        at, n = langid.gram_counts(langid.fold_letters(data), langid.SIZES, langid.BITS)
        z = (n @ model.weights[at] / n.sum() + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[d.doc_id].lang_pred == model.langs[p.argmax()] and abs(got[d.doc_id].score - p.max()) < 1e-4
    twice = docs.union(docs.limit(3)).union(docs.limit(3))
    again = langid.fit(twice.where(~langid.held_out()).select("doc_id", "text", "lang"))
    assert set(again.langs) == set(model.langs)


def test_urls_of_unseen_hosts(spark):
    told = urls.held_out_scores(urls.seed_urls(spark)).collect()
    right = np.mean([(r.probability > 0.5) == (r.label == 1) for r in told])
    blocked_wanted = np.mean([r.probability > 0.75 for r in told if r.label == 0])
    assert len(told) == urls.seed_urls(spark).count() and right > 0.8 and blocked_wanted < 0.1
    rules = (("net", "/a", "block"), ("x.net", "/", "allow"), ("y.net", "/", "block"))
    pages = spark.createDataFrame([(1, "http://x.net/a"), (1, "http://x.net/a"), (2, "http://q.y.net/b")], "page_id long, url string")
    out = [(r.page_id, r.rule, r.verdict) for r in urls.judge(pages, urls.fit(urls.seed_urls(spark)), rules).collect()]
    assert out == [(1, "x.net/", "allow"), (1, "x.net/", "allow"), (2, "y.net/", "block")]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    folder = shared_path(spark, "tables")
    for name in ("documents", "labels", "benchmark"):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        (t.limit(0) if name == "documents" else t).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
    odd = spark.read.parquet(f"{SF}/documents.parquet").limit(80).selectExpr("*", "1 as _gone", "2 as _hash", "3 as _id", "4 as _source", "5 as draw")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns
