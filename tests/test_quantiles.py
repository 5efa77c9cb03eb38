"""Radix selection gives what percentile gives."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.operators.activity import activity, bin_stats
from fieldscope.operators.quantiles import DIGITS, exact_quantiles

PERCENTS = [0.0, 0.1, 0.25, 0.5, 1 / 3, 0.95, 1.0]


@pytest.mark.parametrize("small", [0, 40, 10**6])
def test_equals_percentile(spark, small):
    rng = np.random.default_rng(0)
    rows = [("a", float(x)) for x in rng.standard_normal(500)] + [("b", float(x)) for x in rng.integers(-3, 3, 301)] + [("c", -0.0), ("c", 0.0), ("c", 5e-324), ("d", None), ("e", 7.5), (None, 1.0), (None, 2.0)]
    rows += [("f", x) for x in (math.inf, -math.inf, 1e308, -1e308, 1e-300, 3.0, math.nan)] + [("g", float(x)) for x in rng.uniform(1, 1 + 1e-12, 77)] + [("h", 4.25)] * 100
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    want = {r.k: (r.n, r.q) for r in frame.where("v is not null").groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", PERCENTS).alias("q")).collect()}
    got = {r.k: (r.n, r.quantiles) for r in exact_quantiles(frame, ["k"], "v", PERCENTS, small).collect()}
    assert set(got) == set(want) == {"a", "b", "c", "e", None, "f", "g", "h"}
    for k, (n, q) in want.items():
        assert got[k][0] == n and np.array_equal(np.array(got[k][1], float), np.array(q, float), equal_nan=True), (k, got[k], q)
    assert exact_quantiles(frame.limit(0), ["k"], "v", PERCENTS, small).collect() == []


def test_no_key_at_all_and_several_keys(spark):
    frame = spark.range(1000).selectExpr("id % 3 as a", "id % 2 as b", "cast((id * 7919) % 1009 as double) as v")
    for keys in ([], ["a", "b"]):
        got = sorted(exact_quantiles(frame, keys, "v", [0.5, 0.9], 10).collect())
        want = sorted(frame.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("v", [0.5, 0.9]).alias("quantiles")).collect())
        assert got == want


def test_five_passes_of_bounded_counts():
    assert sum(DIGITS) == 64 and len(DIGITS) == 5 and max(DIGITS) <= 13


def test_activity_does_not_depend_on_the_form(spark, monkeypatch):
    from fieldscope.operators import quantiles

    samples = spark.range(6000).selectExpr("'r' as recording_id", "cast(id % 2 as int) as channel", "id div 2 as frame", "sin(id * id) * (1 + id % 700 div 600) as value")
    stats = bin_stats(samples, 32)
    key = lambda r: (r.channel, r.bin)
    gathered = sorted(activity(stats, ["recording_id", "channel"]).collect(), key=key)
    monkeypatch.setattr(quantiles.exact_quantiles, "__defaults__", (5,))
    assert sorted(activity(stats, ["recording_id", "channel"]).collect(), key=key) == gathered
