"""Derived traces: one pass gives what the single steps give one after the other."""

import numpy as np
import pytest

from fieldscope.operators import traces
from fieldscope.operators.signals import band_filter, to_blocks, with_halo
from fieldscope.operators.traces import Trace


@pytest.fixture
def blocks(spark):
    x = np.random.default_rng(0).normal(size=(2, 203))
    rows = [("r", c, i, float(v)) for c in range(2) for i, v in enumerate(x[c])]
    return x, to_blocks(spark.createDataFrame(rows, "recording_id string, channel int, frame long, value double"), 16)


def joined(df, name):
    rows = sorted(df.where(f"trace = '{name}'").collect(), key=lambda r: (r.channel, r.block))
    return [np.concatenate([r.samples for r in rows if r.channel == c]) for c in (0, 1)]


def test_a_graph_of_three_stages(spark, blocks):
    x, frame = blocks
    calls = []

    def one(y, rate):
        return np.convolve(y, [1.0, 2.0, 1.0], "same")

    def two(y, rate):
        return np.concatenate([[0.0, 0.0], y[2:] - y[:-2]])

    def three(y, rate):
        return np.maximum(y, 0) * rate

    known = {t.name: t for t in (Trace("three", "two", three), Trace("two", "one", two, before=2), Trace("one", "data", one, 1, 1), Trace("side", "one", lambda y, rate: -y), Trace("low", "data", lambda b, rate: calls.append(1) or band_filter(b, rate, None, 10.0), whole=True), Trace("far", "low", three), Trace("near", "low", two, before=2))}
    out = traces.derive(frame, 50.0, ["three", "side", "one", "far", "near", "low"], known)
    want_low = [np.concatenate([r.samples for r in sorted(band_filter(frame, 50.0, None, 10.0).collect(), key=lambda r: r.block) if r.channel == c]) for c in (0, 1)]
    for c in (0, 1):
        a = one(x[c], 50.0)
        assert np.allclose(joined(out, "one")[c], a) and np.allclose(joined(out, "side")[c], -a) and np.allclose(joined(out, "three")[c], three(two(a, 50.0), 50.0))
        assert np.allclose(joined(out, "low")[c], want_low[c]) and np.allclose(joined(out, "far")[c], three(want_low[c], 50.0)) and np.allclose(joined(out, "near")[c], two(want_low[c], 50.0))
    assert len(calls) == 1 and traces.reach(traces.chain("three", known)) == (3, 1)
    one_pass = traces.derive(frame, 50.0, ["three", "side"], known)
    plan = one_pass._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("LogicalRDD") == with_halo(frame, 3, 1)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    with pytest.raises(KeyError):
        traces.derive(frame, 50.0, ["none"], known)
    with pytest.raises(ValueError):
        traces.derive(frame, 50.0, ["a"], {"a": Trace("a", "b", one), "b": Trace("b", "a", one)})


def test_registered_traces(spark, blocks):
    x, frame = blocks
    out = traces.derive(frame, 64.0, ["slope", "envelope"])
    for c in (0, 1):
        assert np.allclose(joined(out, "slope")[c], traces._slope(traces._smooth(x[c], 64.0), 64.0))
    assert all((e >= 0).all() and len(e) == 203 for e in joined(out, "envelope"))


def test_table_function_from_sql(spark, blocks):
    x, frame = blocks
    traces.register_table_functions(spark)
    got = spark.sql("SELECT * FROM window_stats(TABLE({b}) PARTITION BY (recording_id, channel) ORDER BY (block), 25)", b=frame).collect()
    want = {(c, s): (x[c, s : s + 25].mean(), np.abs(x[c, s : s + 25]).max()) for c in (0, 1) for s in range(0, 200, 25)}
    assert {(r.channel, r.start_frame) for r in got} == set(want) and all(np.allclose((r["mean"], r.peak), want[r.channel, r.start_frame]) for r in got)
    with pytest.raises(Exception, match="window_stats"):
        spark.sql("SELECT * FROM window_stats(TABLE({b}) PARTITION BY (channel), 0)", b=frame)
