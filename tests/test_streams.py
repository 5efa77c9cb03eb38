"""Streams in five micro-batches, with late rows, give what the batch operators give."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.operators import joins, runs
from fieldscope.streaming import state

START = dt.datetime(2024, 1, 1)


def streamed(spark, tmp_path, rows, schema, make, name):
    """rows in five files, read one a batch, and a row far later that moves the watermark on."""
    rng = np.random.default_rng(1)
    rows = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=float(rng.uniform(0, 500)))))  # up to 500 s out of order
    for i, part in enumerate([*(rows[k : k + len(rows) // 5 + 1] for k in range(0, len(rows), len(rows) // 5 + 1)), [("end", START + dt.timedelta(days=30), 0, *rows[0][3:])], [("end", START + dt.timedelta(days=60), 1, *rows[0][3:])]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert run.exception() is None and len(run.recentProgress) >= 5
    return spark.table(name).where("key <> 'end'")


def times(n, seed):
    rng = np.random.default_rng(seed)
    return [START + dt.timedelta(seconds=float(round(s, 3))) for s in np.sort(rng.uniform(0, 6000, n))], rng


@pytest.fixture
def seconds():
    return lambda c: (F.unix_micros(c) - int(START.replace(tzinfo=dt.UTC).timestamp() * 1e6)) / 1e6


def test_runs(spark, tmp_path, seconds):
    at, rng = times(120, 2)
    rows = [(str(rng.integers(0, 3)), t, i, bool(rng.integers(0, 2))) for i, t in enumerate(at)] + [("stop", at[5], 500, False), ("stop", at[9], 501, False)]
    schema = "key string, ts timestamp, row long, is_start boolean"
    got = streamed(spark, tmp_path, rows, schema, lambda s: state.stream_pair_runs(s, ["key"], "600 seconds"), "runs_out")
    batch = runs.pair_runs(spark.createDataFrame(rows, schema).withColumn("t", seconds("ts")), ["key"])
    have = sorted((r.key, r.row, round(r.a, 3), round(r.b, 3), r.open_left, r.open_right) for r in got.select("key", "row", seconds("t0").alias("a"), seconds("t1").alias("b"), "open_left", "open_right").collect())
    assert have == sorted((r.key, r.row, round(r.t0, 3), round(r.t1, 3), r.open_left, r.open_right) for r in batch.collect()) and len(have) > 40


def test_islands(spark, tmp_path, seconds):
    at, rng = times(150, 3)
    rows = [(str(rng.integers(0, 3)), t, i, t + dt.timedelta(seconds=float(round(rng.uniform(-20, 60), 3)))) for i, t in enumerate(at)]
    schema = "key string, ts timestamp, row long, ts_end timestamp"
    got = streamed(spark, tmp_path, rows, schema, lambda s: state.stream_merge_spans(s, ["key"], 15.0, "600 seconds"), "spans_out")
    batch = joins.merge_spans(spark.createDataFrame(rows, schema).withColumns({"t0": seconds("ts"), "t1": seconds("ts_end")}), ["key"], 15.0)
    have = sorted((r.key, round(r.a, 3), round(r.b, 3), r.first_row, r.n) for r in got.select("key", seconds("t0").alias("a"), seconds("t1").alias("b"), "first_row", "n").collect())
    assert have == sorted((r.key, round(r.t0, 3), round(r.t1, 3), r.first_row, r.n) for r in batch.collect()) and len(have) > 20


def test_values_in_force(spark, tmp_path, seconds):
    at, rng = times(80, 4)
    series = spark.createDataFrame([(str(rng.integers(0, 3)), float(rng.integers(0, 60) * 100), i, None if i % 7 == 0 else float(i)) for i in range(60)], "key string, t double, row long, value double")
    rows = [(str(rng.integers(0, 4)), t, i) for i, t in enumerate(at)]
    asked = lambda df: df.withColumn("t", F.floor(seconds("ts") / 50) * 50.0)
    got = streamed(spark, tmp_path, rows, "key string, ts timestamp, row long", lambda s: state.stream_value_at(asked(s), series, ["key"], 1000.0), "values_out")
    batch = joins.value_in_force(asked(spark.createDataFrame(rows, "key string, ts timestamp, row long")), series, ["key"], 1000.0).select("row", F.col("held.value").alias("value"))
    assert sorted(map(tuple, got.select("row", "value").collect())) == sorted(map(tuple, batch.collect()))
