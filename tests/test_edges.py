"""Queries on small event tables at edges that the given tables do not reach, against their SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from fieldscope.functions import polygons
from fieldscope.operators import edits, joins, signals, tracks
from fieldscope.plans import boxes

duckdb = pytest.importorskip("duckdb")
OWN, SQL = __spark_entry__._own()


def differing(spark, folder, name, rows):
    """Rows of a query that its SQL has not and the other way round, over events(event_id, seconds, user_id, event_type, value)."""
    con = duckdb.connect()
    con.sql("CREATE TABLE e (event_id BIGINT, s DOUBLE, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?)", rows)
    con.sql(f"COPY (SELECT event_id, TIMESTAMP '2024-01-01' + to_microseconds(CAST(round(s * 1e6) AS BIGINT)) AS ts, user_id, event_type, value FROM e) TO '{folder}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    OWN[name](spark, str(folder)).write.parquet(f"{folder}/out")
    columns = ", ".join(f'"{c}"' for c in spark.read.parquet(f"{folder}/out").columns)
    ours, theirs = f"SELECT {columns} FROM '{folder}/out/*.parquet'", f"SELECT {columns} FROM ({SQL[name]})"
    return con.sql(f"{ours} EXCEPT ALL {theirs}").fetchall() + con.sql(f"{theirs} EXCEPT ALL {ours}").fetchall()


def test_outlines_from_pixels_late_and_at_halves(spark, tmp_path):
    rows = [(k, 5_000_000 + k * 7919.7 + k / 1e6, 1, "click", 100 + k * 0.005) for k in range(3000)]
    assert differing(spark, tmp_path, "outlines_from_pixels", rows) == []


def test_outline_text_at_halves(spark):
    values = [0.0000005, 1.0000005, 3.0000015, 20.5 + 2.0**-21, 90.1234565, -0.0]
    rows = spark.createDataFrame([([(v, v) for v in values],)], "p array<struct<t:double,f:double>>")
    assert rows.select(boxes._text(F.col("p"))).first()[0] == ";".join(f"{v + 0.0:.6f} {v + 0.0:.6f}" for v in values)


def test_spatial_coherence_counts_very_weak_channels(spark):
    """As the query's SQL does, which knows no dead channels; by default those under 1e-9 of the loudest are dead."""
    cells = spark.createDataFrame([("a", c, 0, 1, p) for c, p in enumerate((1.0, 0.5, 1e-11))], "recording_id string, channel int, col long, bin long, power double")
    all_live = {r.channel: r.power for r in signals.spatial_coherence(cells, 12.0, 3.0, dead=0.0).collect()}
    assert all_live[0] == pytest.approx(1.0)
    dead = {r.channel: r.power for r in signals.spatial_coherence(cells, 12.0, 3.0).collect()}
    assert dead[0] < 0.1


def test_cut_tracks_of_one_row(spark, tmp_path):
    rows = [(3 * k, 1000.0 * k + 0.123457, 2 + 2 * (k % 3), "click", 1.0) for k in range(10)] + [(30, 77.7, 40, "view", 2.0), (33, 80.1, 42, "view", 2.0), (36, 80.1, 42, "view", 3.0)]
    assert differing(spark, tmp_path, "cut_tracks", rows) == []


def test_cuts_are_read_once(spark):
    """Cut times that come out otherwise when they are worked out again (here: on purpose) still cut."""
    rows = spark.createDataFrame([(i, 1, float(i)) for i in range(10)], "row long, ident long, t double")
    cuts = spark.createDataFrame([(1, 5)], "ident long, new_id long").select("ident", (F.lit(4.5) + F.rand() * 1e-9).alias("t"), "new_id")
    wobbly = cuts.select("ident", F.udf(lambda t: t + __import__("time").time_ns() % 1000 * 1e-12, "double")("t").alias("t"), "new_id")
    assert {r.row for r in edits.cut_at(rows, wobbly).collect()} == {5, 6, 7, 8, 9}


def test_add_rows_where_new_numbers_are_in_use(spark, tmp_path):
    rows = [(i, 600.0 * i, i % 3, "click", float(i)) for i in range(1, 12)]
    rows += [(1_000_000 + i, 100.0 * (i // 3), 1, "click", float(i)) for i in range(1, 40)]
    assert differing(spark, tmp_path, "add_rows", rows) == []


def crowd(n=400):
    """Many events in few hours, a third of them thrice over at one place."""
    rows = [(i, 40.0 * (i % 350) + i % 7 / 8, i % 23, "signup" if i % 3 == 0 else "click", (i * 37 % 500) / 4) for i in range(n)]
    return rows + [(n + 3 * i + 3 * n * j, *rows[i][1:]) for i in range(0, n, 3) for j in (1, 2)]


@pytest.mark.parametrize("name", ["nearest_row", "nearest_ends", "join_issues", "track_issues", "brush_rows", "line_crossings"])
def test_crowded_tracks(spark, tmp_path, name, monkeypatch):
    """In several steps, however few the rows are."""
    monkeypatch.setattr(tracks, "_steps", lambda most, crowd, fewer: [most / 16, most / 4, most])
    assert differing(spark, tmp_path, name, crowd()) == []


def test_nearest_ends_of_few_tracks(spark, tmp_path):
    """Ends as near as each other, a point without an end in reach, and distances that are rounded."""
    rows = [(3 * i, 3600.0 * i + 0.1234567, 1 + i % 2, "click", 10.0 + i / 7) for i in range(6)] + [(60, 5000.2, 9, "signup", 9.3), (63, 5000.2, 9, "signup", 9.3), (66, 900_000.0, 9, "signup", 90.0)]
    assert differing(spark, tmp_path, "nearest_ends", rows) == []


def test_steps_follow_the_crowd():
    assert tracks._steps(20.0, 3.0, 16) == [20.0] and tracks._steps(20.0, 5000.0, 16) == [20 / 4**3, 20 / 4**2, 20 / 4, 20.0]


def test_brushed_rows_and_crossings_are_not_shuffled(spark):
    rows = spark.createDataFrame([(i, i % 2, i // 2, float(i), 100.0 * i) for i in range(20)], "row long, ident long, k long, f double, t double")
    line = spark.createDataFrame([(1, 0.0, 0.0, 900.0, 20.0)], "line long, t_a double, f_a double, t_b double, f_b double")
    for out in (tracks.line_crossings(rows, line), tracks.brush_rows(rows, line.withColumnRenamed("line", "stroke"), 0.01, 0.5, 5.0)):
        assert not out._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Aggregate") and out.count() > 0


def test_bucket_joins_do_not_broadcast_exploded_rows(spark):
    spans = spark.range(3).select(F.lit(1).alias("rec"), F.col("id").alias("t0"), (F.col("id") + 5).alias("t1"))
    other = spans.select("rec", F.col("t0").alias("t0_b"), F.col("t1").alias("t1_b"))
    plan = joins.overlapping(spans, other, ["rec"], 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
