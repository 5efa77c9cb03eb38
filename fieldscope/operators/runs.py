"""Runs, windows of points, spans and steps, and joins of split recordings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.operators.joins import along, neighbour


def window_spans(spans: DataFrame, t0: float, t1: float) -> DataFrame:
    """The spans that reach into [t0, t1): start < t1 and max(end, start) > t0. NaN bounds are refused; none where t1 <= t0."""
    if math.isnan(t0) or math.isnan(t1):
        raise ValueError("window bounds must be numbers")
    return spans.where((F.col("t0") < t1) & (F.greatest("t1", "t0") > t0) & F.lit(t1 > t0))


def span_reach(spans: DataFrame, keys: list[str], width: float = 86400.0) -> DataFrame:
    """keys, row, max_end (furthest end so far), duration, free_after (the next span starts after every end so far)."""
    rows = spans.withColumn("_end", F.greatest("t0", "t1"))
    out = along(rows, keys, width, ("t0", "row"), reach={"_reach": "_end"}, after={"_next": ["t0"]})
    out = out.withColumn("max_end", F.greatest("_end", "_reach"))
    return out.select(*keys, "row", "max_end", F.greatest(F.col("t1") - F.col("t0"), F.lit(0.0)).alias("duration"), F.coalesce(F.col("_next.t0") >= F.col("max_end"), F.lit(True)).alias("free_after"))


def pair_runs(rows: DataFrame, keys: list[str], width: float = 86400.0) -> DataFrame:
    """keys, row, t0, t1, open_left, open_right of rows(keys, row, t, is_start).

    A stop closes the last start before it, the first stop wins. A start without a stop ends at the next row (or at the last
    row of all) and is open to the right; a first stop before any start begins at the row before it (or the first row of all) and is open
    to the left. Rows without a finite time take no part.
    """
    rows = rows.where(F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < math.inf)).withColumn("_start", F.col("is_start").cast("int"))
    x = along(rows, keys, width, sums={"owner": "_start"}, before={"_prv": ["t"]}, after={"_nxt": ["t"]})
    mark = F.struct("t", "row", F.col("_nxt.t").alias("nxt"), F.col("_prv.t").alias("prv"))
    runs = x.groupBy(*keys, "owner").agg(F.min(F.when(F.col("is_start"), mark)).alias("a"), F.min(F.when(~F.col("is_start"), mark)).alias("b"))
    runs = runs.join(rows.groupBy(*keys).agg(F.min("t").alias("t_first"), F.max("t").alias("t_last")), keys)
    paired = runs.where("owner > 0").select(*keys, F.col("a.row").alias("row"), F.col("a.t").alias("t0"), F.coalesce("b.t", "a.nxt", "t_last").alias("t1"), F.lit(False).alias("open_left"), F.col("b").isNull().alias("open_right"))
    loose = runs.where("owner = 0").select(*keys, F.col("b.row").alias("row"), F.coalesce("b.prv", "t_first").alias("t0"), F.col("b.t").alias("t1"), F.lit(True).alias("open_left"), F.lit(False).alias("open_right"))
    return paired.unionByName(loose)


def window_points(points: DataFrame, keys: list[str], t0: float, t1: float, pixels: int) -> DataFrame:
    """The points of [t0, t1] with col and total; where a key has more than pixels of them, the first of each column only."""
    col = F.floor((F.col("t") - t0) * pixels / F.lit(t1 - t0)).cast("long")
    inside = points.where((F.col("t") >= t0) & (F.col("t") <= t1)).withColumn("col", col)
    n = inside.groupBy(*keys).agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy(*keys, "col").orderBy("t", "event_id"))
    return inside.join(n, keys).withColumn("_rank", rank).where((F.col("total") <= pixels) | (F.col("_rank") == 1)).drop("_rank")


def count_columns(points: DataFrame, keys: list[str], t0: float, t1: float, pixels: int) -> DataFrame:
    col = F.least(F.floor((F.col("t") - t0) * pixels / F.lit(t1 - t0)).cast("long"), F.lit(pixels - 1)).alias("col")
    return points.where((F.col("t") >= t0) & (F.col("t") <= t1)).groupBy(*keys, col).agg(F.count("*").alias("n"))


def window_steps(steps: DataFrame, keys: list[str], t0: float, t1: float, t_end: float, width: float = 86400.0) -> DataFrame:
    """keys, row, t0, t1, value: the staircase within [t0, min(t1, t_end)), the row in force at t0 included; nothing where the value is null."""
    after = neighbour(steps, keys, ["t"], "_after", width, forward=True).withColumn("_next", F.coalesce("_after.t", F.lit(t_end)))
    held = after.where((F.col("t") < t1) & (F.col("_next") > t0) & F.col("value").isNotNull())
    return held.select(*keys, "row", F.greatest("t", F.lit(t0)).alias("t0"), F.least("_next", F.lit(t1)).alias("t1"), "value")


def step_envelope(steps: DataFrame, keys: list[str], width: float) -> DataFrame:
    return steps.where("value is not null").groupBy(*keys, F.floor(F.col("t") / width).cast("long").alias("col")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def join_gaps(files: DataFrame, rate: float, tolerance: float = 1.0) -> DataFrame:
    """rec, part, expected_open, seen, suspect of every file but the first of files(rec, part, frames, stamp).

    A stamp may tell when a file was opened or when it was closed; a join is suspect where both readings are over tolerance off. Without a
    first stamp nothing is said (null). Windows hold a row per file of a recording.
    """
    w = Window.partitionBy("rec").orderBy("part")
    end = F.sum("frames").over(w) / rate
    start = (F.sum("frames").over(w) - F.col("frames")) / rate
    first, first_end = F.first("stamp").over(w), F.first("frames").over(w) / rate
    x = files.select("rec", "part", start.alias("expected_open"), (F.col("stamp") - first).alias("seen"), (end - first_end).alias("_closed"))
    suspect = F.least(F.abs(F.col("seen") - F.col("expected_open")), F.abs(F.col("seen") - F.col("_closed"))) > tolerance
    return x.where("part > 0").select("rec", "part", "expected_open", "seen", suspect.alias("suspect"))
