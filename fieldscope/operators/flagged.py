"""Runs of samples for which something holds, as spans of frames: found in blocks, joined across their borders, and worked on as intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.operators.joins import merge_spans, points_in_spans
from fieldscope.operators.signals import KEYS

#: Frames of a bucket in which runs are joined along a channel.
WIDTH = float(1 << 20)


def joined_runs(spans: DataFrame, width: float = WIDTH) -> DataFrame:
    """recording_id, channel, a, z (exclusive) of spans of frames, those that touch or overlap as one."""
    rows = spans.select(*KEYS, F.col("a").alias("row"), F.col("a").cast("double").alias("t0"), F.col("z").cast("double").alias("t1"))
    return merge_spans(rows, KEYS, 0.0, width).select(*KEYS, F.col("t0").cast("long").alias("a"), F.col("t1").cast("long").alias("z"))


def flag_runs(blocks: DataFrame, holds: Callable[[Column], Column], width: float = WIDTH) -> DataFrame:
    """recording_id, channel, a, z (exclusive): the longest runs of frames whose samples holds is true of; null and false end a run.

    Each block gives the runs inside it, a row a run; what touches at a border is joined after, so the result does not depend on the blocks.
    """
    flags = F.transform("samples", lambda x: F.coalesce(holds(x), F.lit(False)))
    n = F.size("_f")
    places = F.sequence(F.lit(0), n)  # one past the end, where every run is over
    edge = lambda now, before: F.filter(places, lambda i: now(i) & ~before(i))
    here = lambda i: F.when(i < n, F.get("_f", i)).otherwise(F.lit(False))
    there = lambda i: F.when(i > 0, F.get("_f", i - 1)).otherwise(F.lit(False))
    found = blocks.withColumn("_f", flags).where(F.size("samples") > 0).select(*KEYS, "start_frame", F.arrays_zip(edge(here, there).alias("a"), edge(there, here).alias("z")).alias("_r"))
    each = found.select(*KEYS, "start_frame", F.explode("_r").alias("r"))
    return joined_runs(each.select(*KEYS, (F.col("start_frame") + F.col("r.a")).alias("a"), (F.col("start_frame") + F.col("r.z")).alias("z")), width)


def long_runs(runs: DataFrame, length: int) -> DataFrame:
    """The runs of length frames at least."""
    return runs.where(F.col("z") - F.col("a") >= length)


def short_runs(runs: DataFrame, length: int) -> DataFrame:
    """The runs of under length frames."""
    return runs.where(F.col("z") - F.col("a") < length)


def runs_holding(runs: DataFrame, seeds: DataFrame, width: float = WIDTH) -> DataFrame:
    """The runs that share a frame with one of seeds (hysteresis: what rises above the higher of two levels lasts as long as it stays above the lower)."""
    body = runs.select(*KEYS, "a", "z", F.col("a").cast("double").alias("t0"), F.col("z").cast("double").alias("t1"))
    # a seed that begins before a run holds its first frame, so one of both beginnings lies in the other
    begins = seeds.select(*KEYS, F.col("a").cast("double").alias("t"))
    inside = points_in_spans(begins, body, KEYS, width).select(*KEYS, "a", "z")
    around = points_in_spans(runs.select(*KEYS, "a", "z", F.col("a").cast("double").alias("t")), seeds.select(*KEYS, F.col("a").cast("double").alias("t0"), F.col("z").cast("double").alias("t1")), KEYS, width).select(*KEYS, "a", "z")
    return runs.join(inside.unionByName(around).distinct(), [*KEYS, "a", "z"], "left_semi")


def dilated(runs: DataFrame, guard: int, lengths: DataFrame, width: float = WIDTH) -> DataFrame:
    """The runs widened by guard frames on both sides, within 0 and n of lengths(recording_id, n), those that meet as one."""
    wide = runs.join(lengths, "recording_id").select(*KEYS, F.greatest(F.col("a") - guard, F.lit(0)).alias("a"), F.least(F.col("z") + guard, F.col("n")).alias("z"))
    return joined_runs(wide, width)
