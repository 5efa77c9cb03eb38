"""What a cursor on drawn traces points at: extremes of a cell of samples, the nearest trace, and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_extremes(blocks: DataFrame, cells: DataFrame, length: int) -> DataFrame:
    """q, channel, k_low, low, k_high, high: the smallest and largest sample of frames i0 to i1 (exclusive) of cells(q, recording_id, i0, i1), the first of equals.

    blocks are of length frames; a cell meets the blocks that it lies in, and only slices of them are looked at.
    """
    each = cells.where("i1 > i0").select("q", "recording_id", "i0", "i1", F.explode(F.sequence(F.floor(F.col("i0") / length), F.floor((F.col("i1") - 1) / length))).alias("block"))
    met = each.join(blocks.select("recording_id", "channel", "block", "start_frame", "samples"), ["recording_id", "block"])
    lo = F.greatest(F.col("i0") - F.col("start_frame"), F.lit(0))
    hi = F.least(F.col("i1") - F.col("start_frame"), F.size("samples").cast("long"))
    part = met.where(hi > lo).select("q", "channel", (F.col("start_frame") + lo).alias("_at"), F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("_x"))
    place = lambda value: F.col("_at") + F.array_position("_x", value) - 1
    ends = part.withColumns({"_low": F.array_min("_x"), "_high": F.array_max("_x")})
    best = ends.groupBy("q", "channel").agg(F.min(F.struct(F.col("_low").alias("v"), place(F.col("_low")).alias("k"))).alias("a"), F.max(F.struct(F.col("_high").alias("v"), (-place(F.col("_high"))).alias("k"))).alias("b"))
    return best.select("q", "channel", F.col("a.k").alias("k_low"), F.col("a.v").alias("low"), (-F.col("b.k")).alias("k_high"), F.col("b.v").alias("high"))


def recording_lengths(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("recording_id").agg(F.max(F.col("start_frame") + F.size("samples")).alias("n"))


def nearest_trace(blocks: DataFrame, pointers: DataFrame, rate: float, step: int, length: int) -> DataFrame:
    """q, channel, distance: the trace drawn nearest y of pointers(q, recording_id, x, y), x in seconds, where step samples are drawn as one cell.

    A cell is drawn from its smallest to its largest sample, of which the one nearer y counts. Of channels as near the first; no row off the recording.
    """
    i0 = F.rint(F.col("x") * rate).cast("long")
    cells = pointers.withColumn("i0", F.floor(i0 / step) * step if step > 1 else i0).join(recording_lengths(blocks), "recording_id").where("i0 >= 0 and i0 < n")
    cells = cells.withColumn("i1", F.least(F.col("i0") + max(step, 1), F.col("n")))
    away = F.least(F.abs(F.col("low") - F.col("y")), F.abs(F.col("high") - F.col("y")))
    each = cell_extremes(blocks, cells, length).join(pointers.select("q", "y"), "q").withColumn("_d", away)
    return each.groupBy("q").agg(F.min(F.struct("_d", "channel")).alias("m")).select("q", "m.channel", F.col("m._d").alias("distance"))


def snap_markers(blocks: DataFrame, pointers: DataFrame, rate: float, length: int) -> DataFrame:
    """q, channel, t, value: where a marker at pointers(q, recording_id, x, dx, y) snaps to on each channel, and nearest: whether it is the channel nearest y.

    The cell goes from x to x + dx seconds, one sample at least, and past the end of a recording to its last one. At the middle of its extremes and
    above a marker goes to the largest, else to the smallest.
    """
    cells = pointers.join(recording_lengths(blocks), "recording_id").withColumn("_a", F.greatest(F.rint(F.col("x") * rate).cast("long"), F.lit(0)))
    cells = cells.withColumn("_z", F.least(F.greatest(F.rint((F.col("x") + F.col("dx")) * rate).cast("long"), F.col("_a") + 1), F.col("n")))
    cells = cells.withColumn("i0", F.when(F.col("_z") <= F.col("_a"), F.greatest(F.col("_z") - 1, F.lit(0))).otherwise(F.col("_a"))).withColumn("i1", F.greatest(F.col("_z"), F.col("i0") + 1))
    each = cell_extremes(blocks, cells, length).join(pointers.select("q", "y"), "q")
    up = F.col("y") >= (F.col("low") + F.col("high")) / 2
    out = each.select("q", "channel", "y", (F.when(up, F.col("k_high")).otherwise(F.col("k_low")) / rate).alias("t"), F.when(up, F.col("high")).otherwise(F.col("low")).alias("value"))
    best = out.groupBy("q").agg(F.min(F.struct(F.abs(F.col("value") - F.col("y")), "channel")).alias("m")).select("q", F.col("m.channel").alias("_best"))
    return out.join(best, "q").select("q", "channel", "t", "value", (F.col("channel") == F.col("_best")).alias("nearest"))


def marker_delta(markers: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """markers(keys, t, value) with dt and dv: how far each is from the stored(keys, t, value) one; null where none is stored."""
    other = stored.select(*keys, F.col("t").alias("_t"), F.col("value").alias("_v"))
    return markers.join(other, keys, "left").withColumns({"dt": F.col("t") - F.col("_t"), "dv": F.col("value") - F.col("_v")}).drop("_t", "_v")
