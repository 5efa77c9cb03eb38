"""Grids of windows, frames and tiles: seconds and hertz to whole samples and bins, and times and frequencies to pixels.

All are column expressions; rounding is half to even where a number is rounded to the nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.scalars import fast_fft_size

#: Resolutions that are offered, coarsest first, and the bounds of a window in samples; fixed values.
LADDER = tuple(20000 / 2**i for i in range(3, 20))
LEAST_NFFT, MOST_NFFT = 8, 1 << 20


def _smooth(most: int) -> list[int]:
    """Numbers up to most without a prime factor over 5."""
    out = []
    for a in range(most.bit_length()):
        x = 2**a
        while x <= most:
            y = x
            while y <= most:
                out.append(y)
                y *= 5
            x *= 3
    return sorted(out)


def next_fast(n: Column, most: int = 1 << 20) -> Column:
    """The smallest number of at least n without a prime factor over 5; null beyond most."""
    return F.array_min(F.filter(F.array(*map(F.lit, _smooth(most))), lambda x: x >= n))


def window_nfft(resolution: Column, rate: Column) -> Column:
    return fast_fft_size(rate / resolution)


def windows(recordings: DataFrame) -> DataFrame:
    """rec, resolution, nfft of recordings(rec, rate, frames): the windows on the ladder that are no longer than half the recording."""
    each = recordings.select("rec", "rate", "frames", F.explode(F.array(*map(F.lit, LADDER))).alias("resolution"))
    top = F.least(F.lit(MOST_NFFT), F.coalesce(F.floor(F.col("frames") / 2), F.lit(MOST_NFFT)))
    each = each.withColumn("nfft", window_nfft(F.col("resolution"), F.col("rate")))
    return each.where((F.col("nfft") >= LEAST_NFFT) & (F.col("nfft") <= top)).select("rec", "resolution", "nfft")


def tile_grid(configs: DataFrame) -> DataFrame:
    """configs(rec, rate, window_s, hop_s, tile_s, overlap_s, fmin_hz, fmax_hz) with the grid: nfft, hop, frames, k0, k1, f_low, f_high, tile_len_s, step_s.

    Window and column share their centre, so nfft and hop have the same parity; the bins that hold the band's edges are both kept. A null fmax_hz is
    the Nyquist frequency.
    """
    rate, whole = F.col("rate"), lambda x: F.rint(x).cast("long")
    out = configs.withColumn("nfft", next_fast(F.greatest(whole(F.col("window_s") * rate), F.lit(LEAST_NFFT))).cast("long"))
    out = out.withColumn("hop", F.least(F.greatest(whole(F.col("hop_s") * rate), F.lit(1)), F.col("nfft")))
    out = out.withColumn("hop", F.col("hop") + (F.col("nfft") - F.col("hop")) % 2)
    per_s, df, half = rate / F.col("hop"), rate / F.col("nfft"), F.floor(F.col("nfft") / 2)
    out = out.withColumn("frames", F.greatest(whole(F.col("tile_s") * per_s), F.lit(1)))
    out = out.withColumn("k0", F.least(F.greatest(F.floor(F.col("fmin_hz") / df + 0.5), F.lit(0)), half))
    above = F.least(F.greatest(F.ceil(F.col("fmax_hz") / df - 0.5) + 1, F.col("k0") + 1), half + 1)
    out = out.withColumn("k1", F.when(F.col("fmax_hz").isNull(), half + 1).otherwise(above))
    step = F.greatest(F.col("frames") - whole(F.col("overlap_s") * per_s), F.lit(1))
    return out.withColumns({"f_low": (F.col("k0") - 0.5) * df, "f_high": (F.col("k1") - 0.5) * df, "tile_len_s": F.col("frames") / per_s, "step_s": step / per_s})


def box_pixels(box: tuple[Column, Column, Column, Column], tile: tuple[Column, Column, Column, Column], width: int, height: int) -> Column:
    """Struct x0, y0, x1, y1 of a box (t0, t1, f0, f1) on a tile (t0, t1, f0, f1); y runs against frequency."""
    t0, t1, f0, f1 = box
    a0, a1, b0, b1 = tile
    x, y = (lambda t: (t - a0) / (a1 - a0) * width), (lambda f: (b1 - f) / (b1 - b0) * height)
    return F.struct(x(t0).alias("x0"), y(f1).alias("y0"), x(t1).alias("x1"), y(f0).alias("y1"))


def pixels_box(pixels: Column, tile: tuple[Column, Column, Column, Column], width: int, height: int) -> Column:
    """Struct t0, t1, f0, f1 of a box in pixels (struct x0, y0, x1, y1)."""
    a0, a1, b0, b1 = tile
    t, f = (lambda c: a0 + pixels[c] / width * (a1 - a0)), (lambda c: b1 - pixels[c] / height * (b1 - b0))
    return F.struct(t("x0").alias("t0"), t("x1").alias("t1"), f("y1").alias("f0"), f("y0").alias("f1"))


def recording_grid(rows: DataFrame) -> DataFrame:
    """rows(rate, n_samples, nfft, step, session_s0) with s0 and n_frames: the frames that a run over the whole recording has.

    A session that began at an odd sample (session_s0, null where there is none) keeps its frames, extended over the whole recording.
    """
    out = rows.withColumn("s0", F.coalesce(F.pmod("session_s0", "step"), F.lit(0)).cast("long"))
    left = F.col("n_samples") - F.col("s0") - F.col("nfft")
    return out.withColumn("n_frames", F.when(left < 0, 0).otherwise(F.floor(left / F.col("step")) + 1).cast("long"))


def clamp_range(start: Column, stop: Column, duration: Column) -> Column:
    """Struct t0, t1, whole, wrong: a range kept within a recording; t1 is null to the end, whole where all is meant, wrong where nothing is left."""
    t0 = F.greatest(F.coalesce(start, F.lit(0.0)), F.lit(0.0))
    known = F.coalesce(duration > 0, F.lit(False))
    low = F.greatest(stop, F.lit(0.0))
    t1 = F.when(stop.isNotNull() & ~(known & (low >= duration)), low)
    wrong = (known & (t0 >= duration)) | F.coalesce(t1 <= t0, F.lit(False))
    return F.struct(t0.alias("t0"), t1.alias("t1"), ((t0 <= 0) & t1.isNull()).alias("whole"), wrong.alias("wrong"))


def detect_window(rows: DataFrame) -> DataFrame:
    """rows(rate, nfft, step, s0, n_frames, t0, t1) with k0, k1 (frames whose centre is in the range), start_s and duration_s of the samples they need.

    Both times null: all frames. duration_s is null to the end of the recording. Fewer than two frames are no window: all four are null.
    """
    place = lambda t: (t * F.col("rate") - F.col("nfft") / 2 - F.col("s0")) / F.col("step")
    n = F.col("n_frames")
    inside = lambda k: F.least(F.greatest(k, F.lit(0)), n).cast("long")
    out = rows.withColumn("k0", inside(F.ceil(place(F.coalesce("t0", F.lit(0.0)))))).withColumn("k1", F.when(F.col("t1").isNull(), n).otherwise(inside(F.floor(place(F.col("t1"))) + 1)))
    out = out.withColumn("_fine", F.col("k1") - F.col("k0") >= 2)
    start = (F.col("s0") + F.col("k0") * F.col("step")) / F.col("rate")
    length = ((F.col("k1") - F.col("k0") - 1) * F.col("step") + F.col("nfft")) / F.col("rate")
    fine = lambda c: F.when(F.col("_fine"), c)
    return out.withColumns({"start_s": fine(start), "duration_s": fine(F.when(F.col("k1") < n, length)), "k0": fine(F.col("k0")), "k1": fine(F.col("k1"))}).drop("_fine")


def range_of_grid(rows: DataFrame) -> DataFrame:
    """rows(rate, nfft, step, s0, n_frames, whole_s0, whole_step, whole_frames) with t0, t1 of the range that results cover, null where it is all of the recording.

    t0 is 0 from the first frame on, t1 null to the last one.
    """
    centre = lambda s0, step, k: (F.col(s0) + k * F.col(step) + F.col("nfft") / 2) / F.col("rate")
    first, last = centre("s0", "step", F.lit(0)), centre("s0", "step", F.col("n_frames") - 1)
    at_start = first <= centre("whole_s0", "whole_step", F.lit(0)) + 0.5 / F.col("rate")
    at_end = last >= centre("whole_s0", "whole_step", F.col("whole_frames") - 1) - 0.5 / F.col("rate")
    some = (F.col("n_frames") > 0) & (F.col("step") == F.col("whole_step")) & (F.col("whole_frames") > 0) & ~(at_start & at_end)
    return rows.withColumns({"t0": F.when(some, F.when(at_start, 0.0).otherwise(first)), "t1": F.when(some & ~at_end, last)})
