"""Settings that follow from data: grids for examples and views, training lengths, windows of a cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.operators.quantiles import exact_quantiles
from fieldscope.operators.tracks import Keys, concurrent_ids

#: Pixels of a typical event on a tile, windows along an event without a band, balance of a window's two resolutions, widths of the band kept
#: beside it, lengths of the longest event that tiles share, and samples that a window has at least; fixed values.
EVENT_PIXELS, WINDOWS_PER_EVENT, BALANCE, BAND_MARGIN, OVERLAP_EVENTS, LEAST_WINDOW = 27.0, 8.0, 3.0, 3.0, 2.0, 8.0
#: Batches of a training, and the fewest and most epochs; fixed values.
TRAIN_STEPS, EPOCHS = 400, (30, 200)
#: Minutes of a cleanup's windows and of its tolerance, and the part that windows overlap; fixed values.
STRIDE_MIN, TOLERANCE_MIN, OVERLAP = 10.0, 5.0, 0.2


def suggest_config(boxes: DataFrame, recordings: DataFrame, keys: list[str], image_size: int = 640) -> DataFrame:
    """keys, window_s, hop_s, tile_s, overlap_s, fmin_hz, fmax_hz, reduction for the examples boxes(keys, t0, t1, f0, f1) of recordings(keys, rate, channels).

    Examples without a length say nothing of time; without a band (null) nothing of frequency. fmax_hz is null up to the top. A key whose
    examples all have no length has no row.
    """
    long = boxes.withColumn("_d", F.col("t1") - F.col("t0"))
    typical = exact_quantiles(long, keys, F.when(F.col("_d") > 0, F.col("_d")), [0.5]).select(*keys, F.col("quantiles")[0].alias("_typical"))
    banded = long.where("f0 is not null and f1 is not null").withColumn("_w", F.col("f1") - F.col("f0"))
    width = exact_quantiles(banded, keys, "_w", [0.5]).select(*keys, F.col("quantiles")[0].alias("_width"))
    ends = long.groupBy(*keys).agg(F.max("_d").alias("_longest"))
    band = banded.groupBy(*keys).agg(F.min("f0").alias("_low"), F.max("f1").alias("_high"))
    x = recordings.join(typical, keys).join(ends, keys).join(band, keys, "left").join(width, keys, "left")
    tile = F.greatest(F.col("_typical") * image_size / EVENT_PIXELS, F.col("_longest") * 4.0)
    x = x.withColumn("tile_s", tile).withColumn("_banded", F.coalesce(F.col("_high") > F.col("_low"), F.lit(False)))
    top = F.col("_high") + BAND_MARGIN * F.col("_width")
    window = F.when(F.col("_banded") & (F.col("_width") > 0), BALANCE * F.sqrt(F.col("_typical") / F.col("_width"))).otherwise(F.col("_typical") / WINDOWS_PER_EVENT)
    return x.select(
        *keys, F.greatest(window, LEAST_WINDOW / F.col("rate")).alias("window_s"), F.greatest(F.col("tile_s") / image_size, 1.0 / F.col("rate")).alias("hop_s"), "tile_s",
        F.least(F.greatest(F.col("_longest") * OVERLAP_EVENTS, F.col("tile_s") * 0.1), F.col("tile_s") * 0.5).alias("overlap_s"),
        F.when(F.col("_banded"), F.greatest(F.col("_low") - BAND_MARGIN * F.col("_width"), F.lit(0.0))).otherwise(0.0).alias("fmin_hz"),
        F.when(F.col("_banded") & (top < F.col("rate") / 2), top).alias("fmax_hz"), F.when(F.col("channels") > 1, "max").otherwise("0").alias("reduction"),
    )


def view_config(t0: Column, t1: Column, f0: Column, f1: Column, rate: Column, size: int) -> Column:
    """Struct window_s, hop_s, tile_s, fmin_hz, fmax_hz, s0: a grid that draws just a rectangle, a pixel worth the same in time and frequency."""
    dt = F.greatest(t1, t0 + 1.0 / rate) - t0
    window = F.least(F.greatest(F.sqrt(dt / F.greatest(f1 - f0, F.lit(1e-6))), 16.0 / rate), F.lit(1.0))
    hop = F.least(F.greatest(dt / size, 1.0 / rate), window)
    return F.struct(window.alias("window_s"), hop.alias("hop_s"), dt.alias("tile_s"), F.greatest(f0, F.lit(0.0)).alias("fmin_hz"), F.when(f1 < rate / 2, f1).alias("fmax_hz"), F.rint(t0 * rate).cast("long").alias("s0"))


def epochs_for(tiles: Column, batch: Column) -> Column:
    """How many epochs make TRAIN_STEPS batches, within EPOCHS; an epoch has one batch at least."""
    each = F.greatest(tiles / F.greatest(batch, F.lit(1)), F.lit(1.0))
    return F.least(F.greatest(F.ceil(TRAIN_STEPS / each), F.lit(EPOCHS[0])), F.lit(EPOCHS[1])).cast("int")


def cleanup_setup(rows: DataFrame, keys: Keys = ()) -> DataFrame:
    """keys, k0, k1 (exclusive), span_s, ids, stride_min, tolerance_min, reason of a cleanup of the tracks rows(ident, k, t); reason tells why there can be none.

    A session without detections has no row.
    """
    ends = rows.groupBy(*keys).agg(F.min("k").alias("k0"), (F.max("k") + 1).alias("k1"), (F.max_by("t", "k") - F.min_by("t", "k")).alias("span_s"))
    ids = concurrent_ids(rows, keys)
    x = ends.join(ids, list(keys), "left") if keys else ends.join(ids, how="left")
    x = x.withColumn("ids", F.coalesce("ids", F.lit(0).cast("long"))).withColumn("_stride", F.least(F.lit(STRIDE_MIN * 60), F.col("span_s")))
    reason = F.when(F.col("ids") == 0, "no detection has an id").when(F.floor(F.col("_stride") * (1 - OVERLAP)) < 1, "the tracks are too short for a cleanup's windows")
    return x.select(*keys, "k0", "k1", "span_s", "ids", (F.col("_stride") / 60).alias("stride_min"), (F.least(F.lit(TOLERANCE_MIN * 60), F.col("_stride") / 2) / 60).alias("tolerance_min"), reason.alias("reason"))
