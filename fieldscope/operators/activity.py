"""Additive bin statistics, baseline-referenced activity and min/max levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.operators.quantiles import exact_quantiles
from fieldscope.sources.tables import written


def bin_stats(samples: DataFrame, step: int, keys: list[str] | None = None) -> DataFrame:
    """keys, bin, n, total, total_sq, minimum, maximum of samples(keys, frame, value) in bins of step frames; a short last bin keeps its n."""
    keys = keys or ["recording_id", "channel"]
    at = F.floor(F.col("frame") / step).cast("long").alias("bin")
    v = F.col("value")
    return samples.groupBy(*keys, at).agg(F.count("value").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("total_sq"), F.min(v).alias("minimum"), F.max(v).alias("maximum"))


def combine(stats: DataFrame, factor: int, keys: list[str]) -> DataFrame:
    """The coarser level of factor bins; a trailing group of fewer is dropped."""
    out = stats.groupBy(*keys, F.floor(F.col("bin") / factor).cast("long").alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("total_sq").alias("total_sq"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.count("*").alias("_bins")
    )
    return out.where(F.col("_bins") == factor).drop("_bins")


def bin_mean() -> Column:
    return F.col("total") / F.col("n")


def bin_variance() -> Column:
    return F.greatest(F.col("total_sq") / F.col("n") - bin_mean() * bin_mean(), F.lit(0.0))


def bin_peak() -> Column:
    return F.greatest(F.abs(F.col("maximum") - bin_mean()), F.abs(F.col("minimum") - bin_mean()))


def global_baseline(stats: DataFrame, keys: list[str], percent: float = 10.0) -> DataFrame:
    """keys, sigma: the percentile of the bins' RMS about their mean, at least 1e-12."""
    found = exact_quantiles(stats, keys, F.sqrt(bin_variance()), [percent / 100])
    return found.select(*keys, F.greatest(F.col("quantiles")[0], F.lit(1e-12)).alias("sigma"))


def noise_peak_db(n: Column) -> Column:
    """The peak that n samples of Gaussian noise are expected to have, in dB over sigma."""
    return 20 * F.log10(F.sqrt(2 * F.log(F.greatest(n, F.lit(2)).cast("double"))))


def activity(stats: DataFrame, keys: list[str], margin_db: float = 6.0, percent: float = 10.0) -> DataFrame:
    """stats with rms_excess_db, peak_excess_db, crest_db and class (quiet, sustained or transient).

    A bin is active if its peak is margin_db over the noise's own; an active bin whose crest is under that floor is sustained.
    """
    stats = written(stats, "bin-stats")
    sigma = global_baseline(stats, keys, percent).select(*(F.col(k).alias(f"_{k}") for k in keys), "sigma")
    on = F.col(keys[0]) == F.col(f"_{keys[0]}")
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"_{k}"))
    out = stats.join(sigma, on).drop(*(f"_{k}" for k in keys))
    out = out.withColumn("rms_excess_db", 10 * F.log10(F.greatest(bin_variance() / (F.col("sigma") * F.col("sigma")), F.lit(1.0))))
    out = out.withColumn("peak_excess_db", 20 * F.log10(F.greatest(bin_peak() / F.col("sigma"), F.lit(1.0))))
    out = out.withColumn("crest_db", F.col("peak_excess_db") - F.col("rms_excess_db"))
    floor = noise_peak_db(F.col("n"))
    kind = F.when(F.col("peak_excess_db") < floor + margin_db, "quiet").when(F.col("crest_db") < floor, "sustained").otherwise("transient")
    return out.withColumn("class", kind)


def minmax_levels(samples: DataFrame, keys: list[str], base: int = 32, levels: int = 4) -> DataFrame:
    """keys, level, step, bin, minimum, maximum at steps base * 2**level; each level from the one below."""
    step = samples.groupBy(*keys, F.floor(F.col("frame") / base).cast("long").alias("bin")).agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    # a bin of a level is known from the finest bin, so all levels come from one scan of it
    shifts = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    rows = step.select(*keys, shifts.alias("level"), "bin", "minimum", "maximum").withColumn("bin", F.expr("shiftright(bin, level)"))
    out = rows.groupBy(*keys, "level", "bin").agg(F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"))
    return out.withColumn("step", (F.lit(base) * F.pow(F.lit(2.0), F.col("level"))).cast("long"))


def level_for(step: float, base: int = 32, levels: int = 4) -> int | None:
    """The coarsest level whose step is no larger than wanted; None where even the finest is."""
    fits = [k for k in range(levels) if base * 2**k <= step]
    return max(fits, default=None)


def amplitude_range(samples: DataFrame, keys: list[str], t0: float, t1: float, headroom: float = 0.08, limit: float = math.inf) -> DataFrame:
    """Lowest and highest value from t0 to t1, widened by headroom of their distance and kept within limit."""
    lo_hi = samples.where((F.col("t") >= t0) & (F.col("t") <= t1)).groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    more = (F.col("hi") - F.col("lo")) * headroom
    return lo_hi.select(*keys, F.greatest(F.col("lo") - more, F.lit(-limit)).alias("lo"), F.least(F.col("hi") + more, F.lit(limit)).alias("hi"))


def region_statistics(regions: DataFrame, samples: DataFrame, keys: list[str], width: float) -> DataFrame:
    """keys, region, t0, t1, duration, n, mean, std (population) of the samples in each closed region."""
    from fieldscope.operators.joins import points_in_spans

    pairs = points_in_spans(samples.select(*keys, "t", "value"), regions.select(*keys, "region", "t0", "t1"), keys, width, closed=True)
    return pairs.groupBy(*keys, "region", "t0", "t1").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).withColumn("duration", F.col("t1") - F.col("t0"))
