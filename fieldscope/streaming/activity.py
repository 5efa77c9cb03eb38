"""Streaming forms of the additive statistics: additions, the batch operators being the reference for their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bin_stats(samples: DataFrame, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """keys, window, n, total, total_sq, minimum, maximum of a stream samples(keys, ts, value); rows later than late are dropped by the watermark."""
    v = F.col("value")
    return samples.withWatermark("ts", late).groupBy(*keys, F.window("ts", width)).agg(
        F.count("value").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("total_sq"), F.min(v).alias("minimum"), F.max(v).alias("maximum")
    )


def stream_runs(rows: DataFrame, keys: list[str], gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """keys, t0, t1, n of runs of a stream rows(keys, ts): session windows that end after a gap."""
    w = F.session_window("ts", gap)
    return rows.withWatermark("ts", late).groupBy(*keys, w.alias("run")).agg(F.count("*").alias("n")).select(*keys, F.col("run.start").alias("t0"), F.col("run.end").alias("t1"), "n")
