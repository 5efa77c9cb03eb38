"""A store of overviews that is brought up to date by what has changed: one version a set of files, published by one pointer.

Below a folder: data/<run> holds rows, manifests/<run> says which run holds what of which version of a recording, and CURRENT names
the manifest that counts. A refresh computes what no manifest entry holds, writes it beside the rest and turns the pointer last; a reader
sees the old state or the new one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.sources.bundles import file_set_key
from fieldscope.sources.sinks import write_files

POINTER = "CURRENT"
MANIFEST = "recording_id string, key string, level int, step long, bins long, channels long, run string"


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """recording_id, key, level, step, bins (of its longest channel), channels, run of all that the store holds now."""
    try:
        rows = spark.read.text(f"{store}/{POINTER}").collect()
    except AnalysisException:
        rows = []
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifests/{rows[0].value}") if rows else spark.createDataFrame([], MANIFEST)


def stale_recordings(spark: SparkSession, store: str, files: DataFrame, levels: int, channels: DataFrame) -> DataFrame:
    """recording_id, key of the recordings in files(recording_id, path, frames) of which the store lacks a level or a channel for the files that there are now.

    channels(recording_id, channels): how many channels a recording has.
    """
    have = manifest(spark, store).join(channels.select("recording_id", F.col("channels").alias("_all")), "recording_id").where("channels = _all")
    whole = have.groupBy("recording_id", "key").agg(F.count_distinct("level").alias("_n")).where(F.col("_n") >= levels)
    return file_set_key(files).join(whole, ["recording_id", "key"], "left_anti")


def refresh(spark: SparkSession, store: str, files: DataFrame, channels: DataFrame, levels: int, compute: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Brings the store up to date and returns the recordings that were computed anew, and no others.

    compute gets a table of their ids and returns recording_id, channel, level, step, bin, minimum, maximum. Recordings that files does not name any
    longer, and older versions, leave the manifest; their rows stay in data until that is cleared.
    """
    stale = stale_recordings(spark, store, files, levels, channels)
    ids = sorted(r.recording_id for r in stale.select("recording_id").collect())  # a row a recording
    old, run = manifest(spark, store), uuid.uuid4().hex
    kept = old.join(file_set_key(files), ["recording_id", "key"], "left_semi").join(stale.select("recording_id"), "recording_id", "left_anti")
    entries = kept.select(*(c.split(" ")[0] for c in MANIFEST.split(", ")))
    if ids:
        asked = spark.createDataFrame([(i,) for i in ids], "recording_id string")
        compute(asked).join(F.broadcast(stale), "recording_id").write.partitionBy("level").parquet(f"{store}/data/{run}")
        made = spark.read.parquet(f"{store}/data/{run}")
        per_channel = made.groupBy("recording_id", "key", "level", "step", "channel").agg(F.count("*").alias("_n"))
        held = per_channel.groupBy("recording_id", "key", "level", "step").agg(F.max("_n").alias("bins"), F.count("*").alias("channels"))
        entries = entries.unionByName(held.select("recording_id", "key", F.col("level").cast("int").alias("level"), "step", "bins", "channels", F.lit(run).alias("run")))
    elif old.count() == kept.count():
        return []
    entries.coalesce(1).write.parquet(f"{store}/manifests/{run}")
    write_files(spark.createDataFrame([(POINTER, run.encode())], "name string, content binary"), store)
    return ids


def serve(spark: SparkSession, store: str, files: DataFrame, least_bins: int) -> DataFrame:
    """recording_id, channel, level, step, bin, minimum, maximum of each recording's coarsest level of least_bins bins at least, for the files there are now.

    Only the runs and levels that hold them are read. A recording without a level that is fine enough has no row: it is to be computed.
    """
    held = manifest(spark, store).join(file_set_key(files), ["recording_id", "key"], "left_semi").where(F.col("bins") >= least_bins)
    best = held.groupBy("recording_id", "key").agg(F.max_by(F.struct("level", "run"), "step").alias("m")).select("recording_id", "key", F.col("m.level").alias("level"), "m.run")
    runs = [(r.run, r.levels) for r in best.groupBy("run").agg(F.collect_set("level").alias("levels")).collect()]
    out = None
    for run, levels in runs:
        part = spark.read.parquet(f"{store}/data/{run}").where(F.col("level").isin(levels))
        part = part.join(F.broadcast(best.where(F.col("run") == run).drop("run")), ["recording_id", "key", "level"]).select("recording_id", "channel", F.col("level").cast("int").alias("level"), "step", "bin", "minimum", "maximum")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "recording_id string, channel int, level int, step long, bin long, minimum double, maximum double") if out is None else out
