"""Queries over files that are written from the given tables and read back: recordings, their regions, and label files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldscope.operators.signals import to_blocks
from fieldscope.plans.registry import ev_labels, query
from fieldscope.sources import recordings, sessions, writers
from fieldscope.sources.tables import shared_folder, told_path, written

_LENGTH, _RATE = 48, 64.0


def _label_recordings(spark, sf_dir):
    """Blocks of one recording a label of the embeddings, their vectors one after the other; channel 1 is channel 0 reversed in sign."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null").select(F.concat(F.lit("label-"), F.col("label").cast("string")).alias("recording_id"), F.col("vec_id").alias("k"), "embedding")
    n = e.groupBy("recording_id", F.floor(F.col("k") / 256).alias("_b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("recording_id").orderBy("_b")  # a row for each 256 ids
    before = n.select("recording_id", "_b", (F.sum("n").over(w) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("recording_id", "_b").orderBy("k"))
    at = e.withColumn("_b", F.floor(F.col("k") / 256)).withColumn("_i", inner).join(before, ["recording_id", "_b"]).select("recording_id", (F.col("before") + F.col("_i") - 1).alias("place"), F.posexplode("embedding").alias("i", "x"))
    rows = at.select("recording_id", F.explode(F.array(F.struct(F.lit(0).alias("channel"), F.col("x").cast("double").alias("value")), F.struct(F.lit(1).alias("channel"), (-F.col("x")).cast("double").alias("value")))).alias("c"), (F.col("place") * 64 + F.col("i")).alias("frame"))
    return to_blocks(rows.select("recording_id", "c.channel", "frame", "c.value"), 256)


_REC = """rec AS (SELECT 'label-' || label AS recording_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 + unnest(generate_series(0, 63)) AS frame, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL),
pcm AS (SELECT recording_id, frame, round_even(x * 2147483648, 0) / 2147483648::DOUBLE AS x FROM rec)"""


def _files(spark, sf_dir) -> tuple[dict[str, list[str]], object]:
    """The files of each recording, two of half the length that all have, below the shared folder; and that length."""
    blocks = written(_label_recordings(spark, sf_dir), "recording-blocks")
    least = blocks.groupBy("recording_id", "channel").agg(F.sum(F.size("samples")).alias("n")).agg(F.min("n")).first()[0]
    folder = told_path(f"{shared_folder(spark)}/recordings-{uuid.uuid4().hex}")
    parts = []
    for i, first in enumerate((0, least // 2)):  # two files a recording, each one job over all recordings
        recordings.export_spans(blocks, f"{folder}/{i}", first, (least // 2, least)[i], _RATE)
        parts.append(f"{folder}/{i}")
    names = [r.recording_id for r in blocks.select("recording_id").distinct().collect()]
    return {n: [f"{p}/{n}.wav" for p in parts] for n in names}, least


_LEAST = ", least AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM rec GROUP BY recording_id))"


@query(f"WITH {_REC}{_LEAST} SELECT recording_id, channel, frame, CASE channel WHEN 0 THEN x ELSE -x END AS value FROM pcm, least, (VALUES (0), (1)) c(channel) WHERE frame < least")
def recording_files(spark, sf_dir):
    """Every sample of recordings that were written as two WAV files each and read back as one; blocks cross the join."""
    files, _ = _files(spark, sf_dir)
    blocks = recordings.read_recordings(spark, files, _LENGTH)
    return blocks.select("recording_id", "channel", "start_frame", F.posexplode("samples").alias("i", "value")).select("recording_id", "channel", (F.col("start_frame") + F.col("i")).alias("frame"), "value")


@query(f"WITH {_REC}{_LEAST} SELECT recording_id, frame, -x AS value FROM pcm, least WHERE frame BETWEEN CAST(floor((least / 128 - 1.5) * 64) AS BIGINT) AND CAST(floor((least / 128 + 2.25) * 64) AS BIGINT) AND frame < least")
def recording_regions(spark, sf_dir):
    """Some seconds about the join of the two files, one channel."""
    files, least = _files(spark, sf_dir)
    middle = least / 128
    region = recordings.read_region(recordings.read_recordings(spark, files, _LENGTH), _LENGTH, _RATE, middle - 1.5, middle + 2.25, 1)
    return region.select("recording_id", F.posexplode("samples").alias("i", "value"), "start_frame").select("recording_id", (F.col("start_frame") + F.col("i")).alias("frame"), "value")


@query(f"WITH {_REC}{_LEAST} SELECT DISTINCT recording_id, part, least // 2 + part * (least % 2) AS frames, 2 AS channels, 64.0::DOUBLE AS rate FROM rec, least, (VALUES (0), (1)) p(part)")
def recording_frames(spark, sf_dir):
    """Frames, channels and rate of the files, from their headers."""
    files, _ = _files(spark, sf_dir)
    of = spark.createDataFrame([(p, r, i) for r, paths in files.items() for i, p in enumerate(paths)], "path string, recording_id string, part_no int")  # a row a file
    heads = recordings.file_frames(spark, [p for paths in files.values() for p in paths])
    return heads.join(of, "path").select("recording_id", F.col("part_no").alias("part"), "frames", "channels", "rate")


@query("""SELECT 'ch-' || coalesce(channel::VARCHAR, 'none') AS recording_id, category, CASE WHEN kind = 'span' AND t1 IS NOT NULL THEN 'span' ELSE 'point' END AS kind, channel, printf('%.6f', t0)::DOUBLE AS t0,
CASE WHEN kind = 'span' THEN printf('%.6f', t1)::DOUBLE END AS t1, printf('%.3f', f0)::DOUBLE AS f0, printf('%.3f', f1)::DOUBLE AS f1, 'no, "' || label_id || '"' AS note FROM lab WHERE category <> 'view'""", "ev labels")
def label_files(spark, sf_dir):
    """All labels but those of a transient category, written as a label file for each channel and read back."""
    name = F.concat(F.lit("ch-"), F.coalesce(F.col("channel").cast("string"), F.lit("none")))
    labels = ev_labels(spark, sf_dir).withColumns({"recording_id": name, "note": F.concat(F.lit('no, "'), F.col("label_id").cast("string"), F.lit('"')), "outline": F.lit(None).cast("array<struct<t:double,f:double>>")})
    folder = told_path(f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}")
    recordings_of = [f"ch-{c}" for c in (*range(16), "none", "empty")]
    writers.write_labels(labels, folder, recordings_of, ["view"])
    back, _ = sessions.read_labels(spark, folder)
    return back.select(name.alias("recording_id"), "category", "kind", "channel", "t0", "t1", "f0", "f1", "note")


_LEVELS = """em AS (SELECT vec_id // 100 AS r, vec_id % 100 AS channel, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id IS NOT NULL),
lv AS (SELECT r, channel, level, 4 * pow(2, level)::BIGINT AS step, i // (4 * pow(2, level)::BIGINT) AS bin, min(x) AS minimum, max(x) AS maximum FROM em, (SELECT unnest(range(4)) AS level) GROUP BY ALL)"""


@query(f"WITH {_LEVELS} SELECT 'rec-' || r AS recording_id, channel, level, step, bin, minimum, maximum FROM lv WHERE level = 2")
def stored_overviews(spark, sf_dir):
    """Overviews of a hundred embeddings a recording: a store of half of them, then of all with one file changed; the coarsest level of four bins is served."""
    from fieldscope.operators.activity import minmax_levels
    from fieldscope.sources import overviews

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null")
    name = F.concat(F.lit("rec-"), F.floor(F.col("vec_id") / 100).cast("string"))
    samples = e.select(name.alias("recording_id"), (F.col("vec_id") % 100).cast("int").alias("channel"), F.posexplode("embedding").alias("frame", "value")).withColumn("value", F.col("value").cast("double"))
    channels = samples.groupBy("recording_id").agg(F.count_distinct("channel").alias("channels"))
    files = channels.select("recording_id", F.concat("recording_id", F.lit(".wav")).alias("path"), F.lit(64).cast("long").alias("frames"))
    store = told_path(f"{shared_folder(spark)}/overviews-{uuid.uuid4().hex}")
    compute = lambda ids: minmax_levels(samples.join(ids, "recording_id", "left_semi"), ["recording_id", "channel"], 4, 4)
    half = files.where(F.pmod(F.xxhash64("recording_id"), F.lit(2)) == 0)
    overviews.refresh(spark, store, half, channels, 4, compute)
    longer = files.withColumn("frames", F.when(F.col("recording_id") == "rec-1", F.lit(65).cast("long")).otherwise(F.col("frames")))
    overviews.refresh(spark, store, longer, channels, 4, compute)
    return overviews.serve(spark, store, longer, 4)
