"""WAV recordings as block tables, and back. Blocks are read by byte ranges (sources/wav.py) and files written by sources/sinks.py."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.sources.sinks import write_files
from fieldscope.sources.wav import ELSEWHERE, FLOAT, PCM, WavBlocks, decoded, forms_of, wav_form

FORM = "rate double, channels int, frames long, at long, bits int, float boolean"


def wav_header(raw: bytes) -> dict | None:
    """rate, channels, bits, float, at, frames of a PCM or float WAV; None where it is none. A data chunk cut short counts as far as it goes."""
    return wav_form(lambda at, n: raw[at : at + n], len(raw))


def wav_samples(raw: bytes) -> np.ndarray:
    """(frames, channels) in -1 to 1."""
    h = wav_header(raw)
    size = h["frames"] * h["channels"] * h["bits"] // 8
    return decoded(raw[h["at"] : h["at"] + size], h["channels"], h["bits"], h["float"])


def _coded(x: np.ndarray, whole: bool) -> bytes:
    """Interleaved 32-bit samples of (frames, channels)."""
    return (np.round(x * (1 << 31)).clip(-(1 << 31), (1 << 31) - 1).astype("<i4") if whole else x.astype("<f4")).tobytes()


def _head(channels: int, frames: int, rate: float, whole: bool) -> bytes:
    """All that stands before the samples; files over 4 GB get the long form."""
    if rate != int(rate):
        raise ValueError("a WAV's rate is a whole number")
    size, wide = 4 * channels * frames, 4 * channels
    form = b"fmt " + struct.pack("<IHHIIHH", 16, PCM if whole else FLOAT, channels, int(rate), int(rate) * wide, wide, 32)
    if size + 36 < ELSEWHERE:
        return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVE" + form + b"data" + struct.pack("<I", size)
    return b"RF64" + struct.pack("<I", ELSEWHERE) + b"WAVEds64" + struct.pack("<IQQQI", 28, size + 72, size, frames, 0) + form + b"data" + struct.pack("<I", ELSEWHERE)


def wav_bytes(x: np.ndarray, rate: float) -> bytes:
    """A WAV of (frames, channels): 32-bit integers where the peak is under 1, else floats. The rate must be a whole number."""
    whole = not len(x) or bool(np.abs(x).max() < 1)
    return _head(x.shape[1], len(x), rate, whole) + _coded(x, whole)


def file_frames(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, part (in the given order), rate, channels, frames, at, bits, float of each file; nulls where it can't be read as a WAV.

    Only heads of chunks are read, in as many tasks as there are cores.
    """

    def heads(batches):
        for pdf in batches:
            forms = pd.DataFrame([f or {} for f in forms_of(list(pdf["path"]))], columns=["rate", "channels", "frames", "at", "bits", "float"])
            yield pd.concat([pdf.reset_index(drop=True), forms.astype({"channels": "Int32", "frames": "Int64", "at": "Int64", "bits": "Int32", "float": "boolean"})], axis=1)

    told = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, part long")
    return told.repartition(min(len(paths), spark.sparkContext.defaultParallelism) or 1, "part").mapInPandas(heads, f"path string, part long, {FORM}")


def read_recordings(spark: SparkSession, recordings: dict[str, list[str]], length: int, partition_bytes: int | None = None) -> DataFrame:
    """Blocks of length frames of recordings (id to its files, joined end to end, whatever gaps the clock tells of).

    An unreadable file, or rates or channel counts that differ within a recording, are an error, and so is a file that ends before the frames
    its header told of. Filters on recording_id, channel and block reach the files: other blocks are not read. A block that crosses a
    join is put together from both files.
    """
    of = [(r, p) for r, paths in recordings.items() for p in paths]
    heads = {row.part: row.asDict() for row in file_frames(spark, [p for _, p in of]).collect()}  # a row a file
    files: dict[str, list] = {r: [] for r in recordings}
    for i, (r, _) in enumerate(of):
        head = heads[i]
        if head["frames"] is None or any(head[c] != f[c] for f in files[r] for c in ("rate", "channels")):
            raise ValueError("files that are unreadable or of different rates or channels")
        files[r].append({c: head[c] for c in ("path", "at", "frames", "rate", "channels", "bits", "float")})
        if any(head[c] != files[r][0][c] for c in ("bits", "float")):
            raise ValueError("files of one recording that hold samples of different kinds")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavBlocks)
    reader = spark.read.format("wav_blocks").option("recordings", json.dumps(files)).option("length", length)
    return (reader if partition_bytes is None else reader.option("partition_bytes", partition_bytes)).load()


def read_recording(spark: SparkSession, recording_id: str, paths: list[str], length: int) -> DataFrame:
    """read_recordings of one."""
    return read_recordings(spark, {recording_id: paths}, length)


def export_spans(blocks: DataFrame, folder: str, first: int, last: int, rate: float) -> list[str]:
    """Writes frames first to last (exclusive) of every recording of blocks as folder/recording_id.wav, all channels, and returns the names.

    Samples are written where they stand in the file, a block at a time, and files appear only when all is written; one that is there is
    replaced then. A span out of a recording, channels of different length and a rate that is no whole number are errors, and leave what is there.
    """
    cut = read_frames(blocks, first, last)
    peak = F.array_max(F.transform("samples", lambda x: F.abs(x)))
    seen = cut.groupBy("recording_id", "channel").agg(F.max(peak).alias("peak"), F.sum(F.size("samples").cast("long")).alias("n"))
    known = seen.groupBy("recording_id").agg(F.max("peak").alias("peak"), F.min("n").alias("least"), F.max("n").alias("most"), F.array_sort(F.collect_list("channel")).alias("channels")).collect()
    every = {r.recording_id for r in blocks.select("recording_id").distinct().collect()}  # a row a recording
    if any(r.least != last - first or r.most != last - first for r in known) or len(known) != len(every) or last <= first:
        raise ValueError("the span is not in all channels of the recordings")
    forms = {r.recording_id: (list(r.channels), bool(r.peak < 1)) for r in known}
    heads = {r: _head(len(channels), last - first, rate, whole) for r, (channels, whole) in forms.items()}

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf["recording_id"].iloc[0]
        channels, whole = forms[r]
        x = np.stack(pdf.sort_values("channel")["samples"].to_list(), axis=1)
        if x.shape[1] != len(channels):
            raise ValueError("a block lacks a channel")
        at = int(pdf["start_frame"].iloc[0]) - first
        return pd.DataFrame({"name": [f"{r}.wav"], "offset": [len(heads[r]) + 4 * len(channels) * at], "content": [_coded(x, whole)]})

    spark = blocks.sparkSession
    tops = spark.createDataFrame([(f"{r}.wav", 0, head) for r, head in heads.items()], "name string, offset long, content binary")
    body = cut.groupBy("recording_id", "start_frame").applyInPandas(pack, "name string, offset long, content binary")
    write_files(tops.unionByName(body), folder, sizes={f"{r}.wav": len(head) + 4 * len(forms[r][0]) * (last - first) for r, head in heads.items()})
    return sorted(f"{r}.wav" for r in heads)


def export_span(blocks: DataFrame, first: int, last: int, rate: float) -> DataFrame:
    """recording_id, content: a WAV of frames first to last (exclusive), all channels, as a value; for short spans. A span out of the recording has no row."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.concatenate(list(g.sort_values("start_frame")["samples"])) for _, g in pdf.groupby("channel")], axis=1)
        return pd.DataFrame({"recording_id": [pdf["recording_id"].iloc[0]], "content": [wav_bytes(x, rate)]})

    cut = read_frames(blocks, first, last)
    return cut.groupBy("recording_id").applyInPandas(pack, "recording_id string, content binary")


def read_frames(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """recording_id, channel, start_frame, samples of the frames first to last (exclusive) of blocks of whatever length."""
    lo, hi = F.greatest(F.lit(first) - F.col("start_frame"), F.lit(0)), F.least(F.lit(last) - F.col("start_frame"), F.size("samples").cast("long"))
    part = blocks.where((F.col("start_frame") < last) & (F.col("start_frame") + F.size("samples") > first))
    return part.select("recording_id", "channel", F.greatest(F.col("start_frame"), F.lit(first)).alias("start_frame"), F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("samples"))


def read_region(blocks: DataFrame, length: int, rate: float, t0: float, t1: float, channel: int | None = None) -> DataFrame:
    """read_frames of the seconds t0 to t1 of blocks of length frames: frames int(t0 * rate) to int(t1 * rate), the last one included.

    The frames are turned into block numbers, which a source of blocks can tell from its files: other blocks are not read.
    """
    first, last = max(int(t0 * rate), 0), int(t1 * rate) + 1
    part = blocks.where(F.col("block").between(first // length, (last - 1) // length))
    return read_frames(part if channel is None else part.where(F.col("channel") == channel), first, last)
