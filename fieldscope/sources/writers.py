"""Label files, detections and training sets as files that are there whole or not at all (sources/sinks.py)."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Collection, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.scalars import fixed
from fieldscope.sources.sessions import LABEL_COLUMNS, label_rows
from fieldscope.sources.sinks import write_files, write_lines

#: What follows a recording's name in the name of its label file, and how lines of such a file end; fixed values.
LABELS_OF, END = "-labels.csv", "\r\n"


def sidecar_name(recording_id: str) -> str:
    """Name of a recording's label file beside it."""
    return f"{recording_id}{LABELS_OF}"


def write_labels(labels: DataFrame, folder: str, recordings: Collection[str], transient: Collection[str] = (), damaged: Collection[str] = (), blocked: Collection[str] = ()) -> None:
    """Writes labels(recording_id, category, kind, channel, t0, t1, f0, f1, note, outline) as one label file a recording, by start.

    Of recordings, those left without a label lose their file. Transient categories are not written. A recording in damaged (rows of its
    file were dropped when it was read) has its file copied aside first, to a name that is free; one in blocked (its file could not be
    read) must not be written, which is an error. Where anything fails, all files stay as they are.
    """
    stray = labels.where(F.col("recording_id").isNull() | ~F.col("recording_id").isin([r for r in recordings if r not in set(blocked)])).limit(1).collect()
    if stray:
        raise ValueError(f"labels of {stray[0].recording_id!r}, which is none of the recordings to be written")
    text = label_rows(labels, list(transient), ("recording_id", "t0", "t1"))
    line = F.concat(F.to_csv(F.struct(*LABEL_COLUMNS), {"escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}), F.lit(END))
    rows = text.select(F.concat("recording_id", F.lit(LABELS_OF)).alias("name"), line.alias("line"), "t0", "t1")
    names = [sidecar_name(r) for r in recordings if r not in set(blocked)]
    write_lines(rows, folder, ["t0", "t1", "line"], ",".join(LABEL_COLUMNS) + END, remove=names, keep=[sidecar_name(r) for r in damaged])


def detection_labels(boxes: DataFrame, names: Sequence[str], cut: float, suffix: str = "") -> DataFrame:
    """Label rows of boxes(recording_id, cls, score, channel, t0, t1, f0, f1[, outline]) from the cut on: class names with a suffix, the score as note."""
    known = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (i, n))), F.col("cls").cast("int")) if names else F.lit(None).cast("string")
    outline = F.col("outline") if "outline" in boxes.columns else F.lit(None).cast("array<struct<t:double,f:double>>")
    return boxes.where(F.col("score") >= cut).select(
        "recording_id", F.concat(known, F.lit(suffix)).alias("category"), F.lit("span").alias("kind"), F.col("channel").cast("int").alias("channel"), "t0", "t1", "f0", "f1",
        F.concat(F.lit("score="), F.coalesce(fixed(F.col("score"), 4), F.lit("null"))).alias("note"), outline.alias("outline"),
    )


def write_detections(boxes: DataFrame, folder: str, recordings: Collection[str], names: Sequence[str], cut: float, suffix: str = "") -> None:
    """detection_labels as label files; recordings without a box from the cut on lose theirs."""
    write_labels(detection_labels(boxes, names, cut, suffix), folder, recordings)


def png(image: bytes, size: int) -> bytes:
    """A grey picture of size * size bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + image[i : i + size] for i in range(0, size * size, size))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_dataset(tiles: DataFrame, images: DataFrame, lines: DataFrame, folder: str, names: Sequence[str], size: int) -> None:
    """Writes a training set: images/split/name.png, labels/split/name.txt and data.yaml, in place of all that the folder held.

    tiles(rec, s0, split) without a split are left out; images(recording_id, s0, image) are those of render_tiles; lines(rec, s0, uid, line) those of
    tile_labels, of which null ones (slivers) are no line. A tile without a line has an empty label file. Where nothing is held out, training
    is judged on itself.
    """
    told = lines.where("line is not null").groupBy("rec", "s0").agg(F.array_sort(F.collect_list(F.struct("uid", "line"))).alias("l"))
    kept = tiles.where("split is not null").select("rec", "s0", "split").join(told, ["rec", "s0"], "left")
    text = F.concat_ws("", F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))))
    whole = kept.join(images.select(F.col("recording_id").alias("rec"), "s0", "image"), ["rec", "s0"]).select("split", F.format_string("%s_%012d", F.col("rec").cast("string"), F.col("s0")).alias("stem"), text.alias("text"), "image")

    def files(frames):
        for pdf in frames:
            out = [(f"images/{r.split}/{r.stem}.png", png(r.image, size)) for r in pdf.itertuples()] + [(f"labels/{r.split}/{r.stem}.txt", (r.text or "").encode()) for r in pdf.itertuples()]
            yield pd.DataFrame(out, columns=["name", "content"])

    held_out = not tiles.where("split = 'val'").isEmpty()
    listed = "".join(f"  {i}: {json.dumps(n)}\n" for i, n in enumerate(names))
    yaml = f"path: {json.dumps(folder)}\ntrain: images/train\nval: images/{'val' if held_out else 'train'}\nnames:\n{listed}"
    write_files(whole.mapInPandas(files, "name string, content binary"), folder, extra={"data.yaml": yaml}, whole=True)
