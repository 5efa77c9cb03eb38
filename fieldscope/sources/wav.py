"""WAV files by byte ranges: headers without their data, samples of single blocks, and a data source over both."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

BLOCKS = "recording_id string, channel int, block long, start_frame long, samples array<double>"
#: Bytes of the files that one partition reads, and samples that it hands on at once.
PARTITION_BYTES, BATCH_SAMPLES = 64 << 20, 1 << 17
#: Formats of a WAV's fmt chunk and the size that stands for "see the ds64 chunk"; fixed values.
PCM, FLOAT, EXTENSIBLE, ELSEWHERE = 1, 3, 0xFFFE, 0xFFFFFFFF


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path or URI lies in, and its name there."""
    if re.match(r"^file:", path) or "://" not in path:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def wav_form(read: Callable[[int, int], bytes], size: int) -> dict | None:
    """rate, channels, bits, float, at, frames of a PCM or float WAV of size bytes, of which read(offset, n) gives some; None where it is none.

    Only chunk heads are read, and data may be over 4 GB (RF64). A data chunk cut short counts as far as it goes.
    """
    head = read(0, 12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return None
    at, form, long = 12, None, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"ds64":
            long = struct.unpack("<Q", read(at + 16, 8))[0]
        elif name == b"fmt " and at + 24 <= size:
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            if kind == EXTENSIBLE and length >= 40:
                kind = struct.unpack("<H", read(at + 32, 2))[0]
            form = {"rate": float(rate), "channels": channels, "bits": bits, "float": kind == FLOAT}
        elif name == b"data" and form and form["channels"] and form["bits"] >= 8:
            length = min(long if long is not None and length == ELSEWHERE else length, size - at - 8)
            return form | {"at": at + 8, "frames": length // (form["channels"] * form["bits"] // 8)}
        at += 8 + length + length % 2
    return None


def file_form(path: str) -> dict | None:
    """wav_form of a file; None too where it can't be opened."""
    store, name = store_of(path)
    try:
        with store.open_input_file(name) as f:
            return wav_form(lambda at, n: f.read_at(n, at), f.size())
    except (OSError, struct.error):
        return None


def decoded(data: bytes, channels: int, bits: int, is_float: bool) -> np.ndarray:
    """(frames, channels) in -1 to 1 of interleaved samples."""
    if is_float:
        x = np.frombuffer(data, f"<f{bits // 8}").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{bits // 8}") / float(1 << (bits - 1))
    return x.reshape(-1, channels)


@dataclass
class Range(InputPartition):
    """Blocks first to last (exclusive) of a recording, and the pieces of files (path, byte, frames) that hold them."""

    recording_id: str
    first: int
    last: int
    total: int
    channels: int
    bits: int
    is_float: bool
    pieces: list[tuple[str, int, int]]


def ranges(recording_id: str, files: list[dict], length: int, wanted: list[tuple[int, int]], partition_bytes: int = PARTITION_BYTES) -> list[Range]:
    """The partitions that read the wanted blocks (first, last; exclusive) of files (path, at, frames, channels, bits, float), which follow each other."""
    starts = np.concatenate([[0], np.cumsum([f["frames"] for f in files])]).tolist()
    form = files[0]
    wide = form["channels"] * form["bits"] // 8
    step, blocks, out = max(1, partition_bytes // (length * wide)), -(-starts[-1] // length), []
    for lo, hi in wanted:
        for first in range(max(lo, 0), min(hi, blocks), step):
            last = min(first + step, hi, blocks)
            a, z = first * length, min(last * length, starts[-1])
            pieces = [(f["path"], f["at"] + max(a - s, 0) * wide, min(z, e) - max(a, s)) for f, s, e in zip(files, starts[:-1], starts[1:], strict=True) if s < z and e > a]
            out.append(Range(recording_id, first, last, starts[-1], form["channels"], form["bits"], form["float"], pieces))
    return out


class WavReader(DataSourceReader):
    """Filters on recording_id, block and channel decide which byte ranges are read at all."""

    def __init__(self, options: dict):
        self.recordings, self.length = json.loads(options["recordings"]), int(options["length"])
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.low, self.high, self.blocks, self.channels, self.ids = 0, None, None, None, None

    def _narrowed(self, name: str, values) -> None:
        have = getattr(self, name)
        setattr(self, name, set(values) if have is None else have & set(values))

    def pushFilters(self, filters):
        sets = {"recording_id": "ids", "block": "blocks", "channel": "channels"}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, IsNotNull):
                continue  # no column is ever null
            if column in sets and isinstance(f, EqualTo | In):
                self._narrowed(sets[column], [f.value] if isinstance(f, EqualTo) else f.value)
            elif column == "block" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
            elif column == "block" and isinstance(f, LessThan | LessThanOrEqual):
                bound = int(f.value) + isinstance(f, LessThanOrEqual)
                self.high = bound if self.high is None else min(self.high, bound)
            else:
                yield f

    def partitions(self) -> list[Range]:
        high = 1 << 62 if self.high is None else self.high
        wanted = [(self.low, high)] if self.blocks is None else [(b, b + 1) for b in sorted(self.blocks) if self.low <= b < high]
        joined = [w for i, w in enumerate(wanted) if not i or w[0] != wanted[i - 1][1]]
        ends = [w[1] for i, w in enumerate(wanted) if i + 1 == len(wanted) or w[1] != wanted[i + 1][0]]
        wanted = [(a, e) for (a, _), e in zip(joined, ends, strict=True)]
        return [p for r, files in self.recordings.items() if files and (self.ids is None or r in self.ids) for p in ranges(r, files, self.length, wanted, self.partition_bytes)]

    def read(self, partition: Range | None):
        if partition is None:  # there is nothing to read, but a task for it
            return
        wide = partition.channels * partition.bits // 8
        channels = [c for c in range(partition.channels) if self.channels is None or c in self.channels]
        rows, held = [], 0
        for block, data in self._blocks(partition, wide):
            x = decoded(data, partition.channels, partition.bits, partition.is_float)
            rows += [(c, block, x[:, c]) for c in channels]
            held += len(x) * len(channels)
            if held >= BATCH_SAMPLES:
                yield self._batch(partition.recording_id, rows)
                rows, held = [], 0
        if rows:
            yield self._batch(partition.recording_id, rows)

    def _blocks(self, p: Range, wide: int):
        """(block, bytes) of all blocks of a partition; a block across a join is put together from both files."""
        pieces, at = iter(p.pieces), p.first * self.length
        file, left, offset, path = None, 0, 0, ""
        try:
            for block in range(p.first, p.last):
                end, parts = min((block + 1) * self.length, p.total), []
                while at < end:
                    if not left:
                        if file:
                            file.close()
                        path, offset, left = next(pieces)
                        store, name = store_of(path)
                        file = store.open_input_file(name)
                    n = min(left, end - at)
                    parts.append(file.read_at(n * wide, offset))
                    if len(parts[-1]) != n * wide:
                        raise ValueError(f"{path}: frames are missing that its header told of")
                    at, left, offset = at + n, left - n, offset + n * wide
                yield block, b"".join(parts)
        finally:
            if file:
                file.close()

    def _batch(self, recording_id: str, rows: list) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) for *_, x in rows])]).astype(np.int32)
        samples = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for *_, x in rows])))
        block = np.array([b for _, b, _ in rows], dtype=np.int64)
        columns = [pa.array([recording_id] * len(rows)), pa.array(np.array([c for c, *_ in rows], dtype=np.int32)), pa.array(block), pa.array(block * self.length), samples]
        return pa.RecordBatch.from_arrays(columns, names=["recording_id", "channel", "block", "start_frame", "samples"])


class WavBlocks(DataSource):
    """Blocks of recordings: options recordings (JSON: id to files with path, at, frames, channels, bits, float) and length.

    A partition is a range of blocks and the bytes that hold them. Headers are not read here: file_frames tells them.
    """

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def forms_of(paths: list[str], threads: int = 16) -> list[dict | None]:
    """file_form of each path, several at once: a header is a matter of waiting."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(file_form, paths))
