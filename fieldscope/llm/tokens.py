"""Token ids as byte- or bit-plane blocks.

A written table has one row per segment: whole documents in ascending id order, about ``segment_ids`` ids
each. A segment's ids are cut into blocks of ``block_ids``; every block is transposed into planes, each plane
is compressed with zstandard, and ``plane_sizes`` is the chunk index that finds a plane in its block. Rows
are self-contained, so any segment can be read alone, and documents are found by ``doc_ids``/``doc_tokens``.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import bound_batches, released, shared_path, table

SCHEMA = (
    "part int, segment int, n_ids long, block_ids int, plane string, blocks array<binary>, "
    "plane_sizes array<array<int>>, doc_ids array<long>, doc_tokens array<long>"
)
_ARROW = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("plane", pa.string()),
    ("blocks", pa.list_(pa.binary())), ("plane_sizes", pa.list_(pa.list_(pa.int32()))),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
])


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """The byte planes (lowest first) or bit planes (lowest first) of uint32 ids; high planes of zeros are left out."""
    top = int(ids.max()) if len(ids) else 0
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [raw[:, j].tobytes() for j in range(max(1, -(-top.bit_length() // 8)))]
    bits = np.unpackbits(raw, axis=1, bitorder="little").T
    return [np.packbits(bits[j], bitorder="little").tobytes() for j in range(max(1, top.bit_length()))]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    if plane == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for j, p in enumerate(planes):
            raw[:, j] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for j, p in enumerate(planes):
            bits[:, j] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def pack(ids: np.ndarray, block_ids: int, plane: str, level: int) -> tuple[list[bytes], list[list[int]]]:
    import zstandard

    press, blocks, sizes = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), block_ids):
        planes = [press.compress(p) for p in to_planes(ids[at : at + block_ids], plane)]
        blocks.append(b"".join(planes))
        sizes.append([len(p) for p in planes])
    return blocks, sizes


def unpack(blocks, plane_sizes, n_ids: int, block_ids: int, plane: str) -> np.ndarray:
    import zstandard

    press, out = zstandard.ZstdDecompressor(), []
    for b, (block, sizes) in enumerate(zip(blocks, plane_sizes, strict=True)):
        n, ends = min(block_ids, n_ids - b * block_ids), np.cumsum([0, *sizes])
        planes = [press.decompress(block[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
        out.append(from_planes(planes, n, plane))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


#: The pre-tokenizer whose pieces _Words finds by itself; fixed value, as in the tokenizer's file.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Words(dict):
    """Ids (bytes) of words; a word not met before is encoded by the library's model, piece by piece."""

    def __init__(self, tokenizer, most: int):
        import regex

        super().__init__({"": b""})
        self.tokenizer, self.model, self.most, self.pieces = tokenizer, tokenizer.model, most, {}
        spec = json.loads(tokenizer.to_str())
        first, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.known = first.get("pattern", {}).get("Regex") == _PIECES and steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in rest] == ["ByteLevel"]
        # letters below U+0250 have no combining forms, so NFC leaves them as they are
        shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b != 173]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in shown)}  # as ByteLevel writes bytes
        self.plain, self.find = regex.compile("[!-~\u00a1-\u024f]+").fullmatch, regex.compile(_PIECES).findall

    def piece(self, p: str) -> bytes:
        raw = self.pieces.get(p)
        if raw is None:
            text = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
            raw = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            if len(self.pieces) < self.most:
                self.pieces[p] = raw
        return raw

    def __missing__(self, w: str) -> bytes:
        low = w.lower()
        core = low.rstrip(".,;:!?")
        if self.known and core.isalpha() and (w.isascii() or self.plain(w)):
            raw = self.piece(core) + self.piece(low[len(core) :]) if len(core) < len(low) else self.piece(core)
        elif self.known and self.plain(w) and "<|" not in w:
            raw = b"".join(map(self.piece, self.find(low)))
        else:
            raw = array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        if len(self) < self.most:
            self[w] = raw
        return raw


class WordEncoder:
    """Ids of a text from cached ids of its words.

    For tokenizers that never join text across a space or a line feed: the ids of a text are those of its words in
    order. The cache is bounded by most_words; words beyond it are encoded each time.
    """

    def __init__(self, path: str, most_words: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.words = _Words(Tokenizer.from_file(path), most_words)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        get = self.words.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


_ENCODERS: dict[str, WordEncoder] = {}


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, block_ids: int = 1 << 16,
    segment_ids: int = 1 << 20, plane: str = "byte", level: int = 1,
) -> DataFrame:
    """Encodes docs(doc_id, text) and writes the segments to path, in ascending doc_id order over parts and segments.

    A null or empty text is end_id alone. A null doc_id comes before all others; equal doc_ids follow each other
    by text. Every row is written, repeated ones too; other columns are not read. An empty table writes no segment.
    """

    def encode(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = _ENCODERS.setdefault(tokenizer_path, WordEncoder(tokenizer_path)) if tokenizer_path not in _ENCODERS else _ENCODERS[tokenizer_path]
        end, segment = np.array([end_id], "<u4").tobytes(), 0
        ids, doc_ids, counts, held = [], [], [], 0

        def row():
            flat = np.frombuffer(b"".join(ids), "<u4")
            blocks, sizes = pack(flat, block_ids, plane, level)
            values = [part, segment, len(flat), block_ids, plane, blocks, sizes, doc_ids, counts]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            keys, texts, lo = batch.column(0).to_pylist(), batch.column(1), 0
            while lo < len(keys):
                some = texts.slice(lo, 256).to_pylist()
                for key, raw in zip(keys[lo : lo + 256], encoder.encode([t or "" for t in some]), strict=True):
                    ids += (raw, end)
                    doc_ids.append(key)
                    counts.append(len(raw) // 4 + 1)
                    held += counts[-1]
                    if held >= segment_ids:
                        yield row()
                        ids, doc_ids, counts, held, segment = [], [], [], 0, segment + 1
                lo += 256
        if doc_ids:
            yield row()

    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(released(encode), SCHEMA).write.parquet(path)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, part, segment, position (in its segment), before (ids of the segment before it), ids (little-endian bytes)."""

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                raw = unpack(r["blocks"], r["plane_sizes"], r["n_ids"], r["block_ids"], r["plane"]).tobytes()
                n = len(r["doc_ids"])
                ends = np.cumsum([0, *r["doc_tokens"]])
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * n, pa.int32()), pa.array([r["segment"]] * n, pa.int32()),
                    pa.array(range(n), pa.int32()), pa.array(ends[:-1], pa.int64()),
                    pa.array([raw[4 * s : 4 * e] for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                ], names=["doc_id", "part", "segment", "position", "before", "ids"])

    return segments.mapInArrow(released(decode), "doc_id long, part int, segment int, position int, before long, ids binary")


def segment_bases(segments: DataFrame) -> DataFrame:
    """part, segment, base: ids of all segments before it.

    Only sizes travel: one total per part comes to the driver (as many as there are write tasks), the rest is a
    running sum within each part.
    """
    spark = segments.sparkSession
    sizes = segments.select("part", "segment", "n_ids")
    totals = sorted(tuple(r) for r in sizes.groupBy("part").agg(F.sum("n_ids")).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in totals])])
    parts = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(totals, starts[:-1], strict=True)], "part int, part_base long")
    w = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(w), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("part_base") + F.col("inner")).alias("base"))


def token_digest(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written segments."""
    return (
        read_tokens(segments)
        .select("doc_id", "part", "segment", "before", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
        .join(segment_bases(segments), ["part", "segment"])
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    segments = write_tokens(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"), str(public_tokenizers.path("word_bpe_49k.json")))
    return token_digest(segments)


QUERIES = {"op5_token_planes": op5_token_planes}
ORACLES: dict[str, str] = {}
