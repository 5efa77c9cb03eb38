"""Shared folder, table and text-hashing helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORK_BYTES = 1 << 19
#: Rows of an Arrow batch: texts are long, and a batch is held several times on its way to Python and back.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def trim() -> None:
    """Gives freed memory of this Python process back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def released(run):
    """run for mapInArrow; at its end the worker, which is used again, gives back the memory that it no longer needs."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all of Spark is one process (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores before those that df has a column of already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df in the shared folder and returns the written table: lineage ends there, and the shuffles that led to it are deleted."""
    spark = df.sparkSession
    bound_batches(spark)
    path, before = shared_path(spark, tag), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that materialize has written, once nothing that is still to be read depends on them; others are left alone."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            with contextlib.suppress(pa.ArrowInvalid, OSError):  # a store that Arrow can't open keeps them
                store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                store.delete_dir(name)
            df._written = None


#: Bits of IdBits for each id, and of a row of them (a power of two).
ID_BITS, SEGMENT_BITS = 16, 1 << 20


def _all_words(rows: pa.Table) -> pa.Table:
    """The words of a segment in order, those without bits too, as one row."""
    words = np.zeros(SEGMENT_BITS // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return pa.table({"segment": rows.column("segment")[:1], "words": pa.array([words], pa.list_(pa.int64()))})


class IdBits:
    """Bits that tell which ids a set of longs may hold: true for all of them and for about 0.5 in 100 of others, always the same ones. Two bytes an id."""

    def __init__(self, ids: DataFrame, tag: str):
        """ids: one column; read twice."""
        (name,) = ids.columns
        self.segments = max(1, -(-ids.count() * ID_BITS // SEGMENT_BITS))
        places = ids.where(F.col(name).isNotNull()).select(self._segment(F.col(name)).alias("segment"), F.explode(F.array(*self._places(F.col(name)))).alias("place"))
        words = places.groupBy("segment", F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        rows = words.groupBy("segment").applyInArrow(_all_words, "segment int, words array<long>")
        self.rows = materialize(rows, tag)

    def _segment(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(5), column), F.lit(self.segments)).cast("int")

    def _places(self, column: Column) -> list[Column]:
        drawn = F.xxhash64(F.lit(11), column)
        return [F.shiftrightunsigned(drawn, 20 * i).bitwiseAND(SEGMENT_BITS - 1).cast("int") for i in range(3)]

    def mark(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with name: whether the set may hold the id in column. df is not shuffled."""
        segment, words = unused(df, "segment", "words")
        held = F.lit(True)
        for place in self._places(F.col(column)):
            held = held & (F.getbit(F.col(words)[F.shiftright(place, 6)], place.bitwiseAND(63)) == 1)
        small = self.rows.select(F.col("segment").alias(segment), F.col("words").alias(words))
        return df.join(F.broadcast(small), self._segment(F.col(column)) == F.col(segment), "left").withColumn(name, F.coalesce(held, F.lit(False))).drop(segment, words)

    def some(self, df: DataFrame, column: str, inside: bool = True) -> DataFrame:
        """The rows of df whose id the set may hold (inside), or surely does not hold."""
        (name,) = unused(df, "held")
        marked = self.mark(df, column, name)
        return marked.where(F.col(name) if inside else ~F.col(name)).drop(name)

    def dropped(self) -> None:
        dropped(self.rows)


def lower_az(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower does that on ASCII much faster than translate, which goes letter by letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER_AZ))


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: A-Z to a-z on bytes; all else as it is.
LOWER = _lower_table()
_CODE = splitmix(np.arange(1, 257, dtype=np.uint64))[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of them."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(2 * WORK_BYTES, n)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p, step = np.ones(1, dtype=np.uint64), base
            while len(p) < size:
                with np.errstate(over="ignore"):
                    p = np.concatenate([p, p * np.uint64(step)])
                step = step * step % (1 << 64)
            both.append(p)
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is true on the given closed byte ranges."""
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


WHITE = byte_class((0x20, 0x20), (0x09, 0x0D))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow text column and its n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_blocks(offsets: np.ndarray, limit: int = WORK_BYTES):
    """(lo, hi) row ranges of at most limit bytes each; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _hash_piece(data: np.ndarray, separator: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and word starts in data; a word ends at a separator byte and at each of breaks."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sep = separator[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = sep[:-1], sep[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~sep & before), np.flatnonzero(~sep & after) + 1
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * up[: len(data)], dtype=np.uint64)])
        return splitmix((total[ends] - total[starts]) * down[starts]), starts


def word_blocks(column: pa.Array, separator: np.ndarray = WHITE):
    """(lo, hi, hashes, offsets) for each block of rows: 64-bit hashes of all words of rows lo to hi, with
    A-Z lower-cased, and hi - lo + 1 offsets of the rows in them. Whole texts; a very long one goes in pieces
    that end at separators."""
    data, offsets = text_buffer(column)
    for lo, hi in row_blocks(offsets):
        block, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if len(block) <= 4 * WORK_BYTES:
            hashes, starts = _hash_piece(block, separator, at)
            yield lo, hi, hashes, np.searchsorted(starts, at)
            continue
        parts, begin = [], 0
        while begin < len(block):
            end = min(begin + WORK_BYTES, len(block))
            while end < len(block) and not (cut := np.flatnonzero(separator[block[begin:end]])).size:
                end = min(end + WORK_BYTES, len(block))
            if end < len(block):
                end = begin + int(cut[-1]) + 1
            parts.append(_hash_piece(block[begin:end], separator, np.zeros(0, np.int64))[0])
            begin = end
        hashes = np.concatenate(parts)
        yield lo, hi, hashes, np.array([0, len(hashes)])


_MIX = [int(x) | 1 for x in splitmix(np.arange(1000, 1064, dtype=np.uint64))]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct sorted hashes of the k-word shingles of one document; fewer words make one shingle of all."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, width, dtype=np.uint64)
        for j in range(width):
            total = total + words[j : n - width + 1 + j] * np.uint64(_MIX[j])
    return np.unique(splitmix(total))
