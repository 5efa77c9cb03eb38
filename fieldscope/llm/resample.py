"""Importance resampling towards a target: documents are drawn by how much more often their words occur in the target.

Features are runs of consecutive words, hashed with crc32. The checksum of a span is the XOR of what each of its bytes
contributes at its distance from the span's end (a table of ``REACH`` by 256 entries) and of a constant for the span's length,
so that all spans of a batch are reduced at once. A span longer than the table goes in blocks: the register of what came before
is moved on by the table's last four rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import LOWER, WORK_BYTES, byte_class, materialize, released, row_blocks, table, text_buffer

REACH = 32
BUCKETS, SEED, MIN_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bytes that end a word, after A-Z are lower-cased: all of ASCII but digits and letters.
NOT_WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_SPACE, _ONES = np.uint8(0x20), np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def position_table() -> tuple[np.ndarray, np.ndarray]:
    """Contribution of each byte by its distance from the end, flat (distance * 256 + byte), and the constants of the lengths 0 to REACH."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = (row >> np.uint32(1)) ^ np.where(row & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    rows = [row]
    while len(rows) < REACH:
        rows.append((rows[-1] >> np.uint32(8)) ^ row[rows[-1] & np.uint32(255)])
    return np.concatenate(rows), np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], dtype=np.uint32)


def _moved_on(register: np.ndarray) -> np.ndarray:
    """The registers after REACH more zero bytes: their four bytes stand for the first four of those."""
    flat, _ = position_table()
    out = np.zeros_like(register)
    for j in range(4):
        out ^= flat[(REACH - 1 - j) * 256 + ((register >> np.uint32(8 * j)) & np.uint32(255)).astype(np.int64)]
    return out


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of data[start:end] for each span; spans may overlap and none is empty."""
    flat, constant = position_table()
    out = np.empty(len(starts), dtype=np.uint32)
    lengths = ends - starts
    blocks = (lengths + REACH - 1) // REACH
    for lo, hi in row_blocks(np.concatenate([[0], np.cumsum(lengths)])):
        count, last = blocks[lo:hi], np.cumsum(blocks[lo:hi])
        # blocks are counted from a span's end, so only its first one is short
        back = np.repeat(last, count) - np.arange(last[-1]) - 1
        stop = np.repeat(ends[lo:hi], count) - back * REACH
        start = np.maximum(stop - REACH, np.repeat(starts[lo:hi], count))
        size = stop - start
        first = np.cumsum(size) - size
        at = np.repeat(start - first, size) + np.arange(int(size.sum()))
        part = np.bitwise_xor.reduceat(flat[(np.repeat(stop, size) - 1 - at) * 256 + data[at]], first)
        head = last - count
        crc = part[head] ^ constant[size[head]]
        long = np.flatnonzero(count > 1)
        register, k = crc[long] ^ _ONES, 1
        while len(long):
            register = _moved_on(register) ^ part[head[long] + k]
            k += 1
            over = count[long] == k
            crc[long[over]] = register[over] ^ _ONES
            long, register = long[~over], register[~over]
        out[lo:hi] = crc
    return out


def feature_blocks(column: pa.Array, shortest: int, longest: int, buckets: int):
    """(lo, hi, words of each row, row of each feature, bucket of each feature) for blocks of rows lo to hi."""
    data, offsets = text_buffer(column)
    for lo, hi in row_blocks(offsets):
        block, at = LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        out = np.ones(len(block) + 2, dtype=bool)
        out[1:-1] = NOT_WORD[block]
        inner = at[(at > 0) & (at < len(block))]
        begins, stops = out[:-2] & ~out[1:-1], out[2:] & ~out[1:-1]
        begins[inner] |= ~out[1:-1][inner]
        stops[inner - 1] |= ~out[1:-1][inner - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        bounds = np.searchsorted(starts, at)
        words = np.diff(bounds)
        of = np.repeat(np.arange(hi - lo), words)
        if longest > 1 and len(starts):
            # the words again with one space between any two
            size = ends - starts
            packed = np.cumsum(size + 1) - size - 1
            text = np.full(int(packed[-1] + size[-1]), _SPACE)
            text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = block[~out[1:-1]]
            block, starts, ends = text, packed, packed + size
        rows, found = [], []
        for n in range(shortest, longest + 1):
            i = np.arange(max(0, len(starts) - n + 1))
            i = i[of[i] == of[i + n - 1]]
            rows.append(of[i])
            found.append(span_crcs(block, starts[i], ends[i + n - 1]) % np.uint32(buckets))
        yield lo, hi, words, np.concatenate(rows), np.concatenate(found).astype(np.int64)


def bucket_counts(texts: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all of texts(text) by bucket. A task sends at most a row a bucket."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for *_, found in feature_blocks(batch.column(0), shortest, longest, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(released(run), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """The gain of each bucket: 1000 * ln of its smoothed share of target over that of docs, floored. buckets rows come to the driver."""
    both = bucket_counts(docs, shortest, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        bucket_counts(target, shortest, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel draw that follows from the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs(doc_id, text); rank counts the drawn rows from 1, others have null.

    Of the rows with at least min_words words, percent in a hundred (floored) are drawn by score, ties by doc_id. The score adds a
    Gumbel draw to the weight, so the draw is one without replacement by weight. A null or empty text has no features and the
    weight 0; a null doc_id counts as an empty one in the draw and comes first among ties. Rows that are equal in id and text are
    told apart only by their ranks. An empty target or an empty table gives its rows all the same. Other columns are not read.
    """
    gain = gains(docs, target, shortest, longest, buckets)

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            words, features, weight = (np.zeros(len(column), dtype=np.int64) for _ in range(3))
            for lo, hi, n, rows, found in feature_blocks(column, shortest, longest, buckets):
                words[lo:hi], features[lo:hi] = n, np.bincount(rows, minlength=hi - lo)
                weight[lo:hi] = np.bincount(rows, gain[found].astype(np.float64), minlength=hi - lo).astype(np.int64)
            weight = np.where(features, weight // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(released(run), f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scores")
    # a row a score: scores lie within some ten thousands of each other however many documents there are
    steps = scored.where(F.col("n_words") >= min_words).groupBy("score").agg(F.count("*").alias("n"))
    falling = Window.orderBy(F.desc("score"))
    steps = materialize(steps.withColumn("upto", F.sum("n").over(falling)), "resample-steps")
    drawn = (steps.agg(F.sum("n")).first()[0] or 0) * percent // 100
    last = steps.where(F.col("upto") - F.col("n") < drawn).agg(F.min("score")).first()[0] if drawn else None
    out = ("doc_id", "n_features", "weight", "score")
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    among = (F.col("n_words") >= min_words) & (F.col("score") >= last)
    # rows that are alike are counted, not sorted
    alike = scored.where(among).groupBy(*out).agg(F.count("*").alias("rows"))
    ahead = steps.where(F.col("score") >= last).select("score", (F.col("upto") - F.col("n")).alias("ahead"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "n_features", "weight")
    before = F.col("ahead") + F.sum("rows").over(order) - F.col("rows")
    ranked = alike.join(F.broadcast(ahead), "score").withColumn("before", before).withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("rows"))))
    ranked = ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~among).select(*out, F.lit(None).cast("long").alias("rank")))


def draw_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, with all their columns; a row that repeats a drawn doc_id stays with it."""
    drawn = resample(docs, target, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_drawn"]), "left_semi")


def op12_resample_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH step AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i))),
words AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM words)),
codes AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, crc[1 + (xor(a, x) & 255)])), 4294967295) % 10000 AS bucket FROM bytes, step),
hashed AS (SELECT side, id, bucket FROM words JOIN codes USING (w)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM hashed GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS g FROM counts),
docs AS (SELECT id AS doc_id, count(*) AS n, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM hashed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN docs USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= drawn THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

QUERIES = {"op12_resample_to_target": op12_resample_to_target}
ORACLES = {"op12_resample_to_target": OP12_SQL}
