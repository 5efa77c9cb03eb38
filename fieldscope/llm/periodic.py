"""Maximal periodic runs of words, and texts without the repeats in them.

A run of period q repeats itself for q words at least, so an aligned block of b <= (q + 1) / 2 words lies in the part that comes
again q words later. At each dyadic block length the occurrences of every block in the words that follow it, at the distances
which that length is for, are the zeros of the sum of squared differences; that is three sums, of which the mixed one is a
convolution, worked out in integers by a number-theoretic transform. Words are coded so small that the sum stays below the
prime and so is exact. The distances found are seeds: stretches of equal words at that distance are then told by the words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm.common import released, row_blocks, splitmix, table, text_buffer

MIN_WORDS = 12
#: A prime with 2**27 a divisor of one less, and a generator of its units.
PRIME, GENERATOR = 2013265921, 31
_P = np.uint64(PRIME)
#: Numbers that one transform of many blocks works on, and words that one comparison of stretches works on.
CELLS, STRETCH = 1 << 17, 1 << 20
#: Longer periods than these blocks are for are looked for with blocks of this length, in more windows.
LONGEST_BLOCK = 1 << 22


def _reduced(x: np.ndarray) -> np.ndarray:
    return x - x // _P * _P


@lru_cache(maxsize=64)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a root of unity of order 2 * half, as a column."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(1, dtype=np.uint64)
    while len(out) < half:
        out = np.concatenate([out, _reduced(out * np.uint64(pow(root, len(out), PRIME)))])
    return out[:, None]


def transform(x: np.ndarray) -> np.ndarray:
    """Transform of each column of x (a power of two of rows), in bit-reversed order."""
    rows, columns = x.shape
    half = rows // 2
    while half:
        pair = x.reshape(-1, 2, half, columns)
        out = np.empty_like(pair)
        total = pair[:, 0] + pair[:, 1]
        np.minimum(total, total - _P, out=out[:, 0])
        out[:, 1] = _reduced((pair[:, 0] + (_P - pair[:, 1])) * _roots(half, False))
        x, half = out.reshape(rows, columns), half // 2
    return x


def inverse(x: np.ndarray) -> np.ndarray:
    """What transform was given."""
    rows, columns = x.shape
    half = 1
    while half < rows:
        pair = x.reshape(-1, 2, half, columns)
        out = np.empty_like(pair)
        turned = _reduced(pair[:, 1] * _roots(half, True))
        total, rest = pair[:, 0] + turned, pair[:, 0] + (_P - turned)
        np.minimum(total, total - _P, out=out[:, 0])
        np.minimum(rest, rest - _P, out=out[:, 1])
        x, half = out.reshape(rows, columns), half * 2
    return _reduced(x * np.uint64(pow(rows, -1, PRIME)))


def matches(words: np.ndarray, starts: np.ndarray, stops: np.ndarray, b: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) where the block of b words at start occurs again first to last words on, before its stop.

    Compared are codes of the words, so some of them may be no match; none is missing. last - first may be 2 * b + 1 at most.
    """
    bits = np.uint64(min(14, (30 - (b - 1).bit_length()) // 2))
    lags, size = last - first + 1, 4 * b
    code = np.zeros(len(words) + last + b + 1, dtype=np.uint64)
    code[: len(words)] = splitmix(words) & ((np.uint64(1) << bits) - np.uint64(1))
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * code)])
    in_block, in_window, lag = np.arange(b)[::-1, None], np.arange(b + lags - 1)[:, None], np.arange(lags)[:, None]
    found, step = [], max(1, CELLS // size)
    for i in range(0, len(starts), step):
        at, stop = starts[i : i + step], stops[i : i + step]
        block, window = np.zeros((size, len(at)), dtype=np.uint64), np.zeros((size, len(at)), dtype=np.uint64)
        block[:b] = code[at + in_block]
        window[: b + lags - 1] = code[at + first + in_window]
        mixed = inverse(_reduced(transform(block) * transform(window)))[b - 1 : b - 1 + lags]
        begin = at + first + lag
        apart = squares[at + b] - squares[at] + squares[begin + b] - squares[begin] - np.uint64(2) * mixed
        k, column = np.nonzero((apart == 0) & (begin + b <= stop))
        found.append((at[column], first + k))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each of lengths, one after the other."""
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))


def _stretches(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, distance) of the longest stretches in lo to hi whose words are equal to those distance words on."""
    out = []
    for a, z in row_blocks(np.concatenate([[0], np.cumsum(hi - lo + 1)]), STRETCH):
        size = hi[a:z] - lo[a:z] + 1  # the last place of each is a border
        at, d = _spread(lo[a:z], size), np.repeat(distance[a:z], size)
        border = np.cumsum(size) - 1
        same = np.zeros(len(at) + 1, dtype=bool)
        inside = np.ones(len(at), dtype=bool)
        inside[border] = False
        i = np.flatnonzero(inside)
        same[1:][i] = words[at[i]] == words[at[i] + d[i]]
        edge = np.flatnonzero(same[1:] != same[:-1])
        begin, end = edge[::2], edge[1::2]
        out.append((at[begin], at[end - 1] + 1, d[begin]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _shortest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of each (start, end), with its smallest period, by start and period. A run that has a smaller period than
    the one it was found by was found by that one too, from its first to its last word."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    one = np.ones(len(start), dtype=bool)
    one[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[one], end[one], period[one]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def find_runs(words: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs in the texts bounds[i] to bounds[i + 1] of words (integers), as places in words."""
    none = np.zeros(0, dtype=np.int64)
    total, sizes = len(words), np.diff(bounds)
    if not total or min_words < 6:
        if total:
            raise ValueError("runs of fewer than six words are not looked for")
        return none, none, none
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = np.sort(words.astype(np.int64) * total + np.arange(total))
    place, word = key % total, key // total
    again = (word[1:] == word[:-1]) & (text[place[1:]] == text[place[:-1]])
    until = np.full(total, total, dtype=np.int64)  # words until the same one comes again
    until[place[:-1][again]] = np.diff(place)[again]
    runs, b, first, last = (none, none, none), 2, 1, 6
    while 2 * first <= sizes.max():
        count = np.where(sizes >= np.maximum(2 * first, first + b), (sizes - first - b) // b + 1, 0)
        late = np.concatenate([[0], np.cumsum(until > last)])
        within = _spread(np.zeros(len(count), np.int64), count)
        starts, stops = np.repeat(bounds[:-1], count) + b * within, np.repeat(bounds[1:], count)
        could = late[starts + b] == late[starts]  # every word of the block comes again soon enough
        starts, stops = starts[could], stops[could]
        if len(starts):
            seeds = [matches(words, starts, stops, b, lo, min(last, lo + 2 * b + 1)) for lo in range(first, last + 1, 2 * b + 2)]
            at, distance = (np.concatenate([s[k] for s in seeds]) for k in (0, 1))
            runs = _grown(words, text, bounds, runs, at, distance, b, min_words)
        first = last + 1
        b, last = min(2 * b, LONGEST_BLOCK), 2 * last + 2
    return runs


def _grown(words, text, bounds, runs, at, distance, b, min_words):
    """runs and those that the seeds (at, distance) lie in."""
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    head = np.ones(len(at), dtype=bool)
    head[1:] = (distance[1:] != distance[:-1]) | (at[1:] != at[:-1] + b)
    heads = np.flatnonzero(head)
    lo, d = at[heads], distance[heads]
    hi = at[np.append(heads[1:], len(at)) - 1] + b if len(at) else lo
    if len(runs[0]) and len(lo):  # seeds within a run that is known, at a multiple of its period, say nothing new
        far = np.maximum.accumulate(runs[1])
        holder = np.maximum.accumulate(np.where(runs[1] == far, np.arange(len(far)), 0))
        k = np.searchsorted(runs[0], lo, side="right") - 1
        known = (k >= 0) & (runs[1][holder[k]] >= hi + d) & (d % runs[2][holder[k]] == 0)
        lo, hi, d = lo[~known], hi[~known], d[~known]
    # the blocks before and after do not match, so a stretch ends within one block on either side
    of = text[lo]
    start, end, period = _stretches(words, np.maximum(bounds[of], lo - b), np.minimum(bounds[of + 1] - d, hi + b), d)
    end = end + period
    some = end - start >= np.maximum(min_words, 2 * period)
    return _shortest(*(np.concatenate([a, z[some]]) for a, z in zip(runs, (start, end, period), strict=True)))


def _words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between the ASCII white space of texts, and the n + 1 bounds of the texts in them."""
    parts = pc.ascii_split_whitespace(column)
    flat, bounds = parts.flatten(), np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)[bounds]


def _judged(column: pa.Array, min_words: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words, runs and what is left of each text."""
    flat, bounds = _words_of(column)
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, end, period = find_runs(ids, bounds, min_words)
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, end, -1)
    keep = np.cumsum(cover[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(keep)])[bounds]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat.filter(pa.array(keep))), " ")
    of = np.searchsorted(bounds, start, side="right") - 1
    fields = [pa.array(start - bounds[of]), pa.array(end - start), pa.array(period)]
    at = pa.array(np.searchsorted(start, bounds).astype(np.int32))
    return np.diff(bounds), pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, names=["start", "length", "period"])), collapsed


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>>, collapsed for every row of docs(doc_id, text).

    Words stand between ASCII white space. A run is a stretch of min_words words at least, and of twice its smallest period at
    least, that no neighbouring word extends; runs are sorted by start, then period. collapsed has the words that no run holds after its first
    period, joined by one space. A null or empty text has no words, no runs and an empty collapsed text. Rows are judged one by
    one, so repeated rows and null ids stay as they are; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            _, offsets = text_buffer(texts)
            parts = [_judged(texts.slice(lo, hi - lo), min_words) for lo, hi in row_blocks(offsets)]
            if parts:
                n, runs, left = zip(*parts, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.concat_arrays(runs), pa.concat_arrays(left)], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(released(run), schema)


def collapse(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with each run of their texts cut down to its first period; a text without runs stays as it is, spaces included, and so does null."""

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = pc.fill_null(batch.column(i).cast(pa.string()), "")
            _, offsets = text_buffer(texts)
            parts = [_judged(texts.slice(lo, hi - lo), min_words)[1:] for lo, hi in row_blocks(offsets)]
            if parts:
                some = pc.greater(pa.concat_arrays([runs for runs, _ in parts]).value_lengths(), 0)
                shorter = pa.concat_arrays([left for _, left in parts]).cast(batch.column(i).type)
                batch = batch.set_column(i, "text", pc.if_else(some, shorter, batch.column(i)))
            yield batch

    return docs.mapInArrow(released(run), docs.schema)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id, text: every text whose id's checksum divides by ten repeats itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = _words(F.col("text"))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), (F.ceil((n - a) / p)).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_period(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP13_SQL = r"""
WITH step AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i))),
split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, CAST(i + 1 AS BIGINT), 1))::BIGINT)),
      lambda a, x: xor(a >> 8, crc[1 + (xor(a, x) & 255)])), 4294967295) AS h FROM documents, step),
sized AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM split),
docs AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w FROM sized),
words AS (SELECT doc_id, n, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM docs),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS d FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
found AS (SELECT doc_id, min(i) AS start, count(*) + d AS length, d FROM (SELECT doc_id, i, d, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, d, island HAVING count(*) + d >= greatest(12, 2 * d)),
runs AS (SELECT doc_id, start, length, min(d) AS period FROM found GROUP BY ALL),
best AS (SELECT doc_id, count(*) AS n_runs, arg_max({'start': start, 'length': length, 'period': period}, (length, -start, -period)) AS b,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op13_periodic_runs": OP13_SQL}
