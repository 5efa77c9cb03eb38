"""Mixing to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents fall in cells of source, language and topic. Topics are learned: a spherical k-means on hashed words of all documents, after the
mean of each language is taken off, so that a topic is not just a language; every document is then assigned by its whole text. A round is one job over
the written word counts; sums are of whole numbers, so that they don't depend on partitions. Token counts per cell are raked until the kept tokens have the wanted shares
on all three marginals; a document is kept with its cell's probability. Values without a target share one class, so
there are never more cells than the targets allow, and only those come to the driver. Where the targets leave nothing for
that class, it keeps its share of the corpus' tokens and the targets divide the rest; its cells are then kept with a quarter
of the mean probability at least, also where the targets can't all be met.
"""

from __future__ import annotations

import contextlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm.common import bound_batches, dropped, materialize, released, table, trim, unused, word_blocks

OTHER = "(other)"
#: Least probability, relative to keep, in the cells of other values that the targets leave nothing.
LEAST_OTHER = 0.25
#: Wanted token shares; what they leave goes to all other values. These leave nothing, so other values keep their share of the corpus.
SOURCE_SHARES = {"src0": 0.2, **{f"src{i}": 0.8 / 19 for i in range(1, 20)}}
LANG_SHARES = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
#: Topics, hash buckets of words, and units of the summed numbers.
TOPICS, DIM, UNIT = 5, 1 << 12, float(1 << 20)
#: Counts of words that a row of packed texts holds, or those of one text.
PACK = 1 << 14


def tokens_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")).cast("long")


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and its square-rooted bucket counts with length 1 (all zero without words)."""
    n, x = np.zeros(len(column), np.int64), np.zeros((len(column), DIM), np.float32)
    for lo, hi, words, at in word_blocks(column):
        bucket = (words % np.uint64(DIM)).astype(np.int64)
        n[lo:hi] = np.diff(at)
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        x[lo:hi] = np.sqrt(np.bincount(row * DIM + bucket, minlength=(hi - lo) * DIM)).reshape(hi - lo, DIM)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-9)[:, None]
    return n, x


@dataclass
class TopicModel:
    """Centres of the topics and what each language's mean adds to them (languages without a target share one mean); sizes are the topics' documents."""

    centres: np.ndarray
    langs: dict[str | None, np.ndarray]
    sizes: np.ndarray

    def names(self) -> list[str]:
        return [f"topic{i}" for i in range(len(self.sizes))]

    def assign(self, x: np.ndarray, langs: list) -> np.ndarray:
        none = self.langs.get(OTHER, np.zeros(len(self.sizes), np.float32))
        return (x @ self.centres.T - np.array([self.langs.get(v, none) for v in langs]).reshape(len(x), len(self.sizes))).argmax(axis=1)

    def shares(self) -> dict[str, float]:
        """Wanted shares of the topics: their square-rooted sizes, so that a rare topic has more than its share."""
        root = np.sqrt(self.sizes + 1.0)
        return dict(zip(self.names(), (root / root.sum()).tolist(), strict=True))


def word_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """draw, lang (its place in langs, the number of them for all others), at, n: buckets of the words of a text and how often; written. Texts without words have no row."""

    def run(batches):
        for batch in batches:
            for lo, hi, words, at in word_blocks(batch.column(1)):
                key, n = np.unique(np.repeat(np.arange(hi - lo), np.diff(at)) * DIM + (words % np.uint64(DIM)).astype(np.int64), return_counts=True)
                offsets = np.searchsorted(key, np.arange(hi - lo + 1) * DIM).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (key % DIM, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], *lists], names=["draw", "lang", "at", "n"])

    number = F.coalesce(F.array_position(F.array(*map(F.lit, langs)), F.col("lang").cast("string")), F.lit(0))
    number = F.when(number > 0, number - 1).otherwise(len(langs)).cast("int").alias("lang")
    rows = docs.select(F.xxhash64(F.lit(17), "doc_id", "text").alias("draw"), "text", number)
    return materialize(rows.mapInArrow(released(run), "draw long, lang int, at array<int>, n array<int>").where("size(at) > 0"), "mixing-words")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lang of each text, and text, bucket and length-1 value of each of its counts."""
    row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
    bucket, n = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
    return batch.column(1).to_numpy(), row, bucket, np.sqrt(n) / np.sqrt(np.bincount(row, n, batch.num_rows))[row]


def _packed(counts: DataFrame, means: np.ndarray) -> DataFrame:
    """counts for the rounds, written: a row holds many texts as bytes (draw, lang, number of buckets, length, and 1 / length of each less its language's
    mean, 0 where nothing is left; all buckets, and how often, in as few bytes as hold them), which pass through the JVM as they are."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, row, bucket, x = _flat(batch)
            left = 1 - 2 * np.bincount(row, x * means[lang[row], bucket], batch.num_rows) + (means * means).sum(axis=1)[lang]
            scale = np.divide(1.0, np.sqrt(np.maximum(left, 0)), out=np.zeros(len(left)), where=left > 1e-6)
            n = batch.column(3).flatten().to_numpy()
            size, draw, length = batch.column(2).value_lengths().to_numpy(), batch.column(0).to_numpy(), np.sqrt(np.bincount(row, n, batch.num_rows))
            at, lo = np.concatenate([[0], np.cumsum(size)]), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PACK, side="right")) - 1)
                s, e = at[lo], at[hi]
                often = n[s:e].astype(np.min_scalar_type(n[s:e].max()))
                cells = (draw[lo:hi], lang[lo:hi].astype(np.int8), size[lo:hi].astype(np.int32), length[lo:hi], scale[lo:hi], bucket[s:e].astype(np.uint16), often)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=[*_PACKED, "n"])
                lo = hi

    return materialize(counts.mapInArrow(released(run), ", ".join(f"{c} binary" for c in (*_PACKED, "n"))), "mixing-packed")


_PACKED = {"draw": np.int64, "lang": np.int8, "size": np.int32, "length": np.float64, "scale": np.float64, "bucket": np.uint16}
#: Square roots of the counts that mostly come.
_ROOTS = np.sqrt(np.arange(256.0))
#: Rows of a batch of packed texts, which are large: in the readers of the written table, and on their way to Python.
_PACKED_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 16, "spark.sql.parquet.columnarReaderBatchSize": 16}


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """Batches of a few rows for the jobs that run meanwhile."""
    before = {key: spark.conf.get(key) for key in _PACKED_ROWS}
    try:
        for key, rows in _PACKED_ROWS.items():
            spark.conf.set(key, min(rows, int(before[key])) if int(before[key]) > 0 else rows)
        yield
    finally:
        for key, rows in before.items():
            spark.conf.set(key, rows)


def _texts(batch: pa.RecordBatch):
    """draw, lang, size, scale, bucket, value of the texts in each row of a batch of _packed."""
    for i in range(batch.num_rows):
        draw, lang, size, length, scale, bucket = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate(_PACKED.values()))
        often = batch.column(len(_PACKED))[i].as_buffer()
        often = np.frombuffer(often, f"u{often.size // len(bucket)}")
        value = _ROOTS[often] if often.itemsize == 1 else np.sqrt(often.astype(np.float64))
        value = value / np.repeat(length, size) * np.repeat(scale, size)
        yield draw, lang.astype(np.int64), size, scale, bucket.astype(np.int64), value


def _cosines(texts: tuple, offsets: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cosines of texts less their language's mean to the centres; offsets: the means' products with these."""
    _, lang, size, scale, bucket, value = texts
    first = np.cumsum(size) - size  # no text is without buckets
    dots = np.array([np.add.reduceat(value * c[bucket], first) for c in centres]).reshape(len(centres), len(lang)).T
    return dots - offsets[lang] * scale[:, None]


def _summed(counts: DataFrame, of, shape: tuple[int, int], parts=_texts) -> np.ndarray:
    """The sum of arrays of whole numbers of one shape, that of gives for each of the parts of a batch; only cells that are not 0 are shuffled."""
    cells = shape[0] * shape[1]

    def run(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for texts in parts(batch):
                total += of(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "s"])

    got = counts.mapInArrow(released(run), "cell long, s long").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()  # DIM numbers a topic or language
    out = np.zeros(cells, np.int64)
    out[got.column("cell").to_numpy()] = got.column("s").to_numpy()
    return out.reshape(shape) / UNIT


def _next_centre(packed: DataFrame, means: np.ndarray, centres: np.ndarray) -> np.ndarray | None:
    """The text drawn by its squared distance from the nearest centre (by a hash, so always the same one), less its language's mean, at length 1."""
    offsets = means @ centres.T

    def run(batches):
        for batch in batches:
            for texts in _texts(batch):
                draw, lang, size, scale, bucket, value = texts
                u = ((draw.view(np.uint64) >> np.uint64(11)) + 0.5) / float(1 << 53)
                far = np.maximum(1 - _cosines(texts, offsets, centres).max(axis=1), 1e-9) if len(centres) else np.ones(len(draw))
                order = np.where(scale > 0, -np.log(u) / far**2, np.inf)
                i = int(order.argmin())
                if np.isfinite(order[i]):
                    e = int(size[: i + 1].sum())
                    lists = [[bucket[e - size[i] : e]], [value[e - size[i] : e] / scale[i]]]
                    yield pa.RecordBatch.from_arrays([pa.array(order[i : i + 1]), pa.array(draw[i : i + 1]), pa.array(lang[i : i + 1], pa.int32()), pa.array(lists[0], pa.list_(pa.int32())), pa.array(lists[1], pa.list_(pa.float64()))], names=["o", "draw", "lang", "at", "x"])

    least = packed.mapInArrow(released(run), "o double, draw long, lang int, at array<int>, x array<double>").agg(F.min(F.struct("o", "draw", "lang", "at", "x")).alias("m")).first().m
    if least is None:
        return None
    y = -means[least.lang]
    y[least.at] += np.array(least.x)
    return y / np.sqrt((y * y).sum())


def fit_topics(docs: DataFrame, sample: int | None = None, topics: int = TOPICS, rounds: int = 20) -> TopicModel:
    """Spherical k-means of all documents of docs(doc_id, text, lang) with words; topics are numbered by size, the largest first.

    Every document teaches once however often it occurs. sample: only so many are looked at, chosen by a hash of doc_id and text.
    """
    langs = list(LANG_SHARES)
    counts = word_counts(docs.where("text is not null"), langs)
    if not counts.groupBy("draw").count().where("count > 1").isEmpty():
        counts = materialize(counts.dropDuplicates(["draw"]), "mixing-words")
    if sample is not None:
        counts = materialize(counts.orderBy("draw").limit(sample), "mixing-words")
    groups = len(langs) + 1

    def by_lang(batch):
        lang, row, bucket, x = _flat(batch)
        sums = np.bincount(lang[row] * (DIM + 1) + bucket, np.rint(x * UNIT), groups * (DIM + 1))
        sums += np.bincount(lang * (DIM + 1) + DIM, np.full(len(lang), UNIT), groups * (DIM + 1))
        return sums.astype(np.int64)

    sums = _summed(counts, by_lang, (groups, DIM + 1), lambda batch: [batch] if batch.num_rows else [])
    means = sums[:, :DIM] / np.maximum(sums[:, DIM:], 1)
    packed, centres = _packed(counts, means), np.zeros((0, DIM))
    with _small_batches(docs.sparkSession):
        while len(centres) < topics and (c := _next_centre(packed, means, centres)) is not None and not (centres == c).all(axis=1).any():
            centres = np.concatenate([centres, c[None]])
    if not len(centres):
        return TopicModel(np.zeros((1, DIM), np.float32), {}, np.array([int(sums[:, DIM].sum())]))
    wide = DIM + groups + 1  # a topic's words, what of each language is in it, and its texts

    def by_topic(centres):
        offsets = means @ centres.T

        def of(texts):
            _, lang, size, scale, bucket, value = texts
            own = _cosines(texts, offsets, centres).argmax(axis=1) * wide
            out = np.bincount(np.repeat(own, size) + bucket, np.rint(value * UNIT), len(centres) * wide)
            out += np.bincount(own + DIM + lang, np.rint(scale * UNIT), len(out)) + np.bincount(own + wide - 1, np.full(len(own), UNIT), len(out))
            return out.astype(np.int64)

        with _small_batches(docs.sparkSession):
            return _summed(packed, of, (len(centres), wide))

    for i in range(rounds + 1):
        sums = by_topic(centres)
        sizes = sums[:, -1].astype(np.int64)
        y = sums[:, :DIM] - sums[:, DIM:-1] @ means
        length = np.sqrt((y * y).sum(axis=1))[:, None]
        moved = np.where(length > 1e-9, y / np.maximum(length, 1e-9), centres)
        if i == rounds or (moved == centres).all():
            break
        centres = moved
    dropped(packed, counts)
    order = np.argsort(-sizes, kind="stable")
    offsets = (means @ centres[order].T).astype(np.float32)
    trim()
    return TopicModel(centres[order].astype(np.float32), dict(zip([*langs, OTHER], offsets, strict=True)), sizes[order])


def rake(tokens: np.ndarray, shares: list[np.ndarray], keep: float, rounds: int = 500, tolerance: float = 1e-9, least: np.ndarray | float = 0.0) -> np.ndarray:
    """Kept tokens of each cell: marginals in the proportions of shares, keep times all tokens in sum, and no cell above its tokens or below least.

    Each round rakes every axis in turn and then trims the cells to what they hold. Where the targets can't all be met (a class without
    tokens, or fewer than wanted), the last round's trimmed weights stand, as near as the rounds came.
    """
    goal = keep * tokens.sum()
    kept = tokens * keep
    for _ in range(rounds if goal > 0 else 0):
        before = kept
        for axis, share in enumerate(shares):
            others = tuple(a for a in range(tokens.ndim) if a != axis)
            have = kept.sum(axis=others)
            there = share * (tokens.sum(axis=others) > 0)
            want = goal * there / max(there.sum(), 1e-300)
            factor = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            kept = kept * np.expand_dims(factor, others)
        kept = np.clip(kept, least, tokens)
        if np.abs(kept - before).max() <= tolerance * goal:
            break
    return kept


def _class(column: str, names: list[str]) -> Column:
    value = F.col(column).cast("string")
    return F.when(value.isin(names), value).otherwise(OTHER)


def cells(docs: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Tokens and documents of each cell: one row per combination of target values at most."""
    axes = list(targets)
    rows = docs.select(*(_class(a, list(t)).alias(a) for a, t in targets.items()), "tokens")
    return rows.groupBy(*axes).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))


def _leaves_nothing(targets: Mapping[str, float]) -> bool:
    return sum(targets.values()) >= 1 - 1e-9


def shares_of(targets: Mapping[str, float], tokens: np.ndarray) -> np.ndarray:
    """Wanted shares of an axis' classes, the class of all other values last; tokens are the classes' own.

    Other values get what the targets leave. Where that is nothing, they keep their share of all tokens, and the targets are scaled to the rest.
    """
    named = np.array([*targets.values()], dtype=np.float64)
    rest = 1 - named.sum()
    if _leaves_nothing(targets):
        rest = tokens[-1] / max(tokens.sum(), 1)
        named = named * (1 - rest) / max(named.sum(), 1e-300)
    return np.append(named, rest)


def probabilities(found: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float) -> DataFrame:
    """The cells with weight (kept over all tokens, relative to keep) and probability."""
    names = [[*t, OTHER] for t in targets.values()]
    tokens = np.zeros([len(n) for n in names])
    rows = found.collect()
    at = [tuple(n.index(r[i]) for i, n in enumerate(names)) for r in rows]
    for place, r in zip(at, rows, strict=True):
        tokens[place] = r["tokens"]
    shares = [shares_of(t, tokens.sum(axis=tuple(a for a in range(tokens.ndim) if a != axis))) for axis, t in enumerate(targets.values())]
    least = np.zeros_like(tokens)
    for axis, t in enumerate(targets.values()):
        if _leaves_nothing(t):
            other = (*(slice(None),) * axis, -1)
            least[other] = LEAST_OTHER * keep * tokens[other]
    kept = rake(tokens, shares, keep, least=least)
    p = np.divide(kept, tokens, out=np.full_like(tokens, keep), where=tokens > 0)
    data = [(*(r[i] for i in range(len(names))), float(p[place] / keep) if keep else 0.0, float(p[place])) for place, r in zip(at, rows, strict=True)]
    kind = ", ".join(f"{a} string" for a in targets)
    return found.sparkSession.createDataFrame(data, f"{kind}, weight double, probability double")


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float = 0.5, seed: int = 1) -> DataFrame:
    """Adds weight, probability and kept to docs(doc_id, tokens, and a column for each target).

    kept follows from seed and doc_id alone, so repeated rows and reruns agree; a null doc_id is a value like another. A null in a target
    column, or a value without a target, is of the class of all others, which is never emptied (shares_of). Documents without tokens are kept with their cell's probability.
    An empty table stays empty.
    """
    p = probabilities(cells(docs, targets), targets, keep)
    names = dict(zip(targets, unused(docs, *(f"_{a}" for a in targets)), strict=True))
    keys = [_class(a, list(t)).eqNullSafe(F.col(names[a])) for a, t in targets.items()]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    small = p.select(*(F.col(a).alias(n) for a, n in names.items()), "weight", "probability")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    return docs.drop("weight", "probability", "kept").join(F.broadcast(small), on, "left").drop(*names.values()).withColumn("kept", draw < F.col("probability"))


def described(docs: DataFrame, model: TopicModel) -> DataFrame:
    """doc_id, source, lang, topic, tokens of docs(doc_id, text, lang, source), each text read once; written. A text without words has the first topic."""

    def run(batches):
        names = np.array(model.names())
        for batch in batches:
            n, x = word_rows(batch.column(3))
            topic = names[np.where(n > 0, model.assign(x, batch.column(2).to_pylist()), 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(topic, pa.string()), pa.array(n)], names=["doc_id", "source", "lang", "topic", "tokens"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return materialize(rows.mapInArrow(released(run), "doc_id long, source string, lang string, topic string, tokens long"), "mixing-rows")


def targets_of(model: TopicModel) -> dict[str, dict[str, float]]:
    return {"source": SOURCE_SHARES, "lang": LANG_SHARES, "topic": model.shares()}


def sample_documents(docs: DataFrame, keep: float = 0.5, seed: int = 1) -> DataFrame:
    """The documents that the mix keeps, with the columns of docs."""
    bound_batches(docs.sparkSession)
    model = fit_topics(docs)
    targets = targets_of(model)
    p = probabilities(cells(described(docs, model), targets), targets, keep)
    chance = {(r.source, r.lang, int(r.topic.removeprefix("topic"))): r.probability for r in p.collect()}  # a row for each cell of the targets
    source, lang, draw = unused(docs, "source_class", "lang_class", "draw")
    names = docs.columns
    rows = docs.withColumns({source: _class("source", list(SOURCE_SHARES)), lang: _class("lang", list(LANG_SHARES)), draw: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)})
    lang_at = rows.columns.index("lang")

    def run(batches):
        for batch in batches:
            n, x = word_rows(batch.column("text"))
            known = batch.column(lang_at).cast(pa.string()).to_pylist()
            topic = np.where(n > 0, model.assign(x, known), 0).tolist()
            own = [chance[cell] for cell in zip(batch.column(source).to_pylist(), batch.column(lang).to_pylist(), topic, strict=True)]
            yield batch.filter(pa.array(batch.column(draw).to_numpy() < np.array(own))).select(names)

    return rows.mapInArrow(released(run), docs.schema).select(*names)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_topics(docs)
    return mix(described(docs, model), targets_of(model))


QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLES: dict[str, str] = {}
