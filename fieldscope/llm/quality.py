"""Quality classifier by co-training.

Two views of a document that share no number are told apart: its content (hashed character n-grams, and how often a word repeats
the one before) and its page metadata (language, source, length, mean word length, and as the page's layout the shares of kinds of
characters). Each has a logistic
regression, calibrated on labelled documents held out. In every round both score all unlabelled documents, and all of which a
view is sure, good and bad, join the other view's training set with the label it gave; copies of a text count as one text
together. Spark sums their features exactly, in bags by the hash of the text, and the means of the bags are the rows that are
trained on, so the driver gets a few rows however many texts there are. At the end the views' calibrated log-odds are
combined for the score of every document.

A fit reads at most ``per_class`` labelled documents of either class; rounds score and learn from the whole table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm.common import WHITE, bound_batches, materialize, released, row_blocks, table, text_buffer, trim
from fieldscope.llm.hashing import gram_counts, gram_sums, pieces

SIZES, BITS = (3, 4), 14
#: Sums of features are whole numbers of this unit, so they do not depend on partitions.
UNIT, CHUNK = 2.0**-32, 1024
#: As many counts of repeated texts are broadcast at most.
MOST_BROADCAST = 1 << 21
_KINDS = (
    ("upper", [*range(65, 91)]), ("digit", [*range(48, 58)]), ("space", [32, 9, 13]), ("line", [10]), ("stop", [33, 44, 46, 58, 59, 63]),
    ("symbol", [*range(35, 39), 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]), ("bar", [124]), ("wide", [*range(128, 256)]),
)
N_PLAIN, N_HASHED = len(_KINDS) + 2, 64
_KIND_OF = np.array([sum((c + 1) * (b in values) for c, (_, values) in enumerate(_KINDS)) for b in range(256)], dtype=np.uint8)


_MARKS = (np.arange(256, dtype=np.uint32) + 7) ** 2 * np.uint32(2654435761)


def repeats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words per row, and how many of them have the length and the letters of the word before."""
    data, off = text_buffer(column)
    n = len(off) - 1
    words, same = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for lo, hi in row_blocks(off):
        for begin in range(off[lo], max(off[hi], off[lo] + 1), 1 << 22):  # a very long text goes in pieces
            end = min(begin + (1 << 22), off[hi])
            part, at = data[begin:end], np.clip(off[lo : hi + 1], begin, end) - begin
            if not len(part):
                continue
            white, inner = WHITE[part], at[(at > 0) & (at < len(part))]
            before, after = np.append(True, white[:-1]), np.append(white[1:], True)
            before[inner], after[inner - 1] = True, True
            starts, ends = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
            run = np.concatenate([np.zeros(1, np.uint32), np.cumsum(_MARKS[part], dtype=np.uint32)])
            mark = (run[ends] - run[starts]).astype(np.int64) * 4096 + (ends - starts) % 4096
            equal = np.concatenate([[0], np.cumsum(np.append(False, mark[1:] == mark[:-1]))]) if len(mark) else np.zeros(1, np.int64)
            place = np.searchsorted(starts, at)
            words[lo:hi] += np.diff(place)
            same[lo:hi] += equal[place[1:]] - equal[np.minimum(place[:-1] + 1, place[1:])]
    return words, same


def metadata(column: pa.Array, langs: list, sources: list, words: np.ndarray) -> np.ndarray:
    """One row of numbers per document; lang and source are hashed into N_HASHED columns. words: their number (repeats)."""
    data, off = text_buffer(column)
    size = np.diff(off).astype(np.float64)
    out = np.zeros((len(size), N_PLAIN + N_HASHED))
    for i, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        kind = _KIND_OF[data[s:e]]
        out[i, : len(_KINDS)] = [np.count_nonzero(kind == c) for c in range(1, len(_KINDS) + 1)]
    out[:, : len(_KINDS)] /= np.maximum(size, 1)[:, None]
    out[:, len(_KINDS)] = np.log1p(size) / 10
    out[:, len(_KINDS) + 1] = np.where(words > 0, size / np.maximum(words, 1), 0) / 10
    for mark, values in (("l", langs), ("s", sources)):
        for i, v in enumerate(values):
            out[i, N_PLAIN + zlib.crc32(f"{mark}:{v}".encode()) % N_HASHED] += 0.1
    return out


class Dense:
    """A matrix of few columns."""

    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.width), self.most = x, x.shape, float(np.abs(x).max(initial=1e-9))

    def times(self, v: np.ndarray) -> np.ndarray:
        return self.x @ v

    def back(self, e: np.ndarray) -> np.ndarray:
        return self.x.T @ e

    def squares(self) -> np.ndarray:
        return (self.x**2).sum(axis=0)


class Sparse:
    """A matrix by its entries (columns and values of each row) that aren't zero; every row has one at least."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        sizes = [len(at) for at, _ in rows]
        self.n, self.width, self.start = len(rows), width, np.cumsum([0, *sizes[:-1]])
        self.sizes = sizes
        self.at, self.value = (np.concatenate([r[i] for r in rows]).astype(t) for i, t in ((0, np.int32), (1, np.float32)))
        self.most = float(self.value.max(initial=1e-9))

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.value * v.astype(np.float32)[self.at], self.start).astype(np.float64)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=self.value * np.repeat(e.astype(np.float32), self.sizes), minlength=self.width)

    def squares(self) -> np.ndarray:
        return np.bincount(self.at, weights=self.value.astype(np.float64) ** 2, minlength=self.width)


def logistic(x: Dense | Sparse, y: np.ndarray, weight: np.ndarray, rounds: int = 300, ridge: float = 1e-3, rate: float = 1.0, standard: bool = False) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by scaled gradient steps; classes count alike. standard: on columns of mean 0 and spread 1, without making them."""
    mean, spread = np.zeros(x.width), np.ones(x.width)
    if standard:
        mean = x.back(np.ones(x.n)) / x.n
        spread = np.sqrt(np.maximum(x.squares() / x.n - mean**2, 0)) + 1e-3 * x.most + 1e-9
    w, b, seen, seen_b = np.zeros(x.width), 0.0, np.full(x.width, 1e-8), 1e-8
    weight = weight / np.where(y > 0.5, max(1e-9, weight[y > 0.5].sum()), max(1e-9, weight[y <= 0.5].sum()))
    for _ in range(rounds):
        v = w / spread
        error = weight * (1 / (1 + np.exp(-np.clip(x.times(v) - mean @ v + b, -40, 40))) - y)
        grad, grad_b = (x.back(error) - mean * error.sum()) / spread + ridge * w, error.sum()
        seen += grad**2
        seen_b += grad_b**2
        w -= rate * grad / np.sqrt(seen)
        b -= rate * grad_b / np.sqrt(seen_b)
    return w / spread, float(b - mean @ (w / spread))


@dataclass
class View:
    """A linear view: x w + bias; calibration turns it into log-odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def fit_view(x: Dense | Sparse, y: np.ndarray, weight: np.ndarray) -> View:
    return View(*logistic(x, y, weight, rate=0.05, standard=True))


@dataclass
class QualityModel:
    """content[-1] weighs the repeated words, the rest the n-gram buckets; size fixed by BITS and N_HASHED."""

    content: View
    page: View
    prior: float
    rounds: list = field(default_factory=list)

    def scores(self, column: pa.Array, langs: list, sources: list) -> tuple[np.ndarray, np.ndarray]:
        return self.views(column, langs, sources)[:2]

    def views(self, column: pa.Array, langs: list, sources: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores of both views, and the features that are no n-grams: the share of repeated words, and the metadata."""
        total, count = gram_sums(*text_buffer(column), SIZES, BITS, self.content.weights[:-1, None].astype(np.float32))
        words, same = repeats(column)
        repeated, meta = same / np.maximum(words, 1), metadata(column, langs, sources, words)
        content = total[:, 0] / np.maximum(count, 1) + self.content.weights[-1] * repeated + self.content.bias
        return content, self.page.score(meta), repeated, meta

    def sure(self, view: View, score: np.ndarray, confidence: float) -> np.ndarray:
        """1 and 0 where the view alone is sure of good and bad, -1 elsewhere."""
        p = 1 / (1 + np.exp(-np.clip(view.slope * score + view.shift - self.prior, -40, 40)))
        return np.where(p >= confidence, 1, np.where(p <= 1 - confidence, 0, -1))

    def combine(self, content: np.ndarray, page: np.ndarray) -> np.ndarray:
        """The probability of good: both calibrated log-odds, and the odds of the labels."""
        odds = self.content.slope * content + self.content.shift + self.page.slope * page + self.page.shift - self.prior
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _features(docs: DataFrame) -> list[tuple]:
    """(doc_id, quality, columns, values, meta) of each row of docs(doc_id, text, lang, source, quality), sorted; docs is bounded by its caller.

    columns and values are the entries of the content view: shares of n-gram buckets, and last the share of repeated words.
    """

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            data, off = text_buffer(column)
            grams = [gram_counts(data[off[i] : off[i + 1]], SIZES, BITS) for i in range(batch.num_rows)]
            words, same = repeats(column)
            meta = metadata(column, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), words)
            at = [np.append(g[0], 1 << BITS).astype(np.int32) for g in grams]
            share = [np.append(g[1] / max(1, g[1].sum()), r).astype(np.float32) for g, r in zip(grams, same / np.maximum(words, 1), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32())), pa.array(list(meta), pa.list_(pa.float64()))],
                names=["doc_id", "quality", "at", "share", "meta"],
            )

    got = docs.mapInArrow(released(run), "doc_id long, quality int, at array<int>, share array<float>, meta array<double>").toArrow()
    columns = [got.column(c).to_pylist() for c in ("doc_id", "quality")] + [[x.values.to_numpy() for x in got.column(c)] for c in ("at", "share", "meta")]
    return sorted(zip(*columns, strict=True), key=lambda r: (r[0], r[1]))


def weighed(docs: DataFrame, bags: int) -> DataFrame:
    """docs with weight and bag: all rows of one text have weight 1 together and are in one bag."""
    rows = docs.withColumn("_hash", F.xxhash64("text"))
    repeated = materialize(rows.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1"), "repeated-texts")
    if repeated.count() <= MOST_BROADCAST:
        repeated = F.broadcast(repeated)
    return rows.join(repeated, "_hash", "left").select(*docs.columns, (1.0 / F.coalesce("_n", F.lit(1))).alias("weight"), F.pmod("_hash", F.lit(bags)).cast("int").alias("bag"))


def _bag_grams(data: np.ndarray, off: np.ndarray, place: np.ndarray, weight: np.ndarray, places: int) -> np.ndarray:
    """Per place: the sum of weight times the shares of n-gram buckets, in units, of the rows with that place (none: -1)."""
    size = np.diff(off)
    each = np.rint(weight / np.maximum(sum(np.maximum(size - n + 1, 0) for n in SIZES), 1) / UNIT)
    out = np.zeros(places << BITS)
    for _, lo, first, last, code in pieces(data, off, SIZES, BITS):
        hi = lo + len(first)
        length = np.where(place[lo:hi] >= 0, last - first, 0)
        if not length.any():
            continue
        within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        at = code[np.repeat(first, length) + within].astype(np.int64) + (np.repeat(place[lo:hi], length) << BITS)
        out += np.bincount(at, weights=np.repeat(each[lo:hi], length), minlength=places << BITS)
    return out.reshape(places, 1 << BITS).astype(np.int64)


def lessons(rows: DataFrame, model: QualityModel, confidence: float, bags: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the view that learns: mean features, label and weight of texts of each bag of which the other view is sure.

    rows(text, lang, source, weight, bag). Two labels times bags come to the driver for each view at most.
    """
    places = 2 * bags

    def run(batches):
        number = {v: np.zeros(places, np.int64) for v in ("content", "page")}
        sums = {"content": np.zeros((places, (1 << BITS) + 1), np.int64), "page": np.zeros((places, N_PLAIN + N_HASHED), np.int64)}
        for batch in batches:
            column, weight, bag = batch.column("text"), batch.column("weight").to_numpy(), batch.column("bag").to_numpy()
            content, page, repeated, meta = model.views(column, batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for view, label in (("content", model.sure(model.page, page, confidence)), ("page", model.sure(model.content, content, confidence))):
                place = np.where(label >= 0, label * bags + bag, -1)
                some = np.flatnonzero(place >= 0)
                np.add.at(number[view], place[some], np.rint(weight[some] / UNIT).astype(np.int64))
                if view == "page":
                    np.add.at(sums[view], place[some], np.rint(meta[some] * weight[some, None] / UNIT).astype(np.int64))
                else:
                    sums[view][:, :-1] += _bag_grams(*text_buffer(column), place, weight, places)
                    np.add.at(sums[view][:, -1], place[some], np.rint(repeated[some] * weight[some] / UNIT).astype(np.int64))
        out = [(v, int(p), at, int(number[v][p]), sums[v][p, at : at + CHUNK]) for v in sums for p in np.flatnonzero(number[v]) for at in range(0, sums[v].shape[1], CHUNK)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["view", "place", "at", "n", "sums"])

    def total(part):
        return part.iloc[:1].assign(n=part["n"].sum(), sums=[np.sum(np.stack(part["sums"].to_list()), axis=0)])

    kinds = "view string, place int, at int, n long, sums array<long>"
    parts = rows.select("text", "lang", "source", "weight", "bag").mapInArrow(released(run), kinds)
    found: dict[tuple, tuple] = {}
    for r in sorted(parts.groupBy("view", "place", "at").applyInPandas(total, kinds).collect(), key=lambda r: (r["view"], r["place"], r["at"])):
        found.setdefault((r["view"], r["place"]), (r["n"], []))[1].extend(r["sums"])
    out = {}
    for view in ("content", "page"):
        mine = [(p, n, values) for (v, p), (n, values) in found.items() if v == view]
        if mine:
            x = np.array([np.array(values, np.float64) / n for _, n, values in mine])
            out[view] = (x, np.array([float(p >= bags) for p, _, _ in mine]), np.array([n * UNIT for _, n, _ in mine]))
    return out


def _calibrate(view: View, score: np.ndarray, y: np.ndarray) -> None:
    spread = score.std() + 1e-9
    w, b = logistic(Dense((score / spread)[:, None]), y, np.ones(len(y)), rounds=200, ridge=1e-2, rate=0.3)
    view.slope, view.shift = float(max(w[0], 0.0) / spread), float(b)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 600, rounds: int = 2, confidence: float = 0.9, bags: int = 16) -> QualityModel | None:
    """docs(doc_id, text, lang, source), labels(doc_id, quality 0 or 1). None without a label of both classes.

    Rows of labels with a null in either column are left out; of several labels of a doc_id the lowest counts. In a round all texts of which a
    view is sure by confidence weigh half as much as the labelled ones of that class.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.lit(5), "doc_id")
    sample = known.where("quality > 0").orderBy(order, "doc_id").limit(per_class).union(known.where("quality <= 0").orderBy(order, "doc_id").limit(per_class))
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in sample.collect()], "doc_id long, quality int")
    columns = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    told = columns.join(F.broadcast(sample), "doc_id")  # bounded by per_class; of rows that repeat a doc_id one teaches
    told = told.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "lang", "source")).alias("row"))
    rows = _features(told.select("doc_id", "row.text", "row.lang", "row.source", "quality"))
    y = np.array([r[1] for r in rows], dtype=np.float64)
    good, bad = known.agg(F.count_if(F.col("quality") > 0), F.count_if(F.col("quality") <= 0)).first()
    prior = float(np.log((bad + 1) / (good + 1)))  # views are fitted on classes that count alike
    if not len(y) or y.min() == y.max():
        return None
    content = [(r[2], r[3]) for r in rows]
    page = np.array([r[4] for r in rows]).reshape(len(rows), N_PLAIN + N_HASHED)
    test = np.arange(len(y)) % 4 == 0
    if len({*y[test]}) < 2 or len({*y[~test]}) < 2:
        test = np.zeros(len(y), bool)
    taught, check = np.flatnonzero(~test), np.flatnonzero(test if test.any() else ~test)
    sets = {"content": ([content[i] for i in taught], y[taught], np.ones(len(taught))), "page": (list(page[taught]), y[taught], np.ones(len(taught)))}
    check_content, check_page = Sparse([content[i] for i in check], (1 << BITS) + 1), page[check]

    def fitted(told: list) -> QualityModel:
        x, t, w = sets["content"]
        model_content = fit_view(Sparse(x, (1 << BITS) + 1), t, w)
        x, t, w = sets["page"]
        model = QualityModel(model_content, fit_view(Dense(np.array(x)), t, w), prior, told)
        _calibrate(model.content, check_content.times(model.content.weights) + model.content.bias, y[check])
        _calibrate(model.page, model.page.score(check_page), y[check])
        return model

    known_sets, model = dict(sets), fitted([])
    free = weighed(columns.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti"), bags)
    for _ in range(rounds):
        more = lessons(free, model, confidence, bags)
        if not more:
            break
        for name, (mean, label, n) in more.items():
            x, t, w = known_sets[name]
            own = np.where(label > 0.5, n * (t > 0.5).sum() / max(n[label > 0.5].sum(), UNIT), n * (t <= 0.5).sum() / max(n[label <= 0.5].sum(), UNIT))
            taken = list(mean) if name == "page" else [(np.arange(len(m)), m) for m in mean]
            sets[name] = (x + taken, np.concatenate([t, label]), np.concatenate([w, 0.5 * own]))
        model = fitted([*model.rounds, sum(float(n.sum()) for _, _, n in more.values())])
    del known_sets, content, page, sets, rows, taught, check_content
    trim()
    return model


def scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, content, page, score for each row of docs(doc_id, text, lang, source): raw scores of the views, and the probability of good."""

    def run(batches):
        for batch in batches:
            content, page = model.scores(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content), pa.array(page), pa.array(model.combine(content, page))], names=["doc_id", "content", "page", "score"])

    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(released(run), "doc_id long, content double, page double, score double")


def judge(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """doc_id, content, page, score, keep for every row of docs; keep is score >= cut.

    A null or empty text is scored like a text without n-grams and words; a null lang or source is a value of its own. Without labels of
    both classes all scores are null and all rows are kept. Repeated rows are scored alike; other columns are not read.
    """
    model = fit(docs, labels)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("content"), none.alias("page"), none.alias("score"), F.lit(True).alias("keep"))
    return scores(docs, model).withColumn("keep", F.col("score") >= cut)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of docs that judge keeps, with the columns of docs."""
    bound_batches(docs.sparkSession)
    model = fit(docs, labels)
    if model is None:
        return docs
    names = docs.columns

    def run(batches):
        for batch in batches:
            content, page = model.scores(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            yield batch.filter(pa.array(model.combine(content, page) >= cut))

    return docs.mapInArrow(released(run), docs.schema).select(*names)


def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_quality_cotraining": op6_quality_cotraining}
ORACLES: dict[str, str] = {}
