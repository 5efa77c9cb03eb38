"""Language ID: averaged hashed subword embeddings with a linear softmax.

The subwords are byte n-grams of the folded text, hashed into 2**bits rows. Training runs in numpy on a sample that is
bounded per language; the embedding and the softmax are linear, so scoring needs one table of 2**bits by languages and
one pass over each whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm.common import released, table, text_buffer
from fieldscope.llm.hashing import fold_letters, gram_counts, gram_sums

SIZES, BITS = (3, 4), 15


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # 2**bits by languages
    bias: np.ndarray
    temperature: float
    cut: float
    sizes: tuple[int, ...] = SIZES
    bits: int = BITS

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = gram_sums(fold_letters(data), offsets, self.sizes, self.bits, self.weights.astype(np.float32))
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, str]], width: int = 16, epochs: int = 6, rate: float = 0.3, seed: int = 3, reject: float = 0.005) -> LanguageModel | None:
    """Stochastic gradient descent with steps scaled per weight; every fifth sample calibrates the temperature and the cut.

    cut is the probability under which a share of ``reject`` of the rightly told calibration texts falls.
    """
    langs = sorted({lang for _, _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    emb, emb_seen = rng.normal(0, 0.1, (1 << BITS, width)), np.full((1 << BITS, width), 1e-8)
    out, out_seen = np.zeros((width, len(langs))), np.full((width, len(langs)), 1e-8)
    bias, target = np.zeros(len(langs)), {lang: i for i, lang in enumerate(langs)}
    learn = [s for i, s in enumerate(samples) if i % 5] or samples
    test = samples[::5]
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(learn)):
            at, n, lang = learn[i]
            share = (n / max(1, n.sum()))[:, None]
            hidden = (share * emb[at]).sum(axis=0)
            error = softmax(hidden @ out + bias)
            error[target[lang]] -= 1
            to_emb, to_out = share * (out @ error), np.outer(hidden, error)
            emb_seen[at] += to_emb**2
            out_seen += to_out**2
            emb[at] -= step * to_emb / np.sqrt(emb_seen[at])
            out -= step * to_out / np.sqrt(out_seen)
            bias -= 0.1 * step * error
    weights = emb @ out
    scores = np.array([(n / max(1, n.sum())) @ weights[at] + bias for at, n, _ in test])
    truth = np.array([target[lang] for _, _, lang in test])
    heat = min(np.geomspace(0.25, 8, 31), key=lambda t: -np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    told = softmax(scores / heat)
    right = told.argmax(axis=1) == truth
    cut = float(np.quantile(told.max(axis=1)[right], reject)) if right.any() else 0.0
    return LanguageModel(langs, weights, bias, float(heat), cut)


def fit(docs: DataFrame, per_lang: int = 400) -> LanguageModel | None:
    """From docs(doc_id, text, lang): about per_lang texts of each language, chosen by hash, with whole texts.

    Rows with a null text or lang, or a text without a letter, teach nothing. None where nothing is left to learn from.
    """
    rows = docs.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").count().select(F.col("lang").alias("_lang"), (F.lit(float(per_lang)) / F.col("count")).alias("_share"))
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(counts), F.col("lang") == F.col("_lang")).where(draw < F.col("_share"))  # counts has a row per language

    def grams(batches):
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            found = [gram_counts(fold_letters(data[off[i] : off[i + 1]]), SIZES, BITS) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.int64())), batch.column(2)],
                names=["doc_id", "at", "n", "lang"],
            )

    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.text", "row.lang")  # of rows that repeat a doc_id one teaches
    got = chosen.mapInArrow(grams, "doc_id long, at array<long>, n array<long>, lang string").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    return train([(np.array(a), np.array(n, dtype=np.float64), lang) for a, n, lang in zip(*(got.column(c).to_pylist() for c in ("at", "n", "lang")), strict=True)])


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row of docs(doc_id, text); only the text is judged.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or where there is no model; accepted is false
    there and where the score is below the model's cut.
    """
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(model is not None)

    def run(batches):
        names = np.array(model.langs) if model else np.array(["und"])
        for batch in batches:
            told = np.ones((batch.num_rows, 1)) if model is None else model.probabilities(*text_buffer(batch.column(1)))
            known = batch.column(2).to_numpy(zero_copy_only=False)
            best = told.argmax(axis=1)
            lang = np.where(known, names[best], "und")
            score = np.clip(np.where(known, told[np.arange(len(best)), best], 0.0), 0.0, 1.0)
            ok = known & (score >= (model.cut if model else 2.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(ok)], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(released(run), "doc_id long, lang_pred string, score double, accepted boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
