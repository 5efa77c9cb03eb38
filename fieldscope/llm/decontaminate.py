"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

An item window is a run of ``window`` words (a shorter item is one window). Its tokens are its word shingles.
For full containment the necessary prefix of a window is one token, so each window is represented by its rarest
shingle in the corpus: documents' shingles are joined with those, the window's place in the document follows from
the shingle's place in the window (length and positional bounds), and the words are compared there.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import LOWER_AZ, UPPER, lower_az, materialize, table

#: Bytes of benchmark windows, with their words and tokens, that a broadcast may hold.
BROADCAST_BYTES = 32 << 20
#: Occurrences of one token that a task may get in the join that does without a broadcast.
SALT_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; null has none."""
    parts = F.split(lower_az(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _shingle(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *(F.get(words, at + j) for j in range(k)))


def item_windows(benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """item_id, words (of one window), n: distinct windows of all items."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return items.select("item_id", F.explode(starts).alias("at"), "all").select("item_id", F.slice("all", F.col("at"), window).alias("words")).distinct().withColumn("n", F.size("words"))


def _tokens(rows: DataFrame, words: str, k: int) -> DataFrame:
    """rows with place and token for each shingle of k words; the row's words stay beside them.

    What follows (a join with a small side, a narrow projection) is fused with the generator, so a long text's words are never copied for
    each of its places; that also holds for unions, which therefore come after.
    """
    each = rows.select("*", F.posexplode_outer(words).alias("place", "_word")).drop("_word")
    return each.where(F.col("place") + k <= F.size(words)).withColumn("token", _shingle(words, F.col("place"), k))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, item_id, start, n: the places of item windows in docs, repeated rows together."""
    windows = materialize(item_windows(benchmark, window, shingle), "windows")
    sizes = sorted({min(shingle, r.n) for r in windows.select("n").distinct().collect()})  # at most window values
    if not sizes:
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("n")).where(F.lit(False))
    fits = lambda k: F.col("n") >= shingle if k == shingle else F.col("n") == k  # noqa: E731  a window's tokens are of the one size that fits it
    parts = materialize(_union([_tokens(windows.where(fits(k)), "words", k) for k in sizes]), "window-tokens")
    small = (parts.agg(F.sum(F.length(F.array_join("words", " ")) * 4 + 64)).first()[0] or 0) <= BROADCAST_BYTES
    near = F.broadcast if small else (lambda df: df)

    texts = docs.select("doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("doc_words"))
    wanted = near(parts.select("token").distinct())
    counts = _union([_tokens(texts.select("doc_words"), "doc_words", k).select("token").join(wanted, "token", "left_semi") for k in sizes]).groupBy("token").agg(F.count("*").alias("seen"))
    rarest = (
        parts.join(materialize(counts, "token-counts"), "token", "left")
        .groupBy("item_id", "words", "n")
        .agg(F.min_by(F.struct("token", "place"), F.struct(F.coalesce("seen", F.lit(0)), "token", "place")).alias("first"), F.min(F.coalesce("seen", F.lit(0))).alias("least"))
        .where("least > 0")  # a token that no document has: the window is in none
        .select("item_id", "words", "n", "least", "first.token", F.col("first.place").alias("offset"))
    )
    rarest = materialize(rarest, "rarest-tokens")

    def places(k: int) -> DataFrame:
        tokens = _tokens(texts, "doc_words", k).withColumnRenamed("place", "at").withColumns({"total": F.size("doc_words"), "skipped": F.lit(0)})
        mine = rarest.where(fits(k))
        if small:
            pairs = tokens.join(F.broadcast(mine), "token")
        else:
            # both sides are dealt by token and a salt, so a frequent token is not one task; only the words around a token travel. A token has as
            # many salts as keep SALT_ROWS of its occurrences together
            around = F.greatest(F.col("at") - window + 1, F.lit(0))
            local = tokens.select("doc_id", "text_hash", "token", "at", "total", around.alias("skipped"), F.slice("doc_words", around + 1, F.lit(2 * window)).alias("doc_words"))
            crowded = mine.groupBy("token").agg(F.max("least").alias("least")).where(F.col("least") > SALT_ROWS)
            salts = {r.token: int(r.least // SALT_ROWS) + 1 for r in crowded.collect()}  # fewer than occurrences / SALT_ROWS
            known = F.from_json(F.lit(json.dumps(salts)), "map<string,int>")
            number = F.coalesce(F.try_element_at(known, F.col("token").cast("string")), F.lit(1)) if salts else F.lit(1)
            pairs = local.withColumn("salt", F.pmod(F.xxhash64("text_hash", "at"), number).cast("int")).join(
                mine.withColumn("salt", F.explode(F.sequence(F.lit(0), number - 1))), ["token", "salt"]
            )
        start = F.col("at") - F.col("offset")
        inside = (start >= 0) & (start + F.col("n") <= F.col("total"))
        there = F.slice("doc_words", F.greatest(start - F.col("skipped"), F.lit(0)) + 1, F.col("n")) == F.col("words")
        return pairs.where(inside & there).select("doc_id", "text_hash", "item_id", start.alias("start"), "n")

    return materialize(_union([places(k) for k in sizes]), "occurrences")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, item_ids: one row per row of docs.

    n_hit counts the words inside any occurrence of an item window. Null and empty texts have no words and no
    hits; rows that repeat are judged alike; rows with a null doc_id are kept. Only doc_id, text and item_id, text are
    read, so other columns may have any name. An empty benchmark hits nothing.
    """
    found = occurrences(docs, benchmark, window, shingle)
    spans = found.groupBy("doc_id", "text_hash", "start").agg(F.max("n").alias("n"))
    w = Window.partitionBy("doc_id", "text_hash").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("start") + F.col("n") - F.greatest("start", F.coalesce(F.max(F.col("start") + F.col("n")).over(w), F.lit(0))), F.lit(0))
    hits = spans.withColumn("fresh", fresh).groupBy("doc_id", "text_hash").agg(F.sum("fresh").alias("n_hit"))
    items = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    marks = hits.join(items, (hits.doc_id.eqNullSafe(items.doc_id)) & (hits.text_hash == items.text_hash)).select(hits.doc_id.alias("_id"), hits.text_hash.alias("_hash"), "n_hit", "item_ids")
    base = docs.select("doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return base.join(marks, base.doc_id.eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """docs without the rows that hold an item window; the columns of docs."""
    found = occurrences(docs, benchmark, window, shingle).select("doc_id", "text_hash").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["text_hash"]), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = f"translate(text, '{UPPER}', '{LOWER_AZ}')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all({_LOW}, '{_PATTERN}') END AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_PATTERN}') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
),
hit AS (SELECT doc_id, s, n, item_id FROM grams JOIN win USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": OP3_SQL}
