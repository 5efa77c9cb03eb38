"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components.

Vectors of one label are hashed by the signs of ``bits`` hyperplanes in ``tables`` tables; both follow from the
largest label's size and the cut, so that a bucket of unrelated vectors stays near ``bucket_rows`` and a pair at
the cut is missed with probability ``miss`` at most. A bucket that is larger all the same is cut into tiles of
``tile_rows``; tile pairs are compared as matrix products. A tile gives one row per vector (its number of links
there and its local component), never the pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.llm.common import materialize, table
from fieldscope.llm.components import connected_components

BUCKET_ROWS, TILE_ROWS = 256, 1024


def plan_tables(largest: int, cut: float, miss: float, bucket_rows: int = BUCKET_ROWS) -> tuple[int, int]:
    """(bits, tables): bits from the largest label's rows, tables from the chance that a pair at the cut shares all signs."""
    bits = min(40, max(4, math.ceil(math.log2(max(1, largest / bucket_rows)))))
    same = (1 - math.acos(cut) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


@lru_cache(maxsize=4)
def planes(width: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, width)).standard_normal((width, bits * tables))


def local_components(adjacent: np.ndarray) -> np.ndarray:
    """The smallest row index that each row reaches in a symmetric boolean matrix with a true diagonal."""
    root = np.argmax(adjacent, axis=1)
    while True:
        low = np.array([root[row].min() for row in adjacent]) if len(root) < 64 else np.where(adjacent, root[None, :], len(root)).min(axis=1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_duplicates(vectors: DataFrame, cut: float = 0.98, miss: float = 1e-4, seed: int = 7, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors(vec_id, embedding, label).

    Only vectors of equal, non-null label and equal width are compared. A vector that is null or zero, or holds a null or
    non-finite component, and a row with a null vec_id, links with nothing. Equal vectors are compared once and counted as often
    as they occur. Rows that repeat a vec_id are one node but count as rows in n_links. Other columns are not read.
    """
    values = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.aggregate(values, F.lit(True), lambda a, x: a & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    length = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    usable = F.coalesce(fine & (length > 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", "label", "embedding").withColumn("usable", usable)
    classes = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, cut, miss)

    def buckets_of(x: np.ndarray, width: int) -> np.ndarray:
        return ((x @ planes(width, bits, tables, seed) > 0).reshape(len(x), tables, bits) << np.arange(bits, dtype=np.int64)).sum(axis=2)

    def signs(batches):
        for pdf in batches:
            out = [None] * len(pdf)
            sizes = pdf["embedding"].map(len)
            for width, group in pdf.groupby(sizes):
                x = np.stack(group["embedding"].to_numpy()).astype(np.float64)
                for at, buckets in zip(pdf.index.get_indexer(group.index), buckets_of(x, width), strict=True):
                    out[at] = buckets
            yield pdf.assign(buckets=out)

    kind = classes.schema["embedding"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    hashed = classes.mapInPandas(signs, f"label {label}, embedding {kind}, rep long, copies long, buckets array<long>")
    placed = hashed.select("label", "embedding", "rep", "copies", F.posexplode("buckets").alias("table_no", "bucket")).withColumn("width", F.size("embedding"))
    key = ["label", "width", "table_no", "bucket"]
    filled = materialize(placed.groupBy(*key).agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")), "vector-buckets")
    # rows that all tasks get together: a bucket of several tiles is copied once for each of its tiles
    tiles_of = F.when(F.col("rows") > tile_rows, F.ceil(F.col("rows") / (tile_rows // 2))).otherwise(1).cast("int")
    n_rows = filled.agg(F.sum(F.col("rows") * tiles_of)).first()[0] or 0
    tiled = placed.join(filled.where(F.col("rows") > tile_rows).select(*key, tiles_of.alias("tiles")), key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("rep"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    n_groups = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // (8 * tile_rows))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    tiled = tiled.select(*key, "own", low, high, "rep", "copies", "embedding").withColumn("deal", F.pmod(F.xxhash64(*key, "low", "high"), F.lit(n_groups)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        reps, links, roots = [], [], []
        for (_, width, t, _, lo, hi), g in pdf.groupby([*key, "low", "high"], sort=False):
            if len(g) < 2:
                continue
            raw = np.stack(g["embedding"].to_numpy()).astype(np.float64)
            x = raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
            copies, own = g["copies"].to_numpy(), g["own"].to_numpy()
            near = x @ x.T >= cut
            np.fill_diagonal(near, False)
            some = np.flatnonzero(near.any(axis=1))
            if not len(some):
                continue
            # signs follow from the vector, so they are worked out again for those that met instead of travelling with each copy
            sign = buckets_of(raw[some], width)
            for earlier in range(t):  # such a pair was found in that table
                near[np.ix_(some, some)] &= sign[:, earlier][:, None] != sign[:, earlier][None, :]
            np.fill_diagonal(near, True)
            if lo != hi:
                near &= own[:, None] != own[None, :]
                np.fill_diagonal(near, True)
            counted = near @ copies - copies
            root = local_components(near)
            some = (counted > 0) | (root != np.arange(len(root)))
            ids = g["rep"].to_numpy()
            reps.append(ids[some])
            links.append(counted[some])
            roots.append(ids[root][some])
        if not reps:
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        return pd.DataFrame({"rep": np.concatenate(reps), "links": np.concatenate(links), "root": np.concatenate(roots)})

    found = materialize(tiled.groupBy("deal").applyInPandas(compare, "rep long, links long, root long"), "vector-links")
    # equal vectors of different labels have different representatives, as have all rows of a class
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    ends = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-components")
    per_class = (
        classes.join(counts, "rep", "left").join(ends, F.col("rep") == F.col("node"), "left")
        .select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    )
    known = rows.where("usable").join(per_class, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))).select("vec_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"))
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
"""

QUERIES = {"op7_vector_duplicates": op7_vector_duplicates}
ORACLES = {"op7_vector_duplicates": OP7_SQL}
