"""Exact top-k search by inner product, with a table of distances to pivots.

Every row's distances to all pivots are worked out once. For a query and a candidate the largest difference of their distances to a
pivot is a lower bound of their own distance, which with both lengths gives an upper bound of their inner product. Rows are
packed into blocks of one nearest pivot each. A query is first answered within its own block, which gives the score it
has to beat; then it meets the other blocks in stripes: a block whose ranges of pivot distances rule it out is passed over, and
of the others rows are taken in the order of their bounds until no bound reaches the k-th best score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import materialize, splitmix, table

#: Pivots, the sample they are chosen from, rows of a block, blocks of a stripe and queries of a group (as expected).
PIVOTS, PIVOT_ROWS, BLOCK_ROWS, STRIPE_BLOCKS, GROUP_QUERIES = 32, 4096, 1024, 8, 2048
#: Cells (pivots times widths) up to which their sizes are broadcast.
CELL_ROWS = 100_000
#: Queries bounded at once, candidates that a query takes in its first step, and the share of rows from which those that are left are multiplied in place.
AT_ONCE, FIRST_STEP, MOST = 16, 128, 0.125
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole(rows, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as doubles; what would overflow is the largest double."""
    with np.errstate(over="ignore"):
        return np.floor(np.nan_to_num(scale * np.stack(list(rows)).astype(np.float64)))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """The origin, then rows of sample, each the farthest from those before it."""
    pivots = [np.zeros(sample.shape[1])]
    far = distances(sample, pivots[0][None])[:, 0]
    while len(pivots) < n and far.max(initial=0) > 0:
        pivots.append(sample[int(far.argmax())])
        far = np.minimum(far, distances(sample, pivots[-1][None])[:, 0])
    return np.stack(pivots)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _bound(lengths: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Of the inner product of vectors whose squared lengths add up to lengths and that are apart or more; a little more than exact, infinite where doubles overflow."""
    return np.nan_to_num((lengths - apart * apart) / 2 + 0.5 + 1e-9 * lengths, nan=np.inf, posinf=np.inf, neginf=np.inf)


def upper_bounds(q: np.ndarray, q_far: np.ndarray, x: np.ndarray, x_far: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of rows of q with rows of x; far: distances to the pivots."""
    apart, gap = np.zeros((len(q), len(x))), np.empty((len(q), len(x)))
    with np.errstate(over="ignore", invalid="ignore"):
        for p in range(q_far.shape[1]):
            np.subtract(q_far[:, p, None], x_far[None, :, p], out=gap)
            np.maximum(apart, np.abs(gap, out=gap), out=apart)
        return _bound(q_far[:, 0, None] ** 2 + x_far[None, :, 0] ** 2, apart)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of q with those of x, whole numbers all; beyond a long's range its ends."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    exact, rows = [[int(v) for v in row] for row in q], [[int(v) for v in row] for row in x]
    return np.array([[min(_LONG[1], max(_LONG[0], sum(v * w for v, w in zip(a, b, strict=True)))) for b in rows] for a in exact], dtype=np.int64).reshape(len(q), len(x))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > 4 * k else np.arange(len(score))
    return some[np.lexsort((ids[some], ~score[some]))][:k]


def _reached(best: np.ndarray, k: int) -> float:
    """What a bound has to reach for its row to be among the k best, given the best so far."""
    return float(best[-1]) - 1e-12 * abs(float(best[-1])) if len(best) == k else -np.inf


def search(query_ids, q, q_far, least, ids, x, x_far, k):
    """For each query (place, ids, scores): the k best rows of x among those with the score least[query] or more; no row of the query's own id.

    Rows are taken in the order of their bounds, in steps that double, until the next bound is below the k-th best score. Where after the first
    step most rows are still to be looked at, they are multiplied together, those of several queries at once.
    """
    x_far = np.asfortranarray(x_far)
    for lo in range(0, len(q), AT_ONCE):
        bound = upper_bounds(q[lo : lo + AT_ONCE], q_far[lo : lo + AT_ONCE], x, x_far)
        bound[query_ids[lo : lo + AT_ONCE, None] == ids[None, :]] = -np.inf
        bound[bound < least[lo : lo + AT_ONCE, None]] = -np.inf
        first = np.argpartition(-bound, FIRST_STEP, axis=1)[:, :FIRST_STEP] if len(x) > FIRST_STEP else np.broadcast_to(np.arange(len(x)), bound.shape)
        held, most = [], []
        for i, row in enumerate(bound):
            some = first[i][row[first[i]] > -np.inf]
            score = _products(q[lo + i : lo + i + 1], x[some])[0]
            top = _best(score, ids[some], k)
            held.append((ids[some][top], score[top], max(least[lo + i], _reached(score[top], k))))
            row[some] = -np.inf
            if np.count_nonzero(row >= held[i][2]) > MOST * len(x):
                most.append(i)
        dense = dict(zip(most, _products(q[lo : lo + AT_ONCE][most], x), strict=True)) if most else {}
        for i, row in enumerate(bound):
            best_ids, best, cut = held[i]
            some = np.flatnonzero((row >= cut) & (row > -np.inf))
            if i in dense:
                some = some[dense[i][some] >= cut]
                parts = [(some, dense[i][some])]
            else:
                some = some[np.argsort(-row[some], kind="stable")]
                parts = _steps(q[lo + i : lo + i + 1], x, some)
            for part, score in parts:
                if not len(part) or row[part[0]] < cut:
                    break
                both, ranked = np.concatenate([best_ids, ids[part]]), np.concatenate([best, score])
                top = _best(ranked, both, k)
                best_ids, best = both[top], ranked[top]
                cut = max(cut, _reached(best, k))
            yield lo + i, best_ids, best


def _steps(q: np.ndarray, x: np.ndarray, order: np.ndarray):
    """(rows, scores) of order in steps that double, worked out as they are asked for."""
    at, step = 0, FIRST_STEP
    while at < len(order):
        part = order[at : at + step]
        yield part, _products(q, x[part])[0]
        at, step = at + step, step * 2


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = PIVOTS, pivot_rows: int = PIVOT_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors(vec_id, embedding) that is_query, the k rows with the highest inner product.

    Components are turned into floor(scale * x) first, so scores are integers; those beyond a long's range count as its ends. All rows
    but those of the query's own id are candidates; ties go to smaller ids. A vector that is null, empty or holds null or non-finite components takes no part, and so does a row with a null id; vectors meet only those of their own width.
    A repeated id is one query, with the smaller of its vectors, and as many candidates as it has rows, which tie by vector and then
    at random. A query without candidates has no row. pivot_rows bounds the sample that pivots come from, which decides what is passed over,
    never what is found.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    usable = F.coalesce(fine & (F.size("embedding") > 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))).where(usable).select("vec_id", "embedding", "is_query")
    sample: dict[int, list] = {}
    for r in rows.select("embedding").orderBy(F.xxhash64("vec_id"), "embedding").limit(pivot_rows).collect():
        sample.setdefault(len(r.embedding), []).append(r.embedding)
    chosen = {width: choose_pivots(whole(v, scale), pivots) for width, v in sample.items()}
    asked = rows.where("is_query").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("is_query", F.lit(True))
    both = rows.withColumn("is_query", F.lit(False)).unionByName(asked).withColumn("width", F.size("embedding"))

    def place(batches):
        made = np.uint64(TaskContext.get().partitionId() << 40)
        for pdf in batches:
            nearest = np.zeros(len(pdf), np.int64)
            for width, at in pdf.groupby("width").indices.items():
                x = whole(pdf["embedding"].iloc[at], scale)
                if len(pivots_of := chosen.get(width, np.zeros((1, width)))) > 1:  # the origin is near to all alike
                    nearest[at] = distances(x, pivots_of[1:]).argmin(axis=1)
            deal = splitmix(made + np.arange(len(pdf), dtype=np.uint64)) >> np.uint64(1)
            made += np.uint64(len(pdf))
            yield pdf.assign(nearest=nearest, deal=deal.astype(np.int64))

    vector = vectors.schema["embedding"].dataType.simpleString()
    placed = materialize(both.mapInPandas(place, f"vec_id {kind}, embedding {vector}, is_query boolean, width int, nearest long, deal long"), "topk-rows")
    cells = materialize(placed.groupBy("width", "nearest").agg(F.ceil(F.count("*") / block_rows).alias("blocks")), "topk-cells")
    few = cells.count() <= CELL_ROWS  # pivots times widths
    dealt = placed.join(F.broadcast(cells) if few else cells, ["width", "nearest"]).withColumn("block", F.pmod("deal", "blocks")).drop("deal", "blocks")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        width, nearest, block = (int(pdf[c].iloc[0]) for c in ("width", "nearest", "block"))
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = whole(pdf["embedding"], scale)
        far, ids, ask = distances(x, chosen.get(width, np.zeros((1, width)))), pdf["vec_id"].to_numpy(np.int64), pdf["is_query"].to_numpy(bool)
        least = np.full(int(ask.sum()), -np.inf)
        for i, _, best in search(ids[ask], x[ask], far[ask], least.copy(), ids[~ask], x[~ask], far[~ask], k):
            least[i] = _reached(best, k)
        out = []
        for asks, part in ((False, ~ask), (True, ask)):
            if part.any():
                data = x[part].astype(np.int16) if np.abs(x[part]).max() < 1 << 15 else x[part]
                out.append((width, asks, f"{nearest}-{block}", ids[part].tobytes(), data.dtype.str, data.tobytes(), far[part].tobytes(), least.tobytes() if asks else b"", far[part].min(axis=0).tolist(), far[part].max(axis=0).tolist()))
        return pd.DataFrame(out, columns=["width", "asks", "name", "ids", "kind", "data", "far", "least", "low", "high"])

    packed_schema = "width int, asks boolean, name string, ids binary, kind string, data binary, far binary, least binary, low array<double>, high array<double>"
    packs = materialize(dealt.groupBy("width", "nearest", "block").applyInPandas(pack, packed_schema), "topk-blocks")
    sizes = packs.groupBy("width").agg(
        F.ceil(F.count_if(~F.col("asks")) / STRIPE_BLOCKS).alias("stripes"), F.ceil(F.sum(F.when(F.col("asks"), F.octet_length("ids") / 8)) / GROUP_QUERIES).alias("groups")
    )
    sizes = materialize(sizes.where("groups > 0 and stripes > 0"), "topk-sizes")
    pairs = sizes.agg(F.sum(F.col("groups") * F.col("stripes"))).first()[0] or 1
    # a query block meets each stripe of blocks once: the rows here are blocks
    sized = packs.join(sizes, "width").withColumn("h", F.xxhash64("name", "asks"))
    candidates = sized.where(~F.col("asks")).withColumn("stripe", F.pmod("h", "stripes").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1)).alias("group"))
    queries = sized.where("asks").withColumn("group", F.pmod("h", "groups").cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("stripes").cast("int") - 1)).alias("stripe"))

    def opened(r, width: int):
        ids = np.frombuffer(r.ids, np.int64)
        return ids, np.frombuffer(r.data, np.dtype(r.kind)).reshape(len(ids), width).astype(np.float64), np.frombuffer(r.far).reshape(len(ids), -1)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        width, out = int(pdf["width"].iloc[0]), []
        blocks = [(np.array(r.low), np.array(r.high), *opened(r, width)) for r in pdf[~pdf["asks"]].sort_values("name").itertuples()]
        for r in pdf[pdf["asks"]].sort_values("name").itertuples():
            query_ids, q, q_far = opened(r, width)
            least = np.frombuffer(r.least)
            # per block and query: how far the query's distances to the pivots are from the block's ranges of them
            with np.errstate(over="ignore", invalid="ignore"):
                gap = [np.maximum(np.maximum(low - q_far, q_far - high), 0).max(axis=1) for low, high, *_ in blocks]
                reach = [_bound(q_far[:, 0] ** 2 + high[0] ** 2, g) for g, (_, high, *_) in zip(gap, blocks, strict=True)]
            near = [b for b, top in zip(blocks, reach, strict=True) if (top >= least).any()]
            if near:
                ids, x, x_far = (np.concatenate([b[i] for b in near]) for i in (2, 3, 4))
                for i, best_ids, best in search(query_ids, q, q_far, least, ids, x, x_far, k):
                    if len(best):
                        out.append((int(query_ids[i]), best_ids.tolist(), best.tolist()))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    columns = ["width", "asks", "name", "group", "stripe", "ids", "kind", "data", "far", "least", "low", "high"]
    # a task a pair of stripe and group, however few bytes that is: the work is their product
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * pairs)
    both_sides = candidates.select(columns).unionByName(queries.select(columns)).repartition(tasks, "width", "group", "stripe")
    met = both_sides.groupBy("width", "group", "stripe").applyInPandas(meet, "query_id long, ids array<long>, scores array<long>")
    each = met.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("r")).select("query_id", F.col("r.ids").alias("vec_id"), F.col("r.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored) WHERE rank <= 20
"""

QUERIES = {"op11_pivot_topk": op11_pivot_topk}
ORACLES = {"op11_pivot_topk": OP11_SQL}
