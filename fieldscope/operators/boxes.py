"""Detector boxes(rec, uid, cls, score, t0, t1, f0, f1): overlaps, suppression, matching, review and tiles."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.scalars import iou
from fieldscope.operators.joins import bucket, overlapping, time_islands
from fieldscope.sources.tables import written

CORNERS = ("t0", "t1", "f0", "f1")
#: Islands that one Python call takes together; they do not touch each other, so it only saves calls.
ISLANDS = 500
#: Boxes of an island up to which it is settled in one call.
BIG = 5000


def _other(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.select(*(F.col(c) if c in keys else F.col(c).alias(f"{c}_b") for c in boxes.columns))


def pair_iou() -> Column:
    return iou(tuple(F.col(c) for c in CORNERS), tuple(F.col(f"{c}_b") for c in CORNERS))


def iou_join(a: DataFrame, b: DataFrame, width: float, least: float = 0.0, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Pairs of boxes of a and b (its columns end in _b) of one recording with iou over least."""
    keys = list(keys)
    return overlapping(a, _other(b, keys), keys, width).withColumn("iou", pair_iou()).where(F.col("iou") > least)


def nms(boxes: DataFrame, cut: float = 0.5, width: float = 3600.0, class_aware: bool = True, earliest: bool = False, big: int = BIG) -> DataFrame:
    """Greedy suppression: best score first (earliest: in order of t0, t1), a box goes if a kept one of its class overlaps it by more than cut.

    Boxes that no chain of overlaps in time joins do not meet, so islands are settled by themselves, many in a call; those of over big
    boxes in rounds (suppressed_in_rounds). The result is that of the greedy loop over all, ties by uid.
    """
    keys = ["rec", "cls"] if class_aware else ["rec"]
    order = [("t0", 1), ("t1", 1), ("uid", 1)] if earliest else [("score", -1), ("uid", 1)]
    islands = written(time_islands(boxes.select(*{*keys, "rec"}, "uid", "score", *CORNERS), keys, 0.0), "nms-islands")
    sizes = islands.groupBy(*keys, "island").agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") > big).drop("_n")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        ranked = pdf.sort_values([c for c, _ in order], ascending=[sign > 0 for _, sign in order])
        for _, g in ranked.groupby([*keys, "island"], sort=False, dropna=False):
            if len(g) == 1:
                continue
            (t0, t1, f0, f1), uid = (g[c].to_numpy(np.float64) for c in CORNERS), g["uid"].tolist()
            area, kept = (t1 - t0) * (f1 - f0), np.zeros(len(g), bool)
            for i in range(len(g)):
                k = np.flatnonzero(kept[:i])
                both = np.maximum(np.minimum(t1[i], t1[k]) - np.maximum(t0[i], t0[k]), 0.0) * np.maximum(np.minimum(f1[i], f1[k]) - np.maximum(f0[i], f0[k]), 0.0)
                union = area[i] + area[k] - both
                kept[i] = not (both / np.where(union > 0, union, np.inf) > cut).any()
            out += [u for u, stays in zip(uid, kept, strict=True) if not stays]
        return pd.DataFrame({"uid": pd.Series(out, dtype=pdf["uid"].dtype)})

    kind = boxes.schema["uid"].dataType.simpleString()
    if large.isEmpty():
        gone = dealt_islands(islands, tuple(keys)).applyInPandas(settle, f"uid {kind}")
    else:
        gone = dealt_islands(islands.join(large, [*keys, "island"], "left_anti"), tuple(keys)).applyInPandas(settle, f"uid {kind}")
        gone = gone.unionByName(suppressed_in_rounds(islands.join(large, [*keys, "island"], "left_semi"), keys, order, cut, width))
    return boxes.join(gone, "uid", "left_anti")


def suppressed_in_rounds(boxes: DataFrame, keys: list[str], order: list[tuple[str, int]], cut: float, width: float) -> DataFrame:
    """uid of the boxes that greedy suppression lets go, in rounds over the pairs that overlap by more than cut: a box with no better living
    neighbour stays, its neighbours go. Each round settles the best box of every cluster at least, and dense clusters are not gathered."""
    ahead = F.struct(*(F.col(f"{c}_b") * sign for c, sign in order)) < F.struct(*(F.col(c) * sign for c, sign in order))
    own = boxes.select(*{*keys, "rec"}, "uid", "score", *CORNERS)
    pairs = written(iou_join(own, own, width, cut, tuple(keys)).where(ahead).select("uid", "uid_b"), "nms-pairs")  # uid is behind uid_b
    gone = pairs.select("uid").limit(0)
    while not pairs.isEmpty():
        behind = pairs.select("uid").distinct()
        heads = pairs.select(F.col("uid_b").alias("uid")).distinct().join(behind, "uid", "left_anti")
        drops = written(pairs.join(heads.withColumnRenamed("uid", "uid_b"), "uid_b", "left_semi").select("uid").distinct(), "nms-drops")
        gone = gone.union(drops)
        left = pairs.join(drops, "uid", "left_anti").join(drops.withColumnRenamed("uid", "uid_b"), "uid_b", "left_anti")
        pairs = written(left.select("uid", "uid_b"), "nms-pairs")
    return gone


def unanswered(candidates: DataFrame, answers: DataFrame, reviewed: DataFrame, width: float, cut: float = 0.5) -> DataFrame:
    """candidates whose centre is in no reviewed rect(rec, t0, t1, f0, f1; null band: all) and that overlap no answer by more than cut."""
    hit = iou_join(candidates, answers, width, cut).select("rec", "uid").distinct()
    return candidates.join(hit, ["rec", "uid"], "left_anti").join(in_rects(candidates, reviewed, width).select("rec", "uid"), ["rec", "uid"], "left_anti")


def in_rects(boxes: DataFrame, rects: DataFrame, width: float) -> DataFrame:
    """The boxes whose centre lies in a rect (closed edges, a null band takes every frequency)."""
    t, f = (F.col("t0") + F.col("t1")) / 2, (F.col("f0") + F.col("f1")) / 2
    r = rects.select("rec", *(F.col(c).alias(f"_{c}") for c in CORNERS)).withColumn("_b", F.explode(F.sequence(bucket(F.col("_t0"), width), bucket(F.col("_t1"), width))))
    inside = t.between(F.col("_t0"), F.col("_t1")) & (F.col("_f0").isNull() | (f >= F.col("_f0"))) & (F.col("_f1").isNull() | (f <= F.col("_f1")))
    hits = boxes.withColumn("_b", bucket(t, width)).join(r, ["rec", "_b"]).where(inside).select("rec", "uid").distinct()
    return boxes.join(hits, ["rec", "uid"], "left_semi")


def candidate_at(boxes: DataFrame, points: DataFrame, width: float) -> DataFrame:
    """q, uid: the smallest box over each of points(rec, q, t, f); of equal areas the smallest uid."""
    spans = boxes.withColumn("_b", F.explode(F.sequence(bucket(F.col("t0"), width), bucket(F.col("t1"), width))))
    pairs = points.withColumn("_b", bucket(F.col("t"), width)).join(spans, ["rec", "_b"]).where(F.col("t").between(F.col("t0"), F.col("t1")) & F.col("f").between(F.col("f0"), F.col("f1")))
    return pairs.groupBy("q").agg(F.min_by("uid", F.struct((F.col("t1") - F.col("t0")) * (F.col("f1") - F.col("f0")), F.col("uid"))).alias("uid"))


def implicit_rects(boxes: DataFrame, rects: DataFrame, width: float) -> DataFrame:
    """rects and, around every box that lies in none whole, the box widened by half its size each way."""
    r = rects.select("rec", *(F.col(c).alias(f"{c}_b") for c in CORNERS))
    inside = overlapping(boxes, r, ["rec"], width).where((F.col("t0") >= F.col("t0_b")) & (F.col("t1") <= F.col("t1_b")) & (F.col("f0") >= F.col("f0_b")) & (F.col("f1") <= F.col("f1_b")))
    bare = boxes.join(inside.select("rec", "uid").distinct(), ["rec", "uid"], "left_anti")
    dt, df = (F.col("t1") - F.col("t0")) / 2, (F.col("f1") - F.col("f0")) / 2
    return rects.select("rec", *CORNERS).unionByName(bare.select("rec", (F.col("t0") - dt).alias("t0"), (F.col("t1") + dt).alias("t1"), (F.col("f0") - df).alias("f0"), (F.col("f1") + df).alias("f1")))


def tile_starts(recordings: DataFrame, tile: int, step: int) -> DataFrame:
    """rec, s0 of recordings(rec, frames): a grid of step; the last tile ends with the recording."""
    last = F.greatest(F.col("frames") - tile, F.lit(0))
    grid = F.when(last > 0, F.sequence(F.lit(0).cast("long"), F.greatest(last - 1, F.lit(0)), F.lit(step).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return recordings.select("rec", F.explode(F.array_distinct(F.concat(grid, F.array(last.cast("long"))))).alias("s0"))


def owned_spans(tiles: DataFrame, tile: int, rate: float) -> DataFrame:
    """tiles(rec, s0) with own0, own1: seconds that each tile answers for, up to the middle of its overlaps."""
    w = Window.partitionBy("rec").orderBy("s0")
    before, after, s0 = F.lag("s0").over(w), F.lead("s0").over(w), F.col("s0")
    low = F.when(before + tile > s0, (s0 + before + tile) / 2).otherwise(s0)
    high = F.when(s0 + tile > after, (after + s0 + tile) / 2).otherwise(s0 + tile)
    return tiles.select("rec", "s0", (low / rate).alias("own0"), (high / rate).alias("own1"))


def sweep_dedup(raw: DataFrame, tiles: DataFrame, margin: float, cut: float = 0.5, width: float = 3600.0) -> DataFrame:
    """raw(rec, s0, ...box) kept by the tile that owns its centre (with margin), then suppressed over the recording."""
    mid = (F.col("t0") + F.col("t1")) / 2
    own = raw.join(tiles, ["rec", "s0"]).where((mid >= F.col("own0") - margin) & (mid <= F.col("own1") + margin)).drop("own0", "own1", "s0")
    return nms(written(own, "sweep"), cut, width)


def tile_membership(boxes: DataFrame, tiles: DataFrame, least: float, width: float) -> DataFrame:
    """rec, s0, uid, visible, labelled: boxes on tiles(rec, s0, t0, t1, f0, f1); a box of which less than least is seen is a sliver."""
    t = tiles.select("rec", "s0", *(F.col(c).alias(f"{c}_b") for c in CORNERS))
    seen = (F.least("t1", "t1_b") - F.greatest("t0", "t0_b")) * F.greatest(F.least("f1", "f1_b") - F.greatest("f0", "f0_b"), F.lit(0.0))
    area = (F.col("t1") - F.col("t0")) * (F.col("f1") - F.col("f0"))
    out = overlapping(boxes, t, ["rec"], width).withColumn("visible", F.when(area > 0, seen / area).otherwise(0.0)).where("visible > 0")
    return out.select("rec", "s0", "uid", "visible", (F.col("visible") >= least).alias("labelled"))


def top_candidates(boxes: DataFrame, cut: float, most: int = 5000) -> DataFrame:
    """The best most boxes at cut or above, with hidden: how many more there are."""
    fit = boxes.where(F.col("score") >= cut)
    total = fit.agg(F.count("*").alias("_n"))
    return fit.orderBy(F.col("score").desc(), "uid").limit(most).crossJoin(F.broadcast(total)).withColumn("hidden", F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


def auto_cut(scores: DataFrame, default: float = 0.25, bins: int = 64) -> DataFrame:
    """cut: Otsu's threshold on the logarithm of the positive scores; default where there are under 8 of them or they are all one.

    One row. The histogram has bins rows, whatever the number of scores.
    """
    logs = scores.where("score > 0").select(F.log("score").alias("v"))
    ends = logs.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("all"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    hist = logs.crossJoin(F.broadcast(ends)).where("hi > lo").groupBy(at.alias("b"), "lo", "hi", "all").agg(F.count("*").alias("n"))
    grid = ends.where("hi > lo").select("lo", "hi", "all", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("b"))
    full = grid.join(hist.select("b", "n"), "b", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    step = (F.col("hi") - F.col("lo")) / bins
    w = Window.partitionBy("all").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("all")
    mid = F.col("lo") + (F.col("b") + 0.5) * step
    x = full.select("b", "lo", "hi", "all", F.sum("n").over(w).alias("wt"), F.sum(F.col("n") * mid).over(w).alias("mean"), F.sum(F.col("n") * mid).over(whole).alias("total"))
    below = F.col("wt") * (F.col("all") - F.col("wt"))
    between = F.when(below > 0, F.pow(F.col("total") * F.col("wt") - F.col("all") * F.col("mean"), F.lit(2.0)) / below).otherwise(0.0)
    best = x.withColumn("between", between).agg(F.max_by(F.struct("between", "b", "lo", "hi", "all"), F.struct("between", -F.col("b"))).alias("m"))
    edge = F.exp(F.col("m.lo") + (F.col("m.b") + 1) * (F.col("m.hi") - F.col("m.lo")) / bins)
    return best.select(F.when((F.col("m.all") >= 8) & (F.col("m.between") > 0), edge).otherwise(default).alias("cut"))


def match_events(found: DataFrame, truth: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """rec, uid, truth_uid (null: false positive) of every found box: one-to-one, best score first, the nearest free centre within tolerance of
    its class whose band overlaps. Centres over tolerance apart never meet, so each island of centres is matched by itself."""
    both = found.select("rec", "cls", "uid", "score", "t0", "t1", "f0", "f1", F.lit(False).alias("true")).unionByName(truth.select("rec", "cls", "uid", F.lit(0.0).alias("score"), "t0", "t1", "f0", "f1", F.lit(True).alias("true")))
    both = both.withColumn("mid", (F.col("t0") + F.col("t1")) / 2)
    islands = time_islands(both, ["rec", "cls"], tolerance, "mid", "mid")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (rec, cls), g in pdf.groupby(["rec", "cls"], sort=False, dropna=False):
            have, want = g[~g["true"]].sort_values(["score", "uid"], ascending=[False, True]), g[g["true"]].sort_values(["mid", "uid"])
            mids, lo, hi, ids, left = want["mid"].tolist(), want["f0"].tolist(), want["f1"].tolist(), want["uid"].tolist(), [True] * len(want)
            for uid, mid, f0, f1 in zip(have["uid"].tolist(), have["mid"].tolist(), have["f0"].tolist(), have["f1"].tolist(), strict=True):
                near = range(bisect_left(mids, mid - tolerance), bisect_right(mids, mid + tolerance))
                best = min(((abs(mids[i] - mid), i) for i in near if left[i] and min(f1, hi[i]) > max(f0, lo[i])), default=None)
                if best:
                    left[best[1]] = False
                out.append((rec, cls, uid, ids[best[1]] if best else None))
        return pd.DataFrame(out, columns=["rec", "cls", "uid", "truth_uid"]).astype({"truth_uid": "Int64"})

    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    return dealt_islands(islands).applyInPandas(greedy, f"rec {kinds['rec']}, cls {kinds['cls']}, uid {kinds['uid']}, truth_uid long")


def dealt_islands(islands: DataFrame, keys: tuple[str, ...] = ("rec", "cls")):
    """Groups of whole islands, of ISLANDS at most of a key: several groups a task, and a number of tasks that is named, or few bytes would make one."""
    tasks = int(islands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.pmod(F.xxhash64(*keys, F.floor(F.col("island") / ISLANDS)), F.lit(8 * tasks))
    return islands.withColumn("_deal", deal).repartition(tasks, "_deal").groupBy("_deal")


def scores_of(matched: DataFrame, n_truth: int) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; a ratio without cases is 0."""
    n = matched.agg(F.count("truth_uid").alias("tp"), F.count("*").alias("n")).select("tp", (F.col("n") - F.col("tp")).alias("fp"), (F.lit(n_truth) - F.col("tp")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_threshold(matched: DataFrame, found: DataFrame, n_truth: int) -> DataFrame:
    """cut (three decimals), f1: the cut with the highest F1, the lowest of equals.

    Matching goes best first, so the matches at a cut are those of the full matching at or above it: one pass of running sums over at most
    1001 cuts.
    """
    cuts = found.select("uid", F.bround("score", 3).alias("cut")).join(matched.select("uid", "truth_uid"), "uid").groupBy("cut").agg(F.count("truth_uid").alias("tp"), F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("cut").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = cuts.select("cut", F.sum("tp").over(w).alias("tp"), F.sum("n").over(w).alias("n")).withColumn("f1", 2 * F.col("tp") / (F.col("n") + n_truth))
    return sums.agg(F.max_by(F.struct("cut", "f1"), F.struct("f1", -F.col("cut"))).alias("m")).select("m.cut", "m.f1")
