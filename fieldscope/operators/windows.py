"""Review windows: a greedy cover of the candidates that are not reviewed, in one of three orders, with blind windows between."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.scalars import uncertainty
from fieldscope.operators.boxes import dealt_islands, in_rects
from fieldscope.operators.dataset import draw
from fieldscope.operators.joins import merge_spans, reach_before, time_islands
from fieldscope.sources.tables import written

STRATEGIES = ("uncertain", "time", "random")
#: A blind window before every so-many-th one, the part of a window that lies before its first candidate, and steps that a draw can take; fixed values.
EXPLORE_EVERY, MARGIN, STEPS = 5, 0.1, 2147483647
#: Candidates of an island up to which its cover is walked along in one call.
BIG = 100_000


def cover_windows(candidates: DataFrame, length: float, reviewed: DataFrame | None = None, spans: DataFrame | None = None, big: int = BIG) -> DataFrame:
    """rec, w0, uid: a greedy cover; a window of length opens a tenth of it before the first candidate that the one before does not hold whole.

    Candidates whose centre lies in a rect of reviewed take no part. spans(rec, first, last): windows stay in their recording. Candidates over a
    length apart never share a window, so each island is covered by itself; one of over big candidates by successor_cover.
    """
    if reviewed is not None:
        candidates = candidates.join(in_rects(candidates, reviewed, length).select("rec", "uid"), ["rec", "uid"], "left_anti")
    start = F.col("t0") - MARGIN * length
    rows = candidates.select("rec", "uid", "t0", "t1")
    if spans is not None:
        rows = rows.join(spans.select("rec", "first", "last"), "rec")
        start = F.least(F.greatest(start, F.col("first")), F.greatest(F.col("last") - length, F.col("first")))
    islands = written(time_islands(rows.select("rec", "uid", "t0", "t1", start.alias("w0")), ["rec"], length, "t0", "t0"), "cover-islands")
    large = islands.groupBy("rec", "island").count().where(F.col("count") > big).select("rec", "island")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rec, g in pdf.groupby("rec", sort=False, dropna=False):
            end, w0 = -np.inf, None
            for uid, t1, own in g.sort_values(["t0", "uid"])[["uid", "t1", "w0"]].itertuples(index=False):
                if t1 > end:
                    w0, end = own, own + length
                out.append((rec, w0, uid))
        return pd.DataFrame(out, columns=["rec", "w0", "uid"])

    kinds = {f.name: f.dataType.simpleString() for f in islands.schema}
    made = f"rec {kinds['rec']}, w0 double, uid {kinds['uid']}"
    if large.isEmpty():
        return dealt_islands(islands, ("rec",)).applyInPandas(walk, made)
    small = dealt_islands(islands.join(large, ["rec", "island"], "left_anti"), ("rec",)).applyInPandas(walk, made)
    dense = islands.join(large, ["rec", "island"], "left_semi").withColumns({"end": F.col("w0") + length, "width": F.lit(float(length))})
    return small.unionByName(successor_cover(dense))


def successors(rows: DataFrame) -> DataFrame:
    """rec, island, uid, then: of rows(rec, island, uid, t0, t1, end, width) the first after each whose t1 is past its end; null where there is none.

    end is at most width, one for a recording, past t0, so the next one is in its bucket of that width, in the one after, or is the first
    of those beyond. Ends never go back along t0, so two pointers find all of a bucket in one walk.
    """
    keys = ["rec", "island"]
    cut = rows.select(*keys, "uid", "t0", "t1", "end", F.floor(F.col("t0") / F.col("width")).alias("_b"))
    both = cut.withColumn("_own", F.lit(True)).unionByName(cut.withColumn("_b", F.col("_b") - 1).withColumn("_own", F.lit(False)))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t0", "uid"])
        t1, end, uid, own = pdf["t1"].to_numpy(), pdf["end"].to_numpy(), pdf["uid"].to_numpy(), pdf["_own"].to_numpy()
        out, p = [], 0
        for i in np.flatnonzero(own):
            p = max(p, i + 1)
            while p < len(t1) and t1[p] <= end[i]:
                p += 1
            out.append((uid[i], uid[p] if p < len(t1) else None))
        got = pd.DataFrame(out, columns=["uid", "_then"]).astype({"_then": "Int64"})
        return got.assign(rec=pdf["rec"].iloc[0], island=pdf["island"].iloc[0], _b=pdf["_b"].iloc[0])[["rec", "island", "_b", "uid", "_then"]]

    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    found = both.groupBy(*keys, "_b").applyInPandas(walk, f"rec {kinds['rec']}, island {kinds['island']}, _b {kinds['_b']}, uid {kinds['uid']}, _then {kinds['uid']}")
    heads = cut.groupBy(*keys, "_b").agg(F.min_by("uid", F.struct("t0", "uid")).alias("_head"))
    w = Window.partitionBy(*keys).orderBy("_b")  # a row a bucket
    far = heads.withColumn("_far", F.when(F.lead("_b").over(w) > F.col("_b") + 1, F.lead("_head").over(w)).otherwise(F.lead("_head", 2).over(w)))
    return found.join(far.select(*keys, "_b", "_far"), [*keys, "_b"]).select(*keys, "uid", F.coalesce("_then", "_far").alias("then"))


def successor_cover(rows: DataFrame) -> DataFrame:
    """rec, w0, uid of rows(rec, island, uid, t0, t1, w0, end, width): the cover as the candidates reached from each island's first by way of their successors.

    Steps double: a round adds what lies as many openings ahead as were known before, so there are as many rounds as the number
    of an island's windows has binary digits, and none gathers an island.
    """
    keys = ["rec", "island"]
    jump = written(successors(rows).where("then is not null"), "cover-jumps")
    reached = written(rows.groupBy(*keys).agg(F.min_by("uid", F.struct("t0", "uid")).alias("uid")), "cover-openers")
    while not jump.isEmpty():
        ahead = reached.join(jump, [*keys, "uid"]).select(*keys, F.col("then").alias("uid"))
        reached = written(reached.unionByName(ahead).distinct(), "cover-openers")
        twice = jump.select(*keys, "uid", F.col("then").alias("_mid")).join(jump.select(*keys, F.col("uid").alias("_mid"), "then"), [*keys, "_mid"])
        jump = written(twice.select(*keys, "uid", "then"), "cover-jumps")
    opened = rows.join(reached.withColumn("_opens", F.lit(True)), [*keys, "uid"], "left").withColumn("_mark", F.when(F.col("_opens"), F.struct("t0", "uid", "w0")))
    held = reach_before(opened, keys, "_mark", "_before", F.col("width"), ("t0", "uid"))
    return held.select("rec", F.coalesce("_mark", "_before")["w0"].alias("w0"), "uid")


def rank_windows(members: DataFrame, candidates: DataFrame, cut: float, strategy: str = "uncertain", seed: int = 0) -> DataFrame:
    """rec, w0, n, priority: windows by the summed uncertainty of their candidates, by time (the earliest first), or as drawn."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such order of windows: {strategy}")
    scored = members.join(candidates.select("rec", "uid", "score"), ["rec", "uid"]).groupBy("rec", "w0").agg(F.count("*").alias("n"), F.sum(uncertainty(F.col("score"), cut)).alias("priority"), F.min("uid").alias("_uid"))
    own = {"uncertain": F.col("priority"), "time": -F.col("w0"), "random": draw(seed, F.col("_uid")) / F.lit(float(STEPS))}[strategy]
    return scored.withColumn("priority", own).drop("_uid")


def free_places(spans: DataFrame, reviewed: DataFrame, length: float) -> DataFrame:
    """rec, a, z, before, total: stretches in which the middle of a window may lie, with their lengths summed up before each and in all.

    A window lies in its span(rec, first, last). What is reviewed is left out, unless nothing else is there: then all of the span counts.
    """
    half = length / 2
    whole = spans.select("rec", (F.col("first") + half).alias("lo"), (F.greatest(F.col("last") - length, F.col("first")) + half).alias("hi"))
    closed = merge_spans(reviewed.select("rec", F.monotonically_increasing_id().alias("row"), "t0", "t1"), ["rec"]).select("rec", "t0", "t1")
    inside = closed.join(whole, "rec").where((F.col("t1") >= F.col("lo")) & (F.col("t0") <= F.col("hi"))).select("rec", "lo", "hi", "t0", "t1")
    w = Window.partitionBy("rec").orderBy("t0")  # a row for each stretch that is reviewed
    gaps = inside.select("rec", F.greatest(F.coalesce(F.lag("t1").over(w), F.col("lo")), F.col("lo")).alias("a"), F.least("t0", "hi").alias("z"))
    tail = inside.groupBy("rec").agg(F.max("t1").alias("a"), F.first("hi").alias("z")).select("rec", "a", "z")
    untouched = whole.join(inside.select("rec").distinct(), "rec", "left_anti").select("rec", F.col("lo").alias("a"), F.col("hi").alias("z"))
    free = gaps.unionByName(tail).unionByName(untouched).where("z > a")
    none = whole.join(free.select("rec").distinct(), "rec", "left_anti").select("rec", F.col("lo").alias("a"), F.col("hi").alias("z"))
    run = Window.partitionBy("rec").orderBy("a")
    return free.unionByName(none).withColumns({"before": F.sum(F.col("z") - F.col("a")).over(run) - (F.col("z") - F.col("a")), "total": F.sum(F.col("z") - F.col("a")).over(Window.partitionBy("rec"))})


def with_blind(ranked: DataFrame, candidates: DataFrame, spans: DataFrame, reviewed: DataFrame, length: float, seed: int = 0, every: int = EXPLORE_EVERY) -> DataFrame:
    """rec, place, w0, n, priority, blind: the windows of each recording, best first (ties by time), with a blind one before every every-th.

    Where there are fewer windows than that, one blind window stands last. Its middle is drawn from what is free (free_places) by the recording's number
    and its own; n counts the candidates that lie in it whole. Recordings without a span have no blind windows.
    """
    order = Window.partitionBy("rec").orderBy(F.desc("priority"), "w0")  # a row a window
    placed = ranked.withColumn("_i", F.row_number().over(order) - 1)
    seen = placed.withColumn("place", (F.col("_i") + (F.floor((F.col("_i") + 1) / every) if every > 0 else 0)).cast("long")).select("rec", "place", "w0", "n", "priority", F.lit(False).alias("blind"))
    if every <= 0:
        return seen
    count = placed.groupBy("rec").agg(F.count("*").alias("_n"))
    turn = count.select("rec", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("_n") / every), F.lit(1)).cast("int") - 1)).alias("_k"))
    turn = turn.withColumn("place", F.when(F.col("_n") < every, F.col("_n")).otherwise((F.col("_k") + 1) * every - 1 + F.col("_k")).cast("long"))
    places = written(free_places(spans, reviewed, length), "free-places")
    at = turn.join(places.select("rec", "total").distinct(), "rec").withColumn("_at", draw(seed, F.col("rec"), F.col("_k")) / F.lit(float(STEPS)) * F.col("total"))
    middle = at.join(places.drop("total"), "rec").where((F.col("_at") >= F.col("before")) & ((F.col("_at") < F.col("before") + F.col("z") - F.col("a")) | (F.col("total") == 0)))
    blind = middle.groupBy("rec", "place").agg(F.min(F.col("a") + F.col("_at") - F.col("before")).alias("_m")).select("rec", "place", (F.col("_m") - length / 2).alias("w0"))
    held = blind.select("rec", "place", "w0", F.explode(F.sequence(F.floor(F.col("w0") / length), F.floor((F.col("w0") + length) / length))).alias("_b"))
    inside = held.join(candidates.select("rec", "uid", "t0", "t1", F.floor(F.col("t0") / length).alias("_b")), ["rec", "_b"]).where((F.col("t0") >= F.col("w0")) & (F.col("t1") <= F.col("w0") + length))
    blind = blind.join(inside.groupBy("rec", "place").agg(F.count("*").alias("n")), ["rec", "place"], "left")
    return seen.unionByName(blind.select("rec", "place", "w0", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0.0).alias("priority"), F.lit(True).alias("blind")))


def pick_window(ranked: DataFrame, finished: DataFrame, every: int = EXPLORE_EVERY) -> DataFrame:
    """rec, place, w0, blind: the window of with_blind to look at after finished(rec, finished) ones: every every-th time the first blind one, else
    the first that is not blind; whichever there is."""
    wants = F.lit(every > 0) & (F.col("finished") % max(every, 1) == max(every, 1) - 1)
    best = ranked.join(finished, "rec").groupBy("rec").agg(F.min_by(F.struct("place", "w0", "blind"), F.struct((F.col("blind") != wants).cast("int"), "place")).alias("m"))
    return best.select("rec", "m.place", "m.w0", "m.blind")
