"""Session checks, review of candidates and views of spectra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.scalars import fixed


def split_coverage(parts: DataFrame, rate: float) -> DataFrame:
    """rec, declared, opened, missing, partial, shift_s of parts(rec, part, frames, opened): shift_s is where the first opened part starts."""
    start = F.sum("frames").over(Window.partitionBy("rec").orderBy("part")) - F.col("frames")
    x = parts.withColumn("_start", start)
    out = x.groupBy("rec").agg(F.count("*").alias("declared"), F.count_if("opened").alias("opened"), F.min(F.when(F.col("opened"), F.col("_start"))).alias("_first"))
    return out.select("rec", "declared", "opened", (F.col("declared") - F.col("opened")).alias("missing"), (F.col("opened") < F.col("declared")).alias("partial"), (F.col("_first") / rate).alias("shift_s"))


def check_recording(meta: DataFrame, recordings: DataFrame) -> DataFrame:
    """rec, rate_ok, frames_ok, channel_ok of meta(rec, rate, frames, channel) against recordings(rec, rate, frames, channels); null where nothing is known."""
    r = recordings.select("rec", F.col("rate").alias("_rate"), F.col("frames").alias("_frames"), "channels")
    return meta.join(r, "rec", "left").select("rec", (F.col("rate") == F.col("_rate")).alias("rate_ok"), (F.col("frames") == F.col("_frames")).alias("frames_ok"), ((F.col("channel") >= 0) & (F.col("channel") < F.col("channels"))).alias("channel_ok"))


def trust(validated: Column, warnings: Column) -> Column:
    """ok or warn where the check is a real true, else unvalidated."""
    return F.when(F.coalesce(validated, F.lit(False)), F.when(warnings > 0, "warn").otherwise("ok")).otherwise("unvalidated")


def integrity(records_lost: Column, drop_events: Column, sequence_breaks: Column, truncated: Column, interrupted: Column) -> Column:
    """What a log says of its own holes, in words; an empty array where it is whole. Counts of 0 and nulls say nothing; interrupted is an array of file numbers."""
    counted = lambda n, what: F.when(n != 0, F.concat(n.cast("string"), F.lit(what)))
    files = F.when(F.size(interrupted) > 0, F.concat(F.lit("interrupted log files: "), F.array_join(interrupted.cast("array<string>"), ", ")))
    return F.array_compact(F.array(counted(records_lost, " log records lost"), counted(drop_events, " drop events"), counted(sequence_breaks, " sequence breaks"), F.when(truncated, "the log was truncated by a power loss"), files))


def join_times(files: DataFrame, rate: float, declared: DataFrame | None = None) -> DataFrame:
    """rec, part, start_frame, start_s, gap_s of files(rec, part, frames; parts from 0 on): where each begins in the recording.

    gap_s is what declared(rec, gaps: seconds of the joins in order) says of the join before it; null for the first part and where none is told. It
    is told, never added.
    """
    start = F.sum("frames").over(Window.partitionBy("rec").orderBy("part")) - F.col("frames")  # a row a file
    out = files.select("rec", "part", start.alias("start_frame"), (start / rate).alias("start_s"))
    if declared is None:
        return out.withColumn("gap_s", F.lit(None).cast("double"))
    gap = F.when(F.col("part") > 0, F.get("gaps", (F.col("part") - 1).cast("int")))
    return out.join(declared.select("rec", "gaps"), "rec", "left").withColumn("gap_s", gap).drop("gaps")


def project_sources(boxes: DataFrame, rejected: DataFrame, reviewed: DataFrame, hidden: DataFrame) -> DataFrame:
    """rec, boxes, rejected, reviewed, hidden, classes of the recordings that have a box or a rejection, from tables of one row a box or rect (rec, and cls of boxes).

    Recordings that were only looked at teach nothing and have no row.
    """
    parts = [df.select("rec", F.lit(name).alias("_of"), (F.col("cls") if name == "boxes" else F.lit(None)).cast("string").alias("_cls")) for name, df in (("boxes", boxes), ("rejected", rejected), ("reviewed", reviewed), ("hidden", hidden))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    counts = every.groupBy("rec").agg(*(F.count_if(F.col("_of") == n).alias(n) for n in ("boxes", "rejected", "reviewed", "hidden")), F.array_join(F.array_sort(F.collect_set("_cls")), ",").alias("classes"))
    return counts.where("boxes > 0 or rejected > 0")


def answer_view(candidates: DataFrame, t0: float, t1: float, cut: float) -> DataFrame:
    """candidates(uid, t0, t1, score) with answer: accepted or rejected where the centre lies in the view, null elsewhere."""
    mid = (F.col("t0") + F.col("t1")) / 2
    return candidates.withColumn("answer", F.when(mid.between(t0, t1), F.when(F.col("score") >= cut, "accepted").otherwise("rejected")))


def finish_views(candidates: DataFrame, views: DataFrame, cut: float, names: list[str], width: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, labels, reviewed) of views(view, rec, t0, t1, f0, f1, accept) over candidates(rec, uid, cls, score, channel, t0, t1, f0, f1).

    answers: uid, view, answer of each candidate whose centre lies in a view, edges included; of several views the first. Shown ones, from the cut
    on, are accepted or rejected as the view says; others are gone. labels: one a accepted candidate, cls being a place in names.
    reviewed: the views as rects, for the classes that are known now.
    """
    from fieldscope.operators.joins import bucket

    t, f = (F.col("t0") + F.col("t1")) / 2, (F.col("f0") + F.col("f1")) / 2
    v = views.select("rec", "view", "accept", *(F.col(c).alias(f"_{c}") for c in ("t0", "t1", "f0", "f1"))).withColumn("_b", F.explode(F.sequence(bucket(F.col("_t0"), width), bucket(F.col("_t1"), width))))
    met = candidates.withColumn("_b", bucket(t, width)).join(v, ["rec", "_b"]).where(t.between(F.col("_t0"), F.col("_t1")) & f.between(F.col("_f0"), F.col("_f1")))
    first = met.groupBy("rec", "uid").agg(F.min(F.struct("view", "accept")).alias("m"), F.first("score").alias("score"))
    answers = first.select("rec", "uid", F.col("m.view").alias("view"), F.when(F.col("score") < cut, "gone").when(F.col("m.accept"), "accepted").otherwise("rejected").alias("answer"))
    known = F.element_at(F.array(*map(F.lit, names)), (F.col("cls") + 1).cast("int"))
    made = candidates.join(answers.where("answer = 'accepted'").select("rec", "uid"), ["rec", "uid"])
    labels = made.select("rec", "uid", known.alias("category"), F.lit("span").alias("kind"), "channel", "t0", "t1", "f0", "f1", F.concat(F.lit("accepted score="), F.coalesce(fixed(F.col("score"), 4), F.lit("null"))).alias("note"))
    return answers, labels, views.select("rec", "view", "t0", "t1", "f0", "f1", F.array(*map(F.lit, range(len(names)))).alias("classes"))


def sync_candidates(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """uid, state: a candidate without its label is rejected, with another category the reader's, moved edited, else kept; a label of its own is new."""
    c = candidates.select("uid", F.col("cls").alias("_c"), F.col("t0").alias("_t"), F.lit(True).alias("_has"))
    x = c.join(labels.select("uid", "cls", "t0", F.lit(True).alias("_label")), "uid", "full")
    state = F.when(F.col("_has").isNull(), "new").when(F.col("_label").isNull(), "rejected").when(F.col("cls") != F.col("_c"), "reader").when(F.col("t0") != F.col("_t"), "edited").otherwise("kept")
    return x.select("uid", state.alias("state"))


def worst_region(regions: DataFrame) -> DataFrame:
    """The region with the largest |median|, the first of equals."""
    return regions.agg(F.max_by(F.struct("region", "median"), F.struct(F.abs("median"), -F.col("region"))).alias("m")).select("m.region", "m.median")


def power_at(cells: DataFrame, points: DataFrame, hop_s: float, df: float, nfft_s: float) -> DataFrame:
    """q, col, bin, power of the cell at each of points(q, recording_id, channel, t, f); power is null off the picture."""
    p = points.select("q", "recording_id", "channel", F.floor((F.col("t") - (nfft_s - hop_s) / 2) / hop_s).cast("long").alias("col"), F.floor(F.col("f") / df + 0.5).cast("int").alias("bin"))
    return p.join(cells.select("recording_id", "channel", "col", "bin", "power"), ["recording_id", "channel", "col", "bin"], "left").select("q", "col", "bin", "power")


def box_of_mask(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.count("*").alias("area"))


def spread_sample(tiles: DataFrame, most: int) -> DataFrame:
    """Up to most tiles of each recording(rec, s0), evenly spread over their order."""
    w = Window.partitionBy("rec")
    x = tiles.withColumns({"_i": F.row_number().over(w.orderBy("s0")) - 1, "_n": F.count("*").over(w)})
    slot = lambda i: F.floor(i * most / F.col("_n"))
    return x.where((F.col("_n") <= most) | (F.col("_i") == 0) | (slot(F.col("_i")) > slot(F.col("_i") - 1))).drop("_i", "_n")


def review_shift(items: DataFrame, shift: float, t0: float, t1: float, renamed: DataFrame) -> DataFrame:
    """items(item, ident, t) moved by shift, those within [t0, t1] only, with ids as renamed(ident, new) says."""
    moved = items.withColumn("t", F.col("t") + shift).where(F.col("t").between(t0, t1))
    return moved.join(renamed, "ident", "left").withColumn("ident", F.coalesce("new", "ident")).drop("new")


def outside_span(items: DataFrame, k0: int, k1: int, t0: float, t1: float) -> DataFrame:
    """items(kind, k, t, ...) without the joins in the frames k0 to k1 (exclusive) and the missed joins in the seconds t0 to t1; tracks stay."""
    join = (F.col("kind") == "join") & (F.col("k") >= k0) & (F.col("k") < k1)
    missed = (F.col("kind") == "missed_join") & F.col("t").between(t0, t1)
    return items.where(~F.coalesce(join, F.lit(False)) & ~F.coalesce(missed, F.lit(False)))


def relabelled(items: DataFrame, names: DataFrame, keys: list[str] | tuple = (), drop: bool = True) -> DataFrame:
    """items(ids, kind, ...) under the names(ident, new); one with an id that has none goes, or keeps it where drop is false. A missed join of one id with itself goes."""
    item, n = [F.monotonically_increasing_id().alias("_item"), *items.columns], F.size("ids")
    each = items.select(*item).select("*", n.alias("_n"), F.posexplode("ids").alias("_at", "ident"))
    met = each.join(names, [*keys, "ident"], "inner" if drop else "left").withColumn("new", F.coalesce("new", "ident"))
    others = [c for c in items.columns if c != "ids" and c not in keys]
    back = met.groupBy(*keys, "_item", "_n").agg(*(F.first(c).alias(c) for c in others), F.transform(F.array_sort(F.collect_list(F.struct("_at", "new"))), lambda r: r["new"]).alias("ids"))
    same = (F.col("kind") == "missed_join") & (F.element_at("ids", 1) == F.element_at("ids", -1))
    return back.where((F.size("ids") == F.col("_n")) & ~F.coalesce(same, F.lit(False))).select(*items.columns)


def brush_bands(strokes: DataFrame, frames: DataFrame, dt: float, df: float, width: float) -> DataFrame:
    """stroke, k, lo, hi: the band that an ellipse (dt, df) swept along segments(stroke, t_a, f_a, t_b, f_b) covers at each of frames(k, t)."""
    from fieldscope.operators.joins import bucket

    s = strokes.withColumn("_b", F.explode(F.sequence(bucket(F.least("t_a", "t_b") - dt, width), bucket(F.greatest("t_a", "t_b") + dt, width))))
    x = s.join(frames.withColumn("_b", bucket(F.col("t"), width)), "_b")
    # the ellipse's nearest centre on the segment, by time
    at = F.greatest(F.least("t_a", "t_b"), F.least(F.greatest("t_a", "t_b"), F.col("t")))
    span = F.col("t_b") - F.col("t_a")
    f = F.col("f_a") + F.when(span != 0, (at - F.col("t_a")) / span).otherwise(0.0) * (F.col("f_b") - F.col("f_a"))
    off = (F.col("t") - at) / dt
    x = x.withColumns({"_off": off, "_f": f}).where(F.abs("_off") <= 1)
    half = df * F.sqrt(1 - F.col("_off") * F.col("_off"))
    return x.groupBy("stroke", "k").agg(F.min(F.col("_f") - half).alias("lo"), F.max(F.col("_f") + half).alias("hi"))


def describe(category: Column, t: Column, value: Column) -> Column:
    return F.concat_ws(" ", category, F.concat(F.coalesce(fixed(t, 1), F.lit("null")), F.lit(" s")), F.concat(F.lit("("), fixed(value, 2), F.lit(")")))


def session_channels(meta: DataFrame) -> DataFrame:
    """recording_id, channels of meta(recording_id, n, channels, exclude): the channels told, else all but the excluded; those that don't exist go."""
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    told = F.array_sort(F.array_intersect("channels", every))
    return meta.select("recording_id", F.coalesce(told, F.array_except(every, F.coalesce("exclude", F.array().cast("array<int>")))).alias("channels"))
