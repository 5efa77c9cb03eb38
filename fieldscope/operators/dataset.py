"""Training sets for detectors: which tiles are drawn, how they are split, what is written on them, and their pictures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions import tiles as kernels
from fieldscope.functions.grids import box_pixels
from fieldscope.operators.boxes import CORNERS, nms
from fieldscope.operators.joins import neighbour, overlapping, running_sum
from fieldscope.sources.tables import written

#: Copies of a short rect, the step of a swept one in tiles, tiles of a block, blocks of one that is held out, least visible part of a box; fixed values.
COPIES, SWEEP, BLOCK_TILES, EVERY, VISIBLE = 8, 0.25, 4, 5, 0.6


def merge_lanes(boxes: DataFrame, cut: float = 0.5, width: float = 3600.0) -> DataFrame:
    """boxes without those that an earlier kept one (by t0, t1) of their class overlaps by more than cut: one event drawn on several lanes."""
    return nms(boxes, cut, width, earliest=True)


def draw(seed: int, *keys: Column) -> Column:
    """A number from 0 to 2**31 - 2 that follows from seed and keys: the same on every partition and in every run."""
    out = F.lit(seed % 2147483647).cast("long")
    for k in keys:
        out = ((out + F.pmod(k.cast("long"), F.lit(2147483647)) + 1) * 48271) % 2147483647
    return (out * 48271) % 2147483647


def plan_tiles(rects: DataFrame, grids: DataFrame, copies: int = COPIES, sweep: float = SWEEP, seed: int = 0) -> DataFrame:
    """rec, s0: starts of the tiles that cover rects(rec, rect, t0, t1) on grids(rec, rate, length, total), all but t in samples.

    A rect longer than a tile is swept; a shorter one lies on copies of tiles, anywhere on them (draw). Tiles stay inside the recording.
    """
    x = rects.join(grids, "rec").withColumns({"_a": F.rint(F.col("t0") * F.col("rate")).cast("long"), "_b": F.rint(F.col("t1") * F.col("rate")).cast("long")})
    low, last = F.col("_b") - F.col("length"), F.greatest(F.col("total") - F.col("length"), F.lit(0))
    step = F.greatest(F.floor(F.col("length") * sweep), F.lit(1)).cast("long")
    swept = F.when(low > F.col("_a"), F.sequence(F.col("_a"), F.greatest(low - 1, F.col("_a")), step)).otherwise(F.array().cast("array<bigint>"))
    room = F.greatest(F.col("_a") - low + 1, F.lit(1))
    thrown = F.array(*(low + draw(seed, F.col("rect"), F.lit(i)) % room for i in range(copies)))
    starts = F.when(F.col("_b") - F.col("_a") >= F.col("length"), F.concat(swept, F.array(low))).otherwise(thrown)
    each = x.select("rec", F.explode(starts).alias("_s"), last.cast("long").alias("_last"))
    return each.select("rec", F.least(F.greatest("_s", F.lit(0)), "_last").cast("long").alias("s0")).distinct()


def tile_blocks(tiles: DataFrame, lengths: DataFrame, big: int = 100_000) -> DataFrame:
    """tiles(rec, s0, ...) with length and block: the start of the first tile of its block, which ends before BLOCK_TILES lengths from there.

    Tiles over so many lengths apart begin a block in any case, so the starts between such gaps are walked along by themselves, many in a call; over
    big of them go by successors and doubling (windows.successor_cover).
    """
    from fieldscope.operators.boxes import dealt_islands
    from fieldscope.operators.windows import successor_cover

    x = tiles.join(lengths.select("rec", "length"), "rec")
    apart = neighbour(x.select("rec", "s0", "length").distinct(), ["rec"], ["s0"], "_prev", float(1 << 24), ("s0",))
    apart = apart.withColumn("_new", F.coalesce((F.col("s0") - F.col("_prev.s0") >= BLOCK_TILES * F.col("length")).cast("int"), F.lit(0))).drop("_prev")
    islands = written(running_sum(apart, ["rec"], "_new", "island", float(1 << 24), ("s0",)).drop("_new"), "tile-islands")
    large = islands.groupBy("rec", "island").count().where(F.col("count") > big).select("rec", "island")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rec, g in pdf.groupby("rec", sort=False, dropna=False):
            s0 = np.sort(g["s0"].to_numpy())
            reach, first, at = BLOCK_TILES * int(g["length"].iloc[0]), np.empty(len(s0), np.int64), 0
            while at < len(s0):
                end = int(np.searchsorted(s0, s0[at] + reach))
                first[at:end] = s0[at]
                at = end
            out.append(pd.DataFrame({"rec": rec, "s0": s0, "block": first}))
        return pd.concat(out)

    made = f"rec {x.schema['rec'].dataType.simpleString()}, s0 long, block long"
    if large.isEmpty():
        blocks = dealt_islands(islands, ("rec",)).applyInPandas(walk, made)
    else:
        reach = BLOCK_TILES * F.col("length") - 1
        dense = islands.join(large, ["rec", "island"], "left_semi").select("rec", "island", F.col("s0").alias("uid"), F.col("s0").alias("t0"), F.col("s0").alias("t1"), F.col("s0").alias("w0"), (F.col("s0") + reach).alias("end"), reach.alias("width"))
        blocks = dealt_islands(islands.join(large, ["rec", "island"], "left_anti"), ("rec",)).applyInPandas(walk, made)
        blocks = blocks.unionByName(successor_cover(dense).select("rec", F.col("uid").alias("s0"), F.col("w0").alias("block")))
    return x.join(blocks, ["rec", "s0"])


def split_tiles(tiles: DataFrame, lengths: DataFrame, every: int = EVERY) -> DataFrame:
    """tiles(rec, s0, has_event) with split: train, val, or null for a tile that is left out.

    Every every-th block with an event is held out; a train tile that shares time with a held-out one is left out. With too few such blocks, or
    without an event left to train on, all tiles train.
    """
    blocks = written(tile_blocks(tiles, lengths), "tile-blocks")
    eventful = blocks.where("has_event").select("rec", "block").distinct()
    per = eventful.groupBy("rec").agg(F.count("*").alias("_n"))
    # a row for each recording
    per = per.select("rec", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("rec").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    inside = F.row_number().over(Window.partitionBy("rec").orderBy("block")) - 1
    place = eventful.withColumn("_i", inside).join(per, "rec").withColumn("_i", F.col("_i") + F.col("_base"))
    if every > 0:
        place = place.where((F.col("_all") >= max(every, 2)) & (F.col("_i") % every == every // 2))
    held = (place if every > 0 else place.limit(0)).select("rec", "block", F.lit(True).alias("_held"))
    x = written(blocks.join(held, ["rec", "block"], "left").withColumn("_held", F.coalesce("_held", F.lit(False))), "tile-blocks")
    at = F.floor(F.col("s0") / F.col("length"))
    val = x.where("_held").select("rec", F.col("s0").alias("_v"), F.explode(F.array(at - 1, at, at + 1)).alias("_b"))
    leaks = x.where("not _held").withColumn("_b", at).join(val, ["rec", "_b"]).where(F.abs(F.col("s0") - F.col("_v")) < F.col("length")).select("rec", "s0").distinct().withColumn("_leak", F.lit(True))
    x = x.join(leaks, ["rec", "s0"], "left").withColumn("_leak", F.coalesce("_leak", F.lit(False)))
    taught = x.agg(F.coalesce(F.max(F.col("has_event") & ~F.col("_held") & ~F.col("_leak")), F.lit(False)).alias("_taught"))
    split = F.when(~F.col("_taught"), "train").when(F.col("_held"), "val").when(~F.col("_leak"), "train")
    return x.crossJoin(F.broadcast(taught)).select(*tiles.columns, split.alias("split"))  # taught is one row


def tile_labels(boxes: DataFrame, tiles: DataFrame, width: float, size: int, least: float = VISIBLE) -> DataFrame:
    """rec, s0, uid, line: the label line (class, centre and size on the picture) of boxes(rec, uid, cls, ...) on tiles(rec, s0, t0, t1, f0, f1).

    line is null for a sliver, a box of which less than least is on the tile: it is to be hidden, neither event nor background.
    """
    t = tiles.select("rec", "s0", *(F.col(c).alias(f"{c}_b") for c in CORNERS))
    clip = {c: (F.greatest if c.endswith("0") else F.least)(c, f"{c}_b") for c in CORNERS}
    met = overlapping(boxes.select("rec", "uid", "cls", *CORNERS), t, ["rec"], width).withColumns({f"_{c}": v for c, v in clip.items()}).where("_t1 > _t0 and _f1 > _f0")
    whole = (F.col("t1") - F.col("t0")) * (F.col("f1") - F.col("f0"))
    seen = (F.col("_t1") - F.col("_t0")) * (F.col("_f1") - F.col("_f0"))
    p = box_pixels(tuple(F.col(f"_{c}") for c in CORNERS), tuple(F.col(f"{c}_b") for c in CORNERS), 1, 1)
    numbers = [(p["x0"] + p["x1"]) / 2, (p["y0"] + p["y1"]) / 2, p["x1"] - p["x0"], p["y1"] - p["y0"]]
    line = F.format_string("%d %.6f %.6f %.6f %.6f", F.col("cls"), *numbers)
    return met.select("rec", "s0", "uid", F.when((whole > 0) & (seen / whole >= least), line).alias("line"), *(F.col(f"_{c}").alias(c) for c in CORNERS))


def render_tiles(blocks: DataFrame, tiles: DataFrame, spec: kernels.TileSpec, block_length: int, rects: DataFrame | None = None) -> DataFrame:
    """recording_id, s0, image: the picture (size * size bytes, highest frequency first) of each of tiles(recording_id, s0, total).

    blocks(recording_id, channel, block, start_frame, samples) are joined with the tiles that need them, so a task holds single tiles. rects
    (recording_id, s0, x0, x1, y0, y1; pixels): where they are given, what lies outside of a tile's rects is filled from its own darker half.
    """
    low = F.col("s0") - spec.margin
    high = low + (spec.frames - 1) * spec.hop + spec.nfft
    needed = tiles.withColumn("block", F.explode(F.sequence(F.floor(F.greatest(low, F.lit(0)) / block_length), F.floor(F.greatest(high - 1, F.lit(0)) / block_length))))
    parts = needed.join(blocks, ["recording_id", "block"], "left").groupBy("recording_id", "s0", "total").agg(F.collect_list(F.struct("channel", "start_frame", "samples")).alias("parts"))
    if rects is None:
        parts = parts.withColumn("rects", F.lit(None).cast("array<struct<x0:int,x1:int,y0:int,y1:int>>"))
    else:
        mine = rects.groupBy("recording_id", "s0").agg(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("x0", "x1", "y0", "y1")))).alias("rects"))
        parts = parts.join(mine, ["recording_id", "s0"], "left").withColumn("rects", F.coalesce("rects", F.array().cast("array<struct<x0:int,x1:int,y0:int,y1:int>>")))

    def paint(frames):
        for pdf in frames:
            images = []
            for s0, total, rows, seen in zip(pdf["s0"], pdf["total"], pdf["parts"], pdf["rects"], strict=True):
                image = kernels.tile_image([(r["channel"], r["start_frame"], r["samples"]) for r in rows if r["samples"] is not None], int(s0), int(total), spec)
                if seen is not None:
                    image = kernels.mask_outside(image, kernels.looked_at(spec.size, [(r["x0"], r["x1"], r["y0"], r["y1"]) for r in seen]), int(s0))
                images.append(image.tobytes())
            yield pd.DataFrame({"recording_id": pdf["recording_id"], "s0": pdf["s0"], "image": images})

    return parts.mapInPandas(paint, f"recording_id {tiles.schema['recording_id'].dataType.simpleString()}, s0 long, image binary")


def dataset_report(tiles: DataFrame, lines: DataFrame) -> DataFrame:
    """split, tiles, background (tiles without a line), events, per_class (class: events) of tiles(rec, s0, split) and their lines (tile_labels)."""
    told = lines.where("line is not null").select("rec", "s0", F.substring_index("line", " ", 1).alias("_cls"))
    per_tile = tiles.where("split is not null").join(told, ["rec", "s0"], "left")
    counts = per_tile.groupBy("split", "_cls").agg(F.count("*").alias("_n"))
    classes = counts.where("_cls is not null").groupBy("split").agg(F.sum("_n").alias("events"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_cls", F.col("_n").cast("string")))), ",").alias("per_class"))
    heads = per_tile.groupBy("split").agg(F.count_distinct("rec", "s0").alias("tiles"), F.count_if(F.col("_cls").isNull()).alias("background"))
    return heads.join(classes, "split", "left").select("split", "tiles", "background", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("per_class", F.lit("")).alias("per_class"))


def build_dataset(boxes: DataFrame, rects: DataFrame, grids: DataFrame, width: float, size: int, every: int = EVERY, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(tiles, lines): the planned tiles with their split, and the label lines on them.

    grids(rec, rate, length, total, f_low, f_high); boxes of several lanes are merged first. tiles(rec, s0, t0, t1, f0, f1, has_event, split).
    """
    plan = plan_tiles(rects, grids, seed=seed).join(grids, "rec")
    t0 = F.col("s0") / F.col("rate")
    placed = plan.select("rec", "s0", t0.alias("t0"), (t0 + F.col("length") / F.col("rate")).alias("t1"), F.col("f_low").alias("f0"), F.col("f_high").alias("f1"))
    lines = tile_labels(merge_lanes(boxes, width=width), placed, width, size)
    events = lines.where("line is not null").select("rec", "s0").distinct().withColumn("has_event", F.lit(True))
    tiles = placed.join(events, ["rec", "s0"], "left").withColumn("has_event", F.coalesce("has_event", F.lit(False)))
    return split_tiles(tiles, grids, every), lines
