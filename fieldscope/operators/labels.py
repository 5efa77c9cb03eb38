"""Hand labels(label_id, category, kind, channel, t0, t1, f0, f1): rules, queries and a log of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(labels: DataFrame) -> DataFrame:
    """The three rules of a label: reversed times and bands are swapped, a point has no end, a span without an end is a point."""
    kind = F.when((F.col("kind") == "span") & F.col("t1").isNotNull(), "span").otherwise("point")
    lo, hi = F.least("t0", "t1"), F.greatest("t0", "t1")
    both = F.col("f0").isNotNull() & F.col("f1").isNotNull()
    return labels.withColumns({
        "kind": kind, "t0": F.when(kind == "span", lo).otherwise(F.col("t0")), "t1": F.when(kind == "span", hi),
        "f0": F.when(both, F.least("f0", "f1")).otherwise(F.col("f0")), "f1": F.when(both, F.greatest("f0", "f1")).otherwise(F.col("f1")),
    })


def overlaps(t0: float, t1: float) -> Column:
    return (F.col("t0") <= t1) & (F.coalesce("t1", "t0") >= t0)


def on_channel(channels: list[int]) -> Column:
    return F.col("channel").isNull() | F.col("channel").isin(channels)


def label_window(labels: DataFrame, t0: float, t1: float, channels: list[int]) -> DataFrame:
    """The labels that reach into the closed window on one of the channels; a label without a channel is on all."""
    return labels.where(overlaps(t0, t1) & on_channel(channels))


def set_geometry(labels: DataFrame, updates: DataFrame) -> DataFrame:
    """labels with the geometry of updates(label_id, t0, t1, f0, f1) where one is given; a null leaves the old value. Adds changed."""
    names = ("t0", "t1", "f0", "f1")
    new = updates.select("label_id", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_given"))
    out = labels.join(new, "label_id", "left")
    moved = out.withColumns({f"old_{c}": F.col(c) for c in names}).withColumns({c: F.coalesce(f"_{c}", c) for c in names})
    same = F.lit(True)
    done = normalised(moved.drop(*(f"_{c}" for c in names)))
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return done.withColumn("changed", F.col("_given").isNotNull() & ~same).drop("_given", *(f"old_{c}" for c in names))


def current_labels(log: DataFrame) -> DataFrame:
    """The labels after log(seq, label_id, op, ...payload): the last add or change of each label, unless a later remove; clear removes all
    before it. Dropping the last seq undoes it."""
    cleared = log.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_cleared"))
    payload = [c for c in log.columns if c not in ("seq", "op", "label_id")]
    live = log.where("op <> 'clear'").crossJoin(F.broadcast(cleared)).where("seq > _cleared")
    last = live.groupBy("label_id").agg(F.max_by(F.struct("op", *payload), "seq").alias("m"))
    return last.where("m.op <> 'remove'").select("label_id", *(F.col(f"m.{c}").alias(c) for c in payload))


def categories(labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """name, kind, colour, n of vocabulary(position, name, kind) and of the categories only labels use: the first of each name; a kind that
    is neither point nor span is span; colours count from 0 to 7 in order."""
    first = vocabulary.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("position"))).where("_n = 1")
    used = labels.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"), F.min("kind").alias("_kind"))
    out = first.join(used, "name", "full")
    kind = F.coalesce(F.when(F.col("kind").isin("point", "span"), F.col("kind")), F.when(F.col("kind").isNull(), F.col("_kind")), F.lit("span"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.coalesce("position", F.lit(1 << 30)), "name"))  # one row a category
    return out.select("name", kind.alias("kind"), ((rank - 1) % 8).cast("int").alias("colour"), F.coalesce("n", F.lit(0)).alias("n"))


def learnable(labels: DataFrame, left_out: list[str], tile_s: float) -> DataFrame:
    """label_id, role, t0, t1: spans with a band teach; of the others and of categories left out the time is hidden, around a point by tile_s / 32."""
    teaches = (F.col("kind") == "span") & F.col("f0").isNotNull() & F.col("f1").isNotNull() & ~F.col("category").isin(left_out)
    pad = F.when(F.col("t1").isNull(), F.lit(tile_s / 32)).otherwise(0.0)
    return labels.select("label_id", F.when(teaches, "box").otherwise("hidden").alias("role"), (F.col("t0") - pad).alias("t0"), (F.coalesce("t1", "t0") + pad).alias("t1"))


def sync_classes(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, class_id: known(name, class_id) stay, new names(name, position) follow in the order first met."""
    fresh = names.groupBy("name").agg(F.min("position").alias("position")).join(known, "name", "left_anti")
    base = known.agg(F.coalesce(F.max("class_id") + 1, F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("position", "name"))  # one row a class
    return known.select("name", "class_id").unionByName(fresh.crossJoin(F.broadcast(base)).select("name", (F.col("_base") + rank - 1).cast("int").alias("class_id")))
