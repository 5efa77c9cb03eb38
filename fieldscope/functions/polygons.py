"""Outlines as arrays of points (t, f): held within a recording, cut at a rectangle, and taken from pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldscope.functions.scalars import rounded


def clamp_polygon(points: Column, duration: Column | float, nyquist: Column | float) -> Column:
    """Every point held between 0 and duration, and 0 and nyquist; as many points as before, null stays null."""
    held = lambda x, top: F.greatest(F.lit(0.0), F.least(x, F.lit(top) if isinstance(top, float) else top))
    return F.transform(points, lambda p: F.struct(held(p["t"], duration).alias("t"), held(p["f"], nyquist).alias("f")))


def outline_to_tf(points: Column, tile: tuple[Column, Column, Column, Column], width: int, height: int, seconds: float | None = None) -> Column:
    """Points (x, y) in pixels of a tile (t0, t1, f0, f1) as (t, f), to the six and three decimals that a label keeps; y runs against frequency.

    seconds: how long the tile is, where t1 - t0 tells it less exactly (late in a recording).
    """
    t0, t1, f0, f1 = tile
    t, f = (lambda p: t0 + p["x"] / width * (t1 - t0 if seconds is None else F.lit(float(seconds)))), (lambda p: f1 - p["y"] / height * (f1 - f0))
    return F.transform(points, lambda p: F.struct(rounded(t(p), 6).alias("t"), rounded(f(p), 3).alias("f")))


def _cut(points: Column, axis: str, bound: Column, above: Column) -> Column:
    """What of a closed outline lies on one side of a line: points inside stay, and where a side crosses the line its crossing comes in."""
    inside = lambda p: F.when(above, p[axis] >= bound).otherwise(p[axis] <= bound)
    other = "f" if axis == "t" else "t"

    def side(p: Column, i: Column) -> Column:
        q = F.element_at(points, F.when(i + 1 < F.size(points), i + 2).otherwise(1).cast("int"))
        at = p[other] + (bound - p[axis]) / (q[axis] - p[axis]) * (q[other] - p[other])
        crossing = F.struct((bound if axis == "t" else at).alias("t"), (bound if axis == "f" else at).alias("f"))
        none = F.filter(F.array(p), lambda _: F.lit(False))
        return F.concat(F.when(inside(p), F.array(p)).otherwise(none), F.when(inside(p) != inside(q), F.array(crossing)).otherwise(none))

    return F.flatten(F.transform(points, side))


def clip_polygon(points: Column, t0: Column | float, t1: Column | float, f0: Column | float, f1: Column | float) -> Column:
    """The part of an outline within a rectangle, edge by edge (Sutherland and Hodgman); empty where nothing is left or it has under three points.

    A point on an edge is inside. An outline that the rectangle cuts in parts comes back as one, its parts joined along the edges.
    """
    edges = [("t", t0, True), ("t", t1, False), ("f", f0, True), ("f", f1, False)]
    plan = F.array(*(F.struct(F.lit(axis).alias("axis"), (bound if isinstance(bound, Column) else F.lit(float(bound))).alias("bound"), F.lit(above).alias("above")) for axis, bound, above in edges))
    some = F.when(F.size(points) >= 3, points).otherwise(F.filter(points, lambda _: F.lit(False)))
    return F.aggregate(plan, some, lambda left, e: F.when(e["axis"] == "t", _cut(left, "t", e["bound"], e["above"])).otherwise(_cut(left, "f", e["bound"], e["above"])))
