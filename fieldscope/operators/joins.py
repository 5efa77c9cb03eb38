"""As-of, interval and nearest joins as unions, buckets and windows.

A window over one key would put a long recording in one task. Helpers here therefore work in two levels: rows are cut in
time buckets, each bucket's summary is carried along the key (one row a bucket), and windows run inside buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(t: Column, width: float) -> Column:
    return F.floor(t / F.lit(width)).cast("long")


def value_in_force(queries: DataFrame, series: DataFrame, keys: list[str], width: float = 86400.0, inclusive: bool = True) -> DataFrame:
    """queries(keys, t, ...) with held: the struct (t, value) of the last row of series(keys, t, row, value) at or before t.

    A row whose value is null holds too: held is then not null but held.value is. Before the first row held is null. Of
    rows at one time the one with the largest row counts. inclusive=False takes only rows strictly before t.
    """
    spark_row = F.struct(F.col("t").alias("t"), F.col("row").alias("row"), F.col("value").alias("value"))
    marks = series.select(*keys, "t", bucket(F.col("t"), width).alias("_b"), spark_row.alias("_mark"), F.lit(1 if not inclusive else 0).alias("_order"))
    carry = marks.groupBy(*keys, "_b").agg(F.max_by("_mark", F.struct("_mark.t", "_mark.row")).alias("_last"))
    asked = queries.select("*", bucket(F.col("t"), width).alias("_b"), F.lit(0 if not inclusive else 1).alias("_order"))
    names = [c for c in queries.columns if c not in (*keys, "t")]
    both = asked.select(*keys, "t", "_b", "_order", F.struct(*(F.col(c) for c in names)).alias("_own"), F.lit(True).alias("_asked")).unionByName(
        marks.select(*keys, "t", "_b", "_order", "_mark").withColumn("_asked", F.lit(False)), allowMissingColumns=True
    )
    buckets = both.select(*keys, "_b").distinct().join(carry, [*keys, "_b"], "left")
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.select(*keys, "_b", F.last("_last", ignorenulls=True).over(along).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("t", "_order", F.col("_mark.row")).rowsBetween(Window.unboundedPreceding, 0)
    held = both.join(before, [*keys, "_b"]).withColumn("held", F.coalesce(F.last("_mark", ignorenulls=True).over(inside), F.col("_before")))
    return held.where("_asked").select(*keys, "t", *(F.col(f"_own.{c}").alias(c) for c in names), "held")


def next_mark(queries: DataFrame, series: DataFrame, keys: list[str], forward: bool, width: float = 86400.0) -> DataFrame:
    """queries with found: the first mark strictly after t, or the last strictly before it; null where there is none."""
    if not forward:
        out = value_in_force(queries, series.withColumn("value", F.lit(None).cast("double")), keys, width, inclusive=False)
        return out.withColumn("found", F.col("held.t")).drop("held")
    flip = lambda df: df.withColumn("t", -F.col("t"))
    out = value_in_force(flip(queries), flip(series.withColumn("value", F.lit(None).cast("double"))), keys, width, inclusive=False)
    return flip(out.withColumn("found", -F.col("held.t"))).drop("held")


def in_buckets(spans: DataFrame, width: float, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """A row for each time bucket that a span (t0 <= t1) reaches, as _b.

    Spark reckons the rows of an explode, here and in what made the spans, as if there were one for each before; joins on buckets therefore sort and
    are not broadcast.
    """
    return spans.withColumn("_b", F.explode(F.sequence(bucket(F.col(t0), width), bucket(F.greatest(t0, t1), width))))


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], width: float, closed: bool = False) -> DataFrame:
    """Pairs of points(keys, t, ...) and spans(keys, t0, t1, ...) with t0 <= t < t1 (<= t1 where closed)."""
    p = points.withColumn("_b", bucket(F.col("t"), width))
    inside = (F.col("t0") <= F.col("t")) & ((F.col("t") <= F.col("t1")) if closed else (F.col("t") < F.col("t1")))
    return p.join(in_buckets(spans, width).hint("merge"), [*keys, "_b"]).where(inside).drop("_b")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of a(keys, t0, t1, ...) and b(keys, t0_b, t1_b, ...) that share some time; each pair once."""
    first = F.greatest(bucket(F.col("t0"), width), bucket(F.col("t0_b"), width))
    pairs = in_buckets(a, width).join(in_buckets(b, width, "t0_b", "t1_b").hint("merge"), [*keys, "_b"])
    return pairs.where((F.col("_b") == first) & (F.col("t0") < F.col("t1_b")) & (F.col("t0_b") < F.col("t1"))).drop("_b")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """left(keys, row, t) with match_row, match_t, delta of the nearest right(keys, row, t) within tolerance; of two as near the later, then the larger row."""
    r = right.select(*keys, F.col("row").alias("match_row"), F.col("t").alias("match_t"), F.explode(F.sequence(bucket(F.col("t"), tolerance) - 1, bucket(F.col("t"), tolerance) + 1)).alias("_b"))
    pairs = left.withColumn("_b", bucket(F.col("t"), tolerance)).join(r, [*keys, "_b"]).withColumn("delta", F.abs(F.col("t") - F.col("match_t"))).where(F.col("delta") <= tolerance)
    best = pairs.groupBy(*keys, "row").agg(F.min_by(F.struct("match_row", "match_t", "delta"), F.struct("delta", -F.col("match_t"), -F.col("match_row"))).alias("m"))
    return left.join(best, [*keys, "row"], "left").select(*left.columns, "m.match_row", "m.match_t", "m.delta")


def nearest_mark(queries: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """queries(keys, t, ...) with mark_t: the mark of series(keys, t, row) strictly before or after t that is nearer, the later of two as near; null where there is none."""
    both = next_mark(next_mark(queries, series, keys, True).withColumnRenamed("found", "_after"), series, keys, False)
    later = F.col("found").isNull() | (F.col("_after") - F.col("t") <= F.col("t") - F.col("found"))
    return both.withColumn("mark_t", F.coalesce(F.when(later, F.col("_after")).otherwise(F.col("found")), "found")).drop("_after", "found")


def spans_at(points: DataFrame, spans: DataFrame, keys: list[str], width: float) -> DataFrame:
    """id, keys, span_row, n_spans of points(id, keys, t): the innermost of spans(keys, row, t0, t1; t0 <= t < t1) that hold it, which began last, and how many do."""
    pairs = points_in_spans(points, spans, keys, width)
    return pairs.groupBy("id", *keys).agg(F.max_by("row", F.struct("t0", "row")).alias("span_row"), F.count("*").alias("n_spans"))


def merge_spans(spans: DataFrame, keys: list[str], tolerance: float = 0.0, width: float = 86400.0) -> DataFrame:
    """keys, t0, t1, first_row, n of the islands of spans(keys, row, t0, t1): a span joins the one before if it starts within
    tolerance of the furthest end so far. An inverted span ends where it starts; an island reaches its last start plus tolerance at least."""
    rows = spans.withColumn("_end", F.greatest("t0", "t1")).withColumn("_b", bucket(F.col("t0"), width))
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_b").orderBy("t0", "row")
    reach = rows.groupBy(*keys, "_b").agg(F.max("_end").alias("_m")).withColumn("_reach", F.max("_m").over(along)).drop("_m")
    rows = rows.join(reach, [*keys, "_b"])
    seen = F.greatest(F.max("_end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_reach"))
    rows = rows.withColumn("_new", F.when(seen.isNull() | (F.col("t0") - seen > tolerance), 1).otherwise(0))
    heads = rows.groupBy(*keys, "_b").agg(F.sum("_new").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    islands = rows.join(heads, [*keys, "_b"]).withColumn("_island", F.col("_base") + F.sum("_new").over(inside))
    # rows of one island and bucket are added up first, so a long island is not gathered
    return islands.groupBy(*keys, "_island").agg(
        F.min("t0").alias("t0"), F.greatest(F.max("_end"), F.max("t0") + tolerance).alias("t1"), F.min_by("row", F.struct("t0", "row")).alias("first_row"), F.count("*").alias("n")
    ).drop("_island")


def along(
    rows: DataFrame, keys: list[str], width: float, order: tuple[str, ...] = ("t", "row"), *, sums: dict[str, str] | None = None, before: dict[str, list[str]] | None = None,
    after: dict[str, list[str]] | None = None, reach: dict[str, str] | None = None,
) -> DataFrame:
    """rows with, for each name, what lies along a key in order: sums: of a column up to the row (rows of equal order share it); before and after: the
    struct of columns of the row beside it, null where there is none; reach: the largest value of a column of all rows before it, null for the first.

    order begins with a time or frame, which is cut in buckets of width. One table of a row a bucket carries all of them along the key; all windows
    run in the same sorted buckets, so rows are shuffled once for any number of names, and read twice.
    """
    sums, before, after, reach = sums or {}, before or {}, after or {}, reach or {}
    cut, at, by = rows.withColumn("_b", bucket(F.col(order[0]), width)), F.struct(*order), Window.partitionBy(*keys).orderBy("_b")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()] + [F.max_by(F.struct(*c), at).alias(f"_last_{n}") for n, c in before.items()]
    ends += [F.min_by(F.struct(*c), at).alias(f"_first_{n}") for n, c in after.items()] + [F.max(c).alias(f"_far_{n}") for n, c in reach.items()]
    carried = [F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums] + [F.lag(f"_last_{n}").over(by).alias(f"_c_{n}") for n in before]
    carried += [F.lead(f"_first_{n}").over(by).alias(f"_c_{n}") for n in after] + [F.max(f"_far_{n}").over(earlier).alias(f"_c_{n}") for n in reach]
    edges = cut.groupBy(*keys, "_b").agg(*ends).select(*keys, "_b", *carried)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    own = {n: F.col(f"_c_{n}") + F.sum(c).over(inside) for n, c in sums.items()} | {n: F.coalesce(F.lag(F.struct(*c)).over(inside), F.col(f"_c_{n}")) for n, c in before.items()}
    own |= {n: F.coalesce(F.lead(F.struct(*c)).over(inside), F.col(f"_c_{n}")) for n, c in after.items()}
    own |= {n: F.greatest(F.max(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col(f"_c_{n}")) for n, c in reach.items()}
    return cut.join(edges, [*keys, "_b"]).withColumns(own).drop("_b", *(f"_c_{n}" for n in own))


def neighbour(rows: DataFrame, keys: list[str], columns: list[str], name: str, width: float, order: tuple[str, ...] = ("t", "row"), forward: bool = False) -> DataFrame:
    """rows with name: the struct of columns of the row before (forward: after) it in order within keys, null where there is none."""
    return along(rows, keys, width, order, **{"after" if forward else "before": {name: columns}})


def running_sum(rows: DataFrame, keys: list[str], value: str, name: str, width: float, order: tuple[str, ...] = ("t", "row")) -> DataFrame:
    """rows with name: the sum of value up to each row in order within keys; rows of equal order share it."""
    return along(rows, keys, width, order, sums={name: value})


def reach_before(rows: DataFrame, keys: list[str], end: str, name: str, width: float, order: tuple[str, ...]) -> DataFrame:
    """rows with name: the largest end of all rows before it in order within keys, null for the first."""
    return along(rows, keys, width, order, reach={name: end})


def time_islands(rows: DataFrame, keys: list[str], gap: float, t0: str = "t0", t1: str = "t1", name: str = "island", width: float = 86400.0) -> DataFrame:
    """rows with the number of its island: a new one starts where t0 is over gap after every end before it."""
    order = (t0, t1) if t0 != t1 else (t0,)
    reached = reach_before(rows, keys, t1, "_reach", width, order)
    fresh = reached.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(t0) - F.col("_reach") > gap), 1).otherwise(0)).drop("_reach")
    return running_sum(fresh, keys, "_new", name, width, order).drop("_new")
