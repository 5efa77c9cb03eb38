"""Connected components as rounds of joins that shrink the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import dropped, materialize


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """node, component for every node of edges(a, b); component is the smallest node reachable.

    Each round every node joins its neighbour (or itself) that comes first in an order drawn anew by hash, and
    the edges are rewritten between those. A round leaves a constant share of the nodes in expectation, whatever
    the shape of the graph, so rounds grow with the logarithm of the largest component. A node's neighbours are
    only aggregated, never gathered; each round is written to the shared folder. Null ends and loops give nothing.
    """
    edges = materialize(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), f"{tag}-edges")
    steps, turn, left = [], 0, edges
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("rank"), F.col(c).alias("id"))
        best = both.groupBy("a").agg(F.min(order("b")).alias("near")).select("a", F.least(F.col("near"), order("a"))["id"].alias("to"))
        best = materialize(best.select(F.col("a").alias("node"), "to"), f"{tag}-step")
        steps.append(best)
        left = (
            left.join(best.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
            .join(best.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
            .where("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct()
        )
        last, left, turn = left, materialize(left, f"{tag}-edges"), turn + 1
        dropped(last)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = steps[0].withColumnRenamed("to", "end")
    for step in steps[1:]:
        ends = ends.join(step.select(F.col("node").alias("end"), "to"), "end", "left").select("node", F.coalesce("to", "end").alias("end"))
    ends = materialize(ends, f"{tag}-ends")
    dropped(left, *steps)
    least = ends.groupBy("end").agg(F.min("node").alias("component"))
    return ends.join(least, "end").select("node", "component")
