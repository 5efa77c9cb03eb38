"""Resharding by minimum-cost flow.

Rows lie in old shards and are to lie in new ones of given capacities. The unit that moves is a block: all rows
of an old shard whose text falls in one hash bucket, so equal texts stay together. A block that is larger than a mean new
shard is dealt in parts by a second hash of the text, and only a text that is itself larger than a shard is dealt by row.
Block sizes are counted by Spark; a flow between shards (a few numbers each) says how many bytes leave which shard for which, blocks are
chosen to fill that flow, and only the shards whose rows change are rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldscope.llm.common import shared_path, table, unused


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] that sends all of supply within capacity at the least total cost, by successive shortest paths.

    sum(capacity) must be sum(supply) at least.
    """
    n, m = len(supply), len(capacity)
    flow, left, room = [[0] * m for _ in range(n)], list(supply), list(capacity)
    while any(left):
        far = [0 if left[i] else None for i in range(n)] + [None] * m  # distances of old shards, then new ones
        back: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] is not None and (far[n + j] is None or far[i] + cost[i][j] < far[n + j]):
                        far[n + j], back[n + j], changed = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[n + j] is not None and (far[i] is None or far[n + j] - cost[i][j] < far[i]):
                        far[i], back[i], changed = far[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (far[n + j], j))
        way, at = [], n + end
        while back[at] is not None:
            way.append((back[at], at))
            at = back[at]
        amount = min([left[at], room[end], *(flow[v][u - n] for u, v in way if u >= n)])
        for u, v in way:
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def assign_blocks(blocks: list[tuple[int, tuple, int]], capacity: list[int]) -> dict[tuple, int]:
    """New shard of each block (old shard, key, bytes): the flow's amounts stay, the largest that fit first; what
    leaves goes, largest first, where the most room is among the shards that the flow feeds."""
    n_old, n_new = 1 + max((b[0] for b in blocks), default=-1), len(capacity)
    supply = [0] * n_old
    for old, _, size in blocks:
        supply[old] += size
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(n_new)] for i in range(n_old)])
    fed = [j for j in range(n_new) if any(flow[i][j] for i in range(n_old) if i != j)]
    room, stays, gone, to = list(capacity), [flow[i][i] if i < n_new else 0 for i in range(n_old)], [], {}
    for old, key, size in sorted(blocks, key=lambda b: (-b[2], b[0], b[1])):
        if size <= stays[old]:
            stays[old] -= size
            room[old] -= size
            to[old, *key] = old
        else:
            gone.append((old, key, size))
    for old, key, size in gone:
        j = max({*fed, old} if old < n_new else fed, key=lambda j: (room[j], -j))
        room[j] -= size
        to[old, *key] = j
    return to


@dataclass
class ShardPlan:
    """New shard of each (old shard, block, part of the block); moved_bytes and least_bytes (the flow's own bound).

    split: parts of each oversized block that its small texts are dealt in. large: first part and parts of each large text (old shard, block, hash) there.
    """

    moves: dict[tuple, int]
    split: dict[tuple, int]
    large: dict[tuple, tuple[int, int]]
    blocks: int
    moved_bytes: int
    least_bytes: int
    shard_bytes: list[int]
    rewritten: list[int]


def text_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")


def _part(split: dict[tuple, int], large: dict[tuple, tuple[int, int]], old: str, block: str) -> Column:
    """0, but in a split block: small texts are dealt by a second hash of the text, large ones have parts of their own, dealt by id.

    At most as many blocks are split as there are shards, and eight times as many texts are large.
    """
    part = F.lit(0)
    for (o, b), n in split.items():
        inner = F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(n)).cast("int")
        for (at, in_block, text), (first, parts) in large.items():
            if (at, in_block) == (o, b):
                own = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int") + first if parts > 1 else F.lit(first)
                inner = F.when(F.xxhash64("text") == text, own).otherwise(inner)
        part = F.when((F.col(old) == o) & (F.col(block) == b), inner).otherwise(part)
    return part


def plan_shards(rows: DataFrame, capacities: int | list[int], blocks: int = 1024) -> ShardPlan:
    """rows(doc_id, text, old_shard). Block sizes come to the driver: old shards times blocks, whatever the row count.

    A block that is larger than a mean new shard is split by text: texts over an eighth of a mean shard are counted by Spark and move each for
    itself, the others are dealt by a second hash. Only a text that is larger than the largest new shard is split by row.
    """
    rows = rows.select("doc_id", "text", "old_shard", text_size().alias("size"), _block(blocks).alias("block"))
    sizes = {(o, b): n for o, b, n in rows.groupBy("old_shard", "block").agg(F.sum("size")).collect()}
    total = sum(sizes.values())
    capacity = even_capacities(total, capacities) if isinstance(capacities, int) else list(capacities)
    mean = max(1, total // len(capacity))
    split = {k: n for k, n in sizes.items() if n > mean}
    large: dict[tuple, tuple[int, int]] = {}
    found = [(o, (b, 0), n) for (o, b), n in sizes.items() if (o, b) not in split]
    if split:
        within = rows.where(" or ".join(f"(old_shard = {o} and block = {b})" for o, b in split))
        texts = within.groupBy("old_shard", "block", F.xxhash64("text").alias("hash")).agg(F.sum("size").alias("n")).where(F.col("n") > mean / 8)
        big = sorted(tuple(r) for r in texts.collect())  # fewer than eight a shard
        for k in split:
            split[k] = max(1, -(-8 * (split[k] - sum(n for o, b, _, n in big if (o, b) == k)) // mean))
        firsts = dict(split)
        for o, b, text, n in big:
            large[o, b, text] = (firsts[o, b], -(-8 * n // mean) if n > max(capacity) else 1)
            firsts[o, b] += large[o, b, text][1]
        parts = within.withColumn("part", _part(split, large, "old_shard", "block"))
        found += [(o, (b, p), n) for o, b, p, n in parts.groupBy("old_shard", "block", "part").agg(F.sum("size")).collect()]
    moves = assign_blocks(found, capacity)
    loads, moved, changed = [0] * len(capacity), 0, set()
    supply = [0] * (1 + max((o for o, _, _ in found), default=-1))
    for old, key, size in found:
        new = moves[old, *key]
        loads[new] += size
        supply[old] += size
        if new != old:
            moved += size
            changed |= {old, new}
    least = sum(max(0, s - (capacity[i] if i < len(capacity) else 0)) for i, s in enumerate(supply))
    return ShardPlan(moves, split, large, blocks, moved, least, loads, sorted(j for j in changed if j < len(capacity)))


def reshard(rows: DataFrame, plan: ShardPlan, path: str, cell_bytes: int = 64 << 20) -> DataFrame:
    """Writes the changed shards below path (one folder a shard) and returns all rows with shard and slot.

    rows(doc_id, text, old_shard, ...): columns named shard or slot are replaced. slot counts a shard's rows from 0 without a gap. Rows
    of a shard are numbered in cells dealt by id, so no task holds a whole shard; a cell's first slot is the count of rows in the cells
    before it. A null text is a text of no bytes; rows with a null doc_id and repeated rows are kept; an empty table gives no rows.
    """
    spark = rows.sparkSession
    n = len(plan.shard_bytes)
    cells = max(-(-max(plan.shard_bytes, default=0) // cell_bytes), -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // n), 1)
    names = [c for c in rows.columns if c not in ("shard", "slot", "old_shard")]
    block, part, cell, first, text = unused(rows, "_block", "_part", "_cell", "_first", "_text")
    moves = spark.createDataFrame([(*k, v) for k, v in plan.moves.items()], f"old_shard int, `{block}` int, `{part}` int, shard int")
    placed = (
        rows.select(*names, "old_shard", _block(plan.blocks).alias(block), F.xxhash64(F.lit(2), "text").alias(text))
        .withColumn(part, _part(plan.split, plan.large, "old_shard", block))
        .join(F.broadcast(moves), ["old_shard", block, part])  # as many rows as blocks, a parameter
        .select(*names, "old_shard", "shard", text, F.pmod(F.xxhash64("doc_id", text), F.lit(cells)).cast("int").alias(cell))
    )
    before = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", cell).agg(F.count("*").alias("n")).select("shard", cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    inside = Window.partitionBy("shard", cell).orderBy("doc_id", text, "old_shard")
    numbered = placed.join(counts, ["shard", cell]).withColumn("slot", (F.col(first) + F.row_number().over(inside) - 1).cast("long"))
    same = [j for j in range(n) if j not in plan.rewritten]
    numbered.where(F.col("shard").isin(plan.rewritten)).select(*names, "slot", "shard").write.partitionBy("shard").parquet(path)
    schema = numbered.select(*names, "slot", "shard").schema
    out = spark.read.schema(schema).parquet(path)
    return out.unionByName(numbered.where(F.col("shard").isin(same)).select(*names, "slot", "shard")) if same and plan.moves else out


def op4_min_cost_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 shards dealt by text to 16 of equal bytes."""
    docs = table(spark, sf_dir, "documents").withColumn("old_shard", F.pmod(F.crc32(F.coalesce("text", F.lit(""))), F.lit(12)).cast("int"))
    written = reshard(docs, plan_shards(docs, 16), shared_path(spark, "shards"))
    return written.select(
        "doc_id", text_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op4_min_cost_reshard": op4_min_cost_reshard}
ORACLES: dict[str, str] = {}
