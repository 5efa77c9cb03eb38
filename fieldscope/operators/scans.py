"""States carried along blocks of any number: a tree of affine maps, no level of which gathers more than a few blocks of a key.

A block takes a state s (a row vector) to s @ transition(n) + end, where n is its length. Maps of neighbours combine to one of the same kind, so
fan blocks are summed up to one row, fan of those to the next, until a key has one; then every level hands the state that
it is entered with down to the one below. That is log(blocks) / log(fan) rounds each way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.sources.tables import written

#: Blocks that one row of the next level sums up, and rows that a call works on (as expected).
FAN, CALL_ROWS = 256, 1 << 16


def _walk(pdf: pd.DataFrame, keys: list[str], transition: Callable[[int], np.ndarray], size: int, into: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(rows by group and block, groups, state before each row, state after each group); all groups take a step at once. into: the states that groups are entered with."""
    group = pdf.groupby([*keys, "_chunk"], sort=False, dropna=False).ngroup().to_numpy()
    order = np.lexsort((pdf["block"].to_numpy(), group))
    pdf, group, into = pdf.iloc[order], group[order], into[order]
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    place = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
    state, before = into[begins].copy(), np.zeros((len(pdf), size))
    lengths, ends = pdf["n"].to_numpy(), np.stack([np.asarray(e, dtype=np.float64) for e in pdf["state"]]) if len(pdf) else before
    step = {int(n): transition(int(n)) for n in np.unique(lengths)}
    by_place = np.argsort(place, kind="stable")
    for rows in np.split(by_place, np.flatnonzero(np.diff(place[by_place])) + 1):
        g = group[rows]
        at = np.searchsorted(group[begins], g)
        before[rows] = state[at]
        for n in np.unique(lengths[rows]):
            some = lengths[rows] == n
            state[at[some]] = state[at[some]] @ step[int(n)] + ends[rows[some]]
    return pdf, begins, before, state


def carried_states(ends: DataFrame, keys: Sequence[str], transition: Callable[[int], np.ndarray], size: int, fan: int = FAN) -> DataFrame:
    """keys, block, state: the state before each block of ends(keys, block, n, state), where state is what the block leaves when entered with zeros.

    Blocks of a key follow each other by number; numbers may be left out. Every key is entered with zeros. ends is read several times.
    """
    keys, spark = list(keys), ends.sparkSession
    kinds = ", ".join(f"{k} {ends.schema[k].dataType.simpleString()}" for k in keys)
    most = ends.agg(F.max("block")).first()[0]
    if most is None:
        return ends.select(*keys, "block", "state")

    def dealt(rows: DataFrame, count: int) -> DataFrame:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // CALL_ROWS)
        return rows.withColumn("_chunk", F.floor(F.col("block") / fan)).withColumn("_deal", F.pmod(F.xxhash64(*keys, "_chunk"), F.lit(tasks))).groupBy("_deal")

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, begins, _, after = _walk(pdf, keys, transition, size, np.zeros((len(pdf), size)))
        n = np.add.reduceat(rows["n"].to_numpy(), begins)
        return rows.iloc[begins][keys].assign(block=rows["_chunk"].to_numpy()[begins], n=n, state=list(after))

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        into = np.stack([np.zeros(size) if s is None else np.asarray(s, dtype=np.float64) for s in pdf["_into"]])
        rows, _, before, _ = _walk(pdf, keys, transition, size, into)
        return rows[[*keys, "block"]].assign(state=list(before))

    levels, counts = [ends], [ends.count()]
    while most >= fan:
        levels.append(written(dealt(levels[-1], counts[-1]).applyInPandas(totals, f"{kinds}, block long, n long, state array<double>"), "scan-level"))
        most, counts = most // fan, [*counts, levels[-1].count()]
    known = None
    for level, count in zip(reversed(levels), reversed(counts), strict=True):
        if known is None:
            rows = level.withColumn("_into", F.lit(None).cast("array<double>"))
        else:
            above = known.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("block").alias("_above"), F.col("state").alias("_into"))
            on = F.floor(F.col("block") / fan) == F.col("_above")
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
            rows = level.join(above, on).drop(*(f"_{k}" for k in keys), "_above")
        known = written(dealt(rows, count).applyInPandas(starts, f"{kinds}, block long, state array<double>"), "scan-starts")
    return known
