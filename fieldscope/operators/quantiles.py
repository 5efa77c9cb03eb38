"""Exact quantiles whatever a key's size: values of small keys are sorted in one buffer, those of large ones are never gathered.

For a large key the rank is looked for digit by digit (radix selection): doubles become 64-bit numbers in the same order, one
aggregation counts the first digits, the digit that holds the rank is kept with the values that begin with it, and so on.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from fieldscope.sources.tables import written

#: Bits of the digits, 64 in all: a key has at most 2**13 counts in a pass, and there are five passes.
DIGITS = (13, 13, 13, 13, 12)
#: Rows of a key up to which its values are gathered.
SMALL = 1 << 17
_TOP = np.uint64(1 << 63)


@F.arrow_udf(LongType())
def _code(value: pa.Array) -> pa.Array:
    """64 bits that are ordered, without sign, as the doubles are: not-a-number last, and both zeros alike."""
    x = value.to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(x), np.float64(np.nan), x).view(np.uint64)
    return pa.array(np.where(bits & _TOP, ~bits, bits | _TOP).view(np.int64))


@F.arrow_udf(DoubleType())
def _value(code: pa.Array) -> pa.Array:
    bits = code.to_numpy(zero_copy_only=False).view(np.uint64)
    return pa.array(np.where(bits & _TOP, bits & ~_TOP, ~bits).view(np.float64))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """Inner join on keys, of which nulls are equal, and on more."""
    named = b.select(*(F.col(k).alias(f"_{k}_of") for k in keys), *(c for c in b.columns if c not in keys and c not in more), *(F.col(m).alias(f"_{m}_of") for m in more))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}_of"))
    for m in more:
        on = on & (F.col(m) == F.col(f"_{m}_of"))
    return a.join(named, on).drop(*(f"_{k}_of" for k in (*keys, *more)))


def ranked_values(rows: DataFrame, keys: Sequence[str], ranks: DataFrame) -> DataFrame:
    """keys, rank, value: the value of rows(keys, value) that has each of ranks(keys, rank), counted from 0 in ascending order.

    rows has no nulls and all that ranks asks for. One pass a digit; after each only values that share a digit with a sought one are left.
    """
    left = written(rows.select(*keys, _code("value").alias("_code")), "quantile-codes")
    sought = ranks.select(*keys, "rank", F.col("rank").alias("_rest"), F.lit(0).cast("long").alias("_head"))
    done = 0
    for bits in DIGITS:
        head = F.shiftrightunsigned("_code", 64 - done) if done else F.lit(0).cast("long")
        digit = F.shiftrightunsigned("_code", 64 - done - bits).bitwiseAND(F.lit((1 << bits) - 1))
        if done:  # the values that begin with a head that is sought
            left = written(_same(left.withColumn("_head", head), sought.select(*keys, "_head").distinct(), keys, "_head").select(*keys, "_code"), "quantile-codes")
        counts = left.groupBy(*keys, head.alias("_head"), digit.alias("_digit")).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*keys, "_head").orderBy("_digit")  # at most 2**bits rows
        counts = counts.withColumn("_upto", F.sum("_n").over(w))
        met = _same(sought, counts, keys, "_head").where((F.col("_rest") < F.col("_upto")) & (F.col("_rest") >= F.col("_upto") - F.col("_n")))
        sought = written(met.select(*keys, "rank", (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_rest"), (F.shiftleft("_head", bits) + F.col("_digit")).alias("_head")), "quantile-heads")
        done += bits
    return sought.select(*keys, "rank", _value("_head").alias("value"))


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: Column | str, percentages: Sequence[float], small: int = SMALL) -> DataFrame:
    """keys, n, quantiles: the values at (n - 1) * percentage of each key, between two neighbours in proportion; nulls are not counted.

    The same as percentile, whose buffer holds all of a key's different values. A key without a value has no row. Not-a-number is the largest
    value, and null keys are one key. rows is read twice, and twice more if some key has over small values.
    """
    values = rows.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("value")).where("value is not null")
    counts = values.groupBy(*keys).agg(F.count("*").alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= small:
        return values.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("value", list(percentages)).alias("quantiles"))
    counts = written(counts, "quantile-counts")
    few, many = counts.where(F.col("n") <= small), counts.where(F.col("n") > small)
    gathered = _same(values, few, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.percentile("value", list(percentages)).alias("quantiles")).where("n is not null")
    at = [(F.col("n") - 1) * p for p in percentages]
    ranks = many.select(*keys, F.explode(F.array_distinct(F.array(*(f(a).cast("long") for a in at for f in (F.floor, F.ceil))))).alias("rank"))
    found = ranked_values(_same(values, many.drop("n"), keys), keys, ranks)
    by_rank = _same(many, found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")), keys)
    low, high = ([F.element_at("_at", f(a).cast("long")) for a in at] for f in (F.floor, F.ceil))
    each = [F.when(lo == hi, lo).otherwise((F.ceil(a) - a) * lo + (a - F.floor(a)) * hi) for a, lo, hi in zip(at, low, high, strict=True)]
    return gathered.unionByName(by_rank.select(*keys, "n", F.array(*each).alias("quantiles")))

