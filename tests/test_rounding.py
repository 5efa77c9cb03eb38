"""Numbers as text and rounded numbers, at values whose shortest decimal ends in a half."""

import math

import pytest
from pyspark.sql import functions as F

from fieldscope.functions import scalars
from fieldscope.operators import reviews

VALUES = [0.125, 1.005, 36.995, 0.35, 0.25, -0.25, 5e-7, -5e-7, -0.0, 9.9999995, 1725838.05, 129.0775, 2.0**53 + 2, 1e-300, 1e15 + 0.5]


@pytest.mark.parametrize("digits", [1, 2, 3, 4, 6])
def test_fixed_is_printf(spark, digits):
    rows = spark.createDataFrame([(x,) for x in [*VALUES, *(k / 32 + 1e6 for k in range(64)), *(k * 5e-7 for k in range(200)), None]], "x double")
    got = rows.select("x", scalars.fixed(F.col("x"), digits).alias("s")).collect()
    assert [r.s for r in got] == [None if r.x is None else "%.*f" % (digits, r.x) for r in got]


def test_marks_are_described_as_printf_does(spark):
    row = spark.createDataFrame([("click", 1234.25, 36.995), ("view", 0.05, None)], "c string, t double, v double")
    assert [r[0] for r in row.select(reviews.describe(F.col("c"), F.col("t"), F.col("v"))).collect()] == ["click 1234.2 s (36.99)", "view 0.1 s"]
