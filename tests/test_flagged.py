"""Runs of flagged samples do not depend on blocks, and are what loops over samples give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscope.operators import flagged
from fieldscope.operators.signals import to_blocks


def runs_by_hand(flag):
    out, begin = set(), None
    for i, f in enumerate([*flag, False]):
        if f and begin is None:
            begin = i
        if not f and begin is not None:
            out.add((begin, i))
            begin = None
    return out


@pytest.mark.parametrize("length", [3, 16, 400])
def test_runs_across_blocks(spark, length):
    rng = np.random.default_rng(0)
    x = np.where(rng.random((2, 331)) < 0.75, 1.0, -1.0) * rng.uniform(0.5, 2, (2, 331))
    x[1, 100:200], x[0, 7] = 1.5, np.nan
    blocks = to_blocks(spark.createDataFrame([("r", c, i, float(v)) for c in range(2) for i, v in enumerate(x[c])], "recording_id string, channel int, frame long, value double"), length)
    body, seeds = flagged.flag_runs(blocks, lambda v: (v > 0) & ~F.isnan(v), 32.0), flagged.flag_runs(blocks, lambda v: (v > 1.8) & ~F.isnan(v), 32.0)
    told = lambda df, c: {(r.a, r.z) for r in df.collect() if r.channel == c}
    held, wide = flagged.runs_holding(body, seeds, 32.0).collect(), None
    lengths = spark.createDataFrame([("r", 331)], "recording_id string, n long")
    wide = flagged.dilated(flagged.short_runs(body, 3), 2, lengths, 32.0)
    rows = body.collect()
    for c in (0, 1):
        want, hot = runs_by_hand(x[c] > 0), runs_by_hand(x[c] > 1.8)
        assert {(r.a, r.z) for r in rows if r.channel == c} == want
        assert {(r.a, r.z) for r in held if r.channel == c} == {(a, z) for a, z in want if any(a < e and b < z for b, e in hot)}
        mask = np.zeros(331, bool)
        for a, z in want:
            if z - a < 3:
                mask[max(a - 2, 0) : z + 2] = True
        assert told(wide, c) == runs_by_hand(mask)
        assert told(flagged.long_runs(body, 5), c) == {(a, z) for a, z in want if z - a >= 5}
    assert flagged.flag_runs(blocks.limit(0), lambda v: v > 0).collect() == []
