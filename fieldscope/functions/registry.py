"""Named extension points: denoisers as functions of DataFrames, analyzers and label assistants as functions of NumPy or pandas. Traces are in operators/traces.py."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DENOISERS: dict[str, tuple[int, Callable]] = {}
ANALYZERS: dict[str, Callable[[pd.DataFrame], float]] = {}


def denoiser(name: str, order: int):
    """Registers cells, settings -> cells; chains run by order, whatever order they are asked in."""
    return lambda f: DENOISERS.setdefault(name, (order, f))[1]


def denoise(cells: DataFrame, chain: dict[str, dict]) -> DataFrame:
    for _, name in sorted((DENOISERS[n][0], n) for n in chain):
        cells = DENOISERS[name][1](cells, **chain[name])
    return cells


def analyze(pairs: DataFrame, names: list[str]) -> DataFrame:
    """region, analyzer, value, error for each region of pairs(region, t, value) and each named analyzer; one that fails costs its own row only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name in names:
            try:
                rows.append((pdf["region"].iloc[0], name, float(ANALYZERS[name](pdf.sort_values("t"))), None))
            except Exception as e:  # noqa: BLE001  an analyzer is the user's code
                rows.append((pdf["region"].iloc[0], name, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["region", "analyzer", "value", "error"])

    return pairs.select("region", "t", "value").groupBy("region").applyInPandas(run, "region long, analyzer string, value double, error string")


def refine_labels(labels: DataFrame, assistant: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """label_id, t0, t1, f0, f1 that an assistant answers for batches of labels; operators.labels.set_geometry merges them."""

    def run(batches):
        for pdf in batches:
            yield assistant(pdf)[["label_id", "t0", "t1", "f0", "f1"]]

    return labels.select("label_id", "t0", "t1", "f0", "f1").where(F.col("t1").isNotNull()).mapInPandas(run, "label_id long, t0 double, t1 double, f0 double, f1 double")


def _comb(cells: DataFrame, **settings) -> DataFrame:
    from fieldscope.operators.signals import mains_comb

    return mains_comb(cells, **settings)


def _coherence(cells: DataFrame, **settings) -> DataFrame:
    from fieldscope.operators.signals import spatial_coherence

    return spatial_coherence(cells, **settings)


denoiser("mains_comb", 10)(_comb)
denoiser("spatial_coherence", 20)(_coherence)
