"""Derived traces as a graph: each says what it is made from and how far around a sample it looks, and all that are asked for come from one pass.

A trace with a kernel maps samples to as many samples. Kernels that follow each other are run on one widened block, whose halo is the sum of
theirs, so the source is read once and what several traces are made from is worked out once. A trace of whole tables (a filter with a
memory that does not end) is a function of blocks; what it gives is written, and traces that are made from it begin anew from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from fieldscope.operators.signals import BLOCKS, KEYS, with_halo
from fieldscope.sources.tables import written

SOURCE = "data"


@dataclass(frozen=True)
class Trace:
    """before, after: how many samples of its source around one of its own a kernel needs. whole: make is a function of blocks and rate."""

    name: str
    source: str
    make: Callable
    before: int = 0
    after: int = 0
    whole: bool = False


TRACES: dict[str, Trace] = {}


def trace(name: str, source: str = SOURCE, before: int = 0, after: int = 0, whole: bool = False):
    """Registers make(samples, rate), or make(blocks, rate) where whole, under a name."""

    def add(make):
        if name == SOURCE or name in TRACES:
            raise ValueError(f"there is a trace {name} already")
        TRACES[name] = Trace(name, source, make, before, after, whole)
        return make

    return add


def chain(name: str, known: dict[str, Trace]) -> list[Trace]:
    """The traces from the source to name, in the order in which they are made."""
    out: list[Trace] = []
    while name != SOURCE:
        if name not in known:
            raise KeyError(f"no trace {name}")
        if known[name] in out:
            raise ValueError(f"{name} is made from itself")
        out.insert(0, known[name])
        name = known[name].source
    return out


def reach(path: Iterable[Trace]) -> tuple[int, int]:
    """How far the last of traces that follow each other looks around in the first one's source."""
    return sum(t.before for t in path), sum(t.after for t in path)


def derive(blocks: DataFrame, rate: float, names: list[str], known: dict[str, Trace] | None = None) -> DataFrame:
    """trace and the columns of blocks, for each of names. A block must be as long as the sum of halos along a chain at least."""
    known = TRACES if known is None else known
    chains = {n: chain(n, known) for n in names}
    bases: dict[str, DataFrame] = {SOURCE: blocks}

    def base(path: list[Trace]) -> tuple[str, list[Trace]]:
        """The last written table along a chain, and the kernels from there on."""
        at = max((i + 1 for i, t in enumerate(path) if t.whole), default=0)
        if not at:
            return SOURCE, path
        last = path[at - 1]
        if last.name not in bases:
            above = path[: at - 1]
            made = derive(blocks, rate, [last.source], known).drop("trace") if above else blocks
            bases[last.name] = written(last.make(made, rate), f"trace-{last.name}")
        return last.name, path[at:]

    plans: dict[str, dict[str, list[Trace]]] = {}
    for n, path in chains.items():
        start, kernels = base(path)
        plans.setdefault(start, {})[n] = kernels
    parts = [_pass(bases[start], rate, plan) for start, plan in plans.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pass(blocks: DataFrame, rate: float, plan: dict[str, list[Trace]]) -> DataFrame:
    before, after = (max(r) for r in zip(*(reach(p) for p in plan.values()), strict=True))

    def run(batches):
        for pdf in batches:
            rows = []
            for rec, ch, block, start, n, lead, x in pdf[["recording_id", "channel", "block", "start_frame", "n", "lead", "samples"]].itertuples(index=False):
                made: dict[str, np.ndarray] = {}
                for name, path in plan.items():
                    y = np.asarray(x, dtype=np.float64)
                    for t in path:
                        if t.name not in made:
                            made[t.name] = np.asarray(t.make(y, rate), dtype=np.float64)
                        y = made[t.name]
                    rows.append((name, rec, ch, block, start, y[lead : lead + n]))
            yield pd.DataFrame(rows, columns=["trace", "recording_id", "channel", "block", "start_frame", "samples"])

    return with_halo(blocks, before, after).mapInPandas(run, f"trace string, {BLOCKS}")


class WindowStats:
    """A table function: start_frame, mean, peak of each n samples of blocks, along a partition in order.

    window_stats(TABLE(blocks) PARTITION BY (recording_id, channel) ORDER BY (block), n). The columns it is parted by come out too, whatever they are. It
    holds one block and what is left of the one before; a last window that is not full has no row.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or n.value is None or n.value < 1:
            raise ValueError("window_stats takes a table and a number of samples")
        own = [f for f in table.dataType.fields if f.name in KEYS]
        return AnalyzeResult(StructType([*own, StructField("start_frame", LongType()), StructField("mean", DoubleType()), StructField("peak", DoubleType())]))

    def __init__(self):
        self.left = np.zeros(0)

    def eval(self, row, n: int):
        x = np.concatenate([self.left, np.asarray(row["samples"], dtype=np.float64)])
        first, whole = row["start_frame"] - len(self.left), len(x) // n * n
        own = [row[c] for c in KEYS if c in row]
        for i in range(0, whole, n):
            part = x[i : i + n]
            yield (*own, first + i, float(part.mean()), float(np.abs(part).max()))
        self.left = x[whole:]


def register_table_functions(spark: SparkSession) -> None:
    """Makes window_stats callable from SQL."""
    spark.udtf.register("window_stats", F.udtf(WindowStats))


@trace("smooth", before=2, after=2)
def _smooth(x: np.ndarray, rate: float) -> np.ndarray:
    """The mean of five samples; at the ends of a recording of those there are."""
    return np.convolve(x, np.ones(5), "same") / np.convolve(np.ones(len(x)), np.ones(5), "same")


@trace("detail", before=2, after=2)
def _detail(x: np.ndarray, rate: float) -> np.ndarray:
    return x - _smooth(x, rate)


@trace("slope", "smooth", before=1)
def _slope(x: np.ndarray, rate: float) -> np.ndarray:
    """Change a second; 0 at the first sample of a recording."""
    return np.diff(x, prepend=x[:1]) * rate


@trace("band", whole=True)
def _band(blocks: DataFrame, rate: float) -> DataFrame:
    from fieldscope.operators.signals import band_filter

    return band_filter(blocks, rate, rate / 16, rate / 4)


@trace("envelope", "band", before=4, after=4)
def _envelope(x: np.ndarray, rate: float) -> np.ndarray:
    """The largest of nine samples about each, without sign."""
    padded = np.pad(np.abs(x), 4)
    return np.lib.stride_tricks.sliding_window_view(padded, 9).max(axis=1)
