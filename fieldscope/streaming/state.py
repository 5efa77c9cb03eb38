"""Runs, islands and values in force as streams. Rows wait until the watermark has passed them, so late ones fall into their places; what is
emitted is what the batch operators give for the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldscope.operators.joins import bucket, neighbour

#: The state store that timers and lists need; a fixed value.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


class InOrder(StatefulProcessor):
    """Hands the rows of a key to step in the order of (first column, row), each once the watermark has passed it.

    waiting is kept as a list, what step needs to know as one row of kind, and a timer is set for every time at which rows wait and for every
    time that step asks to be woken at.
    """

    waits: str
    kind: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waits)
        self.known = handle.getValueState("known", self.kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            held = self.told(pdf)
            self.waiting.appendList(held)
            for at in {-(-r[0] // 1000) for r in held}:
                self.handle.registerTimer(max(at, 0))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        due = [r for r in held if r[0] <= now]
        known, out = (self.known.get() if self.known.exists() else None), []
        for r in due:
            known, made = self.step(known, r)
            out += made
        if due:
            self.waiting.clear()
            if len(due) < len(held):
                self.waiting.put([tuple(r) for r in held[len(due) :]])
        known, made = self.over(known, now)
        out += made
        if known is None:
            self.known.clear()
        else:
            self.known.update(tuple(known))
            wake = self.wake(known)
            if wake is not None and wake > now:
                self.handle.registerTimer(-(-wake // 1000))
        if out:
            yield self.frame(key, out)

    def close(self) -> None:
        pass


def _frame(keys: list[str], key: tuple, rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("t0", "t1"):
        out[c] = pd.to_datetime(out[c], unit="us")
    for i, k in enumerate(keys):
        out.insert(i, k, key[i])
    return out


class RunProcessor(InOrder):
    """States of pair_runs: the start that is open, if any, and whether there was a start or a loose stop before."""

    waits = "t long, row long, is_start boolean"
    kind = "t long, row long, open boolean, begun boolean"

    def __init__(self, keys: list[str], close_after: int):
        self.keys, self.close_after = keys, close_after

    def told(self, pdf):
        return list(zip(_micros(pdf["ts"]), pdf["row"].tolist(), pdf["is_start"].tolist(), strict=True))

    def step(self, known, r):
        t, row, is_start = r
        begun = known is not None and known[3]
        is_open = known is not None and known[2]
        made = []
        if is_open:
            made.append((known[1], known[0], t, False, is_start))
        elif not is_start and not begun:
            made.append((row, t, t, True, False))
        return ((t, row, True, True) if is_start else (t, row, False, True)), made

    def over(self, known, now):
        """An open run without any row for close_after ends where it began."""
        if known is not None and known[2] and known[0] + self.close_after <= now:
            return (known[0], known[1], False, True), [(known[1], known[0], known[0], False, True)]
        return known, []

    def wake(self, known):
        return known[0] + self.close_after if known[2] else None

    def frame(self, key, rows):
        return _frame(self.keys, key, rows, ["row", "t0", "t1", "open_left", "open_right"])


class SpanProcessor(InOrder):
    """State of merge_spans: the island that may still grow."""

    waits = "t0 long, row long, t1 long"
    kind = "t0 long, first_row long, reach long, last long, n long"

    def __init__(self, keys: list[str], tolerance: int):
        self.keys, self.tolerance = keys, tolerance

    def told(self, pdf):
        return list(zip(_micros(pdf["ts"]), pdf["row"].tolist(), _micros(pdf["ts_end"]), strict=True))

    def step(self, known, r):
        t0, row, t1 = r[0], r[1], max(r[0], r[2])
        if known is not None and t0 - known[2] <= self.tolerance:
            return (known[0], known[1], max(known[2], t1), t0, known[4] + 1), []
        return (t0, row, t1, t0, 1), [self._island(known)] if known is not None else []

    def _island(self, known):
        return known[0], max(known[2], known[3] + self.tolerance), known[1], known[4]

    def over(self, known, now):
        return (None, [self._island(known)]) if known is not None and known[2] + self.tolerance < now else (known, [])

    def wake(self, known):
        return known[2] + self.tolerance + 1000

    def frame(self, key, rows):
        return _frame(self.keys, key, rows, ["t0", "t1", "first_row", "n"])


def _stateful(rows: DataFrame, keys: list[str], processor: InOrder, schema: str, late: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(processor, f"{kinds}, {schema}", "Append", "EventTime")


def stream_pair_runs(rows: DataFrame, keys: list[str], late: str = "1 hour", close_after: float = 86400.0) -> DataFrame:
    """pair_runs of a stream rows(keys, ts, row, is_start); times are timestamps. A run is emitted once the watermark has passed what ends it.

    A start that no row follows within close_after seconds is a run that is open to the right, and ends where it begins; in the batch form it
    does so only if it is the last row of all. Rows later than the watermark are dropped. A row without a time takes no part.
    """
    made = "row long, t0 timestamp, t1 timestamp, open_left boolean, open_right boolean"
    return _stateful(rows.where("ts is not null").select(*keys, "ts", "row", "is_start"), keys, RunProcessor(keys, round(close_after * 1e6)), made, late)


def stream_merge_spans(spans: DataFrame, keys: list[str], tolerance: float = 0.0, late: str = "1 hour") -> DataFrame:
    """merge_spans of a stream spans(keys, ts, row, ts_end): an island is emitted once the watermark is past its end and the tolerance."""
    made = "t0 timestamp, t1 timestamp, first_row long, n long"
    return _stateful(spans.where("ts is not null and ts_end is not null").select(*keys, "ts", "row", "ts_end"), keys, SpanProcessor(keys, round(tolerance * 1e6)), made, late)


def stream_value_at(queries: DataFrame, series: DataFrame, keys: list[str], width: float = 86400.0) -> DataFrame:
    """queries(keys, t, ...), a stream, with value: the one of the static series(keys, t, row, value) in force at t, null before the first.

    The series is turned into stretches that each hold from a row to the next, cut at buckets of width, so the stream is joined on keys
    and bucket; the last row of a key holds on without end and is joined on keys alone.
    """
    each = neighbour(series.select(*keys, "t", "row", "value"), keys, ["t"], "_next", width, forward=True)
    names = {k: f"_{k}_of" for k in keys}
    held = each.where("_next is not null and _next.t > t").select(
        *(F.col(k).alias(names[k]) for k in keys), F.col("t").alias("_from"), F.col("_next.t").alias("_to"), F.struct("value").alias("_held"), F.explode(F.sequence(bucket(F.col("t"), width), bucket(F.col("_next.t"), width))).alias("_at")
    )
    last = each.where("_next is null").select(*(F.col(k).alias(f"_{k}_last") for k in keys), F.col("t").alias("_since"), F.struct("value").alias("_last"))
    asked = queries.withColumn("_b", bucket(F.col("t"), width))
    on = (F.col("_b") == F.col("_at")) & (F.col("t") >= F.col("_from")) & (F.col("t") < F.col("_to"))
    then = F.col("t") >= F.col("_since")
    for k in keys:
        on, then = on & (F.col(k) == F.col(names[k])), then & (F.col(k) == F.col(f"_{k}_last"))
    return asked.join(held, on, "left").join(last, then, "left").select(*queries.columns, F.coalesce("_held", "_last")["value"].alias("value"))
