"""Layers of sessions: trials, pulses, detections, events and controls as marks and spans, with what does not fit together.

Tables carry keys that tell sessions apart, and their own row number; times are recording times. A table that a session lacks is no empty layer:
layers come from rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.functions.scalars import fixed
from fieldscope.operators.joins import nearest_within
from fieldscope.operators.quantiles import exact_quantiles
from fieldscope.operators.runs import pair_runs

#: Tolerance of a match where the session names none, bins of a session without file joins, and tolerances from which a residual is told; fixed values.
TOLERANCE, BINS, FAR = 5e-4, 8, 10.0
RUN_STARTED, RUN_STOPPED = "localization_started", "localization_stopped"


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def trial_spans(trials: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, layer, t0, t1, open_left, open_right, inverted of trials(treatment, recording_time_s, recording_ended_s); layer is null for
    a treatment that is blank or unknown. A missing end is an instant that is open to the right; one before the start stays and is marked."""
    layer = F.when(F.col("treatment").isin("volley", "baseline", "silence"), F.concat(F.lit("trials."), F.col("treatment")))
    t0, t1 = F.col("recording_time_s"), F.col("recording_ended_s")
    return trials.select(*keys, "row", layer.alias("layer"), t0.alias("t0"), F.coalesce(t1, t0).alias("t1"), F.lit(False).alias("open_left"), t1.isNull().alias("open_right"), F.coalesce(t1 < t0, F.lit(False)).alias("inverted"))


def pulse_marks(pulses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, layer, observed, t, disagree of pulses(pulse_type, match_status, detected_time_s, recording_time_s).

    A session with any match_status goes by it, one with any detected time by that, and one with neither has all pulses observed. disagree: matched
    without a detected time, or the other way round. layer is null for other types.
    """
    kind = F.when(F.col("pulse_type").isin("localization", "baseline"), "pulses.resting").when(F.col("pulse_type") == "volley", "pulses.volley")
    has = pulses.groupBy(*keys).agg((F.count("match_status") > 0).alias("_status"), F.max(finite(F.col("detected_time_s"))).alias("_times"))
    matched, heard = F.coalesce(F.col("match_status") == "matched", F.lit(False)), finite(F.col("detected_time_s"))
    observed = F.when(F.col("_status"), matched).when(F.col("_times"), heard).otherwise(True)
    out = pulses.join(has, keys)
    return out.select(*keys, "row", kind.alias("layer"), observed.alias("observed"), F.col("recording_time_s").alias("t"), (F.col("_status") & F.col("_times") & (matched != heard)).alias("disagree"))


def detection_marks(detections: DataFrame, pulses: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """keys, row, layer, series, t, disagree of detections(explained_by_log, source_row, recording_time_s).

    An explained one belongs to the series of the pulse that was heard nearest to it within tolerance (volley or resting), else to unjoined.
    disagree: explained_by_log and source_row say different things.
    """
    explained = F.coalesce("explained_by_log", F.lit(False))
    rows = detections.select(*keys, "row", F.col("recording_time_s").alias("t"), explained.alias("_e"), (F.col("source_row").isNull() == explained).alias("disagree"))
    heard = pulses.where(finite(F.col("detected_time_s"))).select(*keys, F.col("row"), F.col("detected_time_s").alias("t"))
    met = nearest_within(rows.where("_e").select(*keys, "row", "t"), heard, keys, tolerance).select(*keys, "row", "match_row")
    kinds = pulses.select(*keys, F.col("row").alias("match_row"), F.when(F.col("pulse_type") == "volley", "volley").otherwise("resting").alias("_kind"))
    parent = met.join(kinds, [*keys, "match_row"], "left").select(*keys, "row", "_kind")
    series = F.when(F.col("_e"), F.coalesce("_kind", F.lit("unjoined"))).otherwise("unexplained")
    return rows.join(parent, [*keys, "row"], "left").select(*keys, "row", F.when(F.col("_e"), "detections.explained").otherwise("detections.unexplained").alias("layer"), series.alias("series"), "t", "disagree")


def run_spans(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, layer, t0, t1, open_left, open_right of the localization runs in events(event, recording_time_s)."""
    edges = events.where(F.col("event").isin(RUN_STARTED, RUN_STOPPED)).select(*keys, "row", F.col("recording_time_s").alias("t"), (F.col("event") == RUN_STARTED).alias("is_start"))
    return pair_runs(edges, keys).select(*keys, "row", F.lit("runs").alias("layer"), "t0", "t1", "open_left", "open_right")


def event_marks(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, layer, series (log or fault), t: a fault lost records or had its radio link down; a null says nothing."""
    fault = F.coalesce(F.col("records_lost") > 0, F.lit(False)) | F.coalesce(~F.col("radio_link_up"), F.lit(False))
    return events.select(*keys, "row", F.lit("events").alias("layer"), F.when(fault, "fault").otherwise("log").alias("series"), F.col("recording_time_s").alias("t"))


def control_ranges(controls: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, name, lo, hi, flat of the control channels named; a channel without values has no row."""
    each = controls.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("c"))
    return each.where("c.value is not null").groupBy(*keys, "c.name").agg(F.min("c.value").alias("lo"), F.max("c.value").alias("hi")).withColumn("flat", F.col("lo") == F.col("hi"))


def build_controls(controls: DataFrame, meta: DataFrame, names: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(steps, flat) of the settings controls(keys, row, recording_time_s, names...), each held until the next row; meta(keys, duration_s).

    steps: keys, name, row, t, t_end, value of the settings that vary, nulls included; t_end is the duration, or the last row where none is told. flat:
    keys, told: the settings that held one value throughout, which have no steps. A setting without a value, or that the table lacks, is in neither.
    """
    there = [n for n in names if n in controls.columns]
    ranges = control_ranges(controls, keys, there)
    placed = controls.where(finite(F.col("recording_time_s")))
    ends = placed.groupBy(*keys).agg(F.max("recording_time_s").alias("_last")).join(meta.select(*keys, "duration_s"), keys, "left")
    ends = ends.select(*keys, F.when(F.col("duration_s") > 0, F.col("duration_s")).otherwise(F.col("_last")).alias("t_end"))
    each = placed.select(*keys, "row", F.col("recording_time_s").alias("t"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in there))).alias("c")).select(*keys, "c.name", "row", "t", "c.value")
    steps = each.join(ranges.where("not flat").select(*keys, "name"), [*keys, "name"]).join(ends, keys).select(*keys, "name", "row", "t", "t_end", "value")
    told = F.concat(F.col("name"), F.lit(" held "), F.regexp_replace(fixed(F.col("lo"), 6), r"\.?0+$", ""), F.lit(" throughout"))
    return steps, ranges.where("flat").select(*keys, told.alias("told"))


def residual_regions(pulses: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """keys, region, label, t0, t1, total, matched, q25_s, median_s, q75_s, far of pulses(recording_time_s, detected_time_s).

    meta(keys, joins array of seconds or null, duration_s, tolerance_s): regions are the files where joins are known, else BINS equal parts up to the
    duration (or the last pulse). A pulse past the end counts in the last region; one without a place in none. far: the median is over FAR
    tolerances from 0. A region in which nothing matched has no quantiles.
    """
    placed = pulses.where(finite(F.col("recording_time_s"))).select(*keys, F.col("recording_time_s").alias("t"), (F.col("detected_time_s") - F.col("recording_time_s")).alias("r"))
    ends = placed.groupBy(*keys).agg(F.max("t").alias("_last"))
    known = F.size(F.coalesce("joins", F.array().cast("array<double>"))) > 0
    end = F.coalesce("duration_s", "_last", F.lit(0.0))
    end = F.when(~known & (end <= 0), F.coalesce("_last", F.lit(1.0))).otherwise(end)
    files = F.concat(F.array(F.lit(0.0)), F.col("joins"), F.array(F.greatest(end, F.element_at("joins", -1))))
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda i: i * F.greatest(end, F.lit(1e-9)) / BINS)
    edges = meta.join(ends, keys).select(*keys, F.coalesce("tolerance_s", F.lit(TOLERANCE)).alias("_tol"), known.alias("_files"), F.when(known, files).otherwise(bins).alias("_edges"))
    inner = F.slice("_edges", 2, F.size("_edges") - 2)
    where = F.size(F.filter(inner, lambda e: e <= F.col("t")))
    # a row for each session: its edges are few
    found = placed.join(edges.select(*keys, "_edges"), keys).withColumn("region", where)
    stats = found.groupBy(*keys, "region").agg(F.count("*").alias("total"))
    matched = exact_quantiles(found, [*keys, "region"], F.when(finite(F.col("r")), F.col("r")), [0.25, 0.5, 0.75])
    stats = stats.join(matched.select(*keys, "region", F.col("n").alias("matched"), F.col("quantiles").alias("_q")), [*keys, "region"], "left")
    n = F.size("_edges") - 1
    each = edges.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("region"))
    label = F.format_string("%s %d of %d", F.when(F.col("_files"), "file").otherwise("region"), F.col("region") + 1, n)
    out = each.join(stats, [*keys, "region"], "left")
    quantiles = [F.col("_q")[i].alias(c) for i, c in enumerate(("q25_s", "median_s", "q75_s"))]
    far = F.coalesce(F.abs(F.col("_q")[1]) > FAR * F.col("_tol"), F.lit(False))
    return out.select(*keys, "region", label.alias("label"), F.col("_edges")[F.col("region")].alias("t0"), F.col("_edges")[F.col("region") + 1].alias("t1"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("matched", F.lit(0)).alias("matched"), *quantiles, far.alias("far"))


def region_at(regions: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """points(keys, q, t) with the region (t0 <= t < t1) that holds them; null outside of all."""
    r = regions.groupBy(*keys).agg(F.collect_list(F.struct("t0", "t1", "region")).alias("_r"))  # a session's regions are few
    held = F.filter("_r", lambda x: (x["t0"] <= F.col("t")) & (F.col("t") < x["t1"]))
    return points.join(r, keys, "left").select(*points.columns, F.get(held, F.lit(0))["region"].alias("region"))


def load_session(tables: dict[str, DataFrame], keys: list[str], tolerance: float = TOLERANCE) -> dict[str, DataFrame]:
    """marks(keys, kind, row, layer, series, t), spans(keys, kind, row, layer, t0, t1, open_left, open_right), counts(keys, kind, rows, layered, unlayered)
    and warnings(keys, warning, n) of the tables trials, pulses, detections and events that there are.
    """
    marks, spans, warned = [], [], []
    rows = {k: t for k, t in tables.items() if t is not None}
    none = F.lit(None).cast("string")

    def warn(df: DataFrame, condition: Column, what: str) -> None:
        warned.append(df.groupBy(*keys).agg(F.count_if(condition).alias("n")).where("n > 0").select(*keys, F.lit(what).alias("warning"), "n"))

    def add_spans(kind: str, df: DataFrame) -> None:
        spans.append(df.where("layer is not null").select(*keys, F.lit(kind).alias("kind"), "row", "layer", "t0", "t1", "open_left", "open_right"))

    def add_marks(kind: str, df: DataFrame) -> None:
        marks.append(df.where("layer is not null").select(*keys, F.lit(kind).alias("kind"), "row", "layer", "series", "t"))

    if "trials" in rows:
        found = trial_spans(rows["trials"], keys)
        add_spans("trials", found)
        warn(found, F.col("layer").isNull(), "trials of an unknown treatment")
        warn(found, F.col("inverted"), "trials that end before they start")
    if "pulses" in rows:
        found = pulse_marks(rows["pulses"], keys)
        add_marks("pulses", found.withColumn("series", F.when(F.col("observed"), "observed").otherwise("predicted")))
        warn(found, F.col("layer").isNull(), "pulses of an unknown type")
        warn(found, F.col("disagree"), "pulses matched without a detected time, or the other way round")
    if "detections" in rows:
        none_heard = rows["detections"].limit(0).select(*keys, "row", F.lit(None).cast("double").alias("detected_time_s"), none.alias("pulse_type"))
        found = detection_marks(rows["detections"], rows.get("pulses", none_heard), keys, tolerance)
        add_marks("detections", found)
        warn(found, F.col("disagree"), "detections whose explanation and source row disagree")
        warn(found, F.col("series") == "unjoined", "explained detections without a pulse")
    if "events" in rows:
        add_spans("runs", run_spans(rows["events"], keys))
        add_marks("events", event_marks(rows["events"], keys))
    union = lambda frames: None if not frames else frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    all_marks, all_spans = union(marks), union(spans)
    layered = union([x.groupBy(*keys, "kind").agg(F.count("*").alias("layered")) for x in (all_marks, all_spans) if x is not None])
    totals = union([t.groupBy(*keys).agg(F.count("*").alias("rows")).select(*keys, F.lit(k).alias("kind"), "rows") for k, t in rows.items()])
    counts = totals.join(layered, [*keys, "kind"], "left").withColumn("layered", F.coalesce("layered", F.lit(0))).withColumn("unlayered", F.col("rows") - F.col("layered"))
    return {"marks": all_marks, "spans": all_spans, "counts": counts, "warnings": union(warned)}


def extents(loaded: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, layer, n, t_min, t_max of a loaded session's layers."""
    parts = [loaded["marks"].select(*keys, "layer", F.col("t").alias("a"), F.col("t").alias("b"))] if loaded["marks"] is not None else []
    if loaded["spans"] is not None:
        parts.append(loaded["spans"].select(*keys, "layer", F.col("t0").alias("a"), F.col("t1").alias("b")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy(*keys, "layer").agg(F.count("*").alias("n"), F.min("a").alias("t_min"), F.max("b").alias("t_max"))
