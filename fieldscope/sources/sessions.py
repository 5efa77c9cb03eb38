"""Experiment sessions: typed CSV tables, labels, tracks and review items under fixed schemas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.functions.scalars import fixed

#: Columns of the session tables; fixed values, since inference from leading nulls mistypes them.
SCHEMAS = {
    "pulses": "time_s double, recording_time_s double, pulse_type string, trial_number long, treatment string, amplitude double, polarity tinyint, stimulus_item long, "
    "pulse_index_in_item long, sample_tick long, source_row long, detected_time_s double, residual_s double, match_status string",
    "trials": "trial_number long, treatment string, requested string, was_blinded boolean, time_s double, recording_time_s double, ended_s double, recording_ended_s double, "
    "duration_s double, stimulus_item long, pulses_emitted long, polarity tinyint, sample_tick long, source_row long",
    "session_events": "time_s double, recording_time_s double, event string, file_index long, clock_unix long, clock_time string, records_lost long, radio_link_up boolean, "
    "trial_number long, sample_tick long, source_row long",
    "detections": "recording_time_s double, device_time_s double, amplitude double, explained_by_log boolean, source_row long",
    "controls": "time_s double, recording_time_s double, volley_amplitude double, randomness double, tick_hz double, tick_interval_s double, throttle_pulse_us long, "
    "trigger_pulse_us long, randomness_pulse_us long, amplitude_pulse_us long, receiver_zero_us long, sample_tick long, source_row long",
}
LABEL_COLUMNS = ("category", "kind", "channel", "t_start_s", "t_end_s", "f_low_hz", "f_high_hz", "note", "outline")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def read_session_csv(spark: SparkSession, kind: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): the known columns of a session table, those that the file lacks as nulls, and counts of rows that have no place.

    Rows are placed by recording_time_s only; one that is missing or not finite drops the row and is counted. An empty field is absent, not zero.
    """
    known = [(x.rsplit(" ", 1)[0], x.rsplit(" ", 1)[1]) for x in SCHEMAS[kind].split(", ")]
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    rows = raw.select(*((F.col(c).try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in known))
    missing = [c for c, _ in known if c not in raw.columns]
    placed = finite(F.col("recording_time_s"))
    problems = rows.agg(F.count_if(~placed).alias("unplaced")).withColumn("missing", F.array(*map(F.lit, missing)).cast("array<string>"))
    return rows.where(placed), problems


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, problems) of a label CSV; older files without an outline column are read too.

    A row needs a category and a finite start. Reversed times and bands are swapped, a point has no end, and an outline (at least three
    t,f corners, parted by semicolons) stays only on a span with a band.
    """
    raw = spark.read.option("header", True).option("nullValue", "").option("escape", '"').option("multiLine", True).csv(path)
    text = {c: (F.col(c) if c in raw.columns else F.lit(None).cast("string")) for c in LABEL_COLUMNS}
    number = lambda c: F.when(finite(text[c].try_cast("double")), text[c].try_cast("double"))
    rows = raw.select(text["category"].alias("category"), text["kind"].alias("kind"), text["channel"].try_cast("int").alias("channel"), number("t_start_s").alias("t0"), number("t_end_s").alias("t1"), number("f_low_hz").alias("f0"), number("f_high_hz").alias("f1"), text["note"].alias("note"), text["outline"].alias("outline"))
    good = F.col("category").isNotNull() & (F.trim("category") != "") & F.col("t0").isNotNull()
    from fieldscope.operators.labels import normalised

    corners = F.transform(F.split("outline", ";"), lambda p: F.struct(F.get(F.split(F.trim(p), r"[ ,]+"), F.lit(0)).try_cast("double").alias("t"), F.get(F.split(F.trim(p), r"[ ,]+"), F.lit(1)).try_cast("double").alias("f")))
    sound = (F.col("kind") == "span") & F.col("f0").isNotNull() & F.col("f1").isNotNull() & (F.size(corners) >= 3) & ~F.exists(corners, lambda p: p["t"].isNull() | p["f"].isNull())
    return normalised(rows.where(good)).withColumn("outline", F.when(sound, corners)), rows.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("dropped"))


def label_rows(labels: DataFrame, transient: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """The nine columns of a label file as text: seconds to six decimals, hertz to three, empty for absent; transient categories are left out; and the extra columns."""
    outline = F.array_join(F.transform("outline", lambda p: F.concat_ws(" ", fixed(p["t"], 6), fixed(p["f"], 3))), ";") if "outline" in labels.columns else F.lit(None).cast("string")
    note = F.col("note") if "note" in labels.columns else F.lit(None).cast("string")
    return labels.where(~F.col("category").isin(transient)).select("category", "kind", F.col("channel").cast("string").alias("channel"), fixed(F.col("t0"), 6).alias("t_start_s"), fixed(F.col("t1"), 6).alias("t_end_s"), fixed(F.col("f0"), 3).alias("f_low_hz"), fixed(F.col("f1"), 3).alias("f_high_hz"), note.alias("note"), outline.alias("outline"), *extra)


def read_review_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, problems) from JSON lines; an item needs a kind, a confidence from 0 to 1 and one or two ids. Unknown fields are ignored."""
    schema = "kind string, source string, confidence double, t double, f double, t0 double, t1 double, ids array<bigint>, action string, impact bigint, why string, k bigint"
    rows = spark.read.schema(schema).json(path)
    good = F.coalesce(F.col("kind").isNotNull() & F.col("confidence").between(0, 1) & F.size("ids").between(1, 2), F.lit(False))
    return rows.where(good), rows.agg(F.count_if(~good).alias("malformed"))


def trial_layers(trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, problems): trials by treatment. Without an end a trial is an instant and open; one that ends before it starts stays and is counted;
    unknown and blank treatments are counted and in no layer."""
    known = F.col("treatment").isin("volley", "baseline", "silence")
    t1 = F.coalesce("recording_ended_s", "recording_time_s")
    spans = trials.where(known).select("treatment", "trial_number", F.col("recording_time_s").alias("t0"), t1.alias("t1"), F.col("recording_ended_s").isNull().alias("open_right"))
    problems = trials.agg(F.count_if(F.coalesce(~known, F.lit(True))).alias("unlayered"), F.count_if(F.col("recording_ended_s") < F.col("recording_time_s")).alias("inverted"))
    return spans, problems


def pulse_layers(pulses: DataFrame) -> DataFrame:
    """layer (resting or volley), observed, t: observed by match_status where the table has any, else by a detected time."""
    resting = F.col("pulse_type").isin("localization", "baseline")
    has = pulses.agg(F.count_if(F.col("match_status").isNotNull()).alias("_s"))
    out = pulses.where(resting | (F.col("pulse_type") == "volley")).crossJoin(F.broadcast(has))
    observed = F.when(F.col("_s") > 0, F.coalesce(F.col("match_status") == "matched", F.lit(False))).otherwise(F.col("detected_time_s").isNotNull())
    return out.select(F.when(resting, "resting").otherwise("volley").alias("layer"), observed.alias("observed"), F.col("recording_time_s").alias("t"), "trial_number")


def fault_events(events: DataFrame) -> DataFrame:
    """Events that tell of lost data: records_lost over 0 or a radio link that is down; a null is no fault."""
    return events.where(F.coalesce(F.col("records_lost") > 0, F.lit(False)) | F.coalesce(~F.col("radio_link_up"), F.lit(False)))


def check_partition(pulses: DataFrame, trials: DataFrame, width: float = 60.0) -> DataFrame:
    """rule, broken: volley and baseline pulses outside trials of their kind, localization pulses inside any, pulses inside silence, silence that
    says it emitted some (a null count says nothing)."""
    from fieldscope.operators.joins import points_in_spans

    spans, _ = trial_layers(trials)
    points = pulses.select(F.monotonically_increasing_id().alias("id"), F.lit(0).alias("key"), F.col("recording_time_s").alias("t"), "pulse_type").where("t is not null")
    met = points_in_spans(points, spans.where("t1 >= t0").withColumn("key", F.lit(0)), ["key"], width, closed=True).groupBy("id").agg(F.collect_set("treatment").alias("inside"))
    seen = points.join(met, "id", "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<string>")))
    has = lambda kind: F.array_contains("inside", kind)
    rules = {
        "volley outside volley": (F.col("pulse_type") == "volley") & ~has("volley"), "baseline outside baseline": (F.col("pulse_type") == "baseline") & ~has("baseline"),
        "localization inside a trial": (F.col("pulse_type") == "localization") & (F.size("inside") > 0), "pulse in silence": has("silence"),
    }
    counted = seen.agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    emitted = trials.where("treatment = 'silence'").agg(F.count_if(F.col("pulses_emitted") > 0).alias("silence emitted"))
    both = counted.crossJoin(F.broadcast(emitted))
    return both.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("broken")) for n in both.columns))).alias("r")).select("r.rule", "r.broken")
