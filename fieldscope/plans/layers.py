"""Queries: the layers of sessions; events stand in for their tables, and a channel for a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldscope.operators import layers
from fieldscope.plans.registry import ev, query

KEYS = ["channel"]
_TABLES = """pu AS (SELECT channel, event_id AS row, CASE event_id % 5 WHEN 0 THEN 'localization' WHEN 1 THEN 'baseline' WHEN 2 THEN 'odd' ELSE 'volley' END AS pulse_type, CASE WHEN channel % 3 = 0 THEN CASE WHEN event_id % 4 > 0 THEN 'matched' ELSE 'missed' END END AS match_status,
  t AS recording_time_s, CASE WHEN event_id % 3 > 0 AND channel % 5 > 0 THEN t + (value - 40) * 1e-4 END AS detected_time_s FROM ev WHERE category IN ('click', 'signup')),
de AS (SELECT channel, event_id AS row, t + CASE WHEN event_id % 2 = 0 THEN (value - 40) * 1e-4 ELSE 7.0 END AS recording_time_s, CASE WHEN event_id % 7 > 0 THEN event_id % 3 > 0 END AS explained_by_log, CASE WHEN event_id % 4 > 0 THEN event_id END AS source_row FROM ev WHERE category IN ('click', 'signup')),
se AS (SELECT channel, event_id AS row, CASE event_id % 3 WHEN 0 THEN 'localization_started' WHEN 1 THEN 'localization_stopped' ELSE 'note' END AS event, t AS recording_time_s, CASE WHEN event_id % 4 = 0 THEN event_id % 8 END AS records_lost, CASE WHEN event_id % 5 > 0 THEN event_id % 10 > 1 END AS radio_link_up FROM ev WHERE category = 'error'),
tr AS (SELECT channel, event_id AS row, CASE event_id % 4 WHEN 0 THEN 'volley' WHEN 1 THEN 'baseline' WHEN 2 THEN 'silence' END AS treatment, t AS recording_time_s, CASE WHEN event_id % 6 > 0 THEN t + value - 20 END AS recording_ended_s FROM ev WHERE category = 'view')"""


def _tables(spark, sf_dir):
    e, i, t, v, c = ev(spark, sf_dir), F.col("event_id"), F.col("t"), F.col("value"), F.col("channel")
    heard = e.where("category in ('click', 'signup')")
    kind = F.when(i % 5 == 0, "localization").when(i % 5 == 1, "baseline").when(i % 5 == 2, "odd").otherwise("volley")
    late = (v - 40) * F.lit(1e-4)
    return {
        "trials": e.where("category = 'view'").select("channel", i.alias("row"), F.when(i % 4 == 0, "volley").when(i % 4 == 1, "baseline").when(i % 4 == 2, "silence").alias("treatment"), t.alias("recording_time_s"), F.when(i % 6 > 0, t + v - 20).alias("recording_ended_s")),
        "pulses": heard.select("channel", i.alias("row"), kind.alias("pulse_type"), F.when(c % 3 == 0, F.when(i % 4 > 0, "matched").otherwise("missed")).alias("match_status"), t.alias("recording_time_s"), F.when((i % 3 > 0) & (c % 5 > 0), t + late).alias("detected_time_s")),
        "detections": heard.select("channel", i.alias("row"), (t + F.when(i % 2 == 0, late).otherwise(7.0)).alias("recording_time_s"), F.when(i % 7 > 0, i % 3 > 0).alias("explained_by_log"), F.when(i % 4 > 0, i).alias("source_row")),
        "events": e.where("category = 'error'").select("channel", i.alias("row"), F.when(i % 3 == 0, layers.RUN_STARTED).when(i % 3 == 1, layers.RUN_STOPPED).otherwise("note").alias("event"), t.alias("recording_time_s"), F.when(i % 4 == 0, i % 8).alias("records_lost"), F.when(i % 5 > 0, i % 10 > 1).alias("radio_link_up")),
    }


_MARKS = _TABLES + """, h AS (SELECT channel, bool_or(match_status IS NOT NULL) AS st, bool_or(detected_time_s IS NOT NULL) AS ti FROM pu GROUP BY channel),
pm AS (SELECT pu.channel, row, CASE WHEN pulse_type IN ('localization', 'baseline') THEN 'pulses.resting' WHEN pulse_type = 'volley' THEN 'pulses.volley' END AS layer, CASE WHEN st THEN coalesce(match_status = 'matched', false) WHEN ti THEN detected_time_s IS NOT NULL ELSE true END AS observed, recording_time_s AS t,
  st AND ti AND (coalesce(match_status = 'matched', false) <> (detected_time_s IS NOT NULL)) AS disagree FROM pu JOIN h USING (channel)),
dx AS (SELECT *, coalesce(explained_by_log, false) AS e FROM de),
nr AS (SELECT dx.channel, dx.row, arg_min(pu.pulse_type, (abs(dx.recording_time_s - pu.detected_time_s), -pu.detected_time_s, -pu.row)) AS parent FROM dx JOIN pu ON pu.channel = dx.channel AND abs(dx.recording_time_s - pu.detected_time_s) <= 0.0005 WHERE e GROUP BY dx.channel, dx.row),
dm AS (SELECT dx.channel, dx.row, CASE WHEN e THEN 'detections.explained' ELSE 'detections.unexplained' END AS layer, CASE WHEN NOT e THEN 'unexplained' WHEN parent IS NULL THEN 'unjoined' WHEN parent = 'volley' THEN 'volley' ELSE 'resting' END AS series, recording_time_s AS t, (source_row IS NULL) = e AS disagree FROM dx LEFT JOIN nr ON nr.channel = dx.channel AND nr.row = dx.row),
ed AS (SELECT channel, row, recording_time_s AS t, event = 'localization_started' AS is_start FROM se WHERE event <> 'note'),
ow AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY channel ORDER BY t, row) AS owner FROM ed),
rn AS (SELECT channel, count(*) AS n FROM (SELECT DISTINCT channel, owner FROM ow) GROUP BY channel),
tm AS (SELECT channel, row, 'trials.' || treatment AS layer, recording_time_s AS t0, recording_ended_s AS t1 FROM tr)"""


@query("+" + _MARKS + " SELECT channel, row, layer, series, t, disagree FROM dm", "ev")
def detection_layers(spark, sf_dir):
    tables = _tables(spark, sf_dir)
    return layers.detection_marks(tables["detections"], tables["pulses"], KEYS)


@query("+" + _MARKS + " SELECT channel, row, layer, observed, t, disagree FROM pm", "ev")
def pulse_layers(spark, sf_dir):
    return layers.pulse_marks(_tables(spark, sf_dir)["pulses"], KEYS)


@query("+" + _MARKS + " SELECT channel, row, CASE WHEN coalesce(records_lost > 0, false) OR coalesce(NOT radio_link_up, false) THEN 'fault' ELSE 'log' END AS series, recording_time_s AS t FROM se", "ev")
def event_layers(spark, sf_dir):
    return layers.event_marks(_tables(spark, sf_dir)["events"], KEYS).select("channel", "row", "series", "t")


@query("+" + _MARKS + """, ly AS (SELECT channel, 'trials' AS kind, layer FROM tm UNION ALL SELECT channel, 'pulses', layer FROM pm UNION ALL SELECT channel, 'detections', layer FROM dm UNION ALL SELECT channel, 'events', 'events' FROM se)
SELECT channel, kind, count(*) AS rows, count(layer) AS layered, count(*) - count(layer) AS unlayered FROM ly GROUP BY channel, kind""", "ev")
def session_counts(spark, sf_dir):
    return layers.load_session(_tables(spark, sf_dir), KEYS)["counts"]


@query("+" + _MARKS + """, ly AS (SELECT channel, layer, t AS a, t AS b FROM pm UNION ALL SELECT channel, layer, t, t FROM dm UNION ALL SELECT channel, 'events', recording_time_s, recording_time_s FROM se UNION ALL SELECT channel, layer, t0, coalesce(t1, t0) FROM tm)
SELECT channel, layer, count(*) AS n, min(a) AS t_min, max(b) AS t_max FROM ly WHERE layer IS NOT NULL GROUP BY channel, layer UNION ALL
SELECT channel, 'runs', min(n), min(t), coalesce(min(t) FILTER (NOT is_start AND owner = mo), max(t)) FROM (SELECT ow.*, rn.n, max(owner) OVER (PARTITION BY ow.channel) AS mo FROM ow JOIN rn USING (channel)) GROUP BY channel""", "ev")
def load_session(spark, sf_dir):
    """Layers with their rows and extents."""
    return layers.extents(layers.load_session(_tables(spark, sf_dir), KEYS), KEYS)


@query("+" + _MARKS + """, w AS (SELECT channel, 'trials of an unknown treatment' AS warning, count(*) AS n FROM tm WHERE layer IS NULL GROUP BY channel UNION ALL SELECT channel, 'trials that end before they start', count(*) FROM tm WHERE t1 < t0 GROUP BY channel
UNION ALL SELECT channel, 'pulses of an unknown type', count(*) FROM pm WHERE layer IS NULL GROUP BY channel UNION ALL SELECT channel, 'pulses matched without a detected time, or the other way round', count(*) FROM pm WHERE disagree GROUP BY channel
UNION ALL SELECT channel, 'detections whose explanation and source row disagree', count(*) FROM dm WHERE disagree GROUP BY channel UNION ALL SELECT channel, 'explained detections without a pulse', count(*) FROM dm WHERE series = 'unjoined' GROUP BY channel)
SELECT * FROM w""", "ev")
def session_warnings(spark, sf_dir):
    return layers.load_session(_tables(spark, sf_dir), KEYS)["warnings"]


_REGIONS = _TABLES + """, me AS (SELECT channel, CASE WHEN channel % 2 = 0 THEN [600000.0::DOUBLE, 1300000.0] END AS joins, CASE WHEN channel % 4 = 1 THEN 2592000.0::DOUBLE END AS duration_s, max(t) AS last FROM ev WHERE category IN ('click', 'signup') GROUP BY channel),
eg AS (SELECT channel, joins IS NOT NULL AS files, CASE WHEN joins IS NOT NULL THEN [0.0::DOUBLE, 600000.0, 1300000.0, greatest(coalesce(duration_s, last), 1300000.0)] ELSE list_transform(generate_series(0, 8), lambda i: i * greatest(coalesce(duration_s, last), 1e-9) / 8) END AS e FROM me),
rg AS (SELECT channel, files, e, unnest(generate_series(0, len(e) - 2)) AS region FROM eg),
ps AS (SELECT pu.channel, recording_time_s AS t, detected_time_s - recording_time_s AS r, len(list_filter(e[2:len(e) - 1], lambda x: x <= recording_time_s)) AS region FROM pu JOIN eg USING (channel)),
ag AS (SELECT channel, region, count(*) AS total, count(r) AS matched, quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.5) AS m, quantile_cont(r, 0.75) AS b FROM ps GROUP BY channel, region),
rr AS (SELECT rg.channel, rg.region, printf('%s %d of %d', CASE WHEN files THEN 'file' ELSE 'region' END, rg.region + 1, len(e) - 1) AS label, e[rg.region + 1] AS t0, e[rg.region + 2] AS t1, coalesce(total, 0) AS total, coalesce(matched, 0) AS matched, round(a, 9) AS q25_s, round(m, 9) AS median_s, round(b, 9) AS q75_s, coalesce(abs(m) > 10 * 0.0005::DOUBLE, false) AS far FROM rg LEFT JOIN ag ON ag.channel = rg.channel AND ag.region = rg.region)"""


def _regions(spark, sf_dir):
    pulses, c = _tables(spark, sf_dir)["pulses"], F.col("channel")
    meta = pulses.select("channel").distinct().select("channel", F.when(c % 2 == 0, F.array(F.lit(600000.0), F.lit(1300000.0))).alias("joins"), F.when(c % 4 == 1, 2592000.0).alias("duration_s"), F.lit(None).cast("double").alias("tolerance_s"))
    return layers.residual_regions(pulses, meta, KEYS)


@query("+" + _REGIONS + " SELECT channel, region, label, round(t0, 6) AS t0, round(t1, 6) AS t1, total, matched, q25_s, median_s, q75_s, far FROM rr", "ev")
def residual_regions(spark, sf_dir):
    out = _regions(spark, sf_dir)
    return out.select("channel", F.col("region").cast("long").alias("region"), "label", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "total", "matched", *(F.round(x, 9).alias(x) for x in ("q25_s", "median_s", "q75_s")), "far")


@query("+" + _REGIONS + " SELECT v.event_id AS q, rr.region FROM (SELECT * FROM ev WHERE category = 'view') v LEFT JOIN rr ON rr.channel = v.channel AND rr.t0 <= v.t AND v.t < rr.t1", "ev")
def region_at(spark, sf_dir):
    points = ev(spark, sf_dir).where("category = 'view'").select("channel", F.col("event_id").alias("q"), "t")
    return layers.region_at(_regions(spark, sf_dir), points, KEYS).select("q", F.col("region").cast("long").alias("region"))
