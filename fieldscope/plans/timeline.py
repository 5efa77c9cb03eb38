"""Queries: activity of irregular samples, timelines, as-of and interval joins, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldscope.operators import activity as act
from fieldscope.operators import joins, layers, reviews, runs
from fieldscope.plans.registry import emb_samples, ev, ev_spans, ev_steps, files, query

HOUR, DAY = 3600.0, 86400.0

_BINS = """
bins AS (SELECT channel, CAST(floor(floor(t) / 86400) AS BIGINT) AS bin, count(*) AS n, sum(value) AS total, sum(value * value) AS total_sq, min(value) AS minimum, max(value) AS maximum FROM ev GROUP BY ALL),
m AS (SELECT *, greatest(total_sq / n - (total / n) * (total / n), 0.0) AS var, greatest(abs(maximum - total / n), abs(minimum - total / n)) AS peak FROM bins),
sigma AS (SELECT channel, greatest(quantile_cont(sqrt(var), 0.1), 1e-12) AS sigma FROM m GROUP BY channel)
"""


def _frames(spark, sf_dir):
    return ev(spark, sf_dir).withColumn("frame", F.floor("t").cast("long"))


@query("+" + _BINS + """
SELECT channel, bin, n, round(total / n, 6) AS mean, round(10 * log10(greatest(var / (sigma * sigma), 1.0)), 6) AS rms_excess_db, round(20 * log10(greatest(peak / sigma, 1.0)), 6) AS peak_excess_db,
  CASE WHEN 20 * log10(greatest(peak / sigma, 1.0)) < 20 * log10(sqrt(2 * ln(greatest(n, 2)))) + 6 THEN 'quiet'
       WHEN 20 * log10(greatest(peak / sigma, 1.0)) - 10 * log10(greatest(var / (sigma * sigma), 1.0)) < 20 * log10(sqrt(2 * ln(greatest(n, 2)))) THEN 'sustained' ELSE 'transient' END AS class
FROM m JOIN sigma USING (channel)
""", "ev")  # fmt: skip
def activity_classes(spark, sf_dir):
    stats = act.bin_stats(_frames(spark, sf_dir), 86400, ["channel"])
    r = lambda c: F.round(c, 6).alias(c)
    return act.activity(stats, ["channel"]).select("channel", "bin", "n", F.round(act.bin_mean(), 6).alias("mean"), r("rms_excess_db"), r("peak_excess_db"), "class")


@query("""SELECT channel, CAST(floor(floor(t) / 3600) AS BIGINT) AS bin, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total, min(value) AS minimum, max(value) AS maximum FROM ev GROUP BY ALL""", "ev")
def bin_statistics(spark, sf_dir):
    exact = _frames(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = act.bin_stats(exact, 3600, ["channel"])
    return out.select("channel", "bin", "n", F.col("total").cast("decimal(38,2)").alias("total"), F.col("minimum").cast("double").alias("minimum"), F.col("maximum").cast("double").alias("maximum"))


@query("""+b AS (SELECT rec, frame // 8 AS bin, count(*) AS n, sum(value) AS total, sum(value * value) AS total_sq, min(value) AS lo, max(value) AS hi FROM emb GROUP BY ALL)
SELECT rec, bin // 3 AS bin, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 6) AS total, round(sum(total_sq), 6) AS total_sq, min(lo) AS minimum, max(hi) AS maximum FROM b GROUP BY rec, bin // 3 HAVING count(*) = 3""", "emb")
def combined_bins(spark, sf_dir):
    out = act.combine(act.bin_stats(emb_samples(spark, sf_dir), 8, ["rec"]), 3, ["rec"])
    return out.select("rec", "bin", "n", F.round("total", 6).alias("total"), F.round("total_sq", 6).alias("total_sq"), "minimum", "maximum")


@query("""SELECT rec, level, CAST(4 * 2 ** level AS BIGINT) AS step, frame // CAST(4 * 2 ** level AS BIGINT) AS bin, min(value) AS minimum, max(value) AS maximum
FROM emb, (SELECT unnest(generate_series(0, 3))::INTEGER AS level) GROUP BY ALL""", "emb")
def minmax_pyramid(spark, sf_dir):
    return act.minmax_levels(emb_samples(spark, sf_dir), ["rec"], 4, 4).select("rec", "level", "step", "bin", "minimum", "maximum")


@query("""SELECT channel, greatest(min(value) - (max(value) - min(value)) * 0.08, -1e6) AS lo, least(max(value) + (max(value) - min(value)) * 0.08, 1e6) AS hi FROM ev WHERE t >= 86400 AND t <= 864000 GROUP BY channel""", "ev")
def amplitude_range(spark, sf_dir):
    return act.amplitude_range(ev(spark, sf_dir), ["channel"], DAY, 10 * DAY, limit=1e6)


@query("""+r AS (SELECT channel, event_id AS region, t AS t0, t + 43200 AS t1 FROM ev WHERE category = 'signup')
SELECT r.channel, region, t0, t1, t1 - t0 AS duration, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM r JOIN ev ON ev.channel = r.channel AND t >= t0 AND t <= t1 GROUP BY r.channel, region, t0, t1""", "ev")
def region_statistics(spark, sf_dir):
    e = ev(spark, sf_dir)
    regions = e.where("category = 'signup'").select("channel", F.col("event_id").alias("region"), F.col("t").alias("t0"), (F.col("t") + 43200).alias("t1"))
    out = act.region_statistics(regions, e, ["channel"], DAY)
    return out.select("channel", "region", "t0", "t1", "duration", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""+c AS (SELECT channel, event_id AS row, t FROM ev WHERE category = 'click'), v AS (SELECT channel, event_id AS row, t FROM ev WHERE category = 'view'),
p AS (SELECT c.channel, c.row, c.t, v.row AS match_row, v.t AS match_t, abs(c.t - v.t) AS delta, row_number() OVER (PARTITION BY c.row ORDER BY abs(c.t - v.t), v.t DESC, v.row DESC) AS rn
  FROM c JOIN v ON c.channel = v.channel AND abs(c.t - v.t) <= 7200)
SELECT c.channel, c.row, c.t, p.match_row, p.match_t, p.delta FROM c LEFT JOIN p ON p.row = c.row AND rn = 1""", "ev")
def nearest_within_tolerance(spark, sf_dir):
    e = ev(spark, sf_dir).select("channel", F.col("event_id").alias("row"), "t", "category")
    return joins.nearest_within(e.where("category = 'click'").drop("category"), e.where("category = 'view'").drop("category"), ["channel"], 7200.0)


@query("""+q AS (SELECT channel, event_id, t FROM ev WHERE category = 'error'), s AS (SELECT channel, row, t, value FROM steps WHERE name = 'view')
SELECT event_id, q.channel, q.t, held.t AS held_t, held.value AS held_value FROM q LEFT JOIN LATERAL (SELECT s.t, s.value FROM s WHERE s.channel = q.channel AND s.t <= q.t ORDER BY s.t DESC, s.row DESC LIMIT 1) held ON true""", "ev steps")
def value_at(spark, sf_dir):
    asked = ev(spark, sf_dir).where("category = 'error'").select("channel", "t", "event_id")
    series = ev_steps(spark, sf_dir).where("name = 'view'").drop("name")
    return joins.value_in_force(asked, series, ["channel"]).select("event_id", "channel", "t", F.col("held.t").alias("held_t"), F.col("held.value").alias("held_value"))


@query("""+q AS (SELECT channel, event_id, t FROM ev WHERE category = 'error'), m AS (SELECT channel, t FROM ev WHERE category = 'click')
SELECT event_id, q.channel, q.t, (SELECT min(m.t) FROM m WHERE m.channel = q.channel AND m.t > q.t) AS after, (SELECT max(m.t) FROM m WHERE m.channel = q.channel AND m.t < q.t) AS before FROM q""", "ev")
def step_mark(spark, sf_dir):
    e = ev(spark, sf_dir)
    asked = e.where("category = 'error'").select("channel", "t", "event_id")
    marks = e.where("category = 'click'").select("channel", "t", F.col("event_id").alias("row"))
    after = joins.next_mark(asked, marks, ["channel"], True).withColumnRenamed("found", "after")
    return joins.next_mark(after, marks, ["channel"], False).select("event_id", "channel", "t", "after", F.col("found").alias("before"))


@query("""+q AS (SELECT channel, event_id, t FROM ev WHERE category = 'error'), m AS (SELECT channel, t FROM ev WHERE category IN ('click', 'view')),
d AS (SELECT event_id, q.channel, q.t, m.t AS mark_t, row_number() OVER (PARTITION BY event_id ORDER BY abs(m.t - q.t), m.t DESC) AS rn FROM q JOIN m ON m.channel = q.channel)
SELECT event_id, channel, t, mark_t FROM d WHERE rn = 1""", "ev")
def nearest_mark(spark, sf_dir):
    e = ev(spark, sf_dir)
    asked = e.where("category = 'error'").select("channel", "t", "event_id")
    marks = e.where("category in ('click', 'view')").select("channel", "t", F.col("event_id").alias("row"))
    return joins.nearest_mark(asked, marks, ["channel"]).select("event_id", "channel", "t", "mark_t").where("mark_t is not null")


@query("""SELECT e.event_id, e.channel, arg_max(s.row, (s.t0, s.row)) AS span_row, count(*) AS n_spans FROM ev e JOIN spans s ON s.channel = e.channel AND s.t0 <= e.t AND e.t < s.t1 GROUP BY e.event_id, e.channel""", "ev spans")
def spans_at(spark, sf_dir):
    points = ev(spark, sf_dir).select(F.col("event_id").alias("id"), "channel", "t")
    return joins.spans_at(points, ev_spans(spark, sf_dir), ["channel"], 6 * HOUR).withColumnRenamed("id", "event_id")


@query("""SELECT s.channel, s.row, e.category, count(*) AS n FROM spans s JOIN ev e ON s.channel = e.channel AND s.t0 <= e.t AND e.t < s.t1 GROUP BY ALL""", "ev spans")
def points_in_span(spark, sf_dir):
    pairs = joins.points_in_spans(ev(spark, sf_dir).select("channel", "t", "category"), ev_spans(spark, sf_dir), ["channel"], 6 * HOUR)
    return pairs.groupBy("channel", "row", "category").agg(F.count("*").alias("n"))


_MERGED = """
o AS (SELECT *, max(greatest(t0, t1)) OVER (PARTITION BY channel ORDER BY t0, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > {tol} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY t0, row) AS island FROM o),
merged AS (SELECT channel, min(t0) AS t0, greatest(max(greatest(t0, t1)), max(t0) + {tol}) AS t1, arg_min(row, (t0, row)) AS first_row, count(*) AS n FROM i GROUP BY channel, island)
"""


@query("+" + _MERGED.format(tol=600) + "SELECT channel, t0, t1, first_row, n FROM merged", "ev spans")
def merge_spans(spark, sf_dir):
    return joins.merge_spans(ev_spans(spark, sf_dir), ["channel"], 600.0)


@query("+" + _MERGED.format(tol=0) + "SELECT event_id, channel, t FROM ev WHERE EXISTS (SELECT 1 FROM merged m WHERE m.channel = ev.channel AND m.t0 <= t AND t < m.t1)", "ev spans")
def inside_any(spark, sf_dir):
    union = joins.merge_spans(ev_spans(spark, sf_dir), ["channel"]).select("channel", "t0", "t1")
    points = ev(spark, sf_dir).select("event_id", "channel", "t")
    return joins.points_in_spans(points, union, ["channel"], 6 * HOUR).select("event_id", "channel", "t")  # islands are disjoint: a point is in one


@query("""SELECT channel, row, t0, t1 FROM spans WHERE t0 < 900000 AND greatest(t1, t0) > 864000""", "ev spans")
def window_spans(spark, sf_dir):
    return runs.window_spans(ev_spans(spark, sf_dir), 864000.0, 900000.0)


@query("""+s AS (SELECT channel, row, t0, t1, max(greatest(t0, t1)) OVER (PARTITION BY channel ORDER BY t0, row) AS max_end, lead(t0) OVER (PARTITION BY channel ORDER BY t0, row) AS next FROM spans)
SELECT channel, row, max_end, greatest(t1 - t0, 0) AS duration, coalesce(next >= max_end, true) AS free_after FROM s""", "ev spans")
def span_reach(spark, sf_dir):
    return runs.span_reach(ev_spans(spark, sf_dir), ["channel"])


@query("""+r AS (SELECT channel, event_id AS row, t, category = 'signup' AS is_start FROM ev WHERE category IN ('signup', 'purchase')),
x AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY channel ORDER BY t, row) AS owner, lead(t) OVER (PARTITION BY channel ORDER BY t, row) AS nxt, lag(t) OVER (PARTITION BY channel ORDER BY t, row) AS prv FROM r),
f AS (SELECT channel, owner, min(t) FILTER (is_start) AS t0, min(nxt) FILTER (is_start) AS nxt, min(t) FILTER (NOT is_start) AS t1, arg_min(row, (t, row)) FILTER (is_start) AS start_row FROM x GROUP BY channel, owner),
e AS (SELECT channel, min(t) AS t_first, max(t) AS t_last FROM r GROUP BY channel),
paired AS (SELECT channel, start_row AS row, t0, coalesce(t1, nxt, t_last) AS t1, false AS open_left, t1 IS NULL AS open_right FROM f JOIN e USING (channel) WHERE owner > 0),
loose AS (SELECT channel, row, coalesce(prv, t_first) AS t0, t AS t1, true AS open_left, false AS open_right FROM (SELECT *, row_number() OVER (PARTITION BY channel, owner, is_start ORDER BY t, row) AS nth FROM x) JOIN e USING (channel) WHERE NOT is_start AND owner = 0 AND nth = 1)
SELECT * FROM paired UNION ALL SELECT * FROM loose""", "ev")
def pair_runs(spark, sf_dir):
    rows = ev(spark, sf_dir).where("category in ('signup', 'purchase')").select("channel", F.col("event_id").alias("row"), "t", (F.col("category") == "signup").alias("is_start"))
    return runs.pair_runs(rows, ["channel"])


@query("""+c AS (SELECT *, CAST(floor((t - 864000) * 200 / 864000) AS BIGINT) AS col FROM ev WHERE t >= 864000 AND t <= 1728000)
SELECT channel, col, event_id, t, total FROM (SELECT *, row_number() OVER (PARTITION BY channel, col ORDER BY t, event_id) AS rn, count(*) OVER (PARTITION BY channel) AS total FROM c) WHERE total <= 200 OR rn = 1""", "ev")
def window_points(spark, sf_dir):
    return runs.window_points(ev(spark, sf_dir), ["channel"], 864000.0, 1728000.0, 200).select("channel", "col", "event_id", "t", "total")


@query("""SELECT channel, least(CAST(floor((t - 864000) * 50 / 864000) AS BIGINT), 49) AS col, count(*) AS n FROM ev WHERE t >= 864000 AND t <= 1728000 GROUP BY ALL""", "ev")
def count_columns(spark, sf_dir):
    return runs.count_columns(ev(spark, sf_dir), ["channel"], 864000.0, 1728000.0, 50)


@query("""+n AS (SELECT *, lead(t) OVER (PARTITION BY channel, name ORDER BY t, row) AS nxt FROM steps)
SELECT channel, name, row, greatest(t, 864000) AS t0, least(coalesce(nxt, 2592000), 900000) AS t1, value FROM n WHERE t < 900000 AND coalesce(nxt, 2592000) > 864000 AND value IS NOT NULL""", "ev steps")
def window_steps(spark, sf_dir):
    return runs.window_steps(ev_steps(spark, sf_dir), ["channel", "name"], 864000.0, 900000.0, 2592000.0)


@query("""SELECT channel, name, CAST(floor(t / 86400) AS BIGINT) AS col, min(value) AS lo, max(value) AS hi FROM steps WHERE value IS NOT NULL GROUP BY ALL""", "ev steps")
def step_envelope(spark, sf_dir):
    return runs.step_envelope(ev_steps(spark, sf_dir), ["channel", "name"], DAY)


@query("""+c AS (SELECT channel, event_id AS row, CASE WHEN event_id % 10 > 0 THEN t END AS t, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS amplitude, channel % 5 + 0.5 AS rate, CASE WHEN channel % 3 = 0 THEN event_id % 2 END AS gate FROM ev),
l AS (SELECT channel, row, t, unnest(['amplitude', 'rate', 'gate']) AS name, unnest([amplitude, rate, gate]::DOUBLE[]) AS value FROM c),
v AS (SELECT channel, name FROM l WHERE value IS NOT NULL GROUP BY ALL HAVING min(value) < max(value)), e AS (SELECT channel, CASE WHEN channel % 2 = 0 THEN 3e6 ELSE max(t) END AS t_end FROM c WHERE t IS NOT NULL GROUP BY channel)
SELECT l.channel, l.name, row, t, t_end, value FROM l JOIN v ON v.channel = l.channel AND v.name = l.name JOIN e ON e.channel = l.channel WHERE t IS NOT NULL""", "ev")
def control_channels(spark, sf_dir):
    return _controls(spark, sf_dir)[0]


@query(r"""SELECT channel, 'rate held ' || regexp_replace(printf('%.6f', channel % 5 + 0.5), '\.?0+$', '') || ' throughout' AS told FROM ev GROUP BY channel
UNION ALL SELECT channel, 'gate held ' || regexp_replace(printf('%.6f', min(event_id % 2)::DOUBLE), '\.?0+$', '') || ' throughout' FROM ev WHERE channel % 3 = 0 GROUP BY channel HAVING min(event_id % 2) = max(event_id % 2)
UNION ALL SELECT channel, 'amplitude held ' || regexp_replace(printf('%.6f', min(value)), '\.?0+$', '') || ' throughout' FROM ev WHERE event_id % 11 > 0 GROUP BY channel HAVING min(value) = max(value)""", "ev")
def flat_controls(spark, sf_dir):
    return _controls(spark, sf_dir)[1]


def _controls(spark, sf_dir):
    e, i, c = ev(spark, sf_dir), F.col("event_id"), F.col("channel")
    controls = e.select("channel", i.alias("row"), F.when(i % 10 > 0, F.col("t")).alias("recording_time_s"), F.when(i % 11 != 0, F.col("value")).alias("amplitude"), (c % 5 + 0.5).alias("rate"), F.when(c % 3 == 0, i % 2).alias("gate"))
    meta = e.select("channel").distinct().select("channel", F.when(c % 2 == 0, 3e6).alias("duration_s"))
    return layers.build_controls(controls, meta, ["amplitude", "rate", "gate", "absent"], ["channel"])


@query("""+w AS (SELECT rec, part, frames, stamp, sum(frames) OVER (PARTITION BY rec ORDER BY part) AS total, first_value(stamp) OVER (PARTITION BY rec ORDER BY part) AS first, lag(stamp) OVER (PARTITION BY rec ORDER BY part) AS prv FROM files)
SELECT rec, part, (total - frames) / 50.0 AS expected_open, stamp - first AS seen, least(abs(stamp - first - (total - frames) / 50.0), abs(stamp - first - (total - first_frames) / 50.0)) > 1.0 AS suspect
FROM (SELECT *, first_value(frames) OVER (PARTITION BY rec ORDER BY part) AS first_frames FROM w) WHERE part > 0""", "files")
def join_gaps(spark, sf_dir):
    return runs.join_gaps(files(spark, sf_dir), 50.0)


@query("""+s AS (SELECT rec, part, CAST(sum(frames) OVER (PARTITION BY rec ORDER BY part) - frames AS BIGINT) AS start_frame FROM files) SELECT rec, part, start_frame, start_frame / 50.0 AS start_s, CASE WHEN part BETWEEN 1 AND 3 AND rec % 2 = 0 THEN (rec % 10) * 0.25 * part END AS gap_s FROM s""", "files")
def join_times(spark, sf_dir):
    f = files(spark, sf_dir)
    gap = (F.col("rec") % 10) * F.lit(0.25)
    declared = f.select("rec").distinct().where("rec % 2 = 0").select("rec", F.array(gap, gap * 2, gap * 3).alias("gaps"))
    return reviews.join_times(f, 50.0, declared)


@query("""SELECT rec, frame, value FROM emb WHERE frame >= 10 AND frame < CAST(0.3 * 64 AS INT) + 1""", "emb")
def read_region(spark, sf_dir):
    from fieldscope.operators.signals import to_blocks
    from fieldscope.sources import recordings

    samples = emb_samples(spark, sf_dir).select(F.col("rec").alias("recording_id"), F.lit(0).alias("channel"), "frame", "value")
    region = recordings.read_region(to_blocks(samples, 8), 8, 64.0, 0.16, 0.3, 0)
    at = region.select(F.col("recording_id").alias("rec"), "start_frame", F.posexplode("samples").alias("i", "value"))
    return at.select("rec", (F.col("start_frame") + F.col("i")).alias("frame"), "value")


@query("""SELECT category AS layer, count(*) AS n, min(t) AS t_min, max(t) AS t_max, count(*) FILTER (value > 150) AS loud FROM ev GROUP BY category""", "ev")
def layer_counts(spark, sf_dir):
    return ev(spark, sf_dir).groupBy(F.col("category").alias("layer")).agg(F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count_if(F.col("value") > 150).alias("loud"))


@query("""SELECT channel % 4 AS recording, channel, count(*) AS n FROM ev WHERE channel IN (0, 2, 3, 4, 5, 9) GROUP BY ALL""", "ev")
def select_channels(spark, sf_dir):
    from fieldscope.functions.scalars import channel_list

    return ev(spark, sf_dir).where(F.col("channel").isin(channel_list("0,2-5,9"))).groupBy((F.col("channel") % 4).alias("recording"), "channel").agg(F.count("*").alias("n"))
