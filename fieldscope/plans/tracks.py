"""Queries: track tables and their issues, harmonics, drawing and picking."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldscope.functions import scalars
from fieldscope.operators import configs, tracks
from fieldscope.plans.registry import SESSION, ev, ev_tracks, query
from fieldscope.sources.tables import written

_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, ident, k ORDER BY row) AS rn FROM trk WHERE ident IS NOT NULL) WHERE rn = 1)"


@query("""SELECT session, ident, count(*) AS n, min(k) AS k_first, max(k) AS k_last, min(t) AS t_first, max(t) AS t_last, min(f) AS f_min, round(quantile_cont(f, 0.5), 6) AS f_median, max(f) AS f_max FROM trk WHERE ident IS NOT NULL GROUP BY session, ident""", "ev tracks")
def track_stats(spark, sf_dir):
    return tracks.track_stats(ev_tracks(spark, sf_dir), SESSION).withColumn("f_median", F.round("f_median", 6))


@query("+" + _ONCE + " SELECT session, row, ident, k, f, t FROM once", "ev tracks")
def one_per_frame(spark, sf_dir):
    return tracks.one_per_frame(ev_tracks(spark, sf_dir), SESSION).select("session", "row", "ident", "k", "f", "t")


@query("""SELECT session, ident, k, count(*) AS n FROM trk WHERE ident IS NOT NULL GROUP BY session, ident, k HAVING count(*) > 1""", "ev tracks")
def frame_duplicates(spark, sf_dir):
    return tracks.frame_duplicates(ev_tracks(spark, sf_dir), SESSION)


LOSERS_SQL = """
dup AS (SELECT session, ident, k FROM trk WHERE ident IS NOT NULL GROUP BY session, ident, k HAVING count(*) > 1),
around AS (SELECT d.session, d.ident, d.k, quantile_cont(o.f, 0.5) AS m FROM dup d JOIN trk o ON o.session = d.session AND o.ident = d.ident AND abs(o.k - d.k) <= 30 AND o.k <> d.k GROUP BY d.session, d.ident, d.k),
own AS (SELECT t.*, quantile_cont(t.f, 0.5) OVER (PARTITION BY t.session, t.ident, t.k) AS o FROM trk t JOIN dup d ON d.session = t.session AND d.ident = t.ident AND d.k = t.k),
losers AS (SELECT session, row, ident, k FROM (SELECT own.*, row_number() OVER (PARTITION BY own.session, own.ident, own.k ORDER BY abs(f - coalesce(m, o)), row) AS rn FROM own LEFT JOIN around USING (session, ident, k)) WHERE rn > 1)
"""


@query("+" + LOSERS_SQL + "SELECT * FROM losers", "ev tracks")
def local_median_losers(spark, sf_dir):
    return tracks.local_median_losers(ev_tracks(spark, sf_dir), keys=SESSION)


@query("+" + _ONCE + """ SELECT session, row, ident, k, round(f - quantile_cont(f, 0.5) OVER (PARTITION BY session, ident ORDER BY k RANGE BETWEEN 24 PRECEDING AND 24 FOLLOWING), 6) AS high FROM once""", "ev tracks")
def track_highpass(spark, sf_dir):
    return tracks.highpass(ev_tracks(spark, sf_dir), 24, SESSION).select("session", "row", "ident", "k", F.round("high", 6).alias("high"))


@query("""+b AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY session, ident ORDER BY k, row) > 12 THEN 1 ELSE 0 END AS n FROM trk WHERE ident IS NOT NULL)
SELECT session, row, ident, k, CAST(sum(n) OVER (PARTITION BY session, ident ORDER BY k, row) AS BIGINT) AS piece FROM b""", "ev tracks")
def track_breaks(spark, sf_dir):
    return tracks.track_breaks(ev_tracks(spark, sf_dir), 12, SESSION).select("session", "row", "ident", "k", "piece")


@query("""SELECT 'gap' AS kind, session, ident, t, t_next FROM (SELECT session, ident, t, lead(t) OVER (PARTITION BY session, ident ORDER BY t, row) AS t_next FROM trk WHERE ident IS NOT NULL) WHERE t_next - t > 86400""", "ev tracks")
def gap_issues(spark, sf_dir):
    return tracks.gap_issues(ev_tracks(spark, sf_dir), 86400.0, SESSION)


@query("""SELECT 'short' AS kind, session, ident, min(t) AS t, count(*) AS n FROM trk WHERE ident IS NOT NULL GROUP BY session, ident HAVING count(*) < 50""", "ev tracks")
def short_issues(spark, sf_dir):
    return tracks.short_issues(ev_tracks(spark, sf_dir), 50, SESSION)


_PIECES = """+pc AS (SELECT *, ident * 1000 + k // 48 AS piece FROM trk WHERE ident IS NOT NULL),
e AS (SELECT session, piece AS ident, max((t, k, f, row)) AS e, min((t, k, f, row)) AS s FROM pc GROUP BY session, piece)
"""


@query(_PIECES.replace("max((t, k, f, row)) AS e, min((t, k, f, row)) AS s", "arg_max(t, (t, k, f, row)) AS te, arg_max(k, (t, k, f, row)) AS ke, arg_max(f, (t, k, f, row)) AS fe, arg_min(t, (t, k, f, row)) AS ts, arg_min(k, (t, k, f, row)) AS ks, arg_min(f, (t, k, f, row)) AS fs").rstrip() + """,
p AS (SELECT a.session, a.ident, b.ident AS other, a.te AS t, b.ts - a.te AS dt, abs(b.fs - a.fe) AS df FROM e a JOIN e b ON a.session = b.session AND a.ident <> b.ident AND b.ks > a.ke AND b.ts - a.te BETWEEN 0 AND 7200 AND abs(b.fs - a.fe) <= 25)
SELECT 'join' AS kind, session, ident, other, t, dt, df FROM (SELECT *, row_number() OVER (PARTITION BY session, ident ORDER BY df, dt, other) AS rn FROM p) WHERE rn = 1""", "ev tracks")
def join_issues(spark, sf_dir):
    """Tracks cut into pieces of 48 frames, so that there are ends to join."""
    pieces = ev_tracks(spark, sf_dir).withColumn("ident", F.col("ident") * 1000 + F.floor(F.col("k") / 48))
    return tracks.join_issues(pieces, 7200.0, 25.0, SESSION)


@query("+" + _ONCE + """, n AS (SELECT *, lead(ident) OVER w AS o, lead(f) OVER w - f AS df FROM once WINDOW w AS (PARTITION BY session, k ORDER BY f, row)),
p AS (SELECT DISTINCT session, least(ident, o) AS lo, greatest(ident, o) AS hi, k FROM n WHERE df <= 5),
q AS (SELECT *, lag(k) OVER (PARTITION BY session, lo, hi ORDER BY k) AS b FROM p) SELECT session, lo, hi, k FROM q WHERE b IS NULL OR k - b > 30""", "ev tracks")
def cross_issues(spark, sf_dir):
    return tracks.cross_issues(ev_tracks(spark, sf_dir), 5.0, keys=SESSION)


@query("""SELECT session, greatest(1, CAST(round_even(quantile_cont(n, 0.5), 0) AS BIGINT)) AS ids FROM (SELECT session, k, count(DISTINCT ident) AS n FROM trk WHERE ident IS NOT NULL GROUP BY session, k) GROUP BY session""", "ev tracks")
def concurrent_ids(spark, sf_dir):
    return tracks.concurrent_ids(ev_tracks(spark, sf_dir), SESSION)


@query("""+f AS (SELECT session, count(DISTINCT ident) AS n FROM trk WHERE ident IS NOT NULL GROUP BY session, k), i AS (SELECT session, greatest(1, CAST(round_even(quantile_cont(n, 0.5), 0) AS BIGINT)) AS ids FROM f GROUP BY session),
e AS (SELECT session, min(k) AS k0, max(k) + 1 AS k1, max(k * 3600.0::DOUBLE) - min(k * 3600.0::DOUBLE) AS span_s FROM trk GROUP BY session)
SELECT e.*, coalesce(ids, 0) AS ids, least(600, span_s) / 60 AS stride_min, least(300, least(600, span_s) / 2) / 60 AS tolerance_min, CASE WHEN ids IS NULL THEN 'no detection has an id' WHEN floor(least(600, span_s) * 0.8) < 1 THEN 'the tracks are too short for a cleanup''s windows' END AS reason FROM e LEFT JOIN i USING (session)""", "ev tracks")
def cleanup_setup(spark, sf_dir):
    return configs.cleanup_setup(ev_tracks(spark, sf_dir).withColumn("t", F.col("k") * 3600.0), SESSION)


_HARM = _ONCE + """, c AS (SELECT a.session, a.ident AS lo, b.ident AS hi, h, count(*) AS n, quantile_cont(b.f - h * a.f, 0.5) AS off FROM once a, once b, (SELECT unnest([2, 3, 4, 5]) AS h)
WHERE a.session = b.session AND a.k = b.k AND a.ident <> b.ident AND abs(b.f - h * a.f) <= 4 * sqrt(1 + h * h) GROUP BY a.session, a.ident, b.ident, h)"""


@query("+" + _HARM + " SELECT session, lo, hi, h, n, round(off, 6) AS off FROM c", "ev tracks")
def harmonic_candidates(spark, sf_dir):
    once = written(tracks.one_per_frame(ev_tracks(spark, sf_dir), SESSION).select("session", "ident", "k", "f"), "frames")
    classes = tracks.track_classes(once, SESSION)
    found = tracks.class_candidates(once, classes, 4.0, keys=SESSION).select("session", "lo", "hi", "h", "n", F.round("offset", 6).alias("off"))
    return tracks.with_members(found, classes, SESSION)  # rounded before ids of a class are spread


_JUDGED = _HARM + """, j AS (SELECT c.session, c.lo, c.hi, c.h, count(*) AS n, quantile_cont(b.f - c.h * a.f, 0.5) AS off, avg(CASE WHEN abs(b.f - c.h * a.f) <= 0.3 * 12 * sqrt(1 + c.h * c.h) THEN 1.0 ELSE 0.0 END) AS match
FROM c JOIN once a ON a.session = c.session AND a.ident = c.lo JOIN once b ON b.session = c.session AND b.ident = c.hi AND b.k = a.k GROUP BY c.session, c.lo, c.hi, c.h), g AS (SELECT * FROM j WHERE n >= 2 AND abs(off) <= 0.1 * 12 * sqrt(1 + h * h) AND match >= 0.7)"""


@query("+" + _JUDGED + """, mv AS (SELECT g.session, g.lo, g.hi, g.h, g.h * a.f - quantile_cont(g.h * a.f, 0.5) OVER w AS x, b.f - quantile_cont(b.f, 0.5) OVER w AS y
  FROM g JOIN once a ON a.session = g.session AND a.ident = g.lo JOIN once b ON b.session = g.session AND b.ident = g.hi AND b.k = a.k WINDOW w AS (PARTITION BY g.session, g.lo, g.hi, g.h ORDER BY a.k RANGE BETWEEN 120 PRECEDING AND 120 FOLLOWING)),
al AS (SELECT session, lo, hi, h, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS corr FROM mv GROUP BY ALL), q AS (SELECT g.*, corr FROM g JOIN al USING (session, lo, hi, h) WHERE corr >= 0.5),
r AS (SELECT q.*, row_number() OVER (PARTITION BY session, hi ORDER BY CASE WHEN (session, lo) IN (SELECT (session, hi) FROM q) THEN 1 ELSE 0 END, -match * n, abs(off), lo, h) AS rn FROM q)
SELECT session, lo, hi, h, n, round(off, 6) AS off, round(match, 6) AS match, round(corr, 6) AS corr FROM r WHERE rn = 1""", "ev tracks")
def find_harmonics(spark, sf_dir):
    """Frames of an hour; what varies alike is told over ten days."""
    found = tracks.find_harmonics(ev_tracks(spark, sf_dir), 4.0, 12.0, 2, 0.7, frame_s=3600.0, timescale=864000.0, keys=SESSION)
    return found.select("session", "lo", "hi", "h", "n", F.round("offset", 6).alias("off"), F.round("match", 6).alias("match"), F.round("corr", 6).alias("corr"))


@query("+" + _ONCE + """, b AS (SELECT session, k, min(f) AS lo_hz, max(f) + 100 AS hi_hz FROM once GROUP BY session, k)
SELECT session, ident, h, up, count(*) AS n, count(*) FILTER (CASE WHEN up THEN f * h ELSE f / h END BETWEEN lo_hz AND hi_hz) AS inside FROM once JOIN b USING (session, k), (SELECT unnest([2, 3, 4, 5]) AS h), (SELECT unnest([true, false]) AS up)
GROUP BY session, ident, h, up HAVING count(*) >= 5 AND count(*) FILTER (CASE WHEN up THEN f * h ELSE f / h END BETWEEN lo_hz AND hi_hz) >= 0.3 * count(*)""", "ev tracks")
def band_harmonics(spark, sf_dir):
    rows = ev_tracks(spark, sf_dir)
    band = tracks.one_per_frame(rows, SESSION).groupBy("session", "k").agg(F.min("f").alias("lo_hz"), (F.max("f") + 100).alias("hi_hz"))
    return tracks.band_harmonics(rows, band, share=0.3, keys=SESSION)


@query("""SELECT session, row, ident, k, f FROM (SELECT *, row_number() OVER (PARTITION BY session, ident, k // 24 ORDER BY k, row) AS rn FROM trk WHERE ident IS NOT NULL) WHERE rn = 1""", "ev tracks")
def track_polylines(spark, sf_dir):
    return tracks.first_per_bin(ev_tracks(spark, sf_dir), 24, SESSION).select("session", "row", "ident", "k", "f")


@query("""+q AS (SELECT event_id % 3 AS session, event_id AS q, t + 100 AS t_q, value + 1 AS f_q FROM ev WHERE category = 'signup'),
d AS (SELECT q.session, q, row, ((t - t_q) * 0.01) * ((t - t_q) * 0.01) + ((f - f_q) * 0.5) * ((f - f_q) * 0.5) AS d2 FROM q JOIN trk ON q.session = trk.session AND abs(t - t_q) <= 2000)
SELECT session, q, arg_min(row, (d2, row)) AS row, round(min(d2), 6) AS d2 FROM d WHERE d2 <= 400 GROUP BY session, q""", "ev tracks")
def nearest_row(spark, sf_dir):
    points = ev(spark, sf_dir).where("category = 'signup'").select((F.col("event_id") % 3).alias("session"), F.col("event_id").alias("q"), (F.col("t") + 100).alias("t_q"), (F.col("value") + 1).alias("f_q"))
    return tracks.nearest_row(ev_tracks(spark, sf_dir), points, 0.01, 0.5, 20.0, SESSION).select("session", "q", "row", F.round("d2", 6).alias("d2"))


_LINES = """+ln AS (SELECT event_id % 3 AS session, event_id AS line, t AS t_a, value AS f_a, t + 20000 AS t_b, value + 60 AS f_b FROM ev WHERE category = 'signup')
"""


def _lines(spark, sf_dir, name):
    return ev(spark, sf_dir).where("category = 'signup'").select((F.col("event_id") % 3).alias("session"), F.col("event_id").alias(name), F.col("t").alias("t_a"), F.col("value").alias("f_a"), (F.col("t") + 20000).alias("t_b"), (F.col("value") + 60).alias("f_b"))


@query(_LINES.rstrip() + """, g AS (SELECT ln.session, line, row, (t_b - t_a) * 0.01 AS ax, (f_b - f_a) * 0.5 AS ay, (t - t_a) * 0.01 AS px, (f - f_a) * 0.5 AS py FROM ln JOIN trk ON ln.session = trk.session AND t BETWEEN t_a - 2000 AND t_b + 2000),
u AS (SELECT *, greatest(0.0, least(1.0, (px * ax + py * ay) / (ax * ax + ay * ay))) AS u FROM g)
SELECT session, line AS stroke, row FROM u WHERE (px - u * ax) * (px - u * ax) + (py - u * ay) * (py - u * ay) <= 25""", "ev tracks")
def brush_rows(spark, sf_dir):
    return tracks.brush_rows(ev_tracks(spark, sf_dir), _lines(spark, sf_dir, "stroke"), 0.01, 0.5, 5.0, SESSION)


@query(_LINES.rstrip() + ", " + _ONCE + """, s AS (SELECT session, ident, k, t, f, lead(t) OVER w AS t2, lead(f) OVER w AS f2 FROM once WINDOW w AS (PARTITION BY session, ident ORDER BY k, row))
SELECT DISTINCT s.session, line, ident, k, (t + t2) / 2 AS cut_t FROM s JOIN ln ON s.session = ln.session AND t <= t_b AND t2 >= t_a
WHERE ((t2 - t) * (f_a - f) - (f2 - f) * (t_a - t)) * ((t2 - t) * (f_b - f) - (f2 - f) * (t_b - t)) <= 0 AND ((t_b - t_a) * (f - f_a) - (f_b - f_a) * (t - t_a)) * ((t_b - t_a) * (f2 - f_a) - (f_b - f_a) * (t2 - t_a)) <= 0""", "ev tracks")
def line_crossings(spark, sf_dir):
    return tracks.line_crossings(ev_tracks(spark, sf_dir), _lines(spark, sf_dir, "line"), SESSION)


@query("""SELECT session, row, CAST(coalesce(ident * 7 % 10, -1) AS INTEGER) AS slot, ident IS NULL AS unassigned FROM trk WHERE k >= 48 AND k < 480""", "ev tracks")
def colour_slots(spark, sf_dir):
    rows = ev_tracks(spark, sf_dir).where((F.col("k") >= 48) & (F.col("k") < 480))
    return rows.select("session", "row", scalars.colour_slot(F.col("ident")).alias("slot"), F.col("ident").isNull().alias("unassigned"))
