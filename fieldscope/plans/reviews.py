"""Queries: session checks, review of candidates and views of spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldscope.operators import cursor, reviews, tracks
from fieldscope.plans.registry import SESSION, emb_samples, ev, ev_boxes, ev_tracks, files, load, query
from fieldscope.plans.signals import _DFT, _cells
from fieldscope.sources import sessions


@query("""+x AS (SELECT rec, part, frames, frames % 3 <> 0 AS opened, sum(frames) OVER (PARTITION BY rec ORDER BY part) - frames AS start FROM files)
SELECT rec, count(*) AS declared, count(*) FILTER (opened) AS opened, count(*) FILTER (NOT opened) AS missing, NOT bool_and(opened) AS partial, min(start) FILTER (opened) / 50.0 AS shift_s FROM x GROUP BY rec""", "files")
def split_coverage(spark, sf_dir):
    return reviews.split_coverage(files(spark, sf_dir).withColumn("opened", F.col("frames") % 3 != 0), 50.0)


@query("""+r AS (SELECT rec, sum(frames) AS frames, count(*) AS channels FROM files GROUP BY rec), m AS (SELECT c_custkey AS rec, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 50.0 END AS rate, CASE WHEN c_custkey % 5 = 0 THEN 7 END AS frames, c_custkey % 12 AS channel FROM customer)
SELECT m.rec, m.rate = CASE WHEN r.rec IS NOT NULL THEN 50.0 END AS rate_ok, m.frames = r.frames AS frames_ok, m.channel >= 0 AND m.channel < r.channels AS channel_ok FROM m LEFT JOIN r ON r.rec = m.rec""", "files")
def check_recording(spark, sf_dir):
    known = files(spark, sf_dir).groupBy("rec").agg(F.lit(50.0).alias("rate"), F.sum("frames").alias("frames"), F.count("*").alias("channels"))
    key = F.col("c_custkey")
    meta = load(spark, sf_dir, "customer").select(key.alias("rec"), F.when(key % 4 != 0, 50.0).alias("rate"), F.when(key % 5 == 0, 7).alias("frames"), (key % 12).alias("channel"))
    return reviews.check_recording(meta, known)


@query("""SELECT channel, CASE WHEN coalesce(bool_or(category = 'signup' AND value > 90), false) THEN CASE WHEN count(*) FILTER (category = 'error') > 10 THEN 'warn' ELSE 'ok' END ELSE 'unvalidated' END AS trust FROM ev GROUP BY channel""", "ev")
def session_trust(spark, sf_dir):
    e = ev(spark, sf_dir).groupBy("channel").agg(F.bool_or((F.col("category") == "signup") & (F.col("value") > 90)).alias("validated"), F.count_if(F.col("category") == "error").alias("errors"))
    return e.select("channel", reviews.trust(F.col("validated"), F.when(F.col("errors") > 10, 1).otherwise(0)).alias("trust"))


@query("""SELECT uid, CASE WHEN (t0 + t1) / 2 BETWEEN 864000 AND 1728000 THEN CASE WHEN score >= 0.4 THEN 'accepted' ELSE 'rejected' END END AS answer FROM boxes""", "ev boxes")
def answer_view(spark, sf_dir):
    return reviews.answer_view(ev_boxes(spark, sf_dir), 864000.0, 1728000.0, 0.4).select("uid", "answer")


@query("""+c AS (SELECT uid, cls, t0 FROM boxes WHERE uid % 7 <> 0), l AS (SELECT uid, CASE WHEN uid % 11 = 0 THEN 'other' ELSE cls END AS cls, CASE WHEN uid % 13 = 0 THEN t0 + 1 ELSE t0 END AS t0 FROM boxes WHERE uid % 5 <> 0)
SELECT coalesce(c.uid, l.uid) AS uid, CASE WHEN c.uid IS NULL THEN 'new' WHEN l.uid IS NULL THEN 'rejected' WHEN l.cls <> c.cls THEN 'reader' WHEN l.t0 <> c.t0 THEN 'edited' ELSE 'kept' END AS state FROM c FULL JOIN l ON l.uid = c.uid""", "ev boxes")
def sync_candidates(spark, sf_dir):
    b, uid = ev_boxes(spark, sf_dir), F.col("uid")
    changed = b.where(uid % 5 != 0).withColumns({"cls": F.when(uid % 11 == 0, "other").otherwise(F.col("cls")), "t0": F.when(uid % 13 == 0, F.col("t0") + 1).otherwise(F.col("t0"))})
    return reviews.sync_candidates(b.where(uid % 7 != 0), changed)


_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, ident, k ORDER BY row) AS rn FROM pc WHERE ident IS NOT NULL) WHERE rn = 1)"


@query("""+pc AS (SELECT session, row, ident * 1000 + k // 48 AS ident, k, f, t FROM trk), g AS (SELECT session, ident, t, lead(t) OVER (PARTITION BY session, ident ORDER BY t, row) AS n FROM pc WHERE ident IS NOT NULL),
e AS (SELECT session, ident, arg_max(t, (t, k, f, row)) AS te, arg_max(k, (t, k, f, row)) AS ke, arg_max(f, (t, k, f, row)) AS fe, arg_min(t, (t, k, f, row)) AS ts, arg_min(k, (t, k, f, row)) AS ks, arg_min(f, (t, k, f, row)) AS fs FROM pc WHERE ident IS NOT NULL GROUP BY session, ident),
p AS (SELECT a.session, a.ident, b.ident AS other, a.te AS t, b.ts - a.te AS dt, abs(b.fs - a.fe) AS df FROM e a JOIN e b ON a.session = b.session AND a.ident <> b.ident AND b.ks > a.ke AND b.ts - a.te BETWEEN 0 AND 7200 AND abs(b.fs - a.fe) <= 25),
""" + _ONCE + """, nx AS (SELECT *, lead(ident) OVER w AS o, lead(f) OVER w - f AS df FROM once WINDOW w AS (PARTITION BY session, k ORDER BY f, row)),
x AS (SELECT DISTINCT session, least(ident, o) AS lo, greatest(ident, o) AS hi, k FROM nx WHERE df <= 5), y AS (SELECT *, lag(k) OVER (PARTITION BY session, lo, hi ORDER BY k) AS b FROM x),
fr AS (SELECT session, k, min(t) AS t FROM trk GROUP BY session, k),
it AS (SELECT session, row AS item, CASE WHEN row % 2 = 0 THEN 'join' ELSE 'cut' END AS kind, ident, CASE WHEN row % 2 = 0 THEN CASE WHEN row % 4 = 0 THEN -5 ELSE ident + 1 END END AS other, k, t, CASE WHEN row % 7 > 0 THEN row % 10 / 10.0::DOUBLE END AS confidence FROM pc WHERE row % 50 = 0 OR row % 50 = 25),
h AS (SELECT session, ident, arg_max(f, (t, row)) AS fl FROM pc WHERE ident IS NOT NULL GROUP BY session, ident),
op AS (SELECT it.session, item, kind, it.ident, other, k, t, coalesce(confidence, 0) AS confidence, h.fl, other IS NOT NULL AND EXISTS (SELECT 1 FROM h h2 WHERE h2.session = it.session AND h2.ident = it.other) AS held FROM it JOIN h ON h.session = it.session AND h.ident = it.ident WHERE coalesce(confidence, 0) <= 0.6),
nf AS (SELECT op.session, item, arg_min(pc.ident, (abs(pc.f - op.fl), pc.row)) AS found FROM op JOIN pc ON pc.session = op.session AND pc.k = op.k AND pc.ident IS NOT NULL AND pc.ident <> op.ident WHERE op.other IS NOT NULL AND NOT held AND kind = 'join' GROUP BY op.session, item),
rv AS (SELECT op.session, op.ident, CASE WHEN held THEN op.other ELSE found END AS other, op.t, op.confidence, op.kind FROM op LEFT JOIN nf ON nf.session = op.session AND nf.item = op.item)
SELECT session, 'gap' AS kind, ident, CAST(NULL AS BIGINT) AS other, t, CAST(NULL AS DOUBLE) AS confidence FROM g WHERE n - t > 172800 UNION ALL SELECT session, 'short', ident, NULL, min(t), NULL FROM pc WHERE ident IS NOT NULL GROUP BY session, ident HAVING count(*) < 3
UNION ALL SELECT session, 'join', ident, other, t, NULL FROM (SELECT *, row_number() OVER (PARTITION BY session, ident ORDER BY df, dt, other) AS rn FROM p) WHERE rn = 1
UNION ALL SELECT y.session, 'cross', lo, hi, fr.t, NULL FROM y JOIN fr ON fr.session = y.session AND fr.k = y.k WHERE b IS NULL OR y.k - b > 30 UNION ALL SELECT session, 'review', ident, other, t, confidence FROM rv WHERE kind <> 'join' OR other IS NOT NULL""", "ev tracks")
def track_issues(spark, sf_dir):
    """All kinds of issues of tracks cut into pieces of 48 frames, with items of a review of every 25th row."""
    rows = ev_tracks(spark, sf_dir).withColumn("ident", F.col("ident") * 1000 + F.floor(F.col("k") / 48))
    row, ident = F.col("row"), F.col("ident")
    other = F.when(row % 2 == 0, F.when(row % 4 == 0, F.lit(-5)).otherwise(ident + 1))
    items = rows.where("row % 50 = 0 or row % 50 = 25").select("session", row.alias("item"), F.when(row % 2 == 0, "join").otherwise("cut").alias("kind"), "ident", other.alias("other"), "k", "t", F.when(row % 7 > 0, row % 10 / F.lit(10.0)).alias("confidence"))
    return tracks.order_issues(tracks.issues(rows, 5.0, 172800.0, 3, 7200.0, 25.0, items, 0.6, SESSION), SESSION)


@query("""SELECT region, median FROM (SELECT CAST(floor(t / 345600) AS BIGINT) AS region, round(median(value - 100), 6) AS median FROM ev GROUP BY 1) ORDER BY abs(median) DESC, region LIMIT 1""", "ev")
def worst_region(spark, sf_dir):
    regions = ev(spark, sf_dir).groupBy(F.floor(F.col("t") / 345600).cast("long").alias("region")).agg(F.round(F.median(F.col("value") - 100), 6).alias("median"))
    return reviews.worst_region(regions)


@query("+" + _DFT + """, q AS (SELECT vec_id AS q, vec_id AS rec, CAST(floor((vec_id % 11 * 0.1 - 0.0625) / 0.125) AS BIGINT) AS col, CAST(floor(vec_id % 37 / 4.0 + 0.5) AS INTEGER) AS bin FROM embeddings)
SELECT q, q.col, q.bin, round(power, 9) AS power FROM q LEFT JOIN cells c ON c.rec = q.rec AND c.col = q.col AND c.bin = q.bin""", "emb")
def power_at(spark, sf_dir):
    v = F.col("vec_id")
    points = load(spark, sf_dir, "embeddings").select(v.alias("q"), F.floor(v / 8).cast("string").alias("recording_id"), (v % 8).cast("int").alias("channel"), (v % 11 * F.lit(0.1)).alias("t"), (v % 37).cast("double").alias("f"))
    return reviews.power_at(_cells(spark, sf_dir), points, 0.125, 4.0, 0.25).withColumn("power", F.round("power", 9))


@query("+" + _DFT + " SELECT rec, col, bin, round(10 * log10(power), 6) AS db FROM cells WHERE col % 2 = 0 AND bin BETWEEN 2 AND 5", "emb")
def db_image(spark, sf_dir):
    from fieldscope.functions.scalars import decibel

    part = _cells(spark, sf_dir).where("col % 2 = 0 and bin between 2 and 5")
    return part.select((F.col("recording_id").cast("long") * 8 + F.col("channel")).alias("rec"), "col", F.col("bin").cast("long").alias("bin"), F.round(decibel(F.col("power")), 6).alias("db"))


@query("""+p AS (SELECT channel, CAST(floor(t / 86400) AS BIGINT) AS x, CAST(floor(value / 10) AS BIGINT) AS y FROM ev WHERE value > 60) SELECT channel, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, count(*) AS area FROM p GROUP BY channel""", "ev")
def box_of_mask(spark, sf_dir):
    pixels = ev(spark, sf_dir).where("value > 60").select("channel", F.floor(F.col("t") / 86400).cast("long").alias("x"), F.floor(F.col("value") / 10).cast("long").alias("y"))
    return reviews.box_of_mask(pixels, ["channel"])


@query("""+x AS (SELECT rec, part AS s0, row_number() OVER (PARTITION BY rec ORDER BY part) - 1 AS i, count(*) OVER (PARTITION BY rec) AS n FROM files)
SELECT rec, s0 FROM x WHERE n <= 5 OR i = 0 OR floor(i * 5 / n::DOUBLE) > floor((i - 1) * 5 / n::DOUBLE)""", "files")
def sample_windows(spark, sf_dir):
    return reviews.spread_sample(files(spark, sf_dir).select("rec", F.col("part").alias("s0")), 5)


@query("""SELECT row AS item, CASE WHEN ident % 3 = 0 THEN ident + 5000 ELSE ident END AS ident, t - 100000 AS t FROM trk WHERE ident IS NOT NULL AND t - 100000 BETWEEN 0 AND 900000""", "ev tracks")
def review_shift(spark, sf_dir):
    items = ev_tracks(spark, sf_dir).where("ident is not null").select(F.col("row").alias("item"), "ident", "t")
    renamed = items.where("ident % 3 = 0").select("ident", (F.col("ident") + 5000).alias("new")).distinct()
    return reviews.review_shift(items, -100000.0, 0.0, 900000.0, renamed)


@query("""+s AS (SELECT event_id AS stroke, t AS t_a, value AS f_a, t + 9000 AS t_b, value + 30 AS f_b FROM ev WHERE category = 'signup'), fr AS (SELECT i AS k, i * 1800.0::DOUBLE AS t FROM (SELECT unnest(generate_series(0, CAST(ceil((max(t_b) + 3600) / 1800) AS BIGINT))) AS i FROM s)),
x AS (SELECT stroke, k, t, greatest(t_a, least(t_b, t)) AS pt, t_a, f_a, t_b, f_b FROM s JOIN fr ON t >= t_a - 3600 AND t <= t_b + 3600), y AS (SELECT stroke, k, f_a + (pt - t_a) / (t_b - t_a) * (f_b - f_a) AS f, (t - pt) / 3600 AS o FROM x)
SELECT stroke, k, round(min(f - 12 * sqrt(1 - o * o)), 6) AS lo, round(max(f + 12 * sqrt(1 - o * o)), 6) AS hi FROM y WHERE abs(o) <= 1 GROUP BY stroke, k""", "ev")
def brush_bands(spark, sf_dir):
    e = ev(spark, sf_dir).where("category = 'signup'")
    strokes = e.select(F.col("event_id").alias("stroke"), F.col("t").alias("t_a"), F.col("value").alias("f_a"), (F.col("t") + 9000).alias("t_b"), (F.col("value") + 30).alias("f_b"))
    frames = strokes.agg(F.ceil((F.max("t_b") + 3600) / 1800).alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("k")).withColumn("t", F.col("k") * 1800.0)
    return reviews.brush_bands(strokes, frames, 3600.0, 12.0, 7200.0).select("stroke", "k", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("""SELECT CASE category WHEN 'click' THEN 'volley' WHEN 'view' THEN 'baseline' ELSE 'silence' END AS treatment, event_id AS trial_number, t AS t0, CASE WHEN event_id % 4 = 0 THEN t ELSE t + value END AS t1, event_id % 4 = 0 AS open_right FROM ev WHERE category IN ('click', 'view', 'error')""", "ev")
def trial_layers(spark, sf_dir):
    treatment = F.when(F.col("category") == "click", "volley").when(F.col("category") == "view", "baseline").when(F.col("category") == "error", "silence").otherwise("odd")
    trials = ev(spark, sf_dir).select(treatment.alias("treatment"), F.col("event_id").alias("trial_number"), F.col("t").alias("recording_time_s"), F.when(F.col("event_id") % 4 != 0, F.col("t") + F.col("value")).alias("recording_ended_s"))
    return sessions.trial_layers(trials)[0]


@query("""SELECT event_id, category || ' ' || printf('%.1f s', t) || CASE WHEN event_id % 6 <> 0 THEN printf(' (%.2f)', value) ELSE '' END AS said FROM ev""", "ev")
def describe_marks(spark, sf_dir):
    e = ev(spark, sf_dir)
    return e.select("event_id", reviews.describe(F.col("category"), F.col("t"), F.when(F.col("event_id") % 6 != 0, F.col("value"))).alias("said"))


@query("""SELECT rec, count(*) FILTER (uid % 9 > 1 AND rec % 6 <> 1) AS boxes, count(*) FILTER (score < 0.1 AND rec % 4 > 0) AS rejected, count(*) FILTER (uid % 7 = 0) AS reviewed, count(*) FILTER (uid % 11 = 0) AS hidden,
array_to_string(list_sort(list_distinct(coalesce(list(cls) FILTER (uid % 9 > 1 AND rec % 6 <> 1), []))), ',') AS classes FROM boxes GROUP BY rec HAVING boxes > 0 OR rejected > 0""", "ev boxes")
def project_sources(spark, sf_dir):
    b, uid, rec = ev_boxes(spark, sf_dir), F.col("uid"), F.col("rec")
    return reviews.project_sources(b.where((uid % 9 > 1) & (rec % 6 != 1)), b.where((F.col("score") < 0.1) & (rec % 4 > 0)), b.where(uid % 7 == 0), b.where(uid % 11 == 0))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 4 > 0 THEN (event_id % 4) || ' log records lost' END, CASE WHEN event_id % 5 = 1 THEN '2 drop events' END, CASE WHEN event_id % 3 = 2 THEN (event_id % 6) || ' sequence breaks' END,
CASE WHEN event_id % 7 = 0 THEN 'the log was truncated by a power loss' END, CASE WHEN event_id % 8 > 0 THEN 'interrupted log files: ' || array_to_string(range(event_id % 8), ', ') END], lambda x: x IS NOT NULL), '; ') AS reasons FROM ev""", "ev")
def log_integrity(spark, sf_dir):
    i = F.col("event_id")
    files_of = F.when(i % 8 > 0, F.sequence(F.lit(0).cast("long"), i % 8 - 1))
    why = reviews.integrity(i % 4, F.when(i % 5 == 1, 2), F.when(i % 3 == 2, i % 6), F.when(i % 2 == 0, i % 7 == 0).otherwise(F.when(i % 7 == 0, True)), files_of)
    return ev(spark, sf_dir).select("event_id", F.array_join(why, "; ").alias("reasons"))


_POINTERS = """pt AS (SELECT vec_id AS q, vec_id // 8 AS r, vec_id % 70 / 64.0::DOUBLE AS x, vec_id % 5 / 64.0::DOUBLE AS dx, (vec_id % 7 - 3) / 20.0::DOUBLE AS y FROM embeddings)"""


def _pointed(spark, sf_dir):
    from fieldscope.operators.signals import to_blocks

    e = emb_samples(spark, sf_dir).select(F.floor(F.col("rec") / 8).cast("string").alias("recording_id"), (F.col("rec") % 8).cast("int").alias("channel"), "frame", "value")
    v = F.col("vec_id")
    pointers = load(spark, sf_dir, "embeddings").select(v.alias("q"), F.floor(v / 8).cast("string").alias("recording_id"), (v % 70 / F.lit(64.0)).alias("x"), (v % 5 / F.lit(64.0)).alias("dx"), ((v % 7 - 3) / F.lit(20.0)).alias("y"))
    return to_blocks(e, 12), pointers


_SNAPPED = """ce AS (SELECT *, CAST(round_even(x * 64, 0) AS BIGINT) AS a, least(greatest(CAST(round_even((x + dx) * 64, 0) AS BIGINT), CAST(round_even(x * 64, 0) AS BIGINT) + 1), 64) AS z FROM pt),
cl AS (SELECT *, CASE WHEN z <= a THEN greatest(z - 1, 0) ELSE a END AS i0 FROM ce),
ex AS (SELECT q, y, CAST(rec % 8 AS INT) AS channel, arg_min(frame, (value, frame)) AS k0, min(value) AS v0, arg_max(frame, (value, -frame)) AS k1, max(value) AS v1 FROM cl JOIN emb ON rec // 8 = r AND frame >= i0 AND frame < greatest(z, i0 + 1) GROUP BY q, y, rec),
sn AS (SELECT q, channel, CASE WHEN y >= (v0 + v1) / 2 THEN k1 ELSE k0 END / 64.0::DOUBLE AS t, CASE WHEN y >= (v0 + v1) / 2 THEN v1 ELSE v0 END AS value, y FROM ex)"""


@query("+" + _POINTERS + ", " + _SNAPPED + " SELECT q, channel, t, value, channel = arg_min(channel, (abs(value - y), channel)) OVER (PARTITION BY q) AS nearest FROM sn", "emb")
def snap_markers(spark, sf_dir):
    blocks, pointers = _pointed(spark, sf_dir)
    return cursor.snap_markers(blocks, pointers, 64.0, 12)


@query("+" + _POINTERS + ", " + _SNAPPED + ", bs AS (SELECT q, arg_min(t, (abs(value - y), channel)) AS t, arg_min(value, (abs(value - y), channel)) AS value FROM sn GROUP BY q) SELECT a.q, a.t, a.value, a.t - b.t AS dt, a.value - b.value AS dv FROM bs a LEFT JOIN bs b ON b.q = a.q - 1", "emb")
def marker_deltas(spark, sf_dir):
    """Every marker against the one before it."""
    blocks, pointers = _pointed(spark, sf_dir)
    at = cursor.snap_markers(blocks, pointers, 64.0, 12).where("nearest").select("q", "t", "value")
    return cursor.marker_delta(at, at.withColumn("q", F.col("q") + 1), ["q"])


@query("+" + _POINTERS + """, ce AS (SELECT *, CAST(floor(CAST(round_even(x * 64, 0) AS BIGINT) / 3) AS BIGINT) * 3 AS i0 FROM pt),
d AS (SELECT q, CAST(rec % 8 AS INT) AS channel, least(abs(min(value) - y), abs(max(value) - y)) AS d FROM ce JOIN emb ON rec // 8 = r AND frame >= i0 AND frame < i0 + 3 WHERE i0 < 64 GROUP BY q, y, rec)
SELECT q, arg_min(channel, (d, channel)) AS channel, min(d) AS distance FROM d GROUP BY q""", "emb")
def nearest_traces(spark, sf_dir):
    blocks, pointers = _pointed(spark, sf_dir)
    return cursor.nearest_trace(blocks, pointers, 64.0, 3, 12)


@query("""+r AS (SELECT rec, CAST(count(*) AS INTEGER) AS n FROM files GROUP BY rec), m AS (SELECT rec, n, CASE WHEN rec % 3 = 0 THEN [n - 1, 0, n + 4] END AS channels, CASE WHEN rec % 4 > 0 THEN [1, 2] END AS exclude FROM r)
SELECT rec, array_to_string(CASE WHEN channels IS NOT NULL THEN list_sort(list_distinct(list_filter(channels, lambda c: c < n))) ELSE list_filter(generate_series(0, n - 1), lambda c: exclude IS NULL OR c NOT IN (1, 2)) END, ',') AS channels FROM m""", "files")
def session_channels(spark, sf_dir):
    known = files(spark, sf_dir).groupBy("rec").agg(F.count("*").cast("int").alias("n"))
    told = F.when(F.col("rec") % 3 == 0, F.array(F.col("n") - 1, F.lit(0), F.col("n") + 4))
    meta = known.select(F.col("rec").alias("recording_id"), "n", told.alias("channels"), F.when(F.col("rec") % 4 > 0, F.array(F.lit(1), F.lit(2))).alias("exclude"))
    return reviews.session_channels(meta).select(F.col("recording_id").alias("rec"), F.array_join(F.col("channels").cast("array<string>"), ",").alias("channels"))
