"""Queries: grids of windows and tiles, and the training sets of detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldscope.functions import grids
from fieldscope.functions.tiles import TileSpec
from fieldscope.operators import dataset
from fieldscope.plans.registry import ev, ev_boxes, files, load, query
from fieldscope.plans.signals import _blocks

_SMOOTH = "sm AS (SELECT DISTINCT CAST(pow(2, a) * pow(3, b) * pow(5, c) AS BIGINT) AS s, a FROM (SELECT unnest(generate_series(0, 21)) AS a), (SELECT unnest(generate_series(0, 13)) AS b), (SELECT unnest(generate_series(0, 9)) AS c) WHERE pow(2, a) * pow(3, b) * pow(5, c) <= 2097152)"


@query("+" + _SMOOTH + """, r AS (SELECT rec, 96000.0 / (rec % 5 + 1) AS rate, sum(frames) AS frames FROM files GROUP BY rec), ld AS (SELECT 20000 / pow(2, i) AS resolution FROM (SELECT unnest(generate_series(3, 19)) AS i)),
d AS (SELECT DISTINCT rate, resolution, rate / resolution AS x FROM r, ld), n AS (SELECT rate, resolution, arg_min(s, (abs(s - x), s)) AS nfft FROM d JOIN sm ON a >= 1 AND s >= x / 2 AND s <= x * 2 + 2 GROUP BY rate, resolution, x)
SELECT rec, resolution, nfft FROM r JOIN n USING (rate) WHERE nfft >= 8 AND nfft <= least(1048576, floor(frames / 2))""", "files")
def window_ladder(spark, sf_dir):
    recordings = files(spark, sf_dir).groupBy("rec").agg(F.sum("frames").alias("frames")).withColumn("rate", 96000.0 / (F.col("rec") % 5 + 1))
    return grids.windows(recordings).withColumn("nfft", F.col("nfft").cast("long"))


@query("WITH " + _SMOOTH + """, c AS (SELECT c_custkey AS rec, (c_custkey % 4 + 1) * 12000.0::DOUBLE AS rate, (c_custkey % 7 + 1) * 0.0031::DOUBLE AS window_s, (c_custkey % 5 + 1) * 0.0007::DOUBLE AS hop_s, (c_custkey % 9 + 1) * 0.13::DOUBLE AS tile_s, (c_custkey % 9 + 1) * 0.04::DOUBLE AS overlap_s, (c_custkey % 11) * 210.0::DOUBLE AS fmin_hz, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 11) * 210.0::DOUBLE + 1700 END AS fmax_hz FROM customer),
w AS (SELECT *, (SELECT min(s) FROM sm WHERE s >= greatest(CAST(round_even(window_s * rate, 0) AS BIGINT), 8)) AS nfft FROM c),
h AS (SELECT * REPLACE (hop + (nfft - hop) % 2 AS hop) FROM (SELECT *, least(greatest(CAST(round_even(hop_s * rate, 0) AS BIGINT), 1), nfft) AS hop FROM w)),
f AS (SELECT *, greatest(CAST(round_even(tile_s * (rate / hop), 0) AS BIGINT), 1) AS frames, CAST(least(greatest(floor(fmin_hz / (rate / nfft) + 0.5), 0), floor(nfft / 2)) AS BIGINT) AS k0 FROM h),
k AS (SELECT *, CAST(CASE WHEN fmax_hz IS NULL THEN floor(nfft / 2) + 1 ELSE least(greatest(ceil(fmax_hz / (rate / nfft) - 0.5) + 1, k0 + 1), floor(nfft / 2) + 1) END AS BIGINT) AS k1 FROM f)
SELECT rec, nfft, hop, frames, k0, k1, round(f_low, 6) AS f_low, round(f_high, 6) AS f_high, round(frames / (rate / hop), 9) AS tile_len_s, round(greatest(frames - CAST(round_even(overlap_s * (rate / hop), 0) AS BIGINT), 1) / (rate / hop), 9) AS step_s
FROM (SELECT *, (k0 - 0.5) * (rate / nfft) AS f_low, (k1 - 0.5) * (rate / nfft) AS f_high FROM k)""")
def tile_grids(spark, sf_dir):
    i = F.col("c_custkey")
    low = (i % 11) * F.lit(210.0)
    configs = load(spark, sf_dir, "customer").select(
        i.alias("rec"), ((i % 4 + 1) * F.lit(12000.0)).alias("rate"), ((i % 7 + 1) * F.lit(0.0031)).alias("window_s"), ((i % 5 + 1) * F.lit(0.0007)).alias("hop_s"), ((i % 9 + 1) * F.lit(0.13)).alias("tile_s"),
        ((i % 9 + 1) * F.lit(0.04)).alias("overlap_s"), low.alias("fmin_hz"), F.when(i % 3 > 0, low + 1700).alias("fmax_hz"),
    )
    out = grids.tile_grid(configs)
    return out.select("rec", "nfft", "hop", "frames", "k0", "k1", *(F.round(c, 6).alias(c) for c in ("f_low", "f_high")), *(F.round(c, 9).alias(c) for c in ("tile_len_s", "step_s")))


@query("""WITH r AS (SELECT o_orderkey AS id, 50.0::DOUBLE AS rate, 256 AS nfft, 64 AS step, o_orderkey % 100000 AS n_samples, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1000 END AS session_s0, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 400)::DOUBLE - 20 END AS start, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 2300)::DOUBLE END AS stop FROM orders),
g AS (SELECT *, coalesce(session_s0 % step, 0) AS s0 FROM r), n AS (SELECT *, CASE WHEN n_samples - s0 - nfft < 0 THEN 0 ELSE CAST(floor((n_samples - s0 - nfft) / step::DOUBLE) AS BIGINT) + 1 END AS n_frames, n_samples / rate AS duration FROM g),
c AS (SELECT *, greatest(coalesce(start, 0), 0) AS t0, CASE WHEN stop IS NOT NULL AND NOT (duration > 0 AND greatest(stop, 0) >= duration) THEN greatest(stop, 0) END AS t1 FROM n),
w AS (SELECT *, (duration > 0 AND t0 >= duration) OR coalesce(t1 <= t0, false) AS wrong, t0 <= 0 AND t1 IS NULL AS whole FROM c),
k AS (SELECT *, least(greatest(CAST(ceil((t0 * rate - nfft / 2 - s0) / step) AS BIGINT), 0), n_frames) AS a, CASE WHEN t1 IS NULL THEN n_frames ELSE least(greatest(CAST(floor((t1 * rate - nfft / 2 - s0) / step) AS BIGINT) + 1, 0), n_frames) END AS b FROM w WHERE NOT wrong)
SELECT id, whole, n_frames, CASE WHEN b - a >= 2 THEN a END AS k0, CASE WHEN b - a >= 2 THEN b END AS k1, CASE WHEN b - a >= 2 THEN round((s0 + a * step) / rate, 9) END AS start_s, CASE WHEN b - a >= 2 AND b < n_frames THEN round(((b - a - 1) * step + nfft) / rate, 9) END AS duration_s FROM k""")
def detect_windows(spark, sf_dir):
    i = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(
        i.alias("id"), F.lit(50.0).alias("rate"), F.lit(256).alias("nfft"), F.lit(64).alias("step"), (i % 100000).alias("n_samples"), F.when(i % 3 == 0, i % 1000).alias("session_s0"),
        F.when(i % 5 > 0, (i % 400).cast("double") - 20).alias("start"), F.when(i % 7 > 0, (i % 2300).cast("double")).alias("stop"),
    )
    asked = grids.recording_grid(rows).withColumn("r", grids.clamp_range(F.col("start"), F.col("stop"), F.col("n_samples") / F.col("rate"))).where("not r.wrong")
    out = grids.detect_window(asked.select("*", "r.t0", "r.t1", "r.whole"))
    return out.select("id", "whole", F.col("n_frames").cast("long").alias("n_frames"), "k0", "k1", F.round("start_s", 9).alias("start_s"), F.round("duration_s", 9).alias("duration_s"))


@query("""+p AS (SELECT uid, (t0 - floor(t0 / 86400) * 86400) / 86400 * 640 AS x0, (200 - f1) / 220 * 320 AS y0, (t1 - floor(t0 / 86400) * 86400) / 86400 * 640 AS x1, (200 - f0) / 220 * 320 AS y1, floor(t0 / 86400) * 86400 AS a FROM boxes)
SELECT uid, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(a + x0 / 640 * 86400, 3) AS t0, round(200 - y0 / 320 * 220, 3) AS f1 FROM p""", "ev boxes")
def box_pixels(spark, sf_dir):
    day = F.floor(F.col("t0") / 86400) * 86400
    tile = (day, day + 86400, F.lit(-20.0), F.lit(200.0))
    rows = ev_boxes(spark, sf_dir).withColumn("p", grids.box_pixels((F.col("t0"), F.col("t1"), F.col("f0"), F.col("f1")), tile, 640, 320))
    rows = rows.withColumn("b", grids.pixels_box(F.col("p"), tile, 640, 320))
    return rows.select("uid", *(F.round(f"p.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")), F.round("b.t0", 3).alias("t0"), F.round("b.f1", 3).alias("f1"))


_PLAN = """rc AS (SELECT channel AS rec, event_id AS rect, CAST(round_even(t, 0) AS BIGINT) AS a, CAST(round_even(t + value * 60, 0) AS BIGINT) AS b FROM ev WHERE category = 'signup'),
dr AS (SELECT rec, a, b, b - 3600 + (((((rect % 2147483647 + 1) * 48271) % 2147483647 + i + 1) * 48271) % 2147483647 * 48271) % 2147483647 % greatest(a - (b - 3600) + 1, 1) AS s FROM rc, (SELECT unnest(generate_series(0, 7)) AS i) WHERE b - a < 3600),
st AS (SELECT rec, s FROM dr UNION ALL SELECT rec, b - 3600 FROM rc WHERE b - a >= 3600 UNION ALL SELECT rec, unnest(generate_series(a, b - 3601, 900)) FROM rc WHERE b - a > 3600),
tl AS (SELECT DISTINCT rec, least(greatest(s, 0), 2588400) AS s0 FROM st)"""


def _rects(spark, sf_dir):
    e = ev(spark, sf_dir).where("category = 'signup'")
    return e.select(F.col("channel").alias("rec"), F.col("event_id").alias("rect"), F.col("t").alias("t0"), (F.col("t") + F.col("value") * 60).alias("t1"))


def _grids(spark, sf_dir):
    return _rects(spark, sf_dir).select("rec").distinct().select("rec", F.lit(1.0).alias("rate"), F.lit(3600).cast("long").alias("length"), F.lit(2592000).cast("long").alias("total"), F.lit(0.0).alias("f_low"), F.lit(150.0).alias("f_high"))


@query("+" + _PLAN + " SELECT rec, s0 FROM tl", "ev")
def plan_tiles(spark, sf_dir):
    return dataset.plan_tiles(_rects(spark, sf_dir), _grids(spark, sf_dir))


_SPLIT = _PLAN + """, te AS (SELECT rec, s0, s0 // 3600 % 7 = 0 AS has_event FROM tl),
bf(rec, f) AS (SELECT rec, min(s0) FROM tl GROUP BY rec UNION ALL SELECT bf.rec, (SELECT min(s0) FROM tl WHERE tl.rec = bf.rec AND tl.s0 >= bf.f + 14400) FROM bf WHERE (SELECT min(s0) FROM tl WHERE tl.rec = bf.rec AND tl.s0 >= bf.f + 14400) IS NOT NULL),
bk AS (SELECT te.*, (SELECT max(f) FROM bf WHERE bf.rec = te.rec AND f <= te.s0) AS block FROM te),
hd AS (SELECT rec, block FROM (SELECT rec, block, row_number() OVER (ORDER BY rec, block) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT rec, block FROM bk WHERE has_event)) WHERE n >= 5 AND i % 5 = 2),
x AS (SELECT bk.*, (rec, block) IN (SELECT (rec, block) FROM hd) AS held FROM bk),
sp AS (SELECT rec, s0, has_event, CASE WHEN held THEN 'val' WHEN NOT EXISTS (SELECT 1 FROM x v WHERE v.held AND v.rec = x.rec AND abs(v.s0 - x.s0) < 3600) THEN 'train' END AS split FROM x)"""


@query("+" + _SPLIT + " SELECT * FROM sp", "ev", recursive=True)
def split_tiles(spark, sf_dir):
    plan = dataset.plan_tiles(_rects(spark, sf_dir), _grids(spark, sf_dir))
    return dataset.split_tiles(plan.withColumn("has_event", F.floor(F.col("s0") / 3600) % 7 == 0), _grids(spark, sf_dir))


_LABELS = _PLAN + """, bx AS (SELECT channel AS rec, event_id AS uid, event_id % 4 AS cls, t AS t0, t + 900 AS t1, value AS f0, value + 50 AS f1 FROM ev),
m AS (SELECT tl.rec, tl.s0, uid, cls, greatest(bx.t0, s0) AS a0, least(bx.t1, s0 + 3600) AS a1, greatest(f0, 0) AS b0, least(f1, 150) AS b1, (bx.t1 - bx.t0) * (f1 - f0) AS whole FROM tl JOIN bx ON bx.rec = tl.rec AND bx.t0 < s0 + 3600 AND bx.t1 > s0),
ll AS (SELECT rec, s0, uid, CASE WHEN whole > 0 AND (a1 - a0) * (b1 - b0) / whole >= 0.6 THEN cls END AS cls, a0, a1, b0, b1 FROM m WHERE a1 > a0 AND b1 > b0)"""


def _placed(spark, sf_dir):
    plan = dataset.plan_tiles(_rects(spark, sf_dir), _grids(spark, sf_dir))
    s0 = F.col("s0").cast("double")
    return plan.select("rec", "s0", s0.alias("t0"), (s0 + 3600).alias("t1"), F.lit(0.0).alias("f0"), F.lit(150.0).alias("f1"))


def _label_rows(spark, sf_dir):
    boxes = ev_boxes(spark, sf_dir).withColumns({"cls": F.col("uid") % 4, "t1": F.col("t0") + 900})
    return dataset.tile_labels(boxes, _placed(spark, sf_dir), 3600.0, 64)


@query("+" + _LABELS + " SELECT rec, s0, uid, cls, round(a0, 6) AS t0, round(a1, 6) AS t1, round(b0, 6) AS f0, round(b1, 6) AS f1 FROM ll", "ev")
def tile_labels(spark, sf_dir):
    return _label_rows(spark, sf_dir).select("rec", "s0", "uid", F.split("line", " ")[0].cast("long").alias("cls"), *(F.round(c, 6).alias(c) for c in ("t0", "t1", "f0", "f1")))


@query("+" + _SPLIT.replace("s0 // 3600 % 7 = 0 AS has_event FROM tl", "(rec, s0) IN (SELECT (rec, s0) FROM ll WHERE cls IS NOT NULL) AS has_event FROM tl").replace(_PLAN, _LABELS) + """, pt AS (SELECT sp.split, sp.rec, sp.s0, ll.cls FROM sp LEFT JOIN (SELECT * FROM ll WHERE cls IS NOT NULL) ll ON ll.rec = sp.rec AND ll.s0 = sp.s0 WHERE split IS NOT NULL),
c AS (SELECT split, cls, count(*) AS n FROM pt WHERE cls IS NOT NULL GROUP BY split, cls)
SELECT split, count(DISTINCT (rec, s0)) AS tiles, count(*) FILTER (cls IS NULL) AS background, CAST(coalesce((SELECT sum(n) FROM c WHERE c.split = pt.split), 0) AS BIGINT) AS events, coalesce((SELECT string_agg(cls || ':' || n, ',' ORDER BY cls) FROM c WHERE c.split = pt.split), '') AS per_class FROM pt GROUP BY split""", "ev", recursive=True)
def dataset_report(spark, sf_dir):
    lines = _label_rows(spark, sf_dir)
    events = lines.where("line is not null").select("rec", "s0").distinct().withColumn("has_event", F.lit(True))
    tiles = _placed(spark, sf_dir).select("rec", "s0").join(events, ["rec", "s0"], "left").withColumn("has_event", F.coalesce("has_event", F.lit(False)))
    return dataset.dataset_report(dataset.split_tiles(tiles, _grids(spark, sf_dir)), lines)


@query("""+o AS (SELECT *, row_number() OVER (PARTITION BY rec, cls ORDER BY t0, t1, uid) AS n FROM boxes),
pr AS (SELECT a.rec, a.cls, a.n, list(b.uid) AS over FROM o a JOIN o b ON a.rec = b.rec AND a.cls = b.cls AND b.n < a.n AND least(a.t1, b.t1) > greatest(a.t0, b.t0) AND least(a.f1, b.f1) > greatest(a.f0, b.f0)
  WHERE (least(a.t1, b.t1) - greatest(a.t0, b.t0)) * (least(a.f1, b.f1) - greatest(a.f0, b.f0)) / ((a.t1 - a.t0) * (a.f1 - a.f0) + (b.t1 - b.t0) * (b.f1 - b.f0) - (least(a.t1, b.t1) - greatest(a.t0, b.t0)) * (least(a.f1, b.f1) - greatest(a.f0, b.f0))) > 0.5 GROUP BY a.rec, a.cls, a.n),
st AS (SELECT o.rec, o.cls, o.n, o.uid, coalesce(over, []) AS over FROM o LEFT JOIN pr ON pr.rec = o.rec AND pr.cls = o.cls AND pr.n = o.n),
k AS (SELECT rec, cls, n, uid, true AS stays, [uid] AS kept FROM st WHERE n = 1
  UNION ALL SELECT st.rec, st.cls, st.n, st.uid, NOT list_has_any(kept, over), CASE WHEN list_has_any(kept, over) THEN kept ELSE list_append(kept, st.uid) END FROM k JOIN st ON st.rec = k.rec AND st.cls = k.cls AND st.n = k.n + 1)
SELECT rec, uid FROM k WHERE stays""", "ev boxes", recursive=True)
def merge_lanes(spark, sf_dir):
    return dataset.merge_lanes(ev_boxes(spark, sf_dir), 0.5, 3600.0).select("rec", "uid")


@query()
def render_tiles(spark, sf_dir):
    """Pictures of every recording of 8 embeddings at five places, two of them past its ends."""
    blocks = _blocks(spark, sf_dir)
    tiles = blocks.select("recording_id").distinct().select("recording_id", F.explode(F.array(*(F.lit(s).cast("long") for s in (-8, 0, 16, 40, 56)))).alias("s0"), F.lit(64).cast("long").alias("total"))
    spec = TileSpec(64.0, 16, 4, 8, 1, 8, size=16)
    return dataset.render_tiles(blocks, tiles, spec, 16).select("recording_id", "s0", F.sha2("image", 256).alias("sha256"))
