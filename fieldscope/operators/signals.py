"""Operators on blocks(recording_id, channel, block, start_frame, samples): fixed-length blocks of a channel; the last may be shorter.

A halo brings the samples of neighbouring blocks beside a block, so a kernel's result does not depend on how blocks are partitioned.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscope.functions import kernels
from fieldscope.operators.scans import carried_states
from fieldscope.sources.tables import written

KEYS = ["recording_id", "channel"]
BLOCKS = "recording_id string, channel int, block long, start_frame long, samples array<double>"


def to_blocks(samples: DataFrame, length: int) -> DataFrame:
    """Blocks of length frames from samples(recording_id, channel, frame, value)."""
    at = F.floor(F.col("frame") / length).cast("long")
    out = samples.groupBy(*KEYS, at.alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("_rows"))
    return out.select(*KEYS, "block", (F.col("block") * length).alias("start_frame"), F.transform("_rows", lambda r: r["value"]).alias("samples"))


def with_halo(blocks: DataFrame, before: int, after: int) -> DataFrame:
    """blocks with samples widened by up to before and after frames of the neighbours, and lead: how many of them stand in front.

    Halos must not be longer than a block. Each block sends its ends to its neighbours; blocks meet by (channel, block), never a channel in one task.
    """
    own = blocks.select(*KEYS, "block", F.lit(1).alias("_part"), "samples", "start_frame", F.size("samples").alias("_n"))
    parts = own
    if before:
        tail = F.slice("samples", F.greatest(F.size("samples") - before + 1, F.lit(1)), before)
        parts = parts.unionByName(own.select(*KEYS, (F.col("block") + 1).alias("block"), F.lit(0).alias("_part"), tail.alias("samples"), F.lit(None).cast("long").alias("start_frame"), F.lit(None).cast("int").alias("_n")))
    if after:
        parts = parts.unionByName(own.select(*KEYS, (F.col("block") - 1).alias("block"), F.lit(2).alias("_part"), F.slice("samples", 1, after).alias("samples"), F.lit(None).cast("long").alias("start_frame"), F.lit(None).cast("int").alias("_n")))
    met = parts.groupBy(*KEYS, "block").agg(F.array_sort(F.collect_list(F.struct("_part", "samples"))).alias("_p"), F.max("start_frame").alias("start_frame"), F.max("_n").alias("n")).where("n is not null")
    lead = F.when(F.col("_p")[0]["_part"] == 0, F.size(F.col("_p")[0]["samples"])).otherwise(0)
    return met.select(*KEYS, "block", "start_frame", "n", lead.alias("lead"), F.flatten(F.transform("_p", lambda p: p["samples"])).alias("samples"))


@lru_cache(8)
def _cascade(order: int, rate: float, high_pass: float | None, low_pass: float | None) -> kernels.SectionFilter:
    return kernels.SectionFilter(kernels.butterworth(order, rate, high_pass, low_pass))


def band_filter(blocks: DataFrame, rate: float, high_pass: float | None = None, low_pass: float | None = None, order: int = 2) -> DataFrame:
    """blocks filtered causally from frame 0 on by Butterworth sections; what one block leaves in the filter goes on in the next.

    Every block is run once, from silence, and written with the state it ends in; those states (a few numbers a block) are carried along by a
    tree (carried_states). What a block was entered with then adds its response into silence to what is written. No group holds a channel.
    """
    if not len(kernels.butterworth(order, rate, high_pass, low_pass)):
        return blocks

    def run(batches):
        cascade = _cascade(order, rate, high_pass, low_pass)
        for pdf in batches:
            sizes, samples, states = pdf["samples"].map(len), [None] * len(pdf), [None] * len(pdf)
            for n in sizes.unique():
                at = np.flatnonzero(sizes.to_numpy() == n)
                y, after = cascade.run_many(np.stack(pdf["samples"].to_numpy()[at]))
                for i, k in enumerate(at):
                    samples[k], states[k] = y[i], after[i]
            yield pdf.assign(samples=samples, n=sizes.astype("int64"), state=states)

    alone = written(blocks.select(*KEYS, "block", "start_frame", "samples").mapInPandas(run, f"{BLOCKS}, n long, state array<double>"), "filter-alone")
    cascade = _cascade(order, rate, high_pass, low_pass)
    entered = carried_states(alone.select(*KEYS, "block", "n", "state"), KEYS, cascade.transition, cascade.size)

    def add(batches):
        cascade = _cascade(order, rate, high_pass, low_pass)
        known: dict[int, np.ndarray] = {}
        for pdf in batches:
            out = []
            for x, z in zip(pdf["samples"], pdf["entered"], strict=True):
                if len(x) not in known:
                    known[len(x)] = cascade.response(len(x))
                out.append(np.asarray(x) + np.asarray(z) @ known[len(x)])
            yield pdf[["recording_id", "channel", "block", "start_frame"]].assign(samples=out)

    met = alone.select(*KEYS, "block", "start_frame", "samples").join(entered.withColumnRenamed("state", "entered"), [*KEYS, "block"])
    return met.mapInPandas(add, BLOCKS)


def clean_clicks(blocks: DataFrame, rate: float) -> DataFrame:
    """blocks without clicks, and clicked: how many samples were repaired. Blocks should be CLICKS["block_s"] long; each is worked out from itself and
    margin_s around it, and only its own samples are taken, so untouched ones stay as they are."""
    margin = round(kernels.CLICKS["margin_s"] * rate)

    def run(batches):
        for pdf in batches:
            done = [kernels.without_clicks(np.asarray(x, dtype=np.float64), rate) for x in pdf["samples"]]
            cut = [(out[s : s + n], int(mask[s : s + n].sum())) for (out, mask), s, n in zip(done, pdf["lead"], pdf["n"], strict=True)]
            yield pdf[["recording_id", "channel", "block", "start_frame"]].assign(samples=[c[0] for c in cut], clicked=[c[1] for c in cut])

    return with_halo(blocks, margin, margin).mapInPandas(run, f"{BLOCKS}, clicked long")


def filter_pipeline(blocks: DataFrame, rate: float, clicks: bool = True, high_pass: float | None = None, low_pass: float | None = None, order: int = 2) -> DataFrame:
    """blocks with clicks repaired first and the band filtered then, so that a click does not ring in the filter."""
    repaired = clean_clicks(blocks, rate).drop("clicked") if clicks else blocks
    return band_filter(repaired, rate, high_pass, low_pass, order)


def power_on_frames(blocks: DataFrame, frames: DataFrame, rate: float, nfft: int, lo_hz: float, hi_hz: float, block_length: int) -> DataFrame:
    """recording_id, k, bin, freq, power (summed over channels), per_channel of frames(recording_id, k, start): windows of nfft samples at any start.

    The window is a symmetric Hann, power is a one-sided density, and only bins from lo_hz to hi_hz come out. A frame that reaches outside of the
    recording has a null power.
    """
    window = np.hanning(nfft)
    bins = np.arange(nfft // 2 + 1)
    bins = bins[(bins * rate / nfft >= lo_hz) & (bins * rate / nfft <= hi_hz)]
    scale = np.where((bins == 0) | (2 * bins == nfft), 1.0, 2.0) / ((window**2).sum() * rate)
    reach = F.sequence(F.floor(F.col("start") / block_length), F.floor((F.col("start") + nfft - 1) / block_length))
    needed = frames.withColumn("block", F.explode(reach))
    met = needed.join(blocks, ["recording_id", "block"], "left").groupBy("recording_id", "k", "start").agg(F.collect_list(F.when(F.col("channel").isNotNull(), F.struct("channel", "start_frame", "samples"))).alias("parts"))

    def run(batches):
        for pdf in batches:
            out = []
            for rec, k, start, parts in zip(pdf["recording_id"], pdf["k"], pdf["start"], pdf["parts"], strict=True):
                channels = sorted({p["channel"] for p in parts}) or [0]
                x = np.full((len(channels), nfft), np.nan)
                for p in parts:
                    first, values = int(p["start_frame"]), np.asarray(p["samples"], dtype=np.float64)
                    lo, hi = max(first, int(start)), min(first + len(values), int(start) + nfft)
                    x[channels.index(p["channel"]), lo - int(start) : hi - int(start)] = values[lo - first : hi - first]
                power = np.full((len(channels), len(bins)), np.nan) if np.isnan(x).any() else np.abs(np.fft.rfft(x * window, axis=1)[:, bins]) ** 2 * scale
                out += [(rec, k, int(b), float(b * rate / nfft), float(power[:, i].sum()), power[:, i].tolist()) for i, b in enumerate(bins)]
            yield pd.DataFrame(out, columns=["recording_id", "k", "bin", "freq", "power", "per_channel"])

    kind = frames.schema["recording_id"].dataType.simpleString()
    return met.mapInPandas(run, f"recording_id {kind}, k long, bin int, freq double, power double, per_channel array<double>")


def gaussian_smooth(cells: DataFrame, sigma: float, floor_db: float = -200.0) -> DataFrame:
    """recording_id, channel, col, bin, smooth of cells(recording_id, channel, col, bin, db), which are a whole picture: Gaussian of sigma cells, cut at
    four sigma, with mirrored edges; what is no finite level counts as floor_db.

    Along the bins an array does it; along the columns every column gives its weighted row to those around, so only neighbours meet.
    """
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = (weights / weights.sum()).tolist()
    level = F.when(F.col("db").isNotNull() & ~F.isnan("db") & (F.abs("db") < float("inf")), F.col("db")).otherwise(F.lit(floor_db))
    rows = cells.groupBy(*KEYS, "col").agg(F.array_sort(F.collect_list(F.struct("bin", level.alias("v")))).alias("_r"))
    values, n = F.transform("_r", lambda r: r["v"]), F.size("_r")

    def mirrored(i, size):
        at = F.pmod(i, 2 * size)
        return F.when(at < size, at).otherwise(2 * size - 1 - at)

    across = F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum(F.get(F.col("_v"), mirrored(i + (j - reach), n)) * w for j, w in enumerate(weights)))
    rows = rows.withColumn("_v", values).select(*KEYS, "col", F.transform("_r", lambda r: r["bin"]).alias("_bins"), across.alias("_v"))
    ends = rows.groupBy(*KEYS).agg(F.min("col").alias("_a"), (F.max("col") - F.min("col") + 1).alias("_n"))
    placed = rows.join(ends, KEYS)
    # every column takes what lies d columns on, mirrored at the picture's ends
    asked = placed.select(*KEYS, F.col("col").alias("_to"), "_a", "_n", "_bins", F.explode(F.array(*(F.struct(F.lit(j - reach).alias("d"), F.lit(w).alias("w")) for j, w in enumerate(weights)))).alias("_s"))
    asked = asked.withColumn("col", (F.col("_a") + mirrored(F.col("_to") - F.col("_a") + F.col("_s.d"), F.col("_n"))).cast("long"))
    met = asked.join(rows.select(*KEYS, "col", F.posexplode("_v").alias("_i", "_x")), [*KEYS, "col"])
    return met.groupBy(*KEYS, F.col("_to").alias("col"), F.get("_bins", F.col("_i")).alias("bin")).agg(F.sum(F.col("_x") * F.col("_s.w")).alias("smooth"))


def spectrogram(blocks: DataFrame, rate: float, nfft: int, hop: int, length: int) -> DataFrame:
    """recording_id, channel, col, t, power: all full windows, a column where its first frame lies. length is the blocks' length, nfft at least."""
    if nfft > length:
        raise ValueError("a block must hold a window")

    def run(batches):
        for pdf in batches:
            first = -(-pdf["start_frame"] // hop)
            size = pdf["samples"].map(len)
            count = np.minimum((pdf["start_frame"] + pdf["n"] - 1) // hop, (pdf["start_frame"] + size - nfft) // hop) - first + 1
            # blocks of one shape are transformed together
            for (lead, windows, _), g in pdf.groupby([first * hop - pdf["start_frame"], count, size], sort=False):
                if windows > 0:
                    power = kernels.power_columns(np.stack(g["samples"].to_numpy()).astype(np.float64), lead, windows, nfft, hop, rate)
                    col = (first[g.index].to_numpy()[:, None] + np.arange(windows)).ravel()
                    yield pd.DataFrame({"recording_id": np.repeat(g["recording_id"].to_numpy(), windows), "channel": np.repeat(g["channel"].to_numpy(), windows), "col": col, "t": col * hop / rate, "power": list(power.reshape(len(col), -1))})

    return with_halo(blocks, 0, nfft - 1).select(*KEYS, "start_frame", "n", "samples").mapInPandas(run, "recording_id string, channel int, col long, t double, power array<double>")


def bins_of(spectra: DataFrame, rate: float, nfft: int) -> DataFrame:
    """recording_id, channel, col, bin, freq, power: one row a cell."""
    return spectra.select(*KEYS, "col", F.posexplode("power").alias("bin", "power")).withColumn("freq", F.col("bin") * (rate / nfft))


def channel_power(cells: DataFrame, how: str = "avg") -> DataFrame:
    """Power over the channels of each cell, by mean or max, before any dB."""
    agg = F.avg("power") if how == "avg" else F.max("power")
    return cells.groupBy("recording_id", "col", "bin", "freq").agg(agg.alias("power"))


def mean_spectrum(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*KEYS, "bin", "freq").agg(F.avg("power").alias("power"))


def noise_levels(cells: DataFrame, bins: int) -> DataFrame:
    """recording_id, floor, top in dB: the floor is the higher of the 95th percentile of the top sixteenth of bins and the median + 3 dB; the top is
    95 % of the way to the maximum, 20 to 80 dB over the floor."""
    from fieldscope.functions.scalars import decibel

    db = cells.withColumn("db", decibel(F.col("power"))).where(F.col("db") > float("-inf"))
    out = db.groupBy("recording_id").agg(F.percentile(F.when(F.col("bin") >= bins - max(1, bins // 16), F.col("db")), 0.95).alias("_high"), F.percentile("db", 0.5).alias("_mid"), F.max("db").alias("_max"))
    floor = F.greatest("_high", F.col("_mid") + 3)
    return out.select("recording_id", floor.alias("floor"), (floor + F.greatest(F.lit(20.0), F.least(F.lit(80.0), 0.95 * (F.col("_max") - floor)))).alias("top"))


def mains_comb(cells: DataFrame, df: float, f0: float = 50.0, harmonics: int = 8, width: float = 1.0, strength: float = 1.0) -> DataFrame:
    """cells with the bins within width of each harmonic drawn down to the median of the bins beside (up to three widths off).

    Bands of different harmonics must not meet (f0 over six widths), so all can be worked out at once.
    """
    half = max(width, df)
    outer = max(3 * half, half + 2 * df)
    if f0 <= 2 * outer:
        raise ValueError("the harmonics' bands overlap")
    h = F.greatest(F.lit(1), F.least(F.lit(harmonics), F.rint(F.col("freq") / f0).cast("int")))
    off = F.abs(F.col("freq") - h * f0)
    near = cells.withColumns({"_h": F.when(off <= outer, h), "_notch": off <= half})
    floors = near.where("_h is not null and not _notch").groupBy(*KEYS, "col", "_h").agg(F.percentile("power", 0.5).alias("_floor"))
    out = near.join(floors, [*KEYS, "col", "_h"], "left")
    less = F.when(F.col("_notch"), F.greatest(F.col("power") - F.col("_floor"), F.lit(0.0)) * strength)
    return out.withColumn("power", F.col("power") - F.coalesce(less, F.lit(0.0))).drop("_h", "_notch", "_floor")


def spatial_coherence(cells: DataFrame, threshold_db: float = 6.0, softness_db: float = 2.0, dead: float = 1e-9) -> DataFrame:
    """cells gated by how much the channels differ: a logistic of their spread in dB. Channels under dead of the loudest are dead (0: all count as live);
    under two live ones nothing changes."""
    top = cells.groupBy("recording_id", "col", "bin").agg(F.max("power").alias("_top"))
    x = cells.join(top, ["recording_id", "col", "bin"])
    live = x.where(F.col("power") >= dead * F.col("_top")).groupBy("recording_id", "col", "bin").agg(F.min("power").alias("_low"), F.count("*").alias("_live"))
    spread = 10 * F.log10(F.col("_top") / F.col("_low"))
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (spread - threshold_db) / softness_db))
    gate = F.when((F.col("_live") >= 2) & (F.col("_low") > 0), 1 / (1 + F.exp(-z))).otherwise(1.0)
    return x.join(live, ["recording_id", "col", "bin"], "left").withColumn("power", F.col("power") * F.coalesce(gate, F.lit(1.0))).drop("_top", "_low", "_live")


def box_smooth(cells: DataFrame, value: str, bins: int, columns: int) -> DataFrame:
    """value averaged over 3 by 3 cells; edges repeat themselves, non-finite values count as -200."""
    v = F.when(F.isnan(value) | (F.abs(value) == float("inf")) | F.col(value).isNull(), -200.0).otherwise(F.col(value))
    steps = F.array(*(F.struct(F.lit(i).alias("dc"), F.lit(j).alias("db")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    keep = lambda c, d, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + d))
    # a cell goes to its neighbours; one on an edge also stands in for the missing ones
    sent = cells.select(*KEYS, "col", "bin", v.alias("_v"), F.explode(steps).alias("_s"))
    target = sent.select(*KEYS, (F.col("col") + F.col("_s.dc")).alias("col"), (F.col("bin") + F.col("_s.db")).alias("bin"), "_v", F.col("col").alias("_c"), F.col("bin").alias("_b"))
    outside = target.withColumns({"_tc": keep("col", 0, columns), "_tb": keep("bin", 0, bins)})
    # values sent outside fold back onto the edge cell that misses them
    return outside.groupBy(*KEYS, F.col("_tc").alias("col"), F.col("_tb").alias("bin")).agg((F.sum("_v") / 9).alias("smooth"))


def peak_in_band(cells: DataFrame, f_lo: float, f_hi: float) -> DataFrame:
    """recording_id, channel, col, bin, freq, power of the strongest bin in the band, and peak: its frequency refined by a parabola through the dB beside."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS, "col").orderBy("bin")
    db = 10 * F.log10(F.greatest("power", F.lit(1e-30)))
    x = cells.withColumn("_y", db).withColumns({"_l": F.lag("_y").over(w), "_r": F.lead("_y").over(w), "_df": F.lead("freq").over(w) - F.col("freq")})
    best = x.where(F.col("freq").between(f_lo, f_hi)).groupBy(*KEYS, "col").agg(F.max_by(F.struct("bin", "freq", "power", "_y", "_l", "_r", "_df"), F.struct("power", -F.col("bin"))).alias("m"))
    m = lambda c: F.col(f"m.{c}")
    bend = m("_l") - 2 * m("_y") + m("_r")
    shift = F.when(bend < 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m("_l") - m("_r")) / (2 * bend)))).otherwise(0.0)
    return best.select(*KEYS, "col", "m.bin", "m.freq", "m.power", (m("freq") + F.coalesce(shift * m("_df"), F.lit(0.0))).alias("peak"))


def find_ridges(spectra: DataFrame, strokes: DataFrame, rate: float, nfft: int, **settings) -> DataFrame:
    """stroke, col, f, db: the ridge through each of strokes(stroke, recording_id, channel, col, t, lo, hi; one row a frame) in spectra (spectrogram).

    Spectra are joined as they are; a stroke is as long as a hand draws it, and many are followed in a call.
    """
    rows = strokes.join(spectra.select(*KEYS, "col", "power"), [*KEYS, "col"]).select("stroke", "col", "t", "lo", "hi", "power")
    tasks = int(spectra.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for stroke, g in pdf.sort_values(["stroke", "col"]).groupby("stroke", sort=False):
            power = np.stack(g["power"].to_numpy())
            f, db = kernels.ridge(power, np.arange(power.shape[1]) * (rate / nfft), *(g[c].to_numpy(dtype=np.float64) for c in ("lo", "hi", "t")), **settings)
            out.append(pd.DataFrame({"stroke": stroke, "col": g["col"].to_numpy(), "f": f, "db": db}))
        return pd.concat(out)

    # a number of partitions is named, or few bytes would make few tasks of much work
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("stroke"), F.lit(8 * tasks))).repartition(tasks, "_deal")
    found = dealt.groupBy("_deal").applyInPandas(follow, "stroke long, col long, f double, db double")
    return found.select("stroke", "col", F.when(~F.isnan("f"), F.col("f")).alias("f"), F.when(~F.isnan("db"), F.col("db")).alias("db"))
