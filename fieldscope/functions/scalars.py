"""Column functions: decibels, FFT sizes, times as text, geometry of boxes and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel_list(text: str) -> list[int]:
    """0,2-5 as a list of channels."""
    out: list[int] = []
    for part in text.split(","):
        lo, dash, hi = part.strip().partition("-")
        out += range(int(lo), int(hi) + 1) if dash else [int(lo)]
    return out


def decibel(p: Column, least: float = 1e-20) -> Column:
    """10 log10 p; -inf at least or below, NaN stays NaN, null stays null."""
    return F.when(F.isnan(p), p).when(p <= least, F.lit(-math.inf)).otherwise(10 * F.log10(p))


def _let(value: Column, f) -> Column:
    """f of value, which is worked out once."""
    return F.transform(F.array(value), f)[0]


def fixed(x: Column, digits: int) -> Column:
    """A double with digits decimals (11 at most) as C's printf writes it: its exact binary value rounded, an exact half to the even digit.

    format_string rounds the shortest decimal that names the double instead, half up: 0.125 and 1.005 come out otherwise there. What is not finite or
    2^63 or more is left to it.
    """
    scale, bits = 10**digits, 26
    limb, mask = float(1 << bits), F.lit((1 << bits) - 1)

    def limbs(rest: Column) -> Column:
        """rest (0 to 1) as three whole numbers of 26 bits."""
        one = _let(rest * limb, lambda v: F.struct(F.floor(v).alias("n"), (v - F.floor(v)).alias("rest")))
        two = _let(one, lambda v: F.struct(v["n"].alias("a"), F.floor(v["rest"] * limb).alias("b"), (v["rest"] * limb - F.floor(v["rest"] * limb)).alias("rest")))
        return _let(two, lambda v: F.struct(v["a"], v["b"], F.floor(v["rest"] * limb).alias("c")))

    def scaled(v: Column) -> Column:
        """Whole number n and fraction (limbs p, q, r) of the limbs times scale."""
        low = _let(v["c"] * scale, lambda c: F.struct(v["a"].alias("a"), (v["b"] * scale + F.shiftright(c, bits)).alias("b"), c.bitwiseAND(mask).alias("r")))
        mid = _let(low, lambda u: F.struct((u["a"] * scale + F.shiftright(u["b"], bits)).alias("a"), u["b"].bitwiseAND(mask).alias("q"), u["r"].alias("r")))
        return _let(mid, lambda u: F.struct(F.shiftright(u["a"], bits).alias("n"), u["a"].bitwiseAND(mask).alias("p"), (u["q"] + u["r"]).alias("beyond")))

    half = 1 << (bits - 1)
    up = lambda v: (v["p"] > half) | ((v["p"] == half) & ((v["beyond"] > 0) | (v["n"] % 2 == 1)))

    def text(a: Column) -> Column:
        whole = F.floor(a)
        units = _let(scaled(limbs(a - whole)), lambda v: v["n"] + up(v).cast("long"))
        return _let(units, lambda n: F.concat((whole + (n >= scale).cast("long")).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0")))

    def quick(y: Column) -> Column:
        """y rounded where a product so small and so far from a half leaves no doubt; the others go the long way."""
        return F.when((y < 2.0**42) & (F.abs(y - F.floor(y) - 0.5) > 1e-3), F.floor(y + 0.5))

    def either(a: Column) -> Column:
        short = lambda n: F.concat(((n - n % scale) / scale).cast("long").cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
        return _let(_let(a * scale, quick), lambda n: F.when(n.isNotNull(), short(n)).otherwise(text(a)))

    minus = (x < 0) | ((x == 0) & x.cast("string").startswith("-"))
    plain = _let(F.abs(x), lambda a: F.when(a < 2.0**63, either(a)))
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**63), F.format_string(f"%.{digits}f", x)).otherwise(F.concat(F.when(minus, "-").otherwise(""), plain))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded to digits decimals in doubles: the whole number nearest x 10^digits, halves away from 0, over 10^digits.

    round goes by the shortest decimal that names the double, which is another number where its next digit is a 5.
    """
    scale = float(10**digits)
    near = lambda y: F.when(F.abs(y) < 2.0**52, F.signum(y) * (F.floor(F.abs(y)) + (F.abs(y) - F.floor(F.abs(y)) >= 0.5).cast("long"))).otherwise(y)
    return _let(x * scale, near) / scale


def smooth_sizes(most: int) -> list[int]:
    """Even numbers 2**a 3**b 5**c up to most."""
    return sorted(2**a * 3**b * 5**c for a in range(1, 64) for b in range(41) for c in range(28) if 2**a * 3**b * 5**c <= most)


def fast_fft_size(x: Column, most: int = 1 << 21) -> Column:
    """The nearest even 5-smooth number; of two as near the smaller."""
    sizes = F.array(*(F.lit(s) for s in smooth_sizes(most)))
    near = F.transform(sizes, lambda s: F.struct(F.abs(s - x).cast("double").alias("d"), s.alias("s")))
    return F.array_min(near)["s"]


def snap(x: Column, ladder: list[float]) -> Column:
    """The rung closest on a log scale, the smaller of two."""
    near = F.array(*(F.struct(F.abs(F.log(F.lit(float(r)) / x)).alias("d"), F.lit(float(r)).alias("r")) for r in ladder))
    return F.array_min(near)["r"]


def hop_of(nfft: Column, overlap: Column) -> Column:
    """Half-even rounded step between windows, from 1 to nfft; overlap is kept within 0 and 0.99999."""
    part = 1 - F.greatest(F.lit(0.0), F.least(overlap, F.lit(0.99999)))
    return F.greatest(F.lit(1), F.least(F.rint(part * nfft).cast("long"), nfft))


def parse_time(text: Column) -> Column:
    """Seconds of [[h:]m:]s[.s]; null where the text is no such time or minutes or seconds under an hour or minute reach 60."""
    t = F.trim(text)
    parts = F.reverse(F.split(t, ":"))
    sec, minute, hour = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"), F.get(parts, F.lit(2)).try_cast("double")
    ok = t.rlike(r"^(\d+:){0,2}\d+(\.\d*)?$") & (minute.isNull() | (sec < 60)) & (hour.isNull() | (minute < 60))
    return F.when(ok, sec + 60 * F.coalesce(minute, F.lit(0.0)) + 3600 * F.coalesce(hour, F.lit(0.0)))


def format_clock(seconds: Column) -> Column:
    """h:mm:ss.s, or m:ss.s under an hour."""
    tenths = F.rint(seconds * 10).cast("long")
    h, m, s = F.floor(tenths / 36000), F.floor(tenths / 600) % 60, tenths % 600
    rest = F.concat(F.floor(s / 10).cast("string"), F.lit("."), (s % 10).cast("string"))
    rest = F.when(s < 100, F.concat(F.lit("0"), rest)).otherwise(rest)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), rest)).otherwise(F.concat(m.cast("string"), F.lit(":"), rest))


def ordinal(n: Column) -> Column:
    end = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def uncertainty(score: Column, cut: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(score - cut) / max(cut, 1 - cut, 1e-6))


def colour_slot(ident: Column) -> Column:
    return F.coalesce(F.pmod(ident * 7, F.lit(10)), F.lit(-1)).cast("int")


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of (t0, t1, f0, f1) boxes; 0 where the union is empty."""
    both = F.greatest(F.least(a[1], b[1]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[2], b[2]), F.lit(0.0))
    area = lambda x: (x[1] - x[0]) * (x[3] - x[2])
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def clamp_box(t0: Column, t1: Column, f0: Column, f1: Column, duration: float, nyquist: float) -> tuple[Column, ...]:
    keep = lambda x, top, digits: F.round(F.greatest(F.lit(0.0), F.least(x, F.lit(top))), digits)
    return keep(t0, duration, 6), keep(t1, duration, 6), keep(f0, nyquist, 3), keep(f1, nyquist, 3)


def frame_range(t0: Column, t1: Column, rate: float, first: int, step: int, nfft: int, frames: int) -> tuple[Column, Column]:
    """[k0, k1) of the frames whose centre (first + k step + nfft / 2) / rate is within [t0, t1]."""
    at = lambda t: (t * rate - first - nfft / 2) / step
    k0 = F.greatest(F.lit(0), F.ceil(at(t0)).cast("long"))
    k1 = F.least(F.lit(frames), (F.floor(at(t1)) + 1).cast("long"))
    return k0, F.greatest(k0, k1)


def frame_time(k: Column, rate: float, first: int, step: int, nfft: int) -> Column:
    return (first + k * step + nfft / 2) / rate
