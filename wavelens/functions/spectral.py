"""Descriptors of one magnitude spectrum (an array), as column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import col, indexed, let, mean, safe, squares, total

LEAST = 1e-10


def bin_hz(i: Column, m: str | Column, rate: float) -> Column:
    """Frequency of bin i of a one-sided spectrum."""
    return i * rate / (2.0 * (F.size(col(m)) - 1))


def _step(m: str | Column, rate: float) -> Column:
    """Distance of two bins in Hz."""
    return rate / (2.0 * (F.size(col(m)) - 1))


def centroid(m: str | Column, rate: float) -> Column:
    return safe(indexed(m, lambda v, i: i * v), total(m)) * _step(m, rate)


def bandwidth(m: str | Column, rate: float) -> Column:
    return let(m, lambda b: let(safe(indexed(b, lambda v, i: i * v), total(b)), lambda c: F.sqrt(safe(indexed(b, lambda v, i: (i - c) * (i - c) * v), total(b))) * _step(b, rate)))


def rolloff(m: str | Column, rate: float, share: float = 0.85) -> Column:
    """Lowest frequency below which the share of the energy lies."""

    def place(b, limit):
        start = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("n"))
        n = F.aggregate(b, start, lambda s, v: F.struct((s["e"] + v * v).alias("e"), (s["n"] + F.when(s["e"] + v * v < limit, 1.0).otherwise(0.0)).alias("n")))["n"]
        return F.when(limit > 0, n * _step(b, rate)).otherwise(0.0)

    return let(m, lambda b: let(squares(b) * share, lambda limit: place(b, limit)))


def flatness(m: str | Column) -> Column:
    """Geometric over arithmetic mean, at most 1."""
    geo = lambda b: let(F.filter(b, lambda v: v > LEAST), lambda sound: F.exp(safe(total(F.transform(sound, lambda v: F.log(v))), F.size(sound))))
    return let(m, lambda b: let(mean(b), lambda a: F.when(a <= LEAST, 0.0).otherwise(F.least(safe(geo(b), a), F.lit(1.0)))))


def flatness_db(m: str | Column) -> Column:
    return let(flatness(m), lambda f: F.when(f <= LEAST, -100.0).otherwise(10 * F.log10(f)))


def tonal_flag(flatness_value: Column, threshold: float = 0.2) -> Column:
    """Whether a flatness is that of a tonal spectrum."""
    return flatness_value < threshold


def flatness_kind(avg: Column, variance: Column) -> Column:
    """Kind of content by the mean and variance of the flatness over a signal's frames."""
    return F.when(avg.isNull(), "unknown").when((avg < 0.2) & (variance < 0.01), "music").when((avg < 0.35) & (variance > 0.01), "speech").when(avg > 0.6, "noise").otherwise("mixed")


def band(m: str | Column, first: int | Column, last: int | Column) -> Column:
    """Bins first to last of a spectrum, both included; none if the range is empty or outside."""
    m, a, b = col(m), F.lit(first) if isinstance(first, int) else first, F.lit(last) if isinstance(last, int) else last
    sound = (a >= 0) & (b < F.size(m)) & (a <= b)
    return F.when(sound, F.slice(m, F.greatest(a, F.lit(0)) + 1, F.greatest(b - a + 1, F.lit(0)))).otherwise(F.array().cast("array<double>"))


def speech_bands(m: str | Column, rate: float) -> Column:
    """Flatness below 1 kHz, from 1 to 4 kHz and from 4 to 8 kHz, as a struct."""
    at = lambda b, hz: F.least(F.floor(F.lit(float(hz)) / _step(b, rate)).cast("int"), F.size(b) - 1)
    return let(m, lambda b: F.struct(*(flatness(band(b, at(b, lo), at(b, hi))).alias(n) for n, lo, hi in (("low", 0, 1000), ("mid", 1000, 4000), ("high", 4000, 8000)))))


def crest(m: str | Column) -> Column:
    return safe(F.array_max(col(m)), F.sqrt(safe(squares(m), F.size(col(m)))))


def slope(m: str | Column, rate: float) -> Column:
    """Least-squares slope of log10 magnitude on log10 frequency over bins above zero."""
    pts = lambda b: F.filter(F.transform(b, lambda v, i: F.struct(i.cast("double").alias("i"), v.alias("v"))), lambda p: (p["v"] > LEAST) & (p["i"] > 0))
    logs = lambda b: let(_step(b, rate), lambda hz: F.transform(pts(b), lambda p: F.struct(F.log10(p["i"] * hz).alias("x"), F.log10(p["v"]).alias("y"))))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "x", "y", "xx", "xy")))
    add = lambda s, p: F.struct((s["n"] + 1).alias("n"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["xy"] + p["x"] * p["y"]).alias("xy"))
    return let(m, lambda b: let(F.aggregate(logs(b), zero, add), lambda s: F.when(s["n"] < 2, 0.0).otherwise(safe(s["n"] * s["xy"] - s["x"] * s["y"], s["n"] * s["xx"] - s["x"] * s["x"]))))


def flux(prev: Column, m: Column, rectified: bool = True) -> Column:
    """L2 norm of the (rising) changes from the previous spectrum."""
    d = F.zip_with(m, prev, lambda a, b: F.greatest(a - b, F.lit(0.0)) if rectified else a - b)
    return F.sqrt(squares(d))


def power_db(m: str | Column, floor_db: float = -100.0) -> Column:
    return F.transform(col(m), lambda v: 10 * F.log10(F.greatest(v * v, F.lit(10 ** (floor_db / 10)))))


def hz_to_mel(f: Column) -> Column:
    return 2595 * F.log10(1 + f / 700)


def mel_to_hz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def hz_to_bark(f: Column) -> Column:
    return 26.81 * f / (1960 + f) - 0.53


def mel_bank(filters: int, bins: int, rate: float, low: float = 0.0, high: float | None = None) -> list[list[float]]:
    """Triangular filters at equal mel distances; weights by filter and bin."""
    high = rate / 2 if high is None else high
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    points = [700 * (10 ** ((mel(low) + (mel(high) - mel(low)) * k / (filters + 1)) / 2595) - 1) for k in range(filters + 2)]
    size = 2 * (bins - 1)
    at = [min(bins - 1, math.floor((size + 1) * f / rate + 0.5)) for f in points]
    bank = []
    for a, b, c in zip(at, at[1:], at[2:]):
        bank.append([(i - a) / (b - a) if a <= i < b else (c - i) / (c - b) if b <= i < c else 0.0 for i in range(bins)])
    return bank


#: Edges and centres of the critical bands in Hz.
BARK_EDGES = (0, 100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720, 2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500)
BARK_CENTRES = (50, 150, 250, 350, 450, 570, 700, 840, 1000, 1170, 1370, 1600, 1850, 2150, 2500, 2900, 3400, 4000, 4800, 5800, 7000, 8500, 10500, 13500)


def bark_bank(filters: int, bins: int, rate: float, low: float = 0.0, high: float | None = None) -> list[list[float]]:
    """Triangular filters at equal Bark distances; weights by filter and bin."""
    high = rate / 2 if high is None else high
    bark = lambda f: 26.81 * f / (1960 + f) - 0.53
    points = [1960 * (z + 0.53) / (26.28 - z) for k in range(filters + 2) for z in [bark(low) + (bark(high) - bark(low)) * k / (filters + 1)]]
    size = 2 * (bins - 1)
    at = [min(bins - 1, math.floor((size + 1) * f / rate + 0.5)) for f in points]
    return [[(i - a) / (b - a) if a <= i < b else (c - i) / (c - b) if b <= i < c else 0.0 for i in range(bins)] for a, b, c in zip(at, at[1:], at[2:])]


def bark_to_hz(z: Column) -> Column:
    return 1960 * (z + 0.53) / (26.28 - z)


def hz_to_bark_zwicker(f: Column) -> Column:
    return 13 * F.atan(0.00076 * f) + 3.5 * F.atan((f / 7500) * (f / 7500))


def banked(power: Column, bank: list[list[float]]) -> Column:
    """Energies of a power spectrum in a bank's filters; only a filter's own bins are read."""
    out = []
    for row in bank:
        own = [i for i, w in enumerate(row) if w]
        if not own:
            out.append(F.lit(0.0))
            continue
        lo, hi = own[0], own[-1] + 1
        weights = F.array(*(F.lit(float(w)) for w in row[lo:hi]))
        out.append(total(F.zip_with(F.slice(power, lo + 1, hi - lo), weights, lambda v, w: v * w)))
    return F.array(*out)


def mfcc(m: str | Column, rate: float, bins: int, filters: int = 26, coefficients: int = 13, lifter: int = 22) -> Column:
    """Cepstral coefficients: power, mel bank, log, orthonormal cosine transform, lifter."""
    bank = mel_bank(filters, bins, rate)
    table = []
    for k in range(coefficients):
        scale = math.sqrt((1 if k == 0 else 2) / filters) * (1 + lifter / 2 * math.sin(math.pi * k / lifter) if k else 1)
        table.append(F.array(*(F.lit(scale * math.cos(math.pi * k * (n + 0.5) / filters)) for n in range(filters))))
    power = F.transform(col(m), lambda v: v * v)
    logs = let(power, lambda p: F.transform(banked(p, bank), lambda e: F.log(F.greatest(e, F.lit(1e-10)))))
    return let(logs, lambda x: F.transform(F.array(*table), lambda row: dot_of(x, row)))


def dot_of(x: Column, row: Column) -> Column:
    return total(F.zip_with(x, row, lambda v, w: v * w))
