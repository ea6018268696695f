"""Recursive filters and their responses, adaptive pre-emphasis, interpolation and resampling of signals (signal_id, v)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import safe

BLOCK = 256


def dc_removal(pole: float = 0.995) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """y[n] = x[n] - x[n-1] + pole * y[n-1]."""
    return (1.0, -1.0), (1.0, -pole)


def pole_of_cutoff(rate: float, cutoff: float) -> float:
    return min(0.999, max(0.001, 1 - 2 * math.pi * cutoff / rate))


def cutoff_of_pole(rate: float, pole: float) -> float:
    return (1 - pole) * rate / (2 * math.pi)


def band_pass(rate: float, centre: float, q: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Second-order section with unit gain at the centre; a bandwidth is centre / q."""
    w = min(2 * math.pi * centre / rate, 0.99 * math.pi)
    alpha = math.sin(w) / (2 * q)
    return (alpha / (1 + alpha), 0.0, -alpha / (1 + alpha)), (1.0, -2 * math.cos(w) / (1 + alpha), (1 - alpha) / (1 + alpha))


def emphasis(a: float = 0.97) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """y[n] = x[n] - a * x[n-1]."""
    if not 0 <= a <= 1:
        raise ValueError("the coefficient must be 0 to 1")
    return (1.0, -a), (1.0,)


def response(section: tuple, rate: float, frequency: float) -> tuple[float, float]:
    """Magnitude and phase of a section."""
    z = complex(math.cos(2 * math.pi * frequency / rate), -math.sin(2 * math.pi * frequency / rate))
    h = sum(b * z**k for k, b in enumerate(section[0])) / sum(a * z**k for k, a in enumerate(section[1]))
    return abs(h), math.atan2(h.imag, h.real)


def responses(spark: SparkSession, sections: dict[str, tuple], rate: float, points: int) -> DataFrame:
    """(filter, frequency, magnitude, phase) of sections at ``points`` equal steps from 0 to half the rate."""
    w = F.col("frequency") * (2 * math.pi / rate)

    def sums(c):
        return sum((F.lit(float(v)) * F.cos(k * w) for k, v in enumerate(c)), F.lit(0.0)), -sum((F.lit(float(v)) * F.sin(k * w) for k, v in enumerate(c)), F.lit(0.0))

    rows = []
    for name, (b, a) in sections.items():
        (br, bi), (ar, ai) = sums(b), sums(a)
        d = ar * ar + ai * ai
        re, im = safe(br * ar + bi * ai, d), safe(bi * ar - br * ai, d)
        rows.append(F.struct(F.lit(name).alias("filter"), F.sqrt(re * re + im * im).alias("magnitude"), F.atan2(im, re).alias("phase")))
    at = spark.range(points).select((F.col("id") * (rate / 2 / max(1, points - 1))).alias("frequency"))
    return at.select("frequency", F.explode(F.array(*rows)).alias("x")).select("x.filter", "frequency", "x.magnitude", "x.phase")


def dc_group_delay(frequency: Column, rate: float, pole: float = 0.995) -> Column:
    """Approximate delay of the DC blocker: pole * sin w / (1 - pole * cos w)^2."""
    w = frequency * (2 * math.pi / rate)
    return safe(pole * F.sin(w), (1 - pole * F.cos(w)) * (1 - pole * F.cos(w)))


def emphasis_tilt(a: float, rate: float) -> tuple[float, float, float]:
    """Gain at the top, gain at zero, and dB per octave between them over log2(rate / 2) octaves."""
    top, low = 1 + a, 1 - a
    return top, low, (20 * math.log10(top) - 20 * math.log10(max(low, 1e-10))) / math.log2(rate / 2)


def best_emphasis(samples: DataFrame, value: str = "v", default: float = 0.97) -> DataFrame:
    """(signal_id, coefficient): correlation at lag one over power, within 0.8 to 0.99; the default for signals of one sample or none but zeros."""
    from .temporal import by_signal

    x = F.col(value)
    s = samples.withColumn("b", F.lag(value).over(by_signal("i")))
    g = s.groupBy("signal_id").agg(F.count("*").alias("n"), F.sum(x * x).alias("r0"), F.sum(x * F.col("b")).alias("r1"))
    return g.select("signal_id", F.when((F.col("n") < 2) | (F.col("r0") == 0), default).otherwise(F.greatest(F.lit(0.8), F.least(F.lit(0.99), safe(F.col("r1"), F.col("r0"))))).alias("coefficient"))


def by_channel(samples: DataFrame, channels: int) -> DataFrame:
    """The samples of interleaved signals as one signal a channel: (signal_id, channel, i, v)."""
    return samples.select("signal_id", (F.col("i") % channels).alias("channel"), F.floor(F.col("i") / channels).alias("i"), "v")


def _applied(signals: DataFrame, one) -> DataFrame:
    """(signal_id, y): a function of whole arrays, in Arrow batches."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"signal_id": b["signal_id"], "y": [np.asarray(one(np.asarray(v, float)), float) for v in b["v"]]})

    schema = T.StructType([signals.schema["signal_id"], T.StructField("y", T.ArrayType(T.DoubleType()))])
    return signals.select("signal_id", "v").mapInPandas(run, schema)


def _section_matrices(section: tuple, size: int):
    """What a section adds over ``size`` samples: (from samples, from its state), and its state afterwards (from samples, from state)."""
    b, a = section
    order = max(len(a), len(b)) - 1
    b, a = list(b) + [0.0] * (order + 1 - len(b)), list(a) + [0.0] * (order + 1 - len(a))

    def play(x, z):
        y = []
        for v in x:
            out = b[0] * v + (z[0] if order else 0.0)
            z = [b[k] * v - a[k] * out + (z[k] if k < order else 0.0) for k in range(1, order + 1)]
            y.append(out)
        return np.array(y), np.array(z)

    h, end = play([1.0] + [0.0] * (size - 1), [0.0] * order)
    from_x = np.array([[h[n - k] if n >= k else 0.0 for k in range(size)] for n in range(size)])
    ends = [play([0.0] * k + [1.0] + [0.0] * (size - 1 - k), [0.0] * order)[1] for k in range(size)]
    free = [play([0.0] * size, [float(i == k) for i in range(order)]) for k in range(order)]
    return from_x, np.array([f[0] for f in free]).reshape(order, size).T, np.array(ends).reshape(size, order).T, np.array([f[1] for f in free]).reshape(order, order).T


def recursive(signals: DataFrame, section: tuple) -> DataFrame:
    """(signal_id, y): the signals through a section (numerator, denominator with leading 1), from rest.

    A section is linear, so a block of samples and the state before it give the block's output and the state after it by four fixed
    matrices; only blocks are stepped through.
    """
    from_x, from_z, end_x, end_z = _section_matrices(section, BLOCK)

    def one(x):
        n = len(x)
        blocks = np.zeros(-(-n // BLOCK) * BLOCK)
        blocks[:n] = x
        blocks = blocks.reshape(-1, BLOCK)
        y, add, z = blocks @ from_x.T, blocks @ end_x.T, np.zeros(from_z.shape[1])
        states = np.zeros((len(blocks), len(z)))
        for k in range(len(blocks)):
            states[k] = z
            z = end_z @ z + add[k]
        return (y + states @ from_z.T).ravel()[:n]

    return _applied(signals, one)


def adaptive_pre_emphasis(signals: DataFrame, base: float = 0.97, speed: float = 0.01) -> DataFrame:
    """(signal_id, y): pre-emphasis whose coefficient falls with the smoothed share of energy that the filter lets through,
    between 0.9 and 0.99. The coefficient depends on the output before, so samples are stepped through."""

    def one(x):
        y, before, high, full = [], 0.0, 0.0, 0.0
        for v in x.tolist():
            a = min(0.99, max(0.9, base - 0.05 * (high / full if full > 1e-12 else 0.0)))
            y.append(v - a * before)
            high, full = (1 - speed) * high + speed * y[-1] * y[-1], (1 - speed) * full + speed * v * v
            before = v
        return y

    return _applied(signals, one)


def interpolate(x: np.ndarray, at: np.ndarray, kind: str = "linear") -> np.ndarray:
    """Values between samples: linear, cubic (through four points), hermite (the same tangents, as a Hermite form) or lanczos (three lobes).

    Kernels that need more neighbours than there are fall back to the next simpler; near an end cubic kernels give the sample at the truncated
    place (start) or the last one (end), and the lanczos kernel the first or last sample.
    """
    if kind not in ("linear", "cubic", "hermite", "lanczos"):
        raise ValueError("unknown interpolation")
    n, at = len(x), np.asarray(at, float)
    if not n:
        return np.zeros(len(at))
    if kind == "lanczos" and n >= 6:
        i = np.trunc(at).astype(int)
        out = np.where(i < 3, x[0], x[-1])
        inner = np.flatnonzero((i >= 3) & (i < n - 3))
        j = i[inner, None] + np.arange(-2, 4)
        d = at[inner, None] - j
        out[inner] = (x[j] * np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0)).sum(1)
        return out
    if kind != "linear" and n >= 4:
        out = np.where(at <= 1, x[np.clip(np.trunc(at), 0, 1).astype(int)], x[-1])
        inner = np.flatnonzero((at > 1) & (at < n - 2))
        i = np.trunc(at[inner]).astype(int)
        t, (a, b, c, d) = at[inner] - i, (x[i + k] for k in (-1, 0, 1, 2))
        m0, m1 = (c - a) / 2, (d - b) / 2
        out[inner] = b + t * (m0 + t * (3 * (c - b) - 2 * m0 - m1 + t * (2 * (b - c) + m0 + m1)))
        return out
    return np.interp(at, np.arange(n), x)


def interpolated(signals: DataFrame, points: int, kind: str = "cubic") -> DataFrame:
    """(signal_id, y): ``points`` values at equal steps from the first sample to the last, by a kernel; empty signals stay empty."""
    return _applied(signals, lambda x: interpolate(x, np.arange(points) * ((len(x) - 1) / max(1, points - 1)), kind) if len(x) else x)


def resampled_rate(signals: DataFrame, old: float, new: float, kind: str = "linear") -> DataFrame:
    """(signal_id, y): the signals at another rate; values between samples by a kernel."""
    return _applied(signals, lambda x: interpolate(x, np.arange(int(len(x) * new / old)) * (old / new), kind))


def upsampled(signals: DataFrame, factor: int) -> DataFrame:
    """(signal_id, y): ``factor`` values a sample, linear between samples and zero after the last."""

    def one(x):
        y = np.interp(np.arange(len(x) * factor) / factor, np.arange(len(x)), x) if len(x) else x
        if len(x) and factor > 1:
            y[(len(x) - 1) * factor + 1 :] = 0.0
        return y

    return _applied(signals, one)


def downsampled(samples: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th sample (signal_id, i, v); an incomplete last group is left out."""
    from .temporal import by_signal

    s = samples.withColumn("n", F.count("*").over(by_signal()))
    return s.where((F.col("i") % factor == 0) & (F.col("i") / factor < F.floor(F.col("n") / factor))).select("signal_id", F.floor(F.col("i") / factor).alias("i"), "v")


def bilinear(rows: Column, x: Column, y: Column) -> Column:
    """Value of a table (array of rows) at column x and row y, between its four neighbours; places outside count as the edge."""
    h, w = F.size(rows), F.size(F.get(rows, F.lit(0)))
    place = lambda v, n: F.greatest(F.lit(0.0), F.least(v.cast("double"), (n - 1).cast("double")))
    px, py = place(x, w), place(y, h)
    x0, y0 = F.floor(px).cast("int"), F.floor(py).cast("int")
    x1, y1 = F.least(x0 + 1, w - 1), F.least(y0 + 1, h - 1)
    at = lambda r, c: F.get(F.get(rows, r), c)
    top = at(y0, x0) + (px - x0) * (at(y0, x1) - at(y0, x0))
    low = at(y1, x0) + (px - x0) * (at(y1, x1) - at(y1, x0))
    return top + (py - y0) * (low - top)


def resampled(signals: DataFrame, points: int) -> DataFrame:
    """(signal_id, k, y): linear interpolation at ``points`` equal steps from the first value to the last; none if empty."""
    s = signals.where(F.size("v") > 0).select("signal_id", "v", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    at = F.col("k") * (F.size("v") - 1) / float(max(points - 1, 1))
    s = s.withColumn("at", F.round(at, 9)).withColumn("lo", F.floor("at").cast("int"))
    a, b = F.get("v", "lo"), F.get("v", F.least(F.col("lo") + 1, F.size("v") - 1))
    return s.select("signal_id", F.col("k").cast("long").alias("k"), (a + (b - a) * (F.col("at") - F.col("lo"))).alias("y"))
