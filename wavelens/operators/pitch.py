"""Fundamental frequency and vocal-tract models: of whole short signals (signal_id, v) and of frames (signal_id, frame, f)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import adjacent, dot, let, mean, safe, squares, variance
from .temporal import centred


def autocorrelation_pitch(signals: DataFrame, rate: float, least: int = 2, most: int = 16) -> DataFrame:
    """(signal_id, lag, r, f0): the lag of the largest mean product x[i] * x[i + lag], normalised by lag zero; ties to the
    smaller lag. Signals of ``least`` values or fewer have no row."""
    s = signals.where(F.size("v") > least).select("signal_id", let(centred(), lambda x: _best_lag(x, least, most)).alias("b"))
    return s.select("signal_id", (-F.col("b.k")).cast("long").alias("lag"), F.col("b.r").alias("r"), (rate / -F.col("b.k")).alias("f0"))


def _best_lag(x: Column, least: int, most: int) -> Column:
    n = F.size(x)
    lags = F.sequence(F.lit(least), F.least(F.lit(most), n - 1))
    product = lambda k: safe(dot(F.slice(x, F.lit(1), n - k), F.slice(x, k + 1, n - k)), n - k)
    return let(safe(squares(x), n), lambda power: F.array_max(F.transform(lags, lambda k: F.struct(F.round(safe(product(k), power), 9).alias("r"), (-k).alias("k")))))


def difference(x: np.ndarray, most: int) -> np.ndarray:
    """Cumulative mean normalised squared difference at lags 0 to most, over the first len(x) - most samples."""
    n = len(x) - most
    size = 1 << (2 * len(x)).bit_length()
    cross = np.fft.irfft(np.conj(np.fft.rfft(x[:n], size)) * np.fft.rfft(x, size), size)[: most + 1]
    power = np.concatenate([[0.0], np.cumsum(x * x)])
    d = np.maximum(power[n] + power[np.arange(most + 1) + n] - power[np.arange(most + 1)] - 2 * cross, 0.0)
    c = np.ones(most + 1)
    run = np.cumsum(d[1:])
    c[1:] = np.where(run > 1e-12 * max(power[-1], 1e-300), d[1:] * np.arange(1, most + 1) / np.maximum(run, 1e-300), 1.0)
    return c


def _vertex(a: float, b: float, c: float) -> float:
    bend = a - 2 * b + c
    return (a - c) / (2 * bend) if bend else 0.0


def yin(x: np.ndarray, rate: float, low: float, high: float, threshold: float = 0.1) -> float:
    """Fundamental by the cumulative mean normalised difference; 0 if no lag falls below the threshold."""
    return yin_confidence(x, rate, low, high, threshold)[0]


def yin_confidence(x: np.ndarray, rate: float, low: float, high: float, threshold: float = 0.1) -> tuple[float, float]:
    """The fundamental and 1 - the difference at its lag."""
    most, first = min(len(x) - 1, int(rate / low)), max(1, int(rate / high))
    if most <= first or not np.any(x):
        return 0.0, 0.0
    c = difference(x, most)
    below = np.flatnonzero(c[first:] < threshold)
    if not len(below):
        return 0.0, 0.0
    k = first + int(below[0])
    while k < most and c[k + 1] < c[k]:
        k += 1
    return float(rate / (k + (_vertex(*c[k - 1 : k + 2]) if 0 < k < most else 0.0))), float(1 - c[k])


def cepstral_pitch(x: np.ndarray, rate: float, low: float, high: float) -> float:
    """Fundamental at the largest value of the cepstrum between two frequencies; 0 for silence or short input."""
    first, most = max(1, int(rate / high)), min(len(x) // 2, int(rate / low))
    if most <= first or not np.any(x):
        return 0.0
    c = np.fft.irfft(np.log(np.maximum(np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2, 1e-10)))
    return float(rate / (first + int(np.argmax(c[first : most + 1]))))


def _best_peak(c: np.ndarray, rate: float, low: float, high: float, least: float) -> tuple[float, float, float]:
    """Frequency, height and clarity of the highest local maximum between two frequencies."""
    k = np.arange(1, len(c) - 1)
    ok = (c[1:-1] > c[:-2]) & (c[1:-1] > c[2:]) & (c[1:-1] > least) & (rate / k >= low) & (rate / k <= high)
    at = k[ok]
    if not len(at):
        return 0.0, 0.0, 0.0
    at = at[np.argsort(-c[at], kind="stable")]
    best = float(c[at[0]])
    return float(rate / at[0]), best, best if len(at) == 1 else float((best - c[at[1]]) / best)


def acf_pitch(x: np.ndarray, rate: float, low: float, high: float, least: float = 0.3) -> tuple[float, float, float]:
    """(f0, confidence, clarity) by the normalised autocorrelation."""
    size = 1 << (2 * len(x)).bit_length()
    c = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[: len(x)]
    return _best_peak(c / c[0], rate, low, high, least) if len(x) > 2 and c[0] > 0 else (0.0, 0.0, 0.0)


def nsdf_pitch(x: np.ndarray, rate: float, low: float, high: float, least: float = 0.3) -> tuple[float, float, float]:
    """(f0, confidence, clarity) by the normalised square difference over half the frame."""
    h = len(x) // 2
    if h < 3:
        return 0.0, 0.0, 0.0
    size = 1 << (2 * len(x)).bit_length()
    cross = np.fft.irfft(np.conj(np.fft.rfft(x[:h], size)) * np.fft.rfft(x, size), size)[:h]
    power = np.concatenate([[0.0], np.cumsum(x * x)])
    both = power[h] + power[np.arange(h) + h] - power[np.arange(h)]
    return _best_peak(np.where(both > 0, 2 * cross / np.maximum(both, 1e-300), 0.0), rate, low, high, least)


def hps_pitch(x: np.ndarray, rate: float, low: float, high: float, factors: int = 5) -> tuple[float, float]:
    """(f0, confidence) by the harmonic product of the spectrum at twice the resolution."""
    size = 2 * len(x)
    m = np.abs(np.fft.rfft(x * np.hanning(len(x)), size))
    p = m.copy()
    for h in range(2, factors + 1):
        p[: (len(m) - 1) // h + 1] *= m[::h][: (len(m) - 1) // h + 1]
        p[(len(m) - 1) // h + 1 :] = 0
    at = np.arange(max(1, int(np.ceil(low * size / rate))), min(len(p) - 1, int(high * size / rate)) + 1)
    if not len(at) or not p[at].any():
        return 0.0, 0.0
    k = int(at[p[at].argmax()])
    return float(k * rate / size), float(min(p[k] / 1000, 1.0))


def crossing_pitch(x: np.ndarray, rate: float) -> tuple[float, float]:
    """(f0, confidence): half the crossings a second, with a fixed confidence."""
    return float(((x[1:] >= 0) != (x[:-1] >= 0)).sum() * rate / (2 * len(x))) if len(x) > 1 else 0.0, 0.3


METHODS = ("yin", "acf", "nsdf", "hps", "cepstrum", "crossings")


def frame_pitch(frames: DataFrame, rate: float, low: float = 80.0, high: float = 1000.0, method: str = "yin", emphasis: float = 0.97, threshold: float = 0.15, least: float = 0.5) -> DataFrame:
    """(signal_id, frame, pitch, confidence, clarity, salience) of every frame by one method; a confidence below ``least`` makes a frame unvoiced (all 0).

    Frames are emphasised and Hann-windowed first. Salience is the confidence, a fifth more from 200 to 800 Hz and a fifth less below 100 and above 1,000 Hz, at most 1.
    """
    if method not in METHODS:
        raise ValueError("unknown method")

    def one(x):
        y = np.append(x[:1], x[1:] - emphasis * x[:-1]) * np.hanning(len(x)) if len(x) else x
        if method == "yin":
            p, c = yin_confidence(y, rate, low, high, threshold)
            return p, c, c
        if method in ("acf", "nsdf"):
            return (acf_pitch if method == "acf" else nsdf_pitch)(y, rate, low, high)
        if method == "cepstrum":
            p = cepstral_pitch(y, rate, low, high)
            return p, float(p > 0), float(p > 0)
        p, c = hps_pitch(y, rate, low, high) if method == "hps" else crossing_pitch(y, rate)
        return p, c, c

    def run(batches):
        for b in batches:
            rows = []
            for sid, frame, f in zip(b["signal_id"], b["frame"], b["f"]):
                p, c, clear = one(np.asarray(f, float))
                p, c = (p, c) if c >= least else (0.0, 0.0)
                rows.append((sid, frame, p, c, clear if c else 0.0, min(1.0, c * (1.2 if 200 <= p <= 800 else 0.8 if p < 100 or p > 1000 else 1.0))))
            yield pd.DataFrame(rows, columns=["signal_id", "frame", "pitch", "confidence", "clarity", "salience"])

    return frames.select("signal_id", "frame", "f").mapInPandas(run, "signal_id long, frame long, pitch double, confidence double, clarity double, salience double")


def smoothed_pitch(pitches: DataFrame, history: int = 20) -> DataFrame:
    """Adds octave (the pitch moved to a half, double, third or triple of the median of the last five voiced frames if it is near that and further from the median), smooth (the median
    of the last three frames if all are voiced, else the pitch) and stability (1 - coefficient of variation over the last ``history`` voiced frames, at least 0)."""
    w = Window.partitionBy("signal_id").orderBy("frame")
    voiced = F.when(F.col("pitch") > 0, F.col("pitch"))
    past = F.filter(F.collect_list(F.struct("frame", "pitch")).over(w.rowsBetween(-5, -1)), lambda s: s["pitch"] > 0)
    s = pitches.withColumns({"_near": F.array_sort(F.transform(past, lambda s: s["pitch"])), "_three": F.collect_list(voiced).over(w.rowsBetween(-2, 0)), "_m": F.avg(voiced).over(w.rowsBetween(1 - history, 0)), "_s": F.stddev_samp(voiced).over(w.rowsBetween(1 - history, 0)), "_n": F.count("*").over(w.rowsBetween(1 - history, 0))})
    n = F.size("_near")
    med = (F.get("_near", F.floor((n - 1) / 2).cast("int")) + F.get("_near", F.floor(n / 2).cast("int"))) / 2
    p = F.col("pitch")
    moved = F.when((n < 3) | (p == 0), p)
    for ratio in (0.5, 2.0, 1 / 3, 3.0):
        near = F.abs(p - med * ratio) / (med * ratio) < 0.1
        moved = moved.when(near & (F.abs(p - med) > F.abs(med * ratio - med)), med * ratio).when(near, p)
    smooth = F.when(F.size("_three") == 3, F.get(F.array_sort("_three"), F.lit(1))).otherwise(p)
    stable = F.when((F.col("_n") >= 3) & F.col("_s").isNotNull(), F.greatest(F.lit(0.0), 1 - safe(F.col("_s"), F.col("_m")))).otherwise(0.0)
    return s.select(*pitches.columns, moved.otherwise(p).alias("octave"), smooth.alias("smooth"), stable.alias("stability"))


def pitch_stability(pitches: DataFrame, frame_rate: float) -> DataFrame:
    """(signal_id, mean, deviation, variation, jitter, stability, vibrato, voiced) over the voiced frames of signals with at least two.

    Jitter is the mean change from one voiced frame to the next; vibrato is half the crossings a second of the pitches less their straight line, 0 below ten frames.
    """
    all_frames = pitches.groupBy("signal_id").agg(F.count("*").alias("all"))
    w = Window.partitionBy("signal_id").orderBy("frame")
    v = pitches.where("pitch > 0").select("signal_id", "frame", "pitch", (F.row_number().over(w) - 1).cast("double").alias("k"))
    line = v.groupBy("signal_id").agg(F.regr_slope("pitch", "k").alias("a"), F.regr_intercept("pitch", "k").alias("b"))
    d = v.join(line, "signal_id").withColumn("up", F.col("pitch") - F.col("a") * F.col("k") - F.col("b") > 1e-9)
    d = d.withColumns({"turn": F.when(F.col("up") != F.lag("up").over(w), 1.0).otherwise(0.0), "step": F.abs(F.col("pitch") - F.lag("pitch").over(w))})
    g = d.groupBy("signal_id").agg(F.count("*").alias("n"), F.avg("pitch").alias("mean"), F.stddev_samp("pitch").alias("deviation"), F.avg("step").alias("jitter"), F.sum("turn").alias("turns")).where("n >= 2")
    cv = safe(F.col("deviation"), F.col("mean"))
    return g.join(all_frames, "signal_id").select("signal_id", "mean", "deviation", cv.alias("variation"), "jitter", (1 / (1 + cv)).alias("stability"), F.when(F.col("n") >= 10, F.col("turns") * frame_rate / (2 * F.col("n"))).otherwise(0.0).alias("vibrato"), (F.col("n") / F.col("all")).alias("voiced"))


def lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Prediction coefficients (x[n] is near the sum of a[k] * x[n - k]) and residual power by Levinson's recursion."""
    a, e, _ = levinson(x, order)
    return a, e


def levinson(x: np.ndarray, order: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Prediction coefficients, residual power and reflection coefficients."""
    r = np.array([float(x[: len(x) - k] @ x[k:]) if k < len(x) else 0.0 for k in range(order + 1)])
    a, e, ks = np.zeros(order), r[0], np.zeros(order)
    for i in range(order):
        if e <= 1e-12:
            break
        k = (r[i + 1] - a[:i] @ r[i:0:-1]) / e
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        ks[i] = k
        e *= 1 - k * k
    return a, float(e), ks


def prediction_error(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """What the predictor leaves of each sample."""
    y = x.astype(float).copy()
    for k, c in enumerate(a, 1):
        y[k:] -= c * x[: len(x) - k]
    return y


def reflection(a: np.ndarray) -> np.ndarray:
    """Reflection coefficients of a predictor, by stepping its order down."""
    a, out = np.array(a, float), np.zeros(len(a))
    for i in range(len(a) - 1, -1, -1):
        out[i] = k = a[i]
        if abs(k) >= 1:
            break
        a = (a[:i] + k * a[:i][::-1]) / (1 - k * k)
    return out


def envelope(a: np.ndarray, points: int = 512) -> np.ndarray:
    """Magnitudes 1 / |1 - sum a[k] z^-k| at ``points`` + 1 frequencies up to half the rate."""
    w = np.exp(-1j * np.pi * np.arange(points + 1)[:, None] * np.arange(1, len(a) + 1) / points)
    return 1 / np.maximum(np.abs(1 - w @ a), 1e-12)


def formants(a: np.ndarray, rate: float, most: int = 4, points: int = 512) -> list[float]:
    """Frequencies of the envelope's local maxima above a tenth of its largest value, lowest first."""
    return [f for f, _, _ in formant_table(a, rate, most, points, 0.0, 0.0)]


def formant_table(a: np.ndarray, rate: float, most: int = 4, points: int = 512, least: float = 0.2, spacing: float = 200.0) -> list[tuple[float, float, float]]:
    """(frequency, bandwidth, confidence) of the envelope's peaks above a tenth of its largest value: bandwidth at half the height, within 50 to
    500 Hz; confidence is the height's share, at least ``least``; peaks nearer than ``spacing`` to the one before are left out."""
    h = envelope(a, points)
    hz = rate / (2 * points)
    out: list[tuple[float, float, float]] = []
    for k in (np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] > h[2:]) & (h[1:-1] > 0.1 * h.max())) + 1).tolist():
        lo = hi = k
        while lo > 0 and h[lo] > h[k] / 2:
            lo -= 1
        while hi < points and h[hi] > h[k] / 2:
            hi += 1
        conf = float(h[k] / h.max())
        if conf >= least and (not out or k * hz - out[-1][0] >= spacing):
            out.append((k * hz, float(min(500, max(50, (hi - lo) * hz))), conf))
    return out[:most]


def tract_length(found: list[tuple[float, float, float]]) -> float:
    """Length of the vocal tract in cm that the formants would have in a uniform tube: the mean of the estimates within 10 to 25 cm from formants of confidence above 0.3, else 17.5."""
    all_ = [(2 * n - 1) * 35000 / (4 * f) for n, (f, _, c) in enumerate(found, 1) if f > 0 and c > 0.3]
    ok = [x for x in all_ if 10 <= x <= 25]
    return sum(ok) / len(ok) if ok else 17.5


def _rows(signals: DataFrame, schema: str, f) -> DataFrame:
    """One output row a signal from Arrow batches; ``f`` gets the centred values."""

    def run(batches):
        for b in batches:
            got = [f(np.asarray(v, float) - (np.mean(v) if len(v) else 0.0)) for v in b["v"]]
            yield pd.DataFrame({"signal_id": b["signal_id"]} | {k: [g[k] for g in got] for k in (got[0] if got else {})})

    return signals.select("signal_id", "v").mapInPandas(run, f"signal_id long, {schema}")


def fundamentals(signals: DataFrame, rate: float, low: float, high: float) -> DataFrame:
    """(signal_id, yin, cepstrum, autocorrelation, confidence): three estimates of the fundamental of each signal, 0 where there is none, and the
    largest of their fixed confidences (0.9, 0.7 and 0.8) among those there are."""

    def one(x):
        y, c, a = yin(x, rate, low, high), cepstral_pitch(x, rate, low, high), acf_pitch(x, rate, low, high, 0.0)[0]
        return {"yin": y, "cepstrum": c, "autocorrelation": a, "confidence": max(0.9 * (y > 0), 0.7 * (c > 0), 0.8 * (a > 0))}

    return _rows(signals, "yin double, cepstrum double, autocorrelation double, confidence double", one)


def vocal_tract(signals: DataFrame, rate: float, order: int = 4, emphasis: float = 0.97) -> DataFrame:
    """(signal_id, coefficients, reflections, residual, stable, formants, bandwidths, length, quality) of the emphasised and Hamming-windowed signal.

    Quality is the mean of the share of three formants found, their mean confidence, 1 - residual share (at least 0) and stability; without formants 0.
    """

    def one(x):
        y = np.append(x[:1], x[1:] - emphasis * x[:-1]) * np.hamming(len(x)) if len(x) else x
        a, e, k = levinson(y, order)
        found, power = formant_table(a, rate, least=0.2, spacing=200.0 * rate / 8000) if e > 1e-12 else [], float(y @ y)
        stable = bool((np.abs(k) < 1).all())
        quality = (min(len(found) / 3, 1.0) + float(np.mean([c for _, _, c in found])) + max(0.0, 1 - e / power) + stable) / 4 if found and power > 0 else 0.0
        return {"coefficients": a.tolist(), "reflections": k.tolist(), "residual": e, "stable": stable, "formants": [f for f, _, _ in found], "bandwidths": [b for _, b, _ in found], "length": tract_length(found), "quality": quality}

    return _rows(signals, "coefficients array<double>, reflections array<double>, residual double, stable boolean, formants array<double>, bandwidths array<double>, length double, quality double", one)


def perturbation(periods: str | Column) -> Column:
    """Mean absolute change over the mean, in percent: jitter of period lengths, shimmer of period levels."""
    return 100 * safe(mean(adjacent(periods, lambda a, b: F.abs(b - a))), mean(periods))


def steadiness(values: str | Column) -> Column:
    """1 - coefficient of variation, at least 0."""
    return F.greatest(F.lit(0.0), 1 - safe(F.sqrt(variance(values)), mean(values)))


def voice_quality(samples: DataFrame) -> DataFrame:
    """(signal_id, perturbation, steadiness, noise) of value series (signal_id, i, v); noise is the energy share of the first difference."""
    from .temporal import by_signal

    v = F.col("v")
    s = samples.withColumn("d", v - F.lag(v).over(by_signal("i")))
    d = F.col("d")
    return s.groupBy("signal_id").agg((100 * safe(F.avg(F.abs(d)), F.avg(v))).alias("perturbation"), F.greatest(F.lit(0.0), 1 - safe(F.stddev_pop(v), F.avg(v))).alias("steadiness"), safe(F.sum(d * d), F.sum(v * v)).alias("noise"))


def periods(x: np.ndarray, rate: float, low: float, high: float, width: int, hop: int) -> tuple[list[int], list[float], list[float]]:
    """Lengths, RMS levels and fundamentals of the pitch periods at the voiced frames; periods do not overlap."""
    lengths, levels, f0s, end = [], [], [], 0
    for at in range(0, len(x) - width, hop):
        f, c = yin_confidence(x[at : at + width], rate, low, high, 0.15)
        if c > 0.5 and low <= f <= high:
            n, start = int(rate / f), max(at, end)
            if start + n < len(x):
                lengths.append(n), f0s.append(f), levels.append(float(np.sqrt(np.mean(x[start : start + n] ** 2))))
                end = start + n
    return lengths, levels, f0s


def _percent(v: list) -> float:
    return float(100 * np.mean(np.abs(np.diff(v))) / np.mean(v)) if len(v) > 1 and np.mean(v) > 0 else 0.0


def harmonics_to_noise(x: np.ndarray, rate: float, f0: float, width: int) -> float:
    """dB of the autocorrelation near a period over what is left of lag zero, in the middle of a signal; 0 where undefined."""
    if f0 <= 0 or len(x) < width:
        return 0.0
    at = max(0, len(x) // 2 - width // 2)
    f = x[at : at + width]
    size = 1 << (2 * width).bit_length()
    c = np.fft.irfft(np.abs(np.fft.rfft(f, size)) ** 2, size)[:width] / np.arange(width, 0, -1)
    k = int(rate / f0)
    lo, hi = max(1, k - k // 4), min(width - 1, k + k // 4)
    top = c[lo : hi + 1].max() if k < width and hi >= lo else 0.0
    return float(10 * np.log10(top / (c[0] - top))) if 0 < top < c[0] else 0.0


def voice_periods(signals: DataFrame, rate: float, low: float = 80.0, high: float = 400.0, width: int = 1024, hop: int = 256) -> DataFrame:
    """(signal_id, periods, jitter, shimmer, hnr_db, noise, mean_f0, f0_range, f0_stability, level_stability, quality, gender, age) from pitch periods; signals
    with fewer than three periods have zeros and no guesses."""

    def one(x):
        n, a, f = periods(x, rate, low, high, width, hop)
        steady = lambda v: float(max(0.0, 1 - np.std(v) / np.mean(v))) if len(v) > 1 and np.mean(v) > 0 else 0.0
        d = np.diff(x)
        power = float(x @ x)
        noise = float(d @ d) / power if power > 0 else 0.0
        if len(n) < 3:
            return {"periods": len(n), "jitter": 0.0, "shimmer": 0.0, "hnr_db": 0.0, "noise": noise, "mean_f0": 0.0, "f0_range": 0.0, "f0_stability": 0.0, "level_stability": 0.0, "quality": 0.0, "age": "unknown"}
        j, s, h = _percent(n), _percent(a), harmonics_to_noise(x, rate, float(np.mean(f)), min(2048, len(x)))
        quality = float(np.mean([max(0.0, 1 - j / 5), max(0.0, 1 - s / 10), min(1.0, max(0.0, h / 20)), steady(f)]))
        age = "elderly" if j > 3 or s > 8 else "young" if np.mean(f) > 200 and max(f) - min(f) > 100 else "adult"
        return {"periods": len(n), "jitter": j, "shimmer": s, "hnr_db": h, "noise": noise, "mean_f0": float(np.mean(f)), "f0_range": max(f) - min(f), "f0_stability": steady(f), "level_stability": steady(a), "quality": quality, "age": age}

    return _rows(signals, "periods long, jitter double, shimmer double, hnr_db double, noise double, mean_f0 double, f0_range double, f0_stability double, level_stability double, quality double, age string", one)


def voice_gender(first: Column, second: Column) -> Column:
    """A guess by the first two formants; unknown between or without them."""
    return F.coalesce(F.when((first < 450) & (second < 2200), "male").when((first > 500) & (second > 2400), "female"), F.lit("unknown"))


def speech_gate(samples: DataFrame, rate: float, shift: tuple[int, int] = (20, 399), part: int = 1024, value: str = "x") -> DataFrame:
    """(signal_id, n, zcr, rms, periodicity, speech): whether a signal may hold speech: at least a quarter second, crossings from 0.01 to 0.3, an RMS of 0.001, and a normalised
    autocorrelation above 0.1 at a lag of ``shift`` within its first ``part`` samples."""
    from .temporal import by_signal

    x = F.col(value)
    s = samples.withColumn("b", F.lag(x).over(by_signal("i")))
    g = s.groupBy("signal_id").agg(F.count("*").alias("n"), safe(F.sum(F.when((x >= 0) != (F.col("b") >= 0), 1.0).otherwise(0.0)), F.count("*") - 1).alias("zcr"), F.sqrt(F.avg(x * x)).alias("rms"))
    head = samples.where(F.col("i") < part).select("signal_id", "i", x.alias("a"))
    power = head.groupBy("signal_id").agg(F.sum(F.col("a") * F.col("a")).alias("p"))
    late = head.select("signal_id", F.col("a").alias("c"), F.explode(F.sequence(F.lit(shift[0]), F.lit(shift[1]))).alias("lag"), F.col("i").alias("k")).withColumn("i", F.col("k") - F.col("lag")).where("i >= 0")
    r = late.join(head, ["signal_id", "i"]).groupBy("signal_id", "lag").agg(F.sum(F.col("a") * F.col("c")).alias("s")).join(power, "signal_id").groupBy("signal_id").agg(F.max(safe(F.col("s"), F.col("p"))).alias("periodicity"))
    j = g.join(r, "signal_id", "left").withColumn("periodicity", F.coalesce("periodicity", F.lit(0.0)))
    ok = (F.col("n") >= rate / 4) & F.col("zcr").between(0.01, 0.3) & (F.col("rms") >= 0.001) & (F.col("periodicity") > 0.1)
    return j.withColumn("speech", ok)


def intelligibility(rows: DataFrame) -> DataFrame:
    """Adds speech_quality and intelligibility to rows with speech, formants, formant_quality, voice_quality, hnr_db, jitter and shimmer (nulls: not known)."""
    c = F.col
    half = lambda q, name: F.when(c(name).isNotNull(), (q + c(name)) / 2).otherwise(q)
    quality = half(half(F.lit(0.5), "formant_quality"), "voice_quality")
    wide = F.coalesce(F.get("formants", F.lit(1)) - F.get("formants", F.lit(0)) > 500, F.lit(False))
    i = F.lit(0.5) + F.when(wide, 0.2).otherwise(0.0)
    i = half(i, "formant_quality") + F.when(c("hnr_db") > 10, 0.1).otherwise(0.0) + F.when((c("jitter") < 2) & (c("shimmer") < 5), 0.1).otherwise(0.0)
    return rows.withColumns({"speech_quality": F.when(c("speech"), quality).otherwise(0.0), "intelligibility": F.when(c("speech"), F.least(F.lit(1.0), i)).otherwise(0.0)})


def spectral_tilt(frames: DataFrame) -> DataFrame:
    """(signal_id, frame, tilt): -10 log10 of the energy of the first difference over that of the samples after the first; 0 for silence."""

    def one(f):
        d = adjacent(f, lambda a, b: F.struct(((b - a) * (b - a)).alias("h"), (b * b).alias("l")))
        sums = F.aggregate(d, F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("l")), lambda s, x: F.struct((s["h"] + x["h"]).alias("h"), (s["l"] + x["l"]).alias("l")))
        return let(sums, lambda s: F.when((s["l"] > 0) & (s["h"] > 0), -10 * F.log10(s["h"] / F.nullif(s["l"], F.lit(0.0)))).otherwise(0.0))

    return frames.select("signal_id", "frame", let("f", one).alias("tilt"))


def pauses(frame_rows: DataFrame, seconds: float, least: float = 0.1) -> DataFrame:
    """(signal_id, pauses, longest, mean, silence, rate): runs longer than ``least`` seconds of frames at or below the energy of rank n / 10, their figures, the share of
    such frames, and the speech rate of four syllables a second of the rest. ``seconds`` is the length of a hop."""
    from .temporal import by_signal, segments

    r = frame_rows.withColumns({"k": F.row_number().over(by_signal("energy")), "n": F.count("*").over(by_signal())})
    limit = r.where(F.col("k") == F.floor(F.col("n") / 10) + 1).select("signal_id", F.col("energy").alias("limit"))
    f = frame_rows.join(limit, "signal_id")
    share = f.groupBy("signal_id").agg(F.avg(F.when(F.col("energy") <= F.col("limit"), 1.0).otherwise(0.0)).alias("silence"))
    runs = segments(f, F.col("energy") <= F.col("limit")).where("kind = 'silence'").withColumn("d", (F.col("last") - F.col("first") + 1) * seconds).where(F.col("d") > least)
    g = runs.groupBy("signal_id").agg(F.count("*").alias("pauses"), F.max("d").alias("longest"), F.avg("d").alias("mean"))
    j = share.join(g, "signal_id", "left")
    return j.select("signal_id", F.coalesce("pauses", F.lit(0)).alias("pauses"), F.coalesce("longest", F.lit(0.0)).alias("longest"), F.coalesce("mean", F.lit(0.0)).alias("mean"), "silence", F.when(F.col("silence") < 1, 4 * (1 - F.col("silence"))).otherwise(3.0).alias("rate"))
