"""Harmonic ratio and inharmonicity of spectra (signal_id, frame, m), and tracks of partials through frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import safe


def noise_floor(m: np.ndarray, method: str = "percentile", share: float = 0.1, reach: int = 10, smooth: int = 10) -> np.ndarray:
    """Level of the noise around every bin: the share's value, the median or the least of the twenty bins around it, averaged over the last ``smooth`` bins."""
    if method not in ("percentile", "median", "minimum"):
        raise ValueError("unknown noise floor")
    q = {"percentile": share, "median": 0.5, "minimum": 0.0}[method]
    floor = np.empty(len(m))
    for i in range(len(m)):
        near = np.sort(m[max(0, i - reach) : min(len(m), i + reach)])
        floor[i] = near[max(0, int(np.ceil(q * len(near))) - 1)]
    sums = np.concatenate([[0.0], np.cumsum(floor)])
    at = np.arange(len(m))
    lo = np.maximum(at - smooth + 1, 0)
    return (sums[at + 1] - sums[lo]) / (at + 1 - lo)


def _maxima(m: np.ndarray) -> np.ndarray:
    return np.flatnonzero((m[1:-1] > m[:-2]) & (m[1:-1] > m[2:])) + 1


def partials(m: np.ndarray, f0: float, hz: float, top: float, tolerance: float, most: int, reach: int) -> list[tuple[int, int]]:
    """(number, bin) of the multiples of f0 that have a local maximum within ``reach`` bins and the relative tolerance."""
    out = []
    for h in range(1, int(min(most, top / f0)) + 1 if f0 > 0 else 1):
        at = int(f0 * h / hz)
        if at >= len(m):
            break
        lo = max(0, at - reach)
        k = lo + int(m[lo : min(len(m), at + reach + 1)].argmax())
        if 0 < k < len(m) - 1 and m[k] > m[k - 1] and m[k] > m[k + 1] and abs(k * hz - f0 * h) < tolerance * f0 * h:
            out.append((h, k))
    return out


RATIO_COLUMNS = ("ratio_db", "f0", "harmonics", "periodicity", "harmonicity", "voicing", "roughness", "snr_db")
METHODS = ("hnr", "comb", "spectral", "hps")


def harmonic_ratio(spectra: DataFrame, rate: float, low: float = 80.0, high: float = 8000.0, method: str = "hnr", tolerance: float = 0.1, most: int = 20, reach: int = 3, floor: str = "percentile") -> DataFrame:
    """(signal_id, frame, ratio_db, f0, harmonics, periodicity, harmonicity, voicing, roughness, snr_db) of every frame.

    f0 is the strongest spectral peak from ``low`` on (hps: the best harmonic product). hnr (comb is the same) divides the energy of the bins within ``reach`` of a
    harmonic's peak by that of the others, spectral the energy of harmonic peaks by that of the others; both are 60 dB without others. Periodicity is the share of magnitude near a
    multiple of f0, harmonicity exp(-10 mean deviation), voicing a logistic curve of the ratio at 10 dB, roughness the sum of the harmonics' products over their distance plus one.
    """
    if method not in METHODS:
        raise ValueError("unknown method")

    def one(m):
        hz = rate / 2 / max(1, len(m) - 1)
        freq = np.arange(len(m)) * hz
        inside = (freq >= low) & (freq <= high)
        e = m * m
        tops = _maxima(m)
        tops = tops[np.argsort(-m[tops], kind="stable")]
        strong = [k for k in tops.tolist() if inside[k]]
        f0 = strong[0] * hz if strong else 0.0
        if method == "hps" and len(m) > 5:
            p = m.copy()
            for h in range(2, 6):
                p[: (len(m) - 1) // h + 1] *= m[::h][: (len(m) - 1) // h + 1]
            lo, hi = int(np.ceil(low / hz)), min(len(m), int(high / hz) + 1)
            f0 = (lo + int(p[lo:hi].argmax())) * hz if hi > lo else 0.0
            ratio = 20 * np.log10(p[lo:hi].max() + 1e-10) if hi > lo else -200.0
        found = partials(m, f0, hz, high, tolerance, most, reach)
        near = np.abs(freq - f0 * np.round(freq / f0)) < tolerance * f0 * np.round(freq / f0) if f0 > 0 else np.zeros(len(m), bool)
        if method in ("hnr", "comb"):
            mask = np.zeros(len(m), bool)
            for _, k in found:
                mask[max(0, k - reach) : k + reach + 1] = True
            good, bad = e[mask & inside].sum(), e[~mask & inside].sum()
        elif method == "spectral":
            at = np.array(strong, int)
            good, bad = e[at][near[at]].sum(), e[at][~near[at]].sum()
        if method != "hps":
            ratio = 10 * np.log10(max(good, 1e-30) / bad) if bad > 0 else 60.0
        total = m[inside].sum()
        dev = [abs(k * hz - h * f0) / (h * f0) for h, k in found]
        rough = sum(m[a] * m[b] / (abs(a - b) * hz + 1) for i, (_, a) in enumerate(found) for _, b in found[i + 1 :] if a != b)
        noise = float((noise_floor(m, floor)[inside] ** 2).sum())
        return (float(ratio), float(f0), len(found), float(m[near & inside].sum() / total) if total > 0 else 0.0, float(np.exp(-10 * np.mean(dev))) if dev else 0.0, float(1 / (1 + np.exp(-0.1 * (ratio - 10)))), float(rough), float(10 * np.log10(max(e[inside].sum(), 1e-30) / noise)) if noise > 0 else 60.0)

    return _frames(spectra, RATIO_COLUMNS, {"harmonics": "long"}, one)


def _frames(spectra: DataFrame, columns: tuple, kinds: dict, one, extra: tuple = ()) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(s, f, *one(np.asarray(m, float), *x)) for s, f, m, *x in zip(b["signal_id"], b["frame"], b["m"], *(b[c] for c in extra))]
            yield pd.DataFrame(rows, columns=["signal_id", "frame", *columns])

    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns)
    return spectra.select("signal_id", "frame", "m", *extra).mapInPandas(run, f"signal_id long, frame long, {schema}")


def ratio_class(db: Column) -> Column:
    return F.when(db >= 20, "Very High").when(db >= 10, "High").when(db >= 5, "Medium").when(db >= 0, "Low").otherwise("Very Low")


def voicing_quality(db: Column) -> Column:
    return 1 / (1 + F.exp(-0.1 * (db - 5)))


def smoothed_series(rows: DataFrame, value: str, alpha: float = 0.3, history: int = 10) -> DataFrame:
    """Adds smooth (exponential average: ``alpha`` of each value and the rest of what was), stability (1 - coefficient of variation over the last ``history`` frames where the mean is positive,
    at least 0; 0 below three) and coherence (exp of minus a tenth of the mean change over them; 0 below two)."""
    w = Window.partitionBy("signal_id").orderBy("frame")
    near = w.rowsBetween(1 - history, 0)
    fold = lambda a: F.aggregate(a, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s))
    s = rows.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w)))
    m, n = F.avg(value).over(near), F.count(value).over(near)
    late = w.rowsBetween(2 - history, 0)
    # the share of values beyond 64 frames ago is below 1e-9, so the average is taken over those
    s = s.withColumns({"smooth": fold(F.collect_list(value).over(w.rowsBetween(-64, 0))), "stability": F.when((n >= 3) & (m > 0), F.greatest(F.lit(0.0), 1 - F.stddev_samp(value).over(near) / m)).otherwise(0.0), "coherence": F.when(n >= 2, F.exp(-F.avg("_d").over(late) / 10)).otherwise(0.0)})
    return s.drop("_d")


def mean_ratio(ratios: DataFrame) -> DataFrame:
    """(signal_id, mean, frames, class): mean ratio of the frames above -60 dB."""
    g = ratios.where("ratio_db > -60").groupBy("signal_id").agg(F.avg("ratio_db").alias("mean"), F.count("*").alias("frames"))
    return g.withColumn("class", ratio_class(F.col("mean")))


INHARMONICITY = ("inharmonicity", "deviation", "confidence", "stiffness", "r2", "weighted", "mean", "fit", "clarity", "purity", "coherence", "partials")


def loudness_weight(hz: np.ndarray) -> np.ndarray:
    """Weight of a frequency: rising to 1 at 1 kHz, falling above 4 kHz, at least 0.1; 0 outside hearing."""
    w = np.where(hz < 1000, 0.5 + 0.5 * hz / 1000, np.where(hz > 4000, 1 - 0.3 * np.log10(np.maximum(hz, 1) / 4000), 1.0))
    return np.where((hz < 20) | (hz > 20000), 0.0, np.maximum(0.1, w))


def inharmonicity(spectra: DataFrame, rate: float, f0: str = "f0", high: float = 8000.0, least: int = 3, most: int = 20, tolerance: float = 0.05) -> DataFrame:
    """(signal_id, frame, inharmonicity, deviation, confidence, stiffness, r2, weighted, mean, fit, clarity, purity, coherence, partials) of spectra with a fundamental column in Hz; frames with
    fewer than ``least`` partials have zeros.

    inharmonicity weighs the partials' relative deviations d by sum(d n^2) / sum(n^4); stiffness is the B between -0.01 and 0.01 (steps of 1e-4) for which n f0 sqrt(1 + B n^2) fits
    best, with its r2 and the fit exp(-mean error / f0); weighted is the mean deviation by loudness; mean leaves out deviations beyond twice the quartile range. Clarity is the dB range
    over 60, purity exp(-20 mean |d|), coherence 1 / (1 + variation of the spacings).
    """
    grid = np.arange(-100, 101) * 1e-4

    def one(m, base):
        hz = rate / 2 / max(1, len(m) - 1)
        found = []
        if base and base > 0:
            for h in range(1, most + 1):
                ideal = base * h
                if ideal > high:
                    break
                lo, hi = int(max(0, ideal * (1 - tolerance) / hz)), int(min(len(m) - 1, ideal * (1 + tolerance) / hz))
                if hi < lo:
                    break
                k = lo + int(m[lo : hi + 1].argmax())
                if 0 < k < len(m) - 1 and m[k] > m[k - 1] and m[k] > m[k + 1] and abs(k * hz - ideal) < tolerance * ideal:
                    found.append((h, k))
        if len(found) < least:
            return (0.0,) * 11 + (len(found),)
        n, f = np.array([h for h, _ in found], float), np.array([k * hz for _, k in found])
        a = m[[k for _, k in found]]
        d = f / (n * base) - 1
        model = n * base * np.sqrt(1 + grid[:, None] * n * n)
        errors = ((f - model) ** 2).sum(1)
        b = int(errors.argmin())
        spread = ((f - f.mean()) ** 2).sum()
        q1, q3 = np.percentile(d, [25, 75])
        kept = d[(d >= q1 - 2 * (q3 - q1)) & (d <= q3 + 2 * (q3 - q1))]
        gaps = np.diff(f)
        return (
            float((d * n**2).sum() / (n**4).sum()), float(d.std(ddof=1)), float(min(1.0, len(n) / most * a.mean())), float(grid[b]), float(1 - errors[b] / spread) if spread > 0 else 0.0, float((d * loudness_weight(f)).mean()),
            float(kept.mean()) if len(kept) else 0.0, float(np.exp(-np.abs(f - model[b]).mean() / base)), float(min(1.0, 20 * np.log10(a.max() / a[a > 0].min()) / 60)) if (a > 0).any() else 0.0, float(np.exp(-20 * np.abs(d).mean())),
            float(1 / (1 + gaps.std(ddof=1) / gaps.mean())) if len(gaps) > 1 and gaps.mean() > 0 else 0.0, len(found),
        )

    return _frames(spectra, INHARMONICITY, {"partials": "long"}, one, (f0,))


def inharmonicity_class(b: Column) -> Column:
    a = F.abs(b)
    return F.when(a < 1e-4, "Very Low").when(a < 1e-3, "Low").when(a < 5e-3, "Moderate").when(a < 0.01, "High").otherwise("Very High")


def instrument(b: Column, f0: Column) -> Column:
    a = F.abs(b)
    return F.when((a > 0.002) & (f0 < 500), "Piano/String").when(a < 0.0005, "Wind/Brass").when((a > 0.0005) & (a < 0.002), "Plucked String").when((a < 0.001) & f0.between(100.0001, 799.9999), "Vocal/Harmonic").otherwise("Unknown")


def mean_inharmonicity(rows: DataFrame, sure: float = 0.5) -> DataFrame:
    """(signal_id, mean, trend, frames): mean over the frames with a confidence above ``sure``, and its slope by frame order."""
    w = Window.partitionBy("signal_id").orderBy("frame")
    s = rows.where(F.col("confidence") > sure).withColumn("k", F.row_number().over(w).cast("double"))
    return s.groupBy("signal_id").agg(F.avg("inharmonicity").alias("mean"), F.coalesce(F.regr_slope("inharmonicity", "k"), F.lit(0.0)).alias("trend"), F.count("*").alias("frames"))


def partial_tracks(peaks: DataFrame, hz: float, far: float = 50.0, loud: float = 20.0, least: float = 0.3, most: int = 20, decay: float = 0.95) -> DataFrame:
    """(signal_id, track, frame, number, freq, mag, confidence): peaks (signal_id, frame, place in bins, mag) linked greedily from frame to frame.

    Tracks that ended in the frame before take, in order of birth, the free peak with the best 0.7 exp(-distance / ``far``) + 0.3 exp(-change / ``loud``), if above ``least``; other peaks of at least ``least`` begin
    tracks while fewer than ``most`` are alive. Frames are taken one after another, a signal in one task; peaks of a frame are few.
    """

    def run(pdf):
        rows, born, alive = [], 0, []
        frames = {f: g for f, g in pdf.groupby("frame", sort=True)}
        for frame in sorted(frames):
            g = frames[frame].sort_values(["mag", "place"], ascending=[False, True])
            f, a = g["place"].to_numpy() * hz, g["mag"].to_numpy()
            free, nxt = np.ones(len(f), bool), []
            for tid, lf, la, conf in alive:
                score = np.where(free, 0.7 * np.exp(-np.abs(f - lf) / far) + 0.3 * np.exp(-np.abs(a - la) / loud), -1.0)
                if len(score) and score.max() > least:
                    k = int(score.argmax())
                    free[k] = False
                    nxt.append((tid, f[k], a[k], max(least, conf * decay)))
            for k in np.flatnonzero(free).tolist():
                if a[k] >= least and len(nxt) < most:
                    nxt.append((born, f[k], a[k], 1.0))
                    born += 1
            alive = nxt
            rows += [(pdf["signal_id"].iloc[0], t, frame, 1 if x < 200 else 2 if x < 400 else 3 if x < 600 else int(x / 100), x, y, c) for t, x, y, c in alive]
        return pd.DataFrame(rows, columns=["signal_id", "track", "frame", "number", "freq", "mag", "confidence"])

    return peaks.select("signal_id", "frame", "place", "mag").groupBy("signal_id").applyInPandas(run, "signal_id long, track long, frame long, number long, freq double, mag double, confidence double")


def track_figures(tracks: DataFrame, seconds: float) -> DataFrame:
    """(signal_id, track, start, last, frames, duration, freq, freq_dev, slope, mag, continuity, salience): per track; continuity is 1 / (1 + mean change of frequency), salience the mean magnitude times ln(duration + 1)."""
    w = Window.partitionBy("signal_id", "track").orderBy("frame")
    s = tracks.withColumns({"d": F.abs(F.col("freq") - F.lag("freq").over(w)), "k": F.row_number().over(w).cast("double")})
    g = s.groupBy("signal_id", "track").agg(F.min("frame").alias("start"), F.max("frame").alias("last"), F.count("*").alias("frames"), F.avg("freq").alias("freq"), F.coalesce(F.stddev_samp("freq"), F.lit(0.0)).alias("freq_dev"), F.coalesce(F.regr_slope("freq", "k"), F.lit(0.0)).alias("slope"), F.avg("mag").alias("mag"), (1 / (1 + F.coalesce(F.avg("d"), F.lit(0.0)))).alias("continuity"), F.avg("confidence").alias("confidence"))
    return g.withColumn("duration", F.col("frames") * seconds).withColumn("salience", F.col("mag") * F.log(F.col("duration") + 1))


def melody(tracks: DataFrame, figures: DataFrame, most: int = 3, least: float = 0.1) -> DataFrame:
    """(signal_id, frame, freq, confidence): in each frame the most salient of the signal's ``most`` best tracks of a salience and duration above ``least``."""
    w = Window.partitionBy("signal_id").orderBy(F.desc(F.round("salience", 9)), "track")
    top = figures.withColumn("r", F.row_number().over(w)).where((F.col("r") <= most) & (F.col("salience") > least) & (F.col("duration") > least))
    j = tracks.join(top.select("signal_id", "track", "r"), ["signal_id", "track"])
    best = j.groupBy("signal_id", "frame").agg(F.min(F.struct("r", "freq", "confidence")).alias("b"))
    return best.select("signal_id", "frame", "b.freq", "b.confidence")


def f0_stability(track_rows: DataFrame) -> DataFrame:
    """(signal_id, stability): 1 - coefficient of variation of the frequencies of the lowest-numbered partials, at least 0."""
    g = track_rows.where("number = 1").groupBy("signal_id").agg(safe(F.stddev_samp("freq"), F.avg("freq")).alias("cv"))
    return g.select("signal_id", F.greatest(F.lit(0.0), 1 - F.col("cv")).alias("stability"))
