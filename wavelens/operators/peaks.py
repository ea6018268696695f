"""Peaks, harmonics and bands of magnitude spectra (signal_id, frame, m)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import safe


def spectral_peaks(spectra: DataFrame, height: float = 0.0, most: int = 5) -> DataFrame:
    """(signal_id, frame, bin, mag, place, rank): bins above both neighbours and at least ``height``, largest first, with the
    vertex of the parabola through the three. Ranked in the row, without a shuffle."""
    m = F.col("m")
    inner = F.transform(F.sequence(F.lit(1), F.size(m) - 2), lambda i: F.struct((-m[i]).alias("n"), i.alias("bin"), m[i - 1].alias("a"), m[i].alias("mag"), m[i + 1].alias("c")))
    found = F.slice(F.array_sort(F.filter(inner, lambda p: (p["mag"] > p["a"]) & (p["mag"] > p["c"]) & (p["mag"] >= height))), 1, most)
    s = spectra.where(F.size(m) > 2).select("signal_id", "frame", F.posexplode(found).alias("rank", "p"))
    shift = safe(F.col("p.c") - F.col("p.a"), 2 * (2 * F.col("p.mag") - F.col("p.a") - F.col("p.c")))
    return s.select("signal_id", "frame", F.col("p.bin").cast("long").alias("bin"), "p.mag", (F.col("p.bin") + shift).alias("place"), (F.col("rank") + 1).cast("long").alias("rank"))


def spaced_peaks(peaks: DataFrame, distance: float) -> DataFrame:
    """Peaks at least ``distance`` bins apart: in order of bins a peak nearer to the last one kept replaces it if it is larger, else it is left out."""
    lists = peaks.groupBy("signal_id", "frame").agg(F.array_sort(F.collect_list(F.struct("bin", "mag", "place"))).alias("all"))
    last = lambda kept: F.element_at(kept, -1)
    step = lambda kept, p: (
        F.when((F.size(kept) == 0) | (p["bin"] - last(kept)["bin"] >= distance), F.concat(kept, F.array(p)))
        .when(p["mag"] > last(kept)["mag"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(p)))
        .otherwise(kept)
    )
    empty = F.slice(F.col("all"), 1, 0)
    guarded = F.aggregate("all", empty, lambda kept, p: F.when(F.size(kept) == 0, F.array(p)).otherwise(step(kept, p)))
    return lists.select("signal_id", "frame", F.explode(guarded).alias("p")).select("signal_id", "frame", "p.bin", "p.mag", "p.place")


def with_phase(peaks: DataFrame, transforms: DataFrame) -> DataFrame:
    """The peaks with the phase of their bin in (signal_id, frame, bin, phase)."""
    return peaks.join(transforms.select("signal_id", "frame", "bin", "phase"), ["signal_id", "frame", "bin"], "left")


def subharmonics(peaks: DataFrame, f0: DataFrame, tolerance: float = 0.05, most: int = 5) -> DataFrame:
    """Peaks within a relative tolerance of f0 / 2 to f0 / ``most``, with the negative divisor as their number."""
    j = peaks.join(f0.where("f0 > 0"), ["signal_id", "frame"]).withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(most))))
    at = F.col("f0") / F.col("k")
    return j.where(F.abs(F.col("place") - at) <= tolerance * at).withColumn("harmonic", -F.col("k")).drop("k")


def peak_figures(peaks: DataFrame) -> DataFrame:
    """(signal_id, frame, n, largest, smallest, mean, low, high): number, magnitudes and range of places of every frame's peaks."""
    return peaks.groupBy("signal_id", "frame").agg(F.count("*").alias("n"), F.max("mag").alias("largest"), F.min("mag").alias("smallest"), F.avg("mag").alias("mean"), F.min("place").alias("low"), F.max("place").alias("high"))


def harmonics(peaks: DataFrame, f0: DataFrame, tolerance: float = 0.05, most: int = 20) -> DataFrame:
    """Peaks that lie within a relative tolerance of a multiple of their frame's f0 (signal_id, frame, f0 in bins), with the
    number of the nearest multiple and its deviation."""
    j = peaks.join(f0.where("f0 > 0"), ["signal_id", "frame"])
    h = F.greatest(F.lit(1), F.least(F.lit(most), F.round(F.col("place") / F.col("f0")).cast("int")))
    j = j.withColumn("harmonic", h).withColumn("deviation", F.abs(F.col("place") - h * F.col("f0")) / (h * F.col("f0")))
    return j.where(F.col("deviation") <= tolerance)


def harmonic_series(assigned: DataFrame) -> DataFrame:
    """(signal_id, frame, n, energy, odd_even, decay, inharmonicity) of assigned harmonics; odd over even energy is 0 without even ones; decay is the slope of the log magnitude by number."""
    e = F.col("mag") * F.col("mag")
    odd = F.col("harmonic") % 2 == 1
    loud = F.when((F.col("harmonic") > 0) & (F.col("mag") > 0), F.log("mag"))
    g = assigned.groupBy("signal_id", "frame").agg(F.coalesce(F.regr_slope(loud, F.col("harmonic").cast("double")), F.lit(0.0)).alias("decay"), F.count("*").alias("n"), F.sum(e).alias("energy"), F.sum(F.when(odd, e).otherwise(0.0)).alias("odd"), F.sum(F.when(odd, 0.0).otherwise(e)).alias("even"), F.avg("deviation").alias("inharmonicity"))
    return g.select("signal_id", "frame", "n", "energy", safe(F.col("odd"), F.col("even")).alias("odd_even"), "decay", "inharmonicity")


def harmonic_product(spectra: DataFrame, factors: int = 3) -> DataFrame:
    """(signal_id, frame, bin, strength): the bin above zero with the largest log product of the powers at its multiples."""
    m = F.col("m")
    last = F.floor((F.size(m) - 1) / factors).cast("int")
    one = lambda i: F.struct(F.round(sum(2 * F.log(F.greatest(m[i * h], F.lit(1e-10))) for h in range(1, factors + 1)), 9).alias("s"), (-i).alias("b"))
    s = spectra.where(F.size(m) > factors).select("signal_id", "frame", F.array_max(F.transform(F.sequence(F.lit(1), last), one)).alias("p"))
    return s.select("signal_id", "frame", (-F.col("p.b")).cast("long").alias("bin"), F.col("p.s").alias("strength"))


def interpolated_product(spectra: DataFrame, factors: int = 3) -> DataFrame:
    """(signal_id, frame, strength): log products, at every bin above zero, of the powers at a h-th of the bin's place, interpolated between bins."""
    m = F.col("m")

    def at(i, h):
        lo = F.floor(i / h).cast("int")
        return m[lo] + (i / h - lo) * (F.get(m, F.least(lo + 1, F.size(m) - 1)) - m[lo])

    one = lambda i: sum(2 * F.log(F.greatest(at(i, h), F.lit(1e-10))) for h in range(1, factors + 1))
    return spectra.where(F.size(m) > 1).select("signal_id", "frame", F.transform(F.sequence(F.lit(1), F.size(m) - 1), one).alias("strength"))


def harmonic_strength(spectra: DataFrame, f0: DataFrame, most: int = 10) -> DataFrame:
    """(signal_id, frame, levels, harmonicity): interpolated magnitudes at the multiples of f0 (in bins), and the share of the spectrum's energy that their squares make (at most 1)."""
    m = F.col("m")
    s = spectra.join(f0.where("f0 > 0"), ["signal_id", "frame"])
    at = lambda k: F.col("f0") * k
    lo = lambda k: F.floor(at(k)).cast("int")
    own = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: at(k) <= F.size(m) - 1)
    levels = F.transform(own, lambda k: F.get(m, lo(k)) + (at(k) - lo(k)) * (F.get(m, F.least(lo(k) + 1, F.size(m) - 1)) - F.get(m, lo(k))))
    power = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v * v)
    return s.select("signal_id", "frame", levels.alias("levels"), F.least(F.lit(1.0), safe(power(levels), power(m))).alias("harmonicity"))


def log_edges(bands: int, bins: int, rate: float, low: float = 200.0) -> tuple[int, ...]:
    """Strictly rising bin edges of bands at equal ratios from ``low`` to half the rate."""
    top = rate / 2
    raw = [round(low * (top / low) ** (k / bands) / top * (bins - 1)) for k in range(bands + 1)]
    out: list[int] = []
    for e in raw:
        out.append(max(e, out[-1] + 1 if out else 0))
    return tuple(min(e, bins) for e in out)


def contrast_statistics(contrasts: DataFrame) -> DataFrame:
    """(signal_id, band, mean, variance): mean and sample variance of the contrast of every band over a signal's frames."""
    return contrasts.groupBy("signal_id", "band").agg(F.avg("contrast").alias("mean"), F.coalesce(F.var_samp("contrast"), F.lit(0.0)).alias("variance"))


def spectral_contrast(spectra: DataFrame, edges: tuple[int, ...] = (0, 8, 16, 32, 64), share: float = 0.2) -> DataFrame:
    """(signal_id, frame, band, contrast): dB between the means of a band's largest and smallest bins (``share`` of them, at
    least one); bands beyond the spectrum are left out."""
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.array_sort(F.slice("m", a + 1, b - a)).alias("s")) for k, (a, b) in enumerate(zip(edges, edges[1:]))))
    s = spectra.select("signal_id", "frame", F.explode(bands).alias("x")).select("signal_id", "frame", "x.band", "x.s").where(F.size("s") > 0)
    k = F.greatest(F.lit(1), F.ceil(share * F.size("s") - 1e-9)).cast("int")
    avg = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v) / k
    top, low = avg(F.slice("s", F.size("s") - k + 1, k)), avg(F.slice("s", F.lit(1), k))
    return s.select("signal_id", "frame", F.col("band").cast("long").alias("band"), (10 * F.log10((top + 1e-10) / (low + 1e-10))).alias("contrast"))
