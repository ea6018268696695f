"""Time-domain descriptors of signals held as rows (signal_id, i, v, x): energy, crossings, envelopes, segments, filters.

A sample belongs to at most width / hop frames (rounded up), so frames come from one explode and one partial aggregate on the
partitioning by signal; no row ever holds a whole signal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.arrays import let, mean, safe

def by_signal(*order: str) -> WindowSpec:
    """The rows of a signal, in an order if one is given."""
    w = Window.partitionBy("signal_id")
    return w.orderBy(*order) if order else w


def centred(v: str | Column = "v") -> Column:
    """An array less its mean."""
    return let(v, lambda a: let(mean(a), lambda m: F.transform(a, lambda x: x - m)))


def frame_samples(samples: DataFrame, width: int, hop: int, value: str = "x") -> DataFrame:
    """(signal_id, frame, j, x, crossed): the samples of every complete frame, and whether each lies on the other side of zero than the one before it in the frame."""
    order = by_signal("i")
    x = F.col(value)
    s = samples.select("signal_id", "i", x.alias("x"), ((x >= 0) != (F.lag(x).over(order) >= 0)).alias("crossed"), F.max("i").over(by_signal()).alias("last"))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / hop))
    end = F.least(F.floor(F.col("i") / hop), F.floor((F.col("last") - width + 1) / hop))
    s = s.where(F.col("last") >= width - 1).withColumn("a", first).withColumn("b", end).where("a <= b")
    s = s.withColumn("frame", F.explode(F.sequence("a", "b"))).withColumn("j", F.col("i") - F.col("frame") * hop)
    return s.select("signal_id", "frame", "j", "x", ((F.col("j") > 0) & F.col("crossed")).alias("crossed"))


def frame_rows(samples: DataFrame, width: int = 16, hop: int = 8, value: str = "x") -> DataFrame:
    """(signal_id, frame, energy, zcr, peak): RMS, share of crossings and largest magnitude of every complete frame."""
    x = F.col("x")
    f = frame_samples(samples, width, hop, value).groupBy("signal_id", "frame")
    crossings = F.sum(F.when(F.col("crossed"), 1.0).otherwise(0.0))
    return f.agg(F.sqrt(F.sum(x * x) / width).alias("energy"), (crossings / max(1, width - 1)).alias("zcr"), F.max(F.abs(x)).alias("peak"))


def framed(samples: DataFrame, width: int = 16, hop: int = 8, value: str = "x") -> DataFrame:
    """(signal_id, frame, f): every complete frame as an array."""
    f = frame_samples(samples, width, hop, value).groupBy("signal_id", "frame").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("r"))
    return f.select("signal_id", "frame", F.transform("r", lambda p: p["x"]).alias("f"))


def profile(samples: DataFrame, width: int = 16, hop: int = 8) -> DataFrame:
    """Per signal: size, crossings, RMS, peak, crest, dynamic range, frame energy variance and stability."""
    x, size = F.col("x"), F.abs("x")
    s = samples.withColumn("crossed", (x >= 0) != (F.lag(x).over(by_signal("i")) >= 0))
    loud = F.when(size > 1e-10, size)
    g = s.groupBy("signal_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("crossed"), 1.0).otherwise(0.0)).alias("c"), F.sqrt(F.avg(x * x)).alias("rms"), F.max(size).alias("peak"), F.max(loud).alias("hi"), F.min(loud).alias("lo"))
    e = F.col("energy") * F.col("energy")
    f = frame_rows(samples, width, hop).groupBy("signal_id").agg(F.var_pop(e).alias("ev"), safe(F.stddev_pop(e), F.avg(e)).alias("cv"))
    j = g.join(f, "signal_id", "left")
    return j.select(
        "signal_id", "n", safe(F.col("c"), F.col("n") - 1).alias("zcr"), "rms", "peak", safe(F.col("peak"), F.col("rms")).alias("crest"), F.coalesce(20 * F.log10(F.col("hi") / F.col("lo")), F.lit(0.0)).alias("range_db"),
        F.coalesce("ev", F.lit(0.0)).alias("energy_variance"), F.greatest(F.lit(0.0), 1 - F.coalesce("cv", F.lit(0.0))).alias("stability"),
    )


def frame_energy(samples: DataFrame, width: int = 16, hop: int = 8) -> DataFrame:
    """(signal_id, frame, energy, zcr, log_energy, delta): RMS of each complete frame, its crossings, its dB and its first difference."""
    w = by_signal("frame")
    f = frame_rows(samples, width, hop).drop("peak")
    return f.withColumn("log_energy", 20 * F.log10(F.greatest("energy", F.lit(1e-10)))).withColumn("delta", F.coalesce(F.col("energy") - F.lag("energy").over(w), F.lit(0.0)))


def energy_statistics(samples: DataFrame, width: int = 16, hop: int = 8) -> DataFrame:
    """Mean, sample variance, entropy and range of frame energies.

    The entropy of shares p = e / s follows from two sums: log2 s - sum(e log2 e) / s.
    """
    e = F.col("energy")
    f = frame_rows(samples, width, hop).groupBy("signal_id").agg(F.avg(e).alias("mean"), F.coalesce(F.var_samp(e), F.lit(0.0)).alias("variance"), F.sum(e).alias("s"), F.sum(F.when(e > 0, e * F.log2(e)).otherwise(0.0)).alias("l"), F.min(e).alias("low"), F.max(e).alias("high"))
    entropy = F.when(F.col("s") > 0, F.log2("s") - F.col("l") / F.nullif(F.col("s"), F.lit(0.0))).otherwise(0.0)
    return f.select("signal_id", "mean", "variance", entropy.alias("entropy"), "low", "high")


def energy_ratio(frame_rows_a: DataFrame, frame_rows_b: DataFrame) -> DataFrame:
    """(signal_id, frame, ratio): energies of one framing over those of another, 0 where the second is at most 1e-10."""
    b = frame_rows_b.select("signal_id", "frame", F.col("energy").alias("other"))
    return frame_rows_a.join(b, ["signal_id", "frame"]).select("signal_id", "frame", F.when(F.col("other") > 1e-10, F.col("energy") / F.nullif(F.col("other"), F.lit(0.0))).otherwise(0.0).alias("ratio"))


def energy_peaks(frame_rows: DataFrame, threshold: float) -> DataFrame:
    """(signal_id, frame, energy): frames whose energy is above both neighbours and at least the threshold."""
    w = by_signal("frame")
    f = frame_rows.withColumns({"a": F.lag("energy").over(w), "b": F.lead("energy").over(w)})
    return f.where((F.col("energy") > F.col("a")) & (F.col("energy") > F.col("b")) & (F.col("energy") >= threshold)).select("signal_id", "frame", "energy")


def segments(frame_rows: DataFrame, quiet: Column, least: int = 1) -> DataFrame:
    """(signal_id, kind, first, last): maximal runs of frames that are quiet or not, of at least ``least`` frames."""
    w = by_signal("frame")
    f = frame_rows.withColumn("kind", F.when(quiet, "silence").otherwise("sound"))
    f = f.withColumn("turn", F.when(F.col("kind") == F.lag("kind").over(w), 0).otherwise(1))
    f = f.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = f.groupBy("signal_id", "run", "kind").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    return out.where(F.col("last") - F.col("first") + 1 >= least).drop("run")


def voiced(frame_rows: DataFrame, energy: float, low: float, high: float) -> Column:
    """Whether a frame holds voice: RMS at least ``energy`` and a share of crossings within the band."""
    return (F.col("energy") >= energy) & F.col("zcr").between(low, high)


def voice_segments(frame_rows: DataFrame, energy: float = 0.001, low: float = 0.02, high: float = 0.6, least: int = 1) -> DataFrame:
    """(signal_id, first, last): maximal runs of at least ``least`` voiced frames."""
    return segments(frame_rows, ~voiced(frame_rows, energy, low, high), least).where("kind = 'sound'").drop("kind")


def frame_kinds(frame_rows: DataFrame, quiet: float = 0.001, low: float = 0.1, high: float = 0.4, top: float = 0.7) -> DataFrame:
    """Adds ``kind``: silence below the quiet level, else by the share of crossings voiced, mixed, unvoiced or noise."""
    z = F.col("zcr")
    return frame_rows.withColumn("kind", F.when(F.col("energy") < quiet, "silence").when(z < low, "voiced").when(z < high, "mixed").when(z < top, "unvoiced").otherwise("noise"))


def crossing_statistics(frame_rows: DataFrame, rate: float, width: int) -> DataFrame:
    """(signal_id, mean, variance, low, high): statistics of the crossings a second over a signal's frames."""
    z = F.col("zcr") * (width - 1) * rate / width
    return frame_rows.groupBy("signal_id").agg(F.avg(z).alias("mean"), F.coalesce(F.var_samp(z), F.lit(0.0)).alias("variance"), F.min(z).alias("low"), F.max(z).alias("high"))


def loud_crossings(samples: DataFrame, threshold: float, value: str = "x") -> DataFrame:
    """(signal_id, zcr): share of neighbours on two sides of zero that both exceed the threshold in magnitude."""
    x, b = F.col(value), F.lag(value).over(by_signal("i"))
    hit = ((x >= 0) != (b >= 0)) & (F.abs(x) > threshold) & (F.abs(b) > threshold)
    s = samples.select("signal_id", F.when(hit, 1.0).otherwise(0.0).alias("hit"))
    return s.groupBy("signal_id").agg(safe(F.sum("hit"), F.count("*") - 1).alias("zcr"))


def onsets(frame_rows: DataFrame) -> DataFrame:
    """(signal_id, frame, strength): local maxima of the rising energy above mean plus one deviation."""
    w = by_signal("frame")
    f = frame_rows.withColumn("rise", F.greatest("delta", F.lit(0.0)))
    f = f.withColumns({"before": F.lag("rise").over(w), "after": F.lead("rise").over(w), "limit": F.avg("rise").over(by_signal()) + F.stddev_pop("rise").over(by_signal())})
    return f.where("rise > before AND rise >= after AND rise >= limit").select("signal_id", "frame", F.col("rise").alias("strength"))


def spaced(onset_rows: DataFrame, gap: int) -> DataFrame:
    """Onsets that come at least ``gap`` frames after the last one kept, per signal in order of frames."""
    lists = onset_rows.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("frame", "strength"))).alias("all"))
    return lists.select("signal_id", F.explode(_spaced("all", gap)).alias("o")).select("signal_id", "o.frame", "o.strength")


def _spaced(column: str, gap: int) -> Column:
    far = lambda kept, o: (F.size(kept) == 0) | (o["frame"] - F.element_at(kept, -1)["frame"] >= gap)
    return F.aggregate(column, F.slice(F.col(column), 1, 0), lambda kept, o: F.when(far(kept, o), F.concat(kept, F.array(o))).otherwise(kept))


def merged_onsets(a: DataFrame, b: DataFrame, tolerance: int) -> DataFrame:
    """Onsets of both frames in order, without those within ``tolerance`` frames of one kept before."""
    return spaced(a.unionByName(b).groupBy("signal_id", "frame").agg(F.max("strength").alias("strength")), tolerance + 1)


def onset_density(onset_rows: DataFrame, samples: DataFrame, rate: float) -> DataFrame:
    """(signal_id, onsets, density): number of onsets, and onsets a second, of every signal."""
    n = samples.groupBy("signal_id").agg(F.count("*").alias("n"))
    o = onset_rows.groupBy("signal_id").agg(F.count("*").alias("onsets"))
    return n.join(o, "signal_id", "left").select("signal_id", F.coalesce("onsets", F.lit(0)).alias("onsets"), (F.coalesce("onsets", F.lit(0)) * rate / F.col("n")).alias("density"))


def smoothed(samples: DataFrame, half: int = 2, value: str = "x") -> DataFrame:
    """Adds the trailing mean, the centred mean and median, and the envelope from the central difference of each sample."""
    w = by_signal("i")
    near = w.rowsBetween(-half, half)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    d = F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)
    d = F.coalesce(d, F.lit(0.0))
    middle = F.element_at(F.array_sort(F.collect_list(value).over(near)), F.floor((F.count(value).over(near) + 2) / 2).cast("int"))
    return samples.withColumns({"trailing": F.avg(value).over(w.rowsBetween(-2 * half, 0)), "centred": F.avg(value).over(near), "median": middle, "envelope": F.sqrt(F.col(value) * F.col(value) + d * d)})


def pre_emphasis(samples: DataFrame, a: float = 0.97, value: str = "x") -> DataFrame:
    """Adds y = x - a * previous x."""
    return samples.withColumn("y", F.col(value) - a * F.coalesce(F.lag(value).over(by_signal("i")), F.lit(0.0)))


def delayed(samples: DataFrame, delay: float, value: str = "x") -> DataFrame:
    """Adds y: the signal ``delay`` samples ago, 0 before its start; fractions are interpolated between two whole delays."""
    w, whole = by_signal("i"), math.floor(delay)
    at = lambda d: F.coalesce(F.lag(value, d).over(w), F.lit(0.0)) if d else F.col(value)
    share = delay - whole
    return samples.withColumn("y", at(whole) * (1 - share) + at(whole + 1) * share if share else at(whole))


def normalized(samples: DataFrame) -> DataFrame:
    """One row a sample with the z-score, min-max, energy, peak and RMS normalisations of its signal.

    A signal's figures come from one partial aggregate and return to its samples by a join on the same partitioning.
    """
    v = F.col("v")
    g = samples.groupBy("signal_id").agg(F.avg(v).alias("m"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.sqrt(F.sum(v * v)).alias("l2"), F.max(F.abs(v)).alias("pk"), F.sqrt(F.avg(v * v)).alias("rm"))
    s = samples.select("signal_id", "i", "v").join(g, "signal_id")
    return s.select("signal_id", "i", safe(v - F.col("m"), F.col("sd")).alias("z"), safe(v - F.col("lo"), F.col("hi") - F.col("lo")).alias("unit"), safe(v, F.col("l2")).alias("energy"), safe(v, F.col("pk")).alias("peak"), safe(v, F.col("rm")).alias("rms"))


def overlap_added(frames: DataFrame, hop: int) -> DataFrame:
    """(signal_id, i, y): frames (signal_id, frame, y as array) added where they overlap, at their places in the signal."""
    rows = frames.select("signal_id", "frame", F.posexplode("y").alias("j", "y"))
    return rows.groupBy("signal_id", (F.col("frame") * hop + F.col("j")).alias("i")).agg(F.sum("y").alias("y"))
