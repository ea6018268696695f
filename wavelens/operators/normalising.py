"""Further normalisations of signals held as rows (signal_id, i, v): quantile, robust, adaptive, to a level, to a loudness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import safe
from .temporal import by_signal, frame_rows, frame_samples

LEAST = 1e-10


def _at(share: float, column: str) -> F.Column:
    """The smallest value that at least this share of the values do not exceed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def scaled(samples: DataFrame, low: float = 0.05, high: float = 0.95, decibels: float = -20.0, span: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """One row a sample: clamped to two quantiles and scaled to 0..1, robust (deviation from the median over 1.4826 times the
    median deviation), mapped to a span, brought to an RMS in dB, and the adaptive choice among these.

    Where a divisor is below 1e-10 the values are only shifted; a silent signal keeps its level. The adaptive choice is robust for a
    crest above 10, centred for a sample deviation below 1e-6, the z-score for a mean beyond three deviations, else energy.
    """
    v = F.col("v")
    g = samples.groupBy("signal_id").agg(
        _at(low, "v").alias("lo"), _at(high, "v").alias("hi"), _at(0.5, "v").alias("med"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"),
        F.sqrt(F.avg(v * v)).alias("rms"), F.sqrt(F.sum(v * v)).alias("l2"), F.max(F.abs(v)).alias("peak"),
    )
    s = samples.select("signal_id", "i", "v").join(g, "signal_id")
    mad = s.select("signal_id", F.abs(v - F.col("med")).alias("dev")).groupBy("signal_id").agg(_at(0.5, "dev").alias("mad"))
    s = s.join(mad, "signal_id")
    c = F.col
    over = lambda x, d, otherwise: F.when(F.abs(d) < LEAST, otherwise).otherwise(x / F.nullif(d, F.lit(0.0)))
    robust = over(v - c("med"), 1.4826 * c("mad"), v - c("med"))
    z, energy = safe(v - c("mean"), c("sd")), safe(v, c("l2"))
    adaptive = F.when(safe(c("peak"), c("rms")) > 10, robust).when(c("sd") < 1e-6, v - c("mean")).when(F.abs("mean") > 3 * c("sd"), z).otherwise(energy)
    return s.select(
        "signal_id", "i", over(F.greatest(c("lo"), F.least(c("hi"), v)) - c("lo"), c("hi") - c("lo"), v - c("lo")).alias("quantile"), robust.alias("robust"),
        (span[0] + (span[1] - span[0]) * safe(v - c("least"), c("most") - c("least"))).alias("span"), over(v * 10 ** (decibels / 20), c("rms"), v).alias("level"), adaptive.alias("adaptive"),
    )


def loudness_gain(samples: DataFrame, target: float, width: int, value: str = "v") -> DataFrame:
    """(signal_id, loudness, gain): mean loudness of overlapping windows (a quarter's hop) that are not silent, and the factor that brings the
    signal to the target. The offset of 0.691 enters each window's loudness and the mean's. Silent or short signals have factor 1."""
    e = frame_rows(samples, width, max(1, width // 4), value).where(F.col("energy") > LEAST)
    power = F.avg(F.col("energy") * F.col("energy") * 10 ** (-0.0691))
    g = e.groupBy("signal_id").agg((-0.691 + 10 * F.log10(power)).alias("loudness"))
    ids = samples.select("signal_id").distinct()
    return ids.join(g, "signal_id", "left").select("signal_id", "loudness", F.coalesce(F.pow(F.lit(10.0), (target - F.col("loudness")) / 20), F.lit(1.0)).alias("gain"))


def to_loudness(samples: DataFrame, target: float, width: int) -> DataFrame:
    """(signal_id, i, y): the signal times its loudness gain."""
    return samples.join(loudness_gain(samples, target, width), "signal_id").select("signal_id", "i", (F.col("v") * F.col("gain")).alias("y"))


def gains(before: DataFrame, after: DataFrame) -> DataFrame:
    """(signal_id, mean, deviation, rms, peak of both, rms_gain, peak_gain): figures of a signal before and after (signal_id, i, y)."""

    def of(df, x, tag):
        x = F.col(x)
        return df.groupBy("signal_id").agg(F.avg(x).alias(f"mean_{tag}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"deviation_{tag}"), F.sqrt(F.avg(x * x)).alias(f"rms_{tag}"), F.max(F.abs(x)).alias(f"peak_{tag}"))

    j = of(before, "v", "before").join(of(after, "y", "after"), "signal_id")
    return j.withColumns({"rms_gain": safe(F.col("rms_after"), F.col("rms_before")), "peak_gain": safe(F.col("peak_after"), F.col("peak_before"))})


def by_frame(samples: DataFrame, width: int = 16, hop: int = 8) -> DataFrame:
    """(signal_id, i, y): z-scores within each frame; a sample's later frames are blended in, each by the sample's share of its way
    through that frame, frame after frame, except in the first ``hop`` samples of a frame, which replace what was there.

    Samples in no complete frame keep their value. Frames of a sample are few, so they are folded in the row.
    """
    f = frame_samples(samples.withColumn("raw", F.col("v")), width, hop, "raw")
    g = f.groupBy("signal_id", "frame").agg(F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"))
    z = f.join(g, ["signal_id", "frame"]).select("signal_id", (F.col("frame") * hop + F.col("j")).alias("i"), "frame", "j", F.when(F.col("sd") < LEAST, F.col("x") - F.col("m")).otherwise((F.col("x") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))).alias("z"))
    steps = z.groupBy("signal_id", "i").agg(F.array_sort(F.collect_list(F.struct("frame", "j", "z"))).alias("s"))
    blend = lambda y, s: F.when((s["frame"] == 0) | (s["j"] < hop), s["z"]).otherwise((1 - s["j"] / width) * y + s["j"] / width * s["z"])
    j = samples.select("signal_id", "i", "v").join(steps, ["signal_id", "i"], "left")
    return j.select("signal_id", "i", F.when(F.col("s").isNull(), F.col("v")).otherwise(F.aggregate("s", F.col("v"), blend)).alias("y"))
