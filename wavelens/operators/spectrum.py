"""Spectra: discrete Fourier transforms and per-frame descriptors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spectral as sp
from ..functions.arrays import let, total
from .temporal import framed


def descriptors(spectra: DataFrame, rate: float) -> DataFrame:
    """Centroid, bandwidth, rolloff, flatness, crest and slope of every frame; no shuffle."""
    return spectra.select(
        "signal_id", "frame", sp.centroid("m", rate).alias("centroid"), sp.bandwidth("m", rate).alias("bandwidth"), sp.rolloff("m", rate).alias("rolloff"), sp.flatness("m").alias("flatness"), sp.flatness_db("m").alias("flatness_db"), sp.crest("m").alias("crest"), sp.slope("m", rate).alias("slope"),
    )


def flatness_figures(spectra: DataFrame, rate: float) -> DataFrame:
    """(signal_id, low, mid, high, mean, variance, tonal, kind): mean flatness of three speech bands and of whole frames, its population variance, the share of tonal frames, and the kind of content these make."""
    s = spectra.select("signal_id", sp.speech_bands("m", rate).alias("b"), sp.flatness("m").alias("f"))
    g = s.groupBy("signal_id").agg(F.avg("b.low").alias("low"), F.avg("b.mid").alias("mid"), F.avg("b.high").alias("high"), F.avg("f").alias("mean"), F.var_pop("f").alias("variance"), F.avg(F.when(sp.tonal_flag(F.col("f")), 1.0).otherwise(0.0)).alias("tonal"))
    return g.withColumn("kind", sp.flatness_kind(F.col("mean"), F.col("variance")))


def flux(spectra: DataFrame) -> DataFrame:
    """(signal_id, frame, flux, change): rising and full change from the frame before; the first frame has none."""
    w = Window.partitionBy("signal_id").orderBy("frame")
    s = spectra.withColumn("before", F.lag("m").over(w)).where("before IS NOT NULL")
    return s.select("signal_id", "frame", sp.flux(F.col("before"), F.col("m")).alias("flux"), sp.flux(F.col("before"), F.col("m"), False).alias("change"))


def cepstra(spectra: DataFrame, rate: float, bins: int, coefficients: int = 13) -> DataFrame:
    """(signal_id, frame, k, c): mel-frequency cepstral coefficients."""
    return spectra.select("signal_id", "frame", F.posexplode(sp.mfcc("m", rate, bins, coefficients=coefficients)).alias("k", "c")).withColumn("k", F.col("k").cast("long"))


def bark_spectra(spectra: DataFrame, rate: float, bins: int, filters: int = 24) -> DataFrame:
    """(signal_id, frame, band, energy): power in triangular filters at equal Bark distances."""
    bank = sp.bark_bank(filters, bins, rate)
    e = let(F.transform("m", lambda v: v * v), lambda p: sp.banked(p, bank))
    return spectra.select("signal_id", "frame", F.posexplode(e).alias("band", "energy"))


def power_levels(spectra: DataFrame, floor_db: float = -100.0) -> DataFrame:
    """(signal_id, frame, bin, power, db): power of every bin and its floored dB."""
    s = spectra.select("signal_id", "frame", F.posexplode("m").alias("bin", "v"))
    p = F.col("v") * F.col("v")
    return s.select("signal_id", "frame", "bin", p.alias("power"), (10 * F.log10(F.greatest(p, F.lit(10 ** (floor_db / 10))))).alias("db"))


def bin_series(spectra: DataFrame, k: int) -> DataFrame:
    """(signal_id, frame, v): one bin over time; frames without that bin have no row."""
    return spectra.select("signal_id", "frame", F.get("m", F.lit(k)).alias("v")).where("v IS NOT NULL")


def dft(samples: DataFrame, width: int = 16, hop: int = 8) -> DataFrame:
    """(signal_id, frame, bin, re, im, power, phase): a short transform of every frame, by cosine and sine sums in the row."""
    f = framed(samples, width, hop).select("signal_id", "frame", "f", F.explode(F.sequence(F.lit(0), F.lit(width // 2))).alias("bin"))
    a = 2 * math.pi / width
    part = lambda g: let(F.col("bin") * a, lambda w: total(F.transform("f", lambda v, i: v * g(w * i))))
    s = f.select("signal_id", "frame", F.col("bin").cast("long").alias("bin"), part(F.cos).alias("re"), (-part(F.sin)).alias("im"))
    return s.withColumns({"power": F.col("re") * F.col("re") + F.col("im") * F.col("im"), "phase": F.atan2("im", "re")})


def inverse_dft(transforms: DataFrame, width: int) -> DataFrame:
    """(signal_id, frame, j, x): the samples of frames from the one-sided transform (signal_id, frame, bin, re, im) of real values."""
    a = 2 * math.pi / width
    t = transforms.select("signal_id", "frame", "bin", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"))
    twice = F.when((F.col("bin") == 0) | (2 * F.col("bin") == width), 1.0).otherwise(2.0)
    angle = F.col("bin") * F.col("j") * a
    return t.groupBy("signal_id", "frame", "j").agg((F.sum(twice * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))) / width).alias("x"))


def stft(samples: DataFrame, width: int = 2048, hop: int = 512, window: np.ndarray | None = None, value: str = "v") -> DataFrame:
    """(signal_id, frame, m): magnitude spectra of complete frames by fast transforms on Arrow batches of frames, for long frames."""
    w = np.ones(width) if window is None else np.asarray(window)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def transform(f: pd.Series) -> pd.Series:
        return pd.Series(list(np.abs(np.fft.rfft(np.stack(f.to_list()) * w, axis=1)))) if len(f) else f

    return framed(samples, width, hop, value).select("signal_id", "frame", transform("f").alias("m"))
