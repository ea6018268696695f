"""Settings by content type, as plain values and as small tables to join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Similarity weights of the feature groups by content type, for comparisons.
COMPARISON_WEIGHTS = {
    "news": {"mfcc": 0.50, "spectral": 0.25, "chroma": 0.05, "temporal": 0.15, "speech": 0.10, "harmonic": 0.05, "energy": 0.10},
    "talk": {"mfcc": 0.50, "spectral": 0.25, "chroma": 0.05, "temporal": 0.15, "speech": 0.10, "harmonic": 0.05, "energy": 0.10},
    "music": {"mfcc": 0.30, "spectral": 0.20, "chroma": 0.25, "temporal": 0.10, "speech": 0.05, "harmonic": 0.15, "energy": 0.10},
    "sports": {"mfcc": 0.25, "spectral": 0.20, "chroma": 0.05, "temporal": 0.25, "speech": 0.10, "harmonic": 0.05, "energy": 0.30},
    "unknown": {"mfcc": 0.35, "spectral": 0.25, "chroma": 0.10, "temporal": 0.20, "speech": 0.10, "harmonic": 0.10, "energy": 0.15},
}
#: What is extracted by content type, with the weights a fingerprint carries; other types count as unknown.
PROFILES = {
    "music": {"mfcc": True, "chroma": True, "contrast": True, "harmonic": True, "speech": False, "temporal": False, "threshold": 0.75, "weights": {"mfcc": 0.35, "chroma": 0.30, "harmonic": 0.20, "spectral": 0.15}},
    "news": {"mfcc": True, "chroma": False, "contrast": True, "harmonic": False, "speech": True, "temporal": True, "threshold": 0.80, "weights": {"mfcc": 0.50, "speech": 0.25, "spectral": 0.15, "temporal": 0.10}},
    "talk": {"mfcc": True, "chroma": False, "contrast": True, "harmonic": False, "speech": True, "temporal": True, "threshold": 0.78, "weights": {"mfcc": 0.45, "speech": 0.30, "spectral": 0.15, "temporal": 0.10}},
    "mixed": {"mfcc": True, "chroma": True, "contrast": True, "harmonic": True, "speech": True, "temporal": True, "threshold": 0.72, "weights": {"mfcc": 0.30, "spectral": 0.20, "temporal": 0.20, "chroma": 0.15, "speech": 0.15}},
    "unknown": {"mfcc": True, "chroma": True, "contrast": True, "harmonic": False, "speech": False, "temporal": True, "threshold": 0.75, "weights": {"mfcc": 0.40, "spectral": 0.25, "chroma": 0.20, "temporal": 0.15}},
}
#: Tolerances of a comparison by content type.
TOLERANCES = {
    "music": {"pitch": 0.1, "tempo": 0.2, "timbre": 0.15}, "news": {"voice": 0.12, "pace": 0.25, "clarity": 0.08}, "talk": {"crowd": 0.35, "commentary": 0.20, "action": 0.25},
    "mixed": {"variation": 0.25, "segments": 0.30, "balance": 0.20}, "unknown": {"general": 0.20},
}
#: Thresholds, methods and limits of comparisons and alignments by content type; the first row of each is the default.
COMPARISON = {"default": (0.75, "auto", 50), "music": (0.80, "precise", 50), "news": (0.70, "precise", 50), "talk": (0.70, "precise", 50), "sports": (0.75, "auto", 50), "mixed": (0.72, "auto", 50)}
ALIGNMENT = {"default": (0.6, "hybrid", 30.0, 50), "news": (0.5, "dtw", 30.0, 50), "talk": (0.5, "dtw", 30.0, 50), "music": (0.7, "hybrid", 30.0, 50), "sports": (0.4, "hybrid", 30.0, 50), "mixed": (0.5, "hybrid", 30.0, 50)}
#: Loudness settings of decoding by content type: method, target in LUFS, peak, range.
DECODING = {"default": ("loudnorm", -23.0, -2.0, 7.0), "music": ("loudnorm", -16.0, -1.0, 8.0), "speech": ("dynaudnorm", -20.0, -3.0, 5.0), "news": ("dynaudnorm", -20.0, -3.0, 5.0), "talk": ("dynaudnorm", -20.0, -3.0, 5.0), "sports": ("compand", -18.0, -2.0, 10.0)}
#: Pre-emphasis by kind of material, and windows by purpose with their parameters.
EMPHASIS = {"default": 0.95, "speech": 0.97, "music": 0.95, "broadcast": 0.96, "narrowband": 0.94, "wideband": 0.98}
WINDOWS = {
    "default": ("hann", {}), "general_analysis": ("hann", {}), "speech_analysis": ("hamming", {}), "music_analysis": ("blackman", {}), "high_resolution": ("blackman_harris", {}),
    "low_leakage": ("kaiser", {"beta": 8.6}), "transient_analysis": ("tukey", {"alpha": 0.25}), "maximum_resolution": ("rectangular", {}),
}


def of(table: dict, kind: str):
    """A kind's entry, or the default (unknown) one."""
    return table.get(kind, table.get("default", table.get("unknown")))


def normalization_filter(kind: str) -> str:
    """The loudness filter of an external decoder for a content type; empty for an unknown method."""
    method, target, peak, span = of(DECODING, kind)
    if method == "loudnorm":
        return f"loudnorm=I={target:.1f}:TP={peak:.1f}:LRA={span:.1f}"
    if method == "dynaudnorm":
        return "dynaudnorm=p=0.95:m=10:s=12"
    return f"compand=0.1,0.3:-90/-90,-{abs(peak):.1f}/-{abs(peak):.1f},0/0:6:0:-90:0.1" if method == "compand" else ""


def weights(spark: SparkSession, table: dict = COMPARISON_WEIGHTS) -> DataFrame:
    """(content_type, feature, weight) of a table of weights; profiles give theirs."""
    rows = [(kind, f, w) for kind, entry in table.items() for f, w in entry.get("weights", entry).items()]
    return spark.createDataFrame(rows, "content_type string, feature string, weight double")


def profiles(spark: SparkSession) -> DataFrame:
    """(content_type, mfcc, chroma, contrast, harmonic, speech, temporal, threshold) of every profile."""
    names = ["mfcc", "chroma", "contrast", "harmonic", "speech", "temporal", "threshold"]
    return spark.createDataFrame([(k, *(p[n] for n in names)) for k, p in PROFILES.items()], "content_type string, " + ", ".join(f"{n} boolean" for n in names[:-1]) + ", threshold double")


def check_signal_format(rate: int, channels: int) -> None:
    """Raises for a rate that is not positive or a number of channels outside 1 to 8."""
    if rate <= 0 or not 1 <= channels <= 8:
        raise ValueError("the rate must be positive and channels 1 to 8")
