"""Window coefficients as columns of the position, and their properties."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import squares, total

TYPES = ("rectangular", "hann", "hamming", "blackman", "blackman_harris", "bartlett", "welch", "tukey", "kaiser")


def bessel_i0(x: float) -> float:
    """Modified Bessel function of order zero by its power series."""
    total = term = 1.0
    for k in range(1, 50):
        term *= (x / (2 * k)) ** 2
        total += term
        if term < 1e-12 * total:
            break
    return total


def _i0(x: Column) -> Column:
    out = F.lit(0.0)
    for k in range(24, 0, -1):
        out = (x / (2 * k)) * (x / (2 * k)) * (out + 1)
    return out + 1


def coefficient(kind: str, i: Column, n: int, symmetric: bool = True, beta: float = 8.6, alpha: float = 0.5) -> Column:
    """Coefficient at position i of n."""
    if kind not in TYPES or not 0 < n <= 1 << 20 or beta < 0 or not 0 <= alpha <= 1:
        raise ValueError("unknown window or bad parameter")
    d = float(max(1, n - 1 if symmetric else n))
    t = i * (2 * math.pi / d)
    if kind == "rectangular" or n == 1:
        return F.lit(1.0)
    if kind == "hann":
        return 0.5 * (1 - F.cos(t))
    if kind == "hamming":
        return 0.54 - 0.46 * F.cos(t)
    if kind == "blackman":
        return 0.42 - 0.5 * F.cos(t) + 0.08 * F.cos(2 * t)
    if kind == "blackman_harris":
        return 0.35875 - 0.48829 * F.cos(t) + 0.14128 * F.cos(2 * t) - 0.01168 * F.cos(3 * t)
    if kind == "bartlett":
        return F.when(i <= d / 2, 2 * i / d).otherwise(2 - 2 * i / d)
    if kind == "welch":
        h = (n - 1) / 2
        return 1 - ((i - h) / h) * ((i - h) / h)
    if kind == "kaiser":
        a = 2 * i / d - 1
        return _i0(beta * F.sqrt(F.greatest(1 - a * a, F.lit(0.0)))) / bessel_i0(beta)
    taper = int(alpha * n / 2)
    if not taper:
        return F.lit(1.0)
    ramp = lambda k: 0.5 * (1 - F.cos(math.pi / taper * k))
    return F.when(i < taper, ramp(i)).when(i >= n - taper, ramp(n - 1 - i)).otherwise(1.0)


def window_table(spark: SparkSession, n: int, kinds: tuple[str, ...] = TYPES, symmetric: bool = True) -> DataFrame:
    """(type, i, w): coefficients of each kind."""
    at = spark.range(n).select(F.col("id").alias("i"))
    pairs = F.array(*(F.struct(F.lit(k).alias("type"), coefficient(k, F.col("i").cast("double"), n, symmetric).alias("w")) for k in kinds))
    return at.select("i", F.explode(pairs).alias("p")).select("p.type", "i", "p.w")


def properties(windows: DataFrame) -> DataFrame:
    """Energy, gains, scallop loss and equivalent noise bandwidth of each window; sums run in order of the position, so they are the same on any partitioning."""
    w = windows.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("r")).select("type", F.transform("r", lambda x: x["w"]).alias("w"))
    w = w.select("type", F.size("w").alias("n"), total("w").alias("s"), squares("w").alias("q"))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    return w.select("type", q.alias("energy"), (s / n).alias("coherent_gain"), (q / n).alias("power_gain"), (10 * F.log10(q / n)).alias("processing_gain_db"), (n * q / (s * s)).alias("enbw"), (-20 * F.log10(F.abs(s / n))).alias("scallop_db"), (s / n > 0.5).alias("coherent"))


def normalized(windows: DataFrame) -> DataFrame:
    """The coefficients over their root mean square, so that a window's energy is its size."""
    own = Window.partitionBy("type")
    return windows.select("type", "i", (F.col("w") / F.sqrt(F.avg(F.col("w") * F.col("w")).over(own))).alias("w"))


def windowed(frames: DataFrame, kind: str, width: int, **parameters) -> DataFrame:
    """Frames (signal_id, frame, f) times a window's coefficients; a frame of another length is an error."""
    table = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: coefficient(kind, i.cast("double"), width, **parameters))
    product = F.zip_with("f", table, lambda a, b: a * b)
    sound = F.when(F.size("f") == width, product).otherwise(F.raise_error(F.lit(f"a frame is not of {width} samples")))
    return frames.select("signal_id", "frame", sound.alias("f"))
