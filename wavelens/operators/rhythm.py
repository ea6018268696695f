"""Envelopes over frames: activity, transients, index percentiles, attack and decay, tempo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import safe
from .temporal import by_signal, frame_rows

#: The tempi, in beats a minute, that intervals vote for.
TEMPI = (60, 70, 80, 90, 100, 110, 120, 130, 140, 150, 160, 170, 180, 200)


def frame_shape(samples: DataFrame, width: int = 16, hop: int = 8) -> DataFrame:
    """(signal_id, frame, peak, crest) of each complete frame of the centred signal."""
    return frame_rows(samples, width, hop).select("signal_id", "frame", "peak", safe(F.col("peak"), F.col("energy")).alias("crest"))


def activity(samples: DataFrame, width: int = 16, hop: int = 8, threshold: float = 60.0) -> DataFrame:
    """Per signal with a frame: share of silent frames, adaptive threshold, and the energy share of transient frames.

    The adaptive threshold is mean - 2 deviations of the frame RMS, or a tenth of the mean if that is negative; a frame is
    transient if its change exceeds mean + 2 deviations of all absolute changes.
    """
    f = frame_rows(samples, width, hop).select("signal_id", "frame", F.round("energy", 9).alias("e"))
    e, d = F.col("e"), F.col("d")
    f = f.withColumn("d", F.abs(e - F.lag("e").over(by_signal("frame"))))
    f = f.withColumn("limit", F.avg(d).over(by_signal()) + 2 * F.stddev_pop(d).over(by_signal()))
    low = F.avg(e) - 2 * F.stddev_pop(e)
    g = f.groupBy("signal_id").agg(F.avg(F.when(e < threshold, 1.0).otherwise(0.0)).alias("silence"), F.when(low < 0, 0.1 * F.avg(e)).otherwise(low).alias("threshold"), F.sum(F.when(d > F.col("limit"), e * e).otherwise(0.0)).alias("hit"), F.sum(e * e).alias("all"))
    return g.select("signal_id", "silence", "threshold", safe(F.col("hit"), F.col("all")).alias("transient"))


def at_share(values: str | Column, share: float) -> Column:
    """The sorted value at the truncated index share * (n - 1); null without values."""
    a = F.array_sort(F.col(values) if isinstance(values, str) else values)
    return F.get(a, F.floor(F.lit(share) * (F.size(a) - 1)).cast("int"))


def index_percentiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """(signal_id, a column a share): the sorted value at the truncated index share * (n - 1), by rank and not by arrays."""
    r = rows.select("signal_id", F.col(value).alias("x"), F.row_number().over(by_signal(value)).alias("k"), F.count("*").over(by_signal()).alias("n"))
    return r.groupBy("signal_id").agg(*(F.max(F.when(F.col("k") == F.floor(s * (F.col("n") - 1)) + 1, F.col("x"))).alias(name) for name, s in shares.items()))


def level_range(samples: DataFrame, width: int = 16, hop: int = 8, low: float = 0.1, high: float = 0.95, value: str = "energy") -> DataFrame:
    """(signal_id, low, high, range_db): index percentiles of the frame RMS (or peak) and their ratio in dB (0 where undefined)."""
    e = index_percentiles(frame_rows(samples, width, hop), value, {"low": low, "high": high})
    return e.withColumn("range_db", F.when((F.col("low") > 1e-10) & (F.col("high") > 1e-10), 20 * F.log10(F.col("high") / F.col("low"))).otherwise(0.0))


def loudness_range(samples: DataFrame, width: int = 16, hop: int = 4) -> DataFrame:
    """(signal_id, low_db, high_db, range_lu, ratio_db): 10th and 95th index percentiles of the frames' dB, their difference, and 20 log10 of
    their ratio where both are positive (else 0), as the level range does with its levels."""
    db = frame_rows(samples, width, hop).withColumn("db", 20 * F.log10(F.greatest("energy", F.lit(1e-10))))
    e = index_percentiles(db, "db", {"low_db": 0.1, "high_db": 0.95})
    lo, hi = F.col("low_db"), F.col("high_db")
    return e.select("signal_id", "low_db", "high_db", (hi - lo).alias("range_lu"), F.when((lo > 1e-10) & (hi > 1e-10), 20 * F.log10(hi / lo)).otherwise(0.0).alias("ratio_db"))


def tempo(onset_rows: DataFrame, ids: DataFrame, seconds: float, default: float = 120.0) -> DataFrame:
    """(signal_id, tempo, votes, category): intervals between onsets vote for the nearest tempo within 10 beats a minute.

    ``seconds`` is the length of a hop; intervals outside (0.2, 2) seconds do not vote. Ties go to the lower tempo; signals
    without a vote get the default.
    """
    w = by_signal("frame")
    bpm = F.col("bpm")
    t = onset_rows.withColumn("gap", (F.col("frame") - F.lag("frame").over(w)) * seconds).where("gap > 0.2 AND gap < 2").withColumn("bpm", 60 / F.col("gap"))
    near = F.array_min(F.array(*(F.struct(F.round(F.abs(bpm - c), 9).alias("d"), F.lit(float(c)).alias("tempo")) for c in TEMPI)))
    t = t.withColumn("near", near).where("near.d <= 10").groupBy("signal_id", F.col("near.tempo").alias("tempo")).agg(F.count("*").alias("votes"))
    best = t.groupBy("signal_id").agg(F.min(F.struct((-F.col("votes")).alias("n"), "tempo")).alias("b"))
    out = ids.join(best, "signal_id", "left").select("signal_id", F.coalesce("b.tempo", F.lit(default)).alias("tempo"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("votes"))
    return out.withColumn("category", tempo_category(F.col("tempo")))


def tempo_category(x: Column) -> Column:
    return F.when(x < 60, "very slow").when(x < 90, "slow").when(x < 120, "moderate").when(x < 150, "fast").otherwise("very fast")


def tempo_by_autocorrelation(frames: DataFrame, seconds: float, low: float = 60.0, high: float = 180.0) -> DataFrame:
    """(signal_id, lag, r, tempo): the lag, in hops of ``seconds``, at which the frame energies (signal_id, frame, energy) agree best with
    themselves, by mean product over the power; lags between the two tempi only. Signals with fewer frames have no row."""
    first, last = max(1, int(60 / high / seconds)), max(1, int(60 / low / seconds))
    e = frames.select("signal_id", "frame", F.col("energy").alias("e"))
    power = e.groupBy("signal_id").agg(F.avg(F.col("e") * F.col("e")).alias("p"))
    shifted = e.select("signal_id", F.col("e").alias("b"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("lag"), F.col("frame").alias("f")).withColumn("frame", F.col("f") - F.col("lag"))
    r = shifted.join(e, ["signal_id", "frame"]).groupBy("signal_id", "lag").agg(F.avg(F.col("e") * F.col("b")).alias("s"))
    r = r.join(power, "signal_id").select("signal_id", "lag", F.round(safe(F.col("s"), F.col("p")), 9).alias("r"))
    best = r.groupBy("signal_id").agg(F.max(F.struct("r", (-F.col("lag")).alias("k"))).alias("b"))
    return best.select("signal_id", (-F.col("b.k")).cast("long").alias("lag"), F.col("b.r").alias("r"), (60 / (-F.col("b.k") * seconds)).alias("tempo"))


def tempo_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(signal_id, tempo, confidence, spread): mean of two tempo estimates, 1 - difference / 50 (at least 0), and their difference."""
    j = a.select("signal_id", F.col("tempo").alias("x")).join(b.select("signal_id", F.col("tempo").alias("y")), "signal_id")
    d = F.abs(F.col("x") - F.col("y"))
    return j.select("signal_id", ((F.col("x") + F.col("y")) / 2).alias("tempo"), F.greatest(F.lit(0.0), 1 - d / 50).alias("confidence"), d.alias("spread"))


def attack_decay(samples: DataFrame, threshold: float, width: int = 16, hop: int = 8) -> DataFrame:
    """(signal_id, frame, attack, decay): for each local peak of the frame RMS at or above the threshold, frames since the level
    was last at a tenth of the threshold or less (else since the start) and until it is at a tenth of the peak (else the end).

    The frame a peak has decayed in is the first later one at or below its tenth; a join on the signal's peaks finds it.
    """
    w = by_signal("frame")
    f = frame_rows(samples, width, hop).select("signal_id", "frame", F.round("energy", 9).alias("e"))
    f = f.withColumns({"a": F.lag("e").over(w), "b": F.lead("e").over(w), "end": F.max("frame").over(by_signal()), "quiet": F.max(F.when(F.col("e") <= 0.1 * threshold, F.col("frame"))).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    peaks = f.where((F.col("a") < F.col("e")) & (F.col("e") > F.col("b")) & (F.col("e") >= threshold))
    later = f.select("signal_id", F.col("frame").alias("t"), F.col("e").alias("level"))
    fallen = peaks.join(later, "signal_id").where((F.col("t") > F.col("frame")) & (F.col("level") <= 0.1 * F.col("e"))).groupBy("signal_id", "frame").agg(F.min("t").alias("t"))
    j = peaks.join(fallen, ["signal_id", "frame"], "left")
    return j.select("signal_id", "frame", (F.col("frame") - F.coalesce("quiet", F.lit(0))).alias("attack"), (F.coalesce("t", "end") - F.col("frame")).alias("decay"))
