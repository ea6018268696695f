"""Pitch classes: chroma, keys, chords, the tone network and profiles. Chroma vectors are arrays of twelve, from C."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, let, mean, safe, squares, total, variance
from ..functions.distance import METRICS, cosine_similarity, euclidean, manhattan, pearson_correlation

NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
#: Major and minor key profiles from C.
PROFILES = {
    "krumhansl": ((6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88), (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)),
    "temperley": ((5.0, 2.0, 3.5, 2.0, 4.5, 4.0, 2.0, 4.5, 2.0, 3.5, 1.5, 4.0), (5.0, 2.0, 3.5, 4.5, 2.0, 4.0, 2.0, 4.5, 3.5, 2.0, 1.5, 4.0)),
    "shaath": ((6.6, 2.0, 3.5, 2.3, 4.6, 4.0, 2.5, 5.2, 2.4, 3.7, 2.3, 3.4), (6.5, 2.7, 3.5, 5.4, 2.6, 3.5, 2.5, 4.7, 4.0, 2.7, 3.4, 3.2)),
    "edma": ((17.7661, 0.145624, 14.9265, 0.160186, 19.8049, 11.3587, 0.291248, 22.062, 0.145624, 8.15494, 0.232998, 4.95122), (18.2648, 0.737619, 14.0499, 16.8599, 0.702494, 14.4362, 0.702494, 18.6161, 4.56621, 1.93186, 7.37619, 1.75623)),
    "bgate": ((16.8, 0.86, 12.95, 1.41, 13.49, 11.93, 1.25, 20.28, 1.80, 8.04, 0.62, 10.57), (18.16, 0.69, 12.99, 13.34, 1.07, 11.15, 1.38, 21.07, 7.49, 1.53, 6.24, 1.61)),
    "diatonic": ((5.0, 0.0, 3.0, 0.0, 4.0, 3.5, 0.0, 4.5, 0.0, 3.0, 0.0, 2.0), (5.0, 0.0, 3.0, 3.5, 0.0, 3.5, 0.0, 4.5, 3.0, 0.0, 2.0, 0.0)),
    "tonic_triad": ((5.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0), (5.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 0.0)),
    "plain": ((1.0, 0.2, 0.6, 0.2, 0.8, 0.6, 0.2, 1.0, 0.2, 0.6, 0.2, 0.4), (1.0, 0.2, 0.4, 0.6, 0.2, 0.8, 0.2, 0.6, 0.8, 0.2, 0.4, 0.2)),
}
MAJOR, MINOR = PROFILES["krumhansl"]
#: Chord qualities with their intervals, weights and consonances.
CHORDS = {
    "major": ((0, 4, 7), 1.0), "minor": ((0, 3, 7), 1.0), "diminished": ((0, 3, 6), 0.8), "augmented": ((0, 4, 8), 0.7), "dominant7": ((0, 4, 7, 10), 0.9),
    "major7": ((0, 4, 7, 11), 0.85), "minor7": ((0, 3, 7, 10), 0.85), "sus2": ((0, 2, 7), 0.7), "sus4": ((0, 5, 7), 0.7), "power": ((0, 7), 0.6),
}
CONSONANCE = {"major": 0.9, "minor": 0.85, "diminished": 0.3, "augmented": 0.4, "dominant7": 0.7, "major7": 0.8, "minor7": 0.75, "sus2": 0.6, "sus4": 0.6, "power": 0.8}
#: Roles of chord qualities, and intervals that extend a chord.
ROLES = {"major": "tonic", "minor": "subdominant", "dominant7": "dominant", "diminished": "leading_tone"}
EXTENSIONS = (2, 5, 9, 10, 11)


def pitch_class(hz: Column, tuning: float = 440.0) -> Column:
    """Pitch class of a frequency, by the nearest semitone."""
    return F.pmod(F.round(69 + 12 * F.log2(hz / tuning)), F.lit(12.0)).cast("int")


def frame_chroma(spectra: DataFrame, rate: float, low: float = 80.0, high: float = 8000.0, tuning: float = 440.0) -> DataFrame:
    """(signal_id, frame, chroma): energy of each frame's bins between two frequencies by pitch class, scaled to sum 1 (zeros for a silent frame). In the row, without a shuffle."""

    def one(m):
        hz = lambda i: i * (rate / 2) / (F.size(m) - 1)
        bins = F.filter(F.transform(m, lambda v, i: F.struct(i.alias("i"), (v * v).alias("e"))), lambda b: (hz(b["i"]) >= low) & (hz(b["i"]) <= high))
        return F.transform(bins, lambda b: F.struct(pitch_class(hz(b["i"]), tuning).alias("pc"), b["e"].alias("e")))

    sums = lambda b: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.aggregate(b, F.lit(0.0), lambda s, x: s + F.when(x["pc"] == k, x["e"]).otherwise(0.0)))
    s = spectra.select("signal_id", "frame", let(let("m", one), sums).alias("c"))
    return s.select("signal_id", "frame", let(total("c"), lambda t: F.transform("c", lambda x: F.when(t > 1e-10, x / F.nullif(t, F.lit(0.0))).otherwise(x))).alias("chroma"))


def chroma(spectra: DataFrame, rate: float, low: float = 80.0, high: float = 8000.0) -> DataFrame:
    """(signal_id, chroma): mean of a signal's frame chromas, scaled to sum 1."""
    return mean_chroma(frame_chroma(spectra, rate, low, high))


def mean_chroma(frames: DataFrame) -> DataFrame:
    """(signal_id, chroma): mean vector of each signal's frames, scaled to sum 1; twelve partial averages, no arrays collected."""
    g = frames.groupBy("signal_id").agg(*(F.avg(F.col("chroma")[i]).alias(f"c{i}") for i in range(12)))
    t = sum(F.col(f"c{i}") for i in range(12))
    return g.withColumn("t", t).select("signal_id", F.array(*(safe(F.col(f"c{i}"), F.col("t")) for i in range(12))).alias("chroma"))


def chroma_frame_statistics(frames: DataFrame) -> DataFrame:
    """(signal_id, pc, mean, variance, energy): mean, population variance and sum of each pitch class over a signal's frames."""
    e = frames.select("signal_id", F.posexplode("chroma").alias("pc", "e"))
    return e.groupBy("signal_id", "pc").agg(F.avg("e").alias("mean"), F.var_pop("e").alias("variance"), F.sum("e").alias("energy"))


def dominant(c: Column) -> Column:
    """First position of the largest value."""
    return F.array_position(c, F.array_max(c)).cast("int") - 1


def turned(c: Column, k: Column | int) -> Column:
    """A vector turned left by k places."""
    n, k = F.size(c), (F.lit(k) if isinstance(k, int) else k)
    return let(F.pmod(k, n).cast("int"), lambda s: F.concat(F.slice(c, s + 1, n), F.slice(c, F.lit(1), s)))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """1 - d / 2 of a cosine or Pearson distance, else exp(-d)."""
    d = METRICS[metric](a, b)
    return 1 - d / 2 if metric in ("cosine", "pearson") else F.exp(-d)


def blended(a: Column, b: Column, share: float) -> Column:
    """A vector between two, ``share`` of the way (kept within 0 and 1)."""
    t = min(1.0, max(0.0, share))
    return F.zip_with(a, b, lambda x, y: x + t * (y - x))


def vector_figures(frames: DataFrame) -> DataFrame:
    """(signal_id, frame, energy, centroid, entropy, spread, dominant, peaks, sparsity, uniformity) of every frame's vector: L2 norm, mean
    position by weight, entropy in bits of the shares, population variance, first largest position, number of circular local maxima, share of values below a hundredth of
    the largest, and 1 / (1 + variance)."""
    c = F.col("chroma")
    n = F.size(c)
    s = frames.select("signal_id", "frame", "chroma", total(c).alias("t"), variance(c).alias("v"), F.array_max(c).alias("top"))
    weight = total(F.transform(c, lambda x, i: x * i))
    entropy = let(F.col("t"), lambda t: -total(F.transform(c, lambda x: F.when((x > 0) & (t > 0), x / F.nullif(t, F.lit(0.0)) * F.log2(x / F.nullif(t, F.lit(0.0)))).otherwise(0.0))))
    peaks = F.size(F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: (c[i] > c[F.pmod(i + 1, n)]) & (c[i] > c[F.pmod(i + n - 1, n)])), lambda x: x))
    sparse = let(F.col("top"), lambda top: F.size(F.filter(c, lambda x: x < 0.01 * top))) / n
    return s.select("signal_id", "frame", F.sqrt(squares(c)).alias("energy"), safe(weight, F.col("t")).alias("centroid"), entropy.alias("entropy"), F.col("v").alias("spread"), dominant(c).alias("dominant"), peaks.alias("peaks"), sparse.alias("sparsity"), (1 / (1 + F.col("v"))).alias("uniformity"))


def smoothed_chroma(frames: DataFrame, half: int = 2) -> DataFrame:
    """(signal_id, frame, chroma): centred moving means of the vectors, shorter at the ends."""
    w = Window.partitionBy("signal_id").orderBy("frame").rowsBetween(-half, half)
    return frames.select("signal_id", "frame", F.array(*(F.avg(F.col("chroma")[i]).over(w) for i in range(12))).alias("chroma"))


def _rotated(profile, k: int, mirrored: bool) -> Column:
    return F.array(*(F.lit(float(profile[(i + k) % 12 if mirrored else (i - k) % 12])) for i in range(12)))


def key_scores(chromas: DataFrame, profile: str = "krumhansl", compat: bool = False) -> DataFrame:
    """The frame's rows without chroma, 24 times, with key, mode and correlation; ``compat`` rotates the other way round."""
    options = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(mode).alias("mode"), _rotated(p, k, compat).alias("p")) for mode, p in zip(("major", "minor"), PROFILES[profile]) for k in range(12)))
    rest = [c for c in chromas.columns if c != "chroma"]
    return chromas.select(*rest, "chroma", F.explode(options).alias("o")).select(*rest, "o.key", "o.mode", F.round(pearson_correlation(F.col("chroma"), F.col("o.p")), 9).alias("correlation"))


def keys(chromas: DataFrame, compat: bool = False, profile: str = "krumhansl") -> DataFrame:
    """(signal_id, key, mode, correlation): the profile with the highest correlation."""
    return key_figures(chromas, compat, profile).select("signal_id", "key", "mode", "correlation")


def key_figures(chromas: DataFrame, compat: bool = False, profile: str = "krumhansl", least: float = 0.5) -> DataFrame:
    """The best key of every vector with its correlation, name (Unknown below ``least``), clarity, ambiguity and tonality.

    Clarity is the lead over the second as a share of the best (0 if that is not positive), ambiguity the entropy of the positive scores over that of
    24 equal ones, tonality 1 - 1 / (1 + variance of the vector).
    """
    rest = [c for c in chromas.columns if c != "chroma"]
    s = key_scores(chromas, profile, compat)
    x = F.col("correlation")
    positive = F.when(x > 0, x)
    best = F.max(F.struct(x.alias("r"), F.when(F.col("mode") == "major", 1).otherwise(0).alias("m"), (-F.col("key")).alias("k")))
    g = s.groupBy(*rest).agg(best.alias("b"), F.sort_array(F.collect_list(x), False).alias("all"), F.coalesce(F.sum(positive), F.lit(0.0)).alias("t"), F.coalesce(F.sum(positive * F.log2(positive)), F.lit(0.0)).alias("l"))
    g = g.join(chromas.select(*rest, variance("chroma").alias("v")), rest)
    key, r = -F.col("b.k"), F.col("b.r")
    mode = F.when(F.col("b.m") == 1, "major").otherwise("minor")
    name = F.when(r < least, "Unknown").otherwise(F.concat_ws(" ", F.get(F.array(*map(F.lit, NAMES)), key), mode))
    clarity = F.when(r > 0, safe(r - F.col("all")[1], r)).otherwise(0.0)
    ambiguity = F.when(F.col("t") > 0, (F.log2("t") - F.col("l") / F.nullif(F.col("t"), F.lit(0.0))) / math.log2(24)).otherwise(0.0)
    return g.select(*rest, key.alias("key"), mode.alias("mode"), r.alias("correlation"), name.alias("name"), clarity.alias("clarity"), ambiguity.alias("ambiguity"), (1 - 1 / (1 + F.col("v"))).alias("tonality"))


def _related(key: Column, mode: Column, to: Column, to_mode: Column) -> Column:
    """How a key relates to another."""
    same = mode == to_mode
    up = F.pmod(to - key, F.lit(12))
    relative = ~same & (up == F.when(mode == "major", 9).otherwise(3))
    return F.when((up == 0) & same, "same_key").when(up == 0, "parallel").when(relative, "relative").when(same & (up == 7), "dominant").when(same & (up == 5), "subdominant").otherwise("distant")


def key_transitions(frame_keys: DataFrame, least: float = 0.5) -> DataFrame:
    """(signal_id, frame, from_key, from_mode, key, mode, kind, distance, strength, confidence): from each frame's key to the next one's, where both
    correlations are above ``least``. Distance is 0 for the same or parallel key, 1 for a near relation, else semitones the shorter way."""
    w = Window.partitionBy("signal_id").orderBy("frame")
    s = frame_keys.select("signal_id", "frame", "key", "mode", "correlation", *(F.lag(c).over(w).alias(f"from_{c}") for c in ("key", "mode", "correlation")))
    s = s.where((F.col("correlation") > least) & (F.col("from_correlation") > least))
    kind = _related(F.col("from_key"), F.col("from_mode"), F.col("key"), F.col("mode"))
    up = F.pmod(F.col("key") - F.col("from_key"), F.lit(12))
    s = s.withColumn("kind", kind).withColumn("distance", F.when(F.col("kind").isin("same_key", "parallel"), 0).when(F.col("kind") != "distant", 1).otherwise(F.least(up, 12 - up)))
    return s.select("signal_id", "frame", "from_key", "from_mode", "key", "mode", "kind", "distance", (1 / (1 + F.col("distance"))).alias("strength"), ((F.col("correlation") + F.col("from_correlation")) / 2).alias("confidence"))


def global_key(frame_keys: DataFrame, least: float = 0.5) -> DataFrame:
    """(signal_id, key, mode, confidence, strength, stability): the key with the largest sum of correlations above ``least``, its share of all such, its sum
    over the number of frames, and the share of frames with the most frequent key. Ties go to the smaller key, major first."""
    votes = frame_keys.groupBy("signal_id", "key", "mode").agg(F.coalesce(F.sum(F.when(F.col("correlation") > least, F.col("correlation"))), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
    first = F.struct(F.round("s", 9).alias("s"), (-F.col("key")).alias("k"), F.when(F.col("mode") == "major", 1).otherwise(0).alias("m"))
    g = votes.groupBy("signal_id").agg(F.max(first).alias("b"), F.sum("s").alias("t"), F.sum("n").alias("n"), F.max("n").alias("most"))
    return g.select("signal_id", (-F.col("b.k")).alias("key"), F.when(F.col("b.m") == 1, "major").otherwise("minor").alias("mode"), safe(F.col("b.s"), F.col("t")).alias("confidence"), (F.col("b.s") / F.col("n")).alias("strength"), (F.col("most") / F.col("n")).alias("stability"))


def modulations(frames: DataFrame, half: int = 5, least: float = 0.7) -> DataFrame:
    """(signal_id, frame, key, mode): frames at which the key of the mean of the ten frames around them differs from that of the frame before,
    with a correlation above ``least``; frames with fewer than ten on either side are left out."""
    w = Window.partitionBy("signal_id").orderBy("frame")
    near = w.rowsBetween(-half, half - 1)
    s = frames.select("signal_id", "frame", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("signal_id")).alias("n"), F.array(*(F.avg(F.col("chroma")[i]).over(near) for i in range(12))).alias("chroma"))
    s = s.where((F.col("k") > 2 * half) & (F.col("k") <= F.col("n") - 2 * half)).select("signal_id", "frame", "chroma")
    k = key_figures(s).withColumn("name", F.concat("key", "mode"))
    return k.withColumn("was", F.lag("name").over(w)).where((F.col("was") != F.col("name")) & (F.col("correlation") > least)).select("signal_id", "frame", "key", "mode")


def chord_scores(chromas: DataFrame, bass: str | None = None, bass_weight: float = 0.3) -> DataFrame:
    """The frame's rows without chroma, 120 times, with root, quality and score; a ``bass`` column of pitch classes (null: none) adds its weight to the chords that hold it."""
    template = lambda root, iv: F.array(*(F.lit(1.0 if (i - root) % 12 in iv else 0.0) for i in range(12)))
    options = F.array(*(F.struct(F.lit(r).alias("root"), F.lit(q).alias("quality"), F.lit(w).alias("w"), template(r, iv).alias("t")) for q, (iv, w) in CHORDS.items() for r in range(12)))
    rest = [c for c in chromas.columns if c != "chroma"]
    s = chromas.select(*rest, "chroma", F.sqrt(squares("chroma")).alias("_l2"), F.explode(options).alias("o"))
    score = F.col("o.w") * safe(dot("chroma", F.col("o.t")), F.col("_l2"))
    if bass:
        score = score + F.coalesce(F.when(F.get(F.col("o.t"), F.col(bass)) > 0, bass_weight), F.lit(0.0))
    return s.select(*rest, "o.root", "o.quality", F.round(score, 9).alias("score"))


def chords(chromas: DataFrame, most: int = 5) -> DataFrame:
    """The frame's rows with root, quality, score and rank of the best weighted templates over the L2-normalised chroma."""
    rest = [c for c in chromas.columns if c != "chroma"]
    w = Window.partitionBy(*rest).orderBy(F.desc("score"), "root", "quality")
    return chord_scores(chromas).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def chord_figures(chromas: DataFrame) -> DataFrame:
    """The best chord of every vector with its name, clarity (lead over the second), consonance, role, tension and extensions.

    Extensions are the intervals 2, 5, 9, 10, 11 above the root that are not in the chord and hold more than 0.3 of the vector.
    """
    rest = [c for c in chromas.columns if c != "chroma"]
    top = chords(chromas, 2)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    g = top.groupBy(*rest).agg(at(1, "root").alias("root"), at(1, "quality").alias("quality"), at(1, "score").alias("score"), F.coalesce(at(2, "score"), F.lit(0.0)).alias("second"))
    g = g.join(chromas, rest)
    c = F.col("chroma")
    pick = lambda table, default: F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col("quality")], F.lit(default))
    suffix = F.when(F.col("quality") == "major", F.lit("")).otherwise(F.concat(F.lit(" "), "quality"))
    tones = F.create_map(*(x for q, (iv, _) in CHORDS.items() for x in (F.lit(q), F.array(*map(F.lit, iv)))))[F.col("quality")]
    more = F.filter(F.array(*map(F.lit, EXTENSIONS)), lambda i: (F.get(c, F.pmod(F.col("root") + i, F.lit(12))) > 0.3) & ~F.array_contains(tones, i))
    return g.select(*rest, "root", "quality", F.concat(F.get(F.array(*map(F.lit, NAMES)), F.col("root")), suffix).alias("name"), "score", (F.col("score") - F.col("second")).alias("clarity"), pick(CONSONANCE, 0.5).alias("consonance"), pick(ROLES, "other").alias("role"), tension(c).alias("tension"), more.alias("extensions"))


def inversions(chromas: DataFrame, bass: str) -> DataFrame:
    """The frame's rows with the best chord by templates that weigh the bass note 1.5, and its inversion (0: the root is the bass).

    Only chords whose notes hold the bass column's pitch class compete; rows without such a column value have no row.
    """
    rest = [c for c in chromas.columns if c != "chroma"]
    template = lambda root, iv, k: F.array(*(F.lit((1.5 if k and (i - root) % 12 == iv[k] else 1.0) if (i - root) % 12 in iv else 0.0) for i in range(12)))
    options = F.array(*(F.struct(F.lit(r).alias("root"), F.lit(q).alias("quality"), F.lit(k).alias("inversion"), F.lit((r + iv[k]) % 12).alias("low"), F.lit(w).alias("w"), template(r, iv, k).alias("t")) for q, (iv, w) in CHORDS.items() for r in range(12) for k in range(len(iv))))
    s = chromas.select(*rest, "chroma", F.sqrt(squares("chroma")).alias("_l2"), F.explode(options).alias("o")).where(F.col("o.low") == F.col(bass))
    s = s.select(*rest, "o.root", "o.quality", "o.inversion", F.round(F.col("o.w") * safe(dot("chroma", F.col("o.t")), F.col("_l2")), 9).alias("score"))
    w = Window.partitionBy(*rest).orderBy(F.desc("score"), "inversion", "root", "quality")
    return s.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def progression(frame_chords: DataFrame) -> DataFrame:
    """(signal_id, chords, changes, mean_score, common_quality): number of a signal's frame chords, of changes of name, mean score and most frequent quality (ties: the first by name)."""
    w = Window.partitionBy("signal_id").orderBy("frame")
    s = frame_chords.withColumn("was", F.lag("name").over(w))
    g = s.groupBy("signal_id").agg(F.count("*").alias("chords"), F.sum(F.when(F.col("was") != F.col("name"), 1).otherwise(0)).alias("changes"), F.avg("score").alias("mean_score"))
    q = s.groupBy("signal_id", "quality").agg(F.count("*").alias("n")).groupBy("signal_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "quality")).alias("b"))
    return g.join(q, "signal_id").select("signal_id", "chords", "changes", "mean_score", F.col("b.quality").alias("common_quality"))


def transitions(frame_chords: DataFrame) -> DataFrame:
    """(signal_id, step, n): how often each chord follows another, as "C -> G"."""
    w = Window.partitionBy("signal_id").orderBy("frame")
    s = frame_chords.select("signal_id", F.concat_ws(" -> ", F.lag("name").over(w), "name").alias("step"), F.lag("name").over(w).alias("was")).where("was IS NOT NULL")
    return s.groupBy("signal_id", "step").agg(F.count("*").alias("n"))


#: Rows of the tone network, by pitch class modulo 4.
ROWS = (0.0, math.sqrt(3), -math.sqrt(3) / 2, math.sqrt(3) / 2)


def tonnetz_point(pc: int) -> tuple[float, float]:
    """Place of a pitch class: fifths along x from -5 to 6, major-third rows along y."""
    fifths = pc * 7 % 12
    return (fifths if fifths <= 6 else fifths - 12), ROWS[pc % 4]


def tonnetz(chromas: DataFrame) -> DataFrame:
    """The frame's rows without chroma, with x and y: the centre of the chroma's weight on the tone network."""
    points = [tonnetz_point(pc) for pc in range(12)]
    lit = lambda axis: F.array(*(F.lit(float(p[axis])) for p in points))
    return chromas.select(*(c for c in chromas.columns if c != "chroma"), dot("chroma", lit(0)).alias("x"), dot("chroma", lit(1)).alias("y"))


def tonnetz_movement(places: DataFrame) -> DataFrame:
    """(signal_id, length, most, mean, variance, stability, efficiency, smooth, direction) of the path through a signal's frames (signal_id, frame, x, y).

    Efficiency is the distance from first to last place over the path's length, smooth the share of steps below 1, direction the share of turns whose
    cosine is above 0.5 among all pairs of consecutive steps (0 where undefined).
    """
    w = Window.partitionBy("signal_id").orderBy("frame")
    s = places.withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)}).withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    s = s.withColumns({c: F.lag(v).over(w) for c, v in (("px", "dx"), ("py", "dy"), ("pd", "d"))})
    cosine_ = safe(F.col("dx") * F.col("px") + F.col("dy") * F.col("py"), F.col("d") * F.col("pd"))
    ahead = (F.col("d") > 1e-10) & (F.col("pd") > 1e-10) & (cosine_ > 0.5)
    ends = lambda f, c: f(F.struct("frame", c))[c]
    g = s.groupBy("signal_id").agg(
        F.count("*").alias("n"), F.sum("d").alias("length"), F.max("d").alias("most"), F.avg("d").alias("mean"), F.var_pop("d").alias("variance"), F.avg(F.when(F.col("d") < 1, 1.0).when(F.col("d").isNotNull(), 0.0)).alias("smooth"),
        F.sum(F.when(ahead, 1.0).otherwise(0.0)).alias("ahead"), (ends(F.max, "x") - ends(F.min, "x")).alias("ex"), (ends(F.max, "y") - ends(F.min, "y")).alias("ey"),
    ).where("n > 1")
    far = F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey"))
    return g.select("signal_id", "length", "most", "mean", "variance", (1 / (1 + F.col("variance"))).alias("stability"), F.when(F.col("length") > 1e-10, far / F.nullif(F.col("length"), F.lit(0.0))).otherwise(0.0).alias("efficiency"), "smooth", safe(F.col("ahead"), F.col("n") - 2).alias("direction"))


def _pairs() -> list[tuple[int, int, float]]:
    p = [tonnetz_point(k) for k in range(12)]
    return [(i, j, math.dist(p[i], p[j])) for i in range(12) for j in range(i + 1, 12)]


def network_tension(chromas: DataFrame, near: float = 1.5) -> DataFrame:
    """The frame's rows without chroma, with tension (mean distance of two pitch classes by the product of their weights), consonance and dissonance
    (shares of the weight of pairs up to and beyond the distance ``near``)."""
    c = F.col("chroma")
    weight = lambda i, j: F.when(c[i] * c[j] > 1e-10, c[i] * c[j]).otherwise(0.0)
    t = sum(weight(i, j) for i, j, _ in _pairs())
    far = sum(weight(i, j) * d for i, j, d in _pairs())
    close = sum(weight(i, j) for i, j, d in _pairs() if d <= near)
    s = chromas.withColumns({"_t": t, "_f": far, "_c": close})
    rest = [x for x in chromas.columns if x != "chroma"]
    return s.select(*rest, safe(F.col("_f"), F.col("_t")).alias("tension"), safe(F.col("_c"), F.col("_t")).alias("consonance"), F.when(F.col("_t") > 0, 1 - safe(F.col("_c"), F.col("_t"))).otherwise(0.0).alias("dissonance"))


#: Steps between three neighbouring classes of a region, and what they make.
TRIADS = {"major_triad": ((4, 3), (3, 5), (5, 4)), "minor_triad": ((3, 4), (4, 5), (5, 3)), "diminished_triad": ((3, 3),), "augmented_triad": ((4, 4),)}


def harmonic_regions(chromas: DataFrame, threshold: float = 0.1, reach: float = 2.0) -> DataFrame:
    """The frame's rows without chroma, once a pitch class of at least ``threshold`` with two or more weighted neighbours within ``reach``: centre,
    energy, classes (sorted) and kind, by the steps between neighbouring classes; the first three that make a triad decide."""
    rest = [x for x in chromas.columns if x != "chroma"]
    places = [tonnetz_point(k) for k in range(12)]
    near = F.array(*(F.array(*(F.lit(j) for j in range(12) if math.dist(places[k], places[j]) <= reach)) for k in range(12)))
    s = chromas.select(*rest, "chroma", F.posexplode("chroma").alias("centre", "w")).where(F.col("w") >= threshold)
    s = s.withColumn("classes", F.filter(F.get(near, F.col("centre")), lambda j: (j == F.col("centre")) | (F.get("chroma", j) > 1e-10))).where(F.size("classes") >= 3)
    three = F.transform(F.sequence(F.lit(0), F.size("classes") - 3), lambda i: (F.get("classes", i + 1) - F.get("classes", i)) * 12 + F.get("classes", i + 2) - F.get("classes", i + 1))
    kinds = F.transform(three, lambda code: F.coalesce(*(F.when(code.isin(*(a * 12 + b for a, b in steps)), name) for name, steps in TRIADS.items())))
    first = F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0))
    kind = F.coalesce(first, F.when(F.size("classes") >= 4, "seventh_chord").otherwise("complex"))
    return s.select(*rest, "centre", total(F.transform("classes", lambda j: F.get("chroma", j))).alias("energy"), "classes", kind.alias("kind"))


def tension(c: Column) -> Column:
    """Sum of products at intervals 1, 6 and 11 of values above 0.2, at most 1."""
    return F.least(sum(F.when((c[i] > 0.2) & (c[(i + d) % 12] > 0.2), c[i] * c[(i + d) % 12]).otherwise(0.0) for i in range(12) for d in (1, 6, 11)), F.lit(1.0))


def chroma_statistics(chromas: DataFrame) -> DataFrame:
    """(signal_id, dominant, strength, entropy, tension): largest pitch class, its share, entropy in bits, and the sum of
    products at intervals 1, 6 and 11 of shares above 0.2, at most 1."""
    c = F.col("chroma")
    entropy = -sum(F.when(c[i] > 0, c[i] * F.log2(c[i])).otherwise(0.0) for i in range(12))
    top = F.array_max(F.array(*(F.struct(F.round(c[i], 9).alias("e"), F.lit(-i).alias("k")) for i in range(12))))
    return chromas.select("signal_id", (-top["k"]).alias("dominant"), top["e"].alias("strength"), entropy.alias("entropy"), tension(c).alias("tension"))


DIATONIC = (0, 2, 4, 5, 7, 9, 11)


def profile_figures(chromas: DataFrame) -> DataFrame:
    """(signal_id, entropy, centroid, spread, uniformity, fifths, tonic_dominant, major_triad, minor_triad, diatonic) of pitch-class profiles.

    The centroid is the circular mean in semitones and the spread the root mean square distance from it; fifths is the correlation of the
    profile in order of fifths with exp(-0.3 k); triads are the largest geometric means of a triad's shares; diatonic is the largest share of a major scale.
    """
    c = F.col("chroma")
    a = [2 * math.pi * k / 12 for k in range(12)]
    s, co = sum(c[k] * math.sin(a[k]) for k in range(12)), sum(c[k] * math.cos(a[k]) for k in range(12))
    angle = F.atan2(s, co)
    p = chromas.withColumn("_m", F.when(angle < 0, angle + 2 * math.pi).otherwise(angle) * (6 / math.pi)).withColumn("_t", total(c))
    away = lambda k: F.least(F.abs(k - F.col("_m")), 12 - F.abs(k - F.col("_m")))
    spread = F.sqrt(safe(sum(c[k] * away(k) * away(k) for k in range(12)), F.col("_t")))
    entropy = -sum(F.when(c[k] > 1e-10, c[k] * F.log2(c[k])).otherwise(0.0) for k in range(12))
    uniform = 1 - F.sqrt(sum((c[k] - 1 / 12) * (c[k] - 1 / 12) for k in range(12)) / 12) * 12
    fifths = pearson_correlation(F.array(*(c[k * 7 % 12] for k in range(12))), F.array(*(F.lit(math.exp(-0.3 * k)) for k in range(12))))
    triad = lambda iv: F.greatest(*(F.pow(c[r] * c[(r + iv[0]) % 12] * c[(r + iv[1]) % 12], F.lit(1 / 3)) for r in range(12)))
    scale = F.greatest(*(sum(c[(r + i) % 12] for i in DIATONIC) for r in range(12)))
    return p.select("signal_id", entropy.alias("entropy"), F.col("_m").alias("centroid"), spread.alias("spread"), uniform.alias("uniformity"), fifths.alias("fifths"), F.greatest(*(c[k] * c[(k + 7) % 12] for k in range(12))).alias("tonic_dominant"), triad((4, 7)).alias("major_triad"), triad((3, 7)).alias("minor_triad"), safe(scale, F.col("_t")).alias("diatonic"))


def salient_classes(chromas: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(signal_id, pc, share, salience, rank): pitch classes of at least ``threshold``, with their share over the mean of their neighbours' (the share
    itself where those are silent), largest first."""
    c = F.col("chroma")
    s = chromas.select("signal_id", "chroma", F.posexplode("chroma").alias("pc", "share")).where(F.col("share") >= threshold)
    around = (F.get(c, F.pmod(F.col("pc") + 1, F.lit(12))) + F.get(c, F.pmod(F.col("pc") + 11, F.lit(12)))) / 2
    w = Window.partitionBy("signal_id").orderBy(F.desc(F.round("share", 9)), "pc")
    return s.select("signal_id", "pc", "share", F.when(around > 1e-10, F.col("share") / F.nullif(around, F.lit(0.0))).otherwise(F.col("share")).alias("salience"), F.row_number().over(w).alias("rank"))


def compare_profiles(a: Column, b: Column) -> Column:
    """Cosine similarity, Euclidean and Manhattan distance, correlation and symmetric divergence of two profiles, as a struct."""
    kl = lambda p, q: total(F.zip_with(p, q, lambda x, y: F.when((x > 1e-10) & (y > 1e-10), x * F.log(x / F.nullif(y, F.lit(0.0)))).otherwise(0.0)))
    return F.struct(cosine_similarity(a, b).alias("cosine"), euclidean(a, b).alias("euclidean"), manhattan(a, b).alias("manhattan"), pearson_correlation(a, b).alias("correlation"), ((kl(a, b) + kl(b, a)) / 2).alias("divergence"))


def best_transposition(a: Column, b: Column, metric: str = "pearson") -> Column:
    """(r, shift): the largest correlation (or similarity by another metric) of a with b turned right by ``shift`` semitones; ties go to the smallest shift."""
    score = pearson_correlation if metric == "pearson" else lambda x, y: similarity(x, y, metric)
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.struct(F.round(score(a, turned(b, 12 - k)), 9).alias("r"), (-k).alias("k"))))


def sequence_similarity(frames: DataFrame, pairs: DataFrame, threshold: float = 0.4, radius: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, ref_id, direct, binary, qmax, oti, shift): similarities of two signals' frame vectors.

    Over all pairs of frames: the mean, the share above ``threshold``, the largest; and, for the best of twelve turns of the query, the sum over pairs
    of frames whose ranks differ by at most ``radius``, divided by the number of all pairs (ties go to the smaller turn).
    """
    w = Window.partitionBy("signal_id").orderBy("frame")
    f = frames.select("signal_id", (F.row_number().over(w) - 1).alias("k"), "chroma")
    q = f.select(F.col("signal_id").alias("query_id"), F.col("k").alias("i"), F.col("chroma").alias("q"))
    r = f.select(F.col("signal_id").alias("ref_id"), F.col("k").alias("j"), F.col("chroma").alias("r"))
    cells = pairs.join(q, "query_id").join(r, "ref_id")
    s = cells.withColumn("s", similarity(F.col("q"), F.col("r"), metric)).groupBy("query_id", "ref_id").agg(F.avg("s").alias("direct"), F.avg(F.when(F.col("s") > threshold, 1.0).otherwise(0.0)).alias("binary"), F.max("s").alias("qmax"), F.count("*").alias("n"))
    turns = cells.where(F.abs(F.col("i") - F.col("j")) <= radius).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(11))))
    t = turns.groupBy("query_id", "ref_id", "shift").agg(F.sum(similarity(turned(F.col("q"), F.col("shift")), F.col("r"), metric)).alias("t"))
    best = t.groupBy("query_id", "ref_id").agg(F.max(F.struct(F.round("t", 9).alias("t"), (-F.col("shift")).alias("k"))).alias("b"))
    return s.join(best, ["query_id", "ref_id"]).select("query_id", "ref_id", "direct", "binary", "qmax", (F.col("b.t") / F.col("n")).alias("oti"), (-F.col("b.k")).alias("shift"))


def local_alignment(frames: DataFrame, pairs: DataFrame, threshold: float = 0.4, gap: float = 0.1) -> DataFrame:
    """(query_id, ref_id, score, similarity): best local alignment of two signals' frame vectors by cosine similarity less ``threshold``, gaps at ``gap``; the
    similarity is the best score over the number of matched cells of its path. Two rows of the table are kept besides the path lengths."""
    import numpy as np

    from .alignment import _by_pair

    def one(q, r):
        a, b = (np.stack([np.asarray(v, float) for v in x]) for x in (q, r))
        unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
        s = (1 + unit(a) @ unit(b).T) / 2 - threshold
        h, length, best = np.zeros(len(b) + 1), np.zeros(len(b) + 1), (0.0, 1.0)
        for i in range(len(a)):
            new, steps = np.zeros(len(b) + 1), np.zeros(len(b) + 1)
            for j in range(1, len(b) + 1):
                moves = ((h[j - 1] + s[i, j - 1], length[j - 1] + 1), (h[j] - gap, length[j] + 1), (new[j - 1] - gap, steps[j - 1] + 1), (0.0, 0.0))
                new[j], steps[j] = max(moves, key=lambda m: m[0])
                if new[j] > best[0]:
                    best = (new[j], steps[j])
            h, length = new, steps
        return {"score": float(best[0]), "similarity": float(best[0] / best[1])}

    return _by_pair(_sequences(frames), pairs, "v", {"score": "double", "similarity": "double"}, one)


def _sequences(frames: DataFrame) -> DataFrame:
    g = frames.groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("frame", "chroma"))).alias("r"))
    return g.select("signal_id", F.transform("r", lambda x: x["chroma"]).alias("v"))


def warped_similarity(frames: DataFrame, pairs: DataFrame, band: int = 50) -> DataFrame:
    """(query_id, ref_id, similarity): exp(-mean distance along the warping path) of two signals' frame vectors."""
    import numpy as np

    from .alignment import _by_pair, dtw

    def one(q, r):
        total_, path, _ = dtw(np.stack([np.asarray(v, float) for v in q]), np.stack([np.asarray(v, float) for v in r]), band)
        return {"similarity": float(np.exp(-total_ / max(1, len(path))))}

    return _by_pair(_sequences(frames), pairs, "v", {"similarity": "double"}, one)


def hpcp(peaks: DataFrame, rate: float, bins: int, size: int = 12, width: float = 1.0, low: float = 40.0, high: float = 5000.0, split: float = 500.0, tuning: float = 440.0) -> DataFrame:
    """(signal_id, frame, chroma): pitch-class profiles from spectral peaks (place in bins of a one-sided spectrum): each peak's power spreads a cosine of
    ``width`` semitones around its fractional class, doubled below ``split``; L2-normalised. Frames without a peak in range have no row."""
    hz = F.col("place") * (rate / 2 / (bins - 1))
    p = peaks.withColumn("hz", hz).where((F.col("hz") >= low) & (F.col("hz") <= high))
    place = F.pmod(F.log2(F.col("hz") / tuning) * size + size * 0.75, F.lit(float(size)))
    p = p.withColumn("pc", place).withColumn("w", F.col("mag") * F.col("mag") * F.when(F.col("hz") < split, 2.0).otherwise(1.0))
    p = p.withColumn("bin", F.explode(F.sequence(F.floor(F.col("pc") - width / 2), F.ceil(F.col("pc") + width / 2))))
    share = F.greatest(F.lit(0.0), F.cos(math.pi * F.abs(F.col("pc") - F.col("bin")) / width))
    share = F.when(F.abs(F.col("pc") - F.col("bin")) <= width / 2, share).otherwise(0.0)
    b = F.pmod(F.col("bin"), F.lit(size))
    g = p.groupBy("signal_id", "frame").agg(*(F.sum(F.when(b == k, F.col("w") * share).otherwise(0.0)).alias(f"h{k}") for k in range(size)))
    norm = F.sqrt(sum(F.col(f"h{k}") * F.col(f"h{k}") for k in range(size)))
    return g.withColumn("n", norm).select("signal_id", "frame", F.array(*(safe(F.col(f"h{k}"), F.col("n")) for k in range(size))).alias("chroma"))


def constant_q(signals: DataFrame, rate: float, hop: int, low: float = 65.4, high: float = 2093.0, per_octave: int = 12, q: float = 25.0, tuning: float = 440.0) -> DataFrame:
    """(signal_id, frame, chroma): magnitudes at equally tempered frequencies by windowed complex exponentials of ``q`` periods each, folded to pitch
    classes and scaled to sum 1, by products with a fixed kernel in Arrow batches."""
    import numpy as np
    import pandas as pd

    freq = [low * 2 ** (k / per_octave) for k in range(int(per_octave * math.log2(min(high, rate / 2.001) / low)) + 1)]
    sizes = [max(4, int(math.ceil(q * rate / f))) for f in freq]
    pcs = np.array([int(round(69 + 12 * math.log2(f / tuning))) % 12 for f in freq])

    def run(batches):
        kernels = [np.hanning(n) * np.exp(-2j * np.pi * f / rate * np.arange(n)) / n for f, n in zip(freq, sizes)]
        for batch in batches:
            rows = []
            for sid, v in zip(batch["signal_id"], batch["v"]):
                x = np.asarray(v, float)
                for t in range(max(1, -(-len(x) // hop)) if len(x) else 0):
                    c = np.zeros(12)
                    for k, kernel in enumerate(kernels):
                        start = t * hop + hop // 2 - len(kernel) // 2
                        lo, hi = max(0, start), min(len(x), start + len(kernel))
                        if hi > lo:
                            c[pcs[k]] += abs(x[lo:hi] @ kernel[lo - start : hi - start]) ** 2
                    rows.append((sid, t, (c / c.sum() if c.sum() > 1e-10 else c).tolist()))
            yield pd.DataFrame(rows, columns=["signal_id", "frame", "chroma"])

    return signals.select("signal_id", "v").mapInPandas(run, "signal_id long, frame long, chroma array<double>")


def related_keys(key: int, mode: str) -> dict[str, tuple[int, str]]:
    """Relative, parallel, dominant and subdominant keys."""
    other = "minor" if mode == "major" else "major"
    return {"relative": ((key + (-3 if mode == "major" else 3)) % 12, other), "parallel": (key, other), "dominant": ((key + 7) % 12, mode), "subdominant": ((key - 7) % 12, mode)}


def key_distance(a: tuple[int, str], b: tuple[int, str]) -> int:
    """0 for the same or parallel key, 1 for a near relation, else semitones the shorter way round."""
    if a == b or b == related_keys(*a)["parallel"]:
        return 0
    if b in related_keys(*a).values():
        return 1
    d = (a[0] - b[0]) % 12
    return min(d, 12 - d)


def fitted(c: Column, size: int) -> Column:
    """A vector at another size, by the nearest smaller position."""
    n = F.size(c)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(c, F.floor(i * n / size).cast("int")))


def around_mean(c: Column) -> Column:
    """A vector less its mean."""
    return let(c, lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m)))


def above_mean(c: Column) -> Column:
    """1 where a vector is above its mean, else 0."""
    return F.transform(around_mean(c), lambda x: F.when(x > 0, 1.0).otherwise(0.0))


