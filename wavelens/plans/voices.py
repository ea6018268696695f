"""Queries of pitch, speech, harmony and tracks on frames; see ``registry`` for the shared SQL. Frames and rates are small ones that the test tables have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import harmony, peaks, pitch, temporal
from ..sources import tables
from .registry import BINS, FRAMES, HOP, ORACLES, RATE, SAMPLES, SPECTRA, TONE, WIDTH, _frame_rows, _r, query, rounded


def _frames(spark, d):
    return temporal.framed(tables.samples(spark, d), WIDTH, HOP)


def _pitches(spark, d, method="acf"):
    return pitch.frame_pitch(_frames(spark, d), RATE, 8.0, 60.0, method, least=0.3)


for _name in pitch.METHODS:
    query(f"frame_pitch_{_name}")(lambda spark, d, m=_name: _pitches(spark, d, m))


@query("smoothed_pitch")
def smoothed_pitch(spark, d):
    return pitch.smoothed_pitch(_pitches(spark, d))


@query("pitch_stability")
def pitch_stability(spark, d):
    return pitch.pitch_stability(_pitches(spark, d), RATE / HOP)


@query("voice_periods")
def voice_periods(spark, d):
    return pitch.voice_periods(tables.signals(spark, d), RATE, 8.0, 60.0, WIDTH, HOP)


@query(
    "speech_gate",
    f"""WITH {SAMPLES}, t AS (SELECT *, lag(x) OVER (PARTITION BY signal_id ORDER BY i) AS b FROM s), g AS (SELECT signal_id, count(*) AS n, coalesce(sum(CASE WHEN (x >= 0) <> (b >= 0) THEN 1.0::DOUBLE ELSE 0 END) / nullif(count(*) - 1, 0), 0) AS zcr, sqrt(avg(x * x)) AS rms, sum(x * x) AS p FROM t GROUP BY 1),
lg AS (SELECT unnest(range(2, 17)) AS lag), r AS (SELECT a.signal_id, lag, sum(a.x * b.x) AS s FROM s AS a, lg JOIN s AS b ON true WHERE b.signal_id = a.signal_id AND b.i = a.i + lag GROUP BY 1, 2), m AS (SELECT signal_id, max(s / nullif(p, 0)) AS per FROM r JOIN g USING (signal_id) GROUP BY 1)
SELECT signal_id, n, {_r('zcr', 'zcr')}, {_r('rms', 'rms')}, {_r('coalesce(per, 0)', 'periodicity')}, n >= 32 AND zcr BETWEEN 0.01 AND 0.3 AND rms >= 0.001 AND coalesce(per, 0) > 0.1 AS speech FROM g LEFT JOIN m USING (signal_id)""",
)
def speech_gate(spark, d):
    return rounded(pitch.speech_gate(tables.samples(spark, d), RATE, (2, 16), 1 << 20))


@query("intelligibility")
def intelligibility(spark, d):
    g = pitch.speech_gate(tables.samples(spark, d), RATE, (2, 16)).select("signal_id", "speech")
    s = tables.signals(spark, d)
    tract = pitch.vocal_tract(s, RATE).select("signal_id", "formants", F.col("quality").alias("formant_quality"))
    voice = pitch.voice_periods(s, RATE, 8.0, 60.0, WIDTH, HOP).select("signal_id", F.col("quality").alias("voice_quality"), "hnr_db", "jitter", "shimmer", "age")
    out = pitch.intelligibility(g.join(tract, "signal_id").join(voice, "signal_id"))
    return out.select("signal_id", "speech", "speech_quality", "intelligibility", pitch.voice_gender(F.get("formants", F.lit(0)), F.get("formants", F.lit(1))).alias("gender"), "age")


@query(
    "spectral_tilt",
    f"""WITH {SAMPLES}, {FRAMES}, t AS (SELECT signal_id, frame, j, x, lag(x) OVER (PARTITION BY signal_id, frame ORDER BY j) AS b FROM f)
SELECT signal_id, CAST(frame AS BIGINT) AS frame, {_r('CASE WHEN sum(x * x) > 0 AND sum((x - b) * (x - b)) > 0 THEN -10 * log10(sum((x - b) * (x - b)) / sum(x * x)) ELSE 0 END', 'tilt')} FROM t WHERE b IS NOT NULL GROUP BY 1, 2""",
)
def spectral_tilt(spark, d):
    return rounded(pitch.spectral_tilt(_frames(spark, d)))


_SECONDS = HOP / 32.0


@query(
    "pauses",
    f"""WITH e AS (SELECT signal_id, frame, energy FROM ({ORACLES['frame_energy']})), l AS (SELECT signal_id, list_sort(list(energy)) AS l FROM e GROUP BY 1), k AS (SELECT signal_id, l[CAST(floor(len(l) / 10e0) AS INT) + 1] AS lim FROM l), f AS (SELECT e.signal_id, frame, energy <= lim AS q FROM e JOIN k USING (signal_id)),
sh AS (SELECT signal_id, avg(CASE WHEN q THEN 1.0::DOUBLE ELSE 0 END) AS silence FROM f GROUP BY 1), r AS (SELECT *, frame - row_number() OVER (PARTITION BY signal_id, q ORDER BY frame) AS run FROM f), u AS (SELECT signal_id, count(*) * {_SECONDS}::DOUBLE AS d FROM r WHERE q GROUP BY signal_id, run HAVING count(*) * {_SECONDS} > 0.1),
g AS (SELECT signal_id, count(*) AS n, max(d) AS mx, avg(d) AS mean FROM u GROUP BY 1)
SELECT signal_id, CAST(coalesce(n, 0) AS BIGINT) AS pauses, {_r('coalesce(mx, 0)', 'longest')}, {_r('coalesce(mean, 0)', 'mean')}, {_r('silence', 'silence')}, {_r('CASE WHEN silence < 1 THEN 4 * (1 - silence) ELSE 3 END', 'rate')} FROM sh LEFT JOIN g USING (signal_id)""",
)
def pauses(spark, d):
    p = pitch.pauses(rounded(_frame_rows(spark, d)), _SECONDS)
    return rounded(p.withColumn("pauses", F.col("pauses").cast("long")))


def _ratios(spark, d, method="hnr"):
    return harmony.harmonic_ratio(tables.spectra(spark, d), TONE, 200.0, 4000.0, method)


for _name in harmony.METHODS:
    query(f"harmonic_ratio_{_name}")(lambda spark, d, m=_name: _ratios(spark, d, m))


@query("smoothed_harmonic_ratio")
def smoothed_harmonic_ratio(spark, d):
    s = harmony.smoothed_series(_ratios(spark, d), "ratio_db")
    return s.select("signal_id", "frame", "ratio_db", "smooth", "stability", "coherence", harmony.ratio_class(F.col("ratio_db")).alias("class"), harmony.voicing_quality(F.col("ratio_db")).alias("quality"))


@query("mean_harmonic_ratio")
def mean_harmonic_ratio(spark, d):
    return harmony.mean_ratio(_ratios(spark, d))


def _with_f0(spark, d):
    s = tables.spectra(spark, d)
    f0 = peaks.harmonic_product(s).select("signal_id", "frame", (F.col("bin") * (TONE / 2 / (BINS - 1))).alias("f0"))
    return s.join(f0, ["signal_id", "frame"])


@query("inharmonicity")
def inharmonicity(spark, d):
    i = harmony.inharmonicity(_with_f0(spark, d), TONE, high=4000.0, tolerance=0.2)
    return i.withColumn("class", harmony.inharmonicity_class(F.col("inharmonicity")))


@query("mean_inharmonicity")
def mean_inharmonicity(spark, d):
    return harmony.mean_inharmonicity(harmony.inharmonicity(_with_f0(spark, d), TONE, high=4000.0, tolerance=0.2), 0.0)


def _peaks(spark, d):
    return rounded(peaks.spectral_peaks(tables.spectra(spark, d), 0.0, 8))


_PEAKS8 = ORACLES["spectral_peaks"].replace("rank <= 5", "rank <= 8")
_F0 = f"SELECT signal_id, frame, CAST(bin AS DOUBLE) AS f0 FROM ({ORACLES['harmonic_product']})"
_HARM = f"""pk AS ({_PEAKS8}), f0 AS ({_F0}), aj AS (SELECT pk.*, f0, CAST(greatest(1, least(20, round(place / f0))) AS INT) AS h FROM pk JOIN f0 USING (signal_id, frame) WHERE f0 > 0), hs AS (SELECT *, abs(place - h * f0) / (h * f0) AS dev FROM aj)"""


@query("harmonics", f"WITH {_HARM} SELECT signal_id, frame, bin, mag, place, rank, f0, h AS harmonic, {_r('dev', 'deviation')} FROM hs WHERE dev <= 0.05")
def harmonics(spark, d):
    f0 = peaks.harmonic_product(tables.spectra(spark, d)).select("signal_id", "frame", F.col("bin").cast("double").alias("f0"))
    return rounded(peaks.harmonics(_peaks(spark, d), f0))


@query(
    "harmonic_series",
    f"""WITH {_HARM}, a AS (SELECT * FROM hs WHERE dev <= 0.05)
SELECT signal_id, frame, count(*) AS n, {_r('sum(mag * mag)', 'energy')}, {_r('coalesce(sum(CASE WHEN h % 2 = 1 THEN mag * mag ELSE 0 END) / nullif(sum(CASE WHEN h % 2 = 0 THEN mag * mag ELSE 0 END), 0), 0)', 'odd_even', 5)}, {_r('coalesce(CASE WHEN var_pop(h) > 0 THEN regr_slope(CASE WHEN mag > 0 THEN ln(mag) END, CAST(h AS DOUBLE)) END, 0)', 'decay', 5)}, {_r('avg(dev)', 'inharmonicity')} FROM a GROUP BY 1, 2""",
)
def harmonic_series(spark, d):
    f0 = peaks.harmonic_product(tables.spectra(spark, d)).select("signal_id", "frame", F.col("bin").cast("double").alias("f0"))
    s = peaks.harmonic_series(peaks.harmonics(_peaks(spark, d), f0))
    return rounded(s.withColumns({c: F.round(c, 5) for c in ("odd_even", "decay")}))


@query(
    "subharmonics",
    f"""WITH pk AS ({_PEAKS8}), f0 AS ({_F0}), k AS (SELECT unnest(range(2, 6)) AS k) SELECT pk.*, f0, CAST(-k AS INTEGER) AS harmonic FROM pk JOIN f0 USING (signal_id, frame), k WHERE f0 > 0 AND abs(place - f0 / k) <= 0.05 * (f0 / k)""",
)
def subharmonics(spark, d):
    f0 = peaks.harmonic_product(tables.spectra(spark, d)).select("signal_id", "frame", F.col("bin").cast("double").alias("f0"))
    return rounded(peaks.subharmonics(_peaks(spark, d), f0))


@query("peak_figures", f"WITH pk AS ({_PEAKS8}) SELECT signal_id, frame, count(*) AS n, max(mag) AS largest, min(mag) AS smallest, {_r('avg(mag)', 'mean', 9)}, min(place) AS low, max(place) AS high FROM pk GROUP BY 1, 2")
def peak_figures(spark, d):
    return rounded(peaks.peak_figures(_peaks(spark, d)), 9)


@query("spaced_peaks")
def spaced_peaks(spark, d):
    return peaks.spaced_peaks(_peaks(spark, d), 4.0)


@query(
    "harmonic_strength",
    f"""WITH {SPECTRA}, f0 AS ({_F0}), l AS (SELECT signal_id, frame, list(mag ORDER BY bin) AS m FROM p GROUP BY 1, 2), k AS (SELECT unnest(range(1, 11)) AS k), x AS (SELECT l.signal_id, l.frame, m, k, CAST(f0 * k AS INT) AS b FROM l JOIN f0 ON f0.signal_id = l.signal_id AND f0.frame = l.frame, k WHERE f0 > 0 AND f0 * k <= {BINS - 1}),
e AS (SELECT signal_id, frame, sum(m[b + 1] * m[b + 1]) AS h, any_value(list_sum(list_transform(m, lambda v: v * v))) AS t FROM x GROUP BY 1, 2) SELECT signal_id, frame, {_r('least(1, h / t)', 'harmonicity')} FROM e""",
)
def harmonic_strength(spark, d):
    s = tables.spectra(spark, d)
    f0 = peaks.harmonic_product(s).select("signal_id", "frame", F.col("bin").cast("double").alias("f0"))
    return rounded(peaks.harmonic_strength(s, f0).select("signal_id", "frame", "harmonicity"))


def _tracks(spark, d):
    p = _peaks(spark, d).withColumn("signal_id", F.col("signal_id").cast("long"))
    return harmony.partial_tracks(p, TONE / 2 / (BINS - 1), 200.0, 1.0, 0.1)


@query("partial_tracks")
def partial_tracks(spark, d):
    return _tracks(spark, d)


@query("track_figures")
def track_figures(spark, d):
    return harmony.track_figures(_tracks(spark, d), HOP / RATE)


@query("melody")
def melody(spark, d):
    t = _tracks(spark, d)
    return harmony.melody(t, harmony.track_figures(t, HOP / RATE), 3, 0.0)
