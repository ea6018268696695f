"""Queries of rhythm, pitch, filters, peaks, clustering and content type; see ``registry`` for the shared SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance
from ..operators import clustering, content, filters, matching, peaks, pitch, rhythm, spectrum, temporal, tonal
from ..sources import tables
from .registry import _CHROMA, HOP, ORACLES, QUERIES, RATE, SAMPLES, FRAMES, SPECTRA, WIDTH, _chroma, _frame_rows, _r, query, rounded


@query("frame_shape", f"WITH {SAMPLES}, {FRAMES} SELECT signal_id, CAST(frame AS BIGINT) AS frame, {_r('max(abs(x))', 'peak')}, {_r(f'coalesce(max(abs(x)) / nullif(sqrt(sum(x * x) / {WIDTH}), 0), 0)', 'crest')} FROM f GROUP BY 1, 2")
def frame_shape(spark, d):
    return rounded(rhythm.frame_shape(tables.samples(spark, d), WIDTH, HOP))


@query(
    "frame_activity",
    f"""WITH {SAMPLES}, {FRAMES}, e AS (SELECT signal_id, frame, round(energy, 9) AS e FROM fe), d AS (SELECT *, abs(e - lag(e) OVER (PARTITION BY signal_id ORDER BY frame)) AS d FROM e),
l AS (SELECT signal_id, avg(d) + 2 * stddev_pop(d) AS lim FROM d GROUP BY 1)
SELECT signal_id, {_r('avg(CASE WHEN e < 60 THEN 1.0 ELSE 0.0 END)', 'silence')}, {_r('CASE WHEN avg(e) - 2 * stddev_pop(e) < 0 THEN 0.1 * avg(e) ELSE avg(e) - 2 * stddev_pop(e) END', 'threshold')},
 {_r('coalesce(sum(CASE WHEN d > lim THEN e * e ELSE 0 END) / nullif(sum(e * e), 0), 0)', 'transient')} FROM d JOIN l USING (signal_id) GROUP BY 1""",
)
def frame_activity(spark, d):
    return rounded(rhythm.activity(tables.samples(spark, d), WIDTH, HOP))


@query(
    "level_range",
    f"""WITH {SAMPLES}, {FRAMES}, l AS (SELECT signal_id, list_sort(list(energy)) AS e FROM fe GROUP BY 1), h AS (SELECT signal_id, e[CAST(floor(0.1 * (len(e) - 1)) AS INT) + 1] AS low, e[CAST(floor(0.95 * (len(e) - 1)) AS INT) + 1] AS high FROM l)
SELECT signal_id, {_r('low', 'low')}, {_r('high', 'high')}, {_r('CASE WHEN low > 1e-10 AND high > 1e-10 THEN 20 * log10(high / low) ELSE 0 END', 'range_db')} FROM h""",
)
def level_range(spark, d):
    return rounded(rhythm.level_range(tables.samples(spark, d), WIDTH, HOP))


_SECONDS = HOP / 32.0
_TEMPI = ", ".join(f"({c})" for c in rhythm.TEMPI)


@query(
    "tempo",
    f"""WITH o AS ({ORACLES['onsets']}), g AS (SELECT signal_id, row_number() OVER () AS id, 60 / ((frame - lag(frame) OVER (PARTITION BY signal_id ORDER BY frame)) * {_SECONDS}) AS bpm FROM o),
c(t) AS (VALUES {_TEMPI}), n AS (SELECT signal_id, t, row_number() OVER (PARTITION BY id ORDER BY round(abs(bpm - t), 9), t) AS k, abs(bpm - t) AS d FROM g, c WHERE 60 / bpm > 0.2 AND 60 / bpm < 2),
v AS (SELECT signal_id, t, count(*) AS votes FROM n WHERE k = 1 AND round(d, 9) <= 10 GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY votes DESC, t) AS k FROM v),
r AS (SELECT i.signal_id, CAST(coalesce(t, 120) AS DOUBLE) AS tempo, CAST(coalesce(votes, 0) AS BIGINT) AS votes FROM (SELECT DISTINCT user_id AS signal_id FROM events) AS i LEFT JOIN (SELECT * FROM b WHERE k = 1) AS b USING (signal_id))
SELECT signal_id, tempo, votes, CASE WHEN tempo < 60 THEN 'very slow' WHEN tempo < 90 THEN 'slow' WHEN tempo < 120 THEN 'moderate' WHEN tempo < 150 THEN 'fast' ELSE 'very fast' END AS category FROM r""",
)
def tempo(spark, d):
    on = temporal.onsets(_frame_rows(spark, d).withColumn("delta", F.round("delta", 9)))
    return rhythm.tempo(on, tables.samples(spark, d).select("signal_id").distinct(), _SECONDS)


@query(
    "autocorrelation_pitch",
    f"""WITH {SAMPLES}, lg AS (SELECT unnest(range(2, 17)) AS lag), z AS (SELECT signal_id, avg(x * x) AS p FROM s GROUP BY 1),
c AS (SELECT a.signal_id, lag, round(coalesce(avg(a.x * b.x) / nullif(any_value(p), 0), 0), 9) AS r FROM s AS a JOIN z ON z.signal_id = a.signal_id, lg JOIN s AS b ON true WHERE b.signal_id = a.signal_id AND b.i = a.i + lag GROUP BY 1, 2)
SELECT signal_id, CAST(lag AS BIGINT) AS lag, {_r('r', 'r')}, {_r(f'{RATE} / lag', 'f0')} FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY r DESC, lag) AS k FROM c) WHERE k = 1""",
)
def autocorrelation_pitch(spark, d):
    return rounded(pitch.autocorrelation_pitch(tables.signals(spark, d), RATE))


@query("fundamentals")
def fundamentals(spark, d):
    return pitch.fundamentals(tables.signals(spark, d), RATE, 4.0, 60.0)


@query("vocal_tract")
def vocal_tract(spark, d):
    return pitch.vocal_tract(tables.signals(spark, d), RATE)


@query(
    "voice_quality",
    f"""WITH {SAMPLES}, t AS (SELECT signal_id, v, v - lag(v) OVER (PARTITION BY signal_id ORDER BY i) AS d FROM s)
SELECT signal_id, {_r('100 * coalesce(avg(abs(d)) / nullif(avg(v), 0), 0)', 'perturbation')}, {_r('greatest(0, 1 - coalesce(stddev_pop(v) / nullif(avg(v), 0), 0))', 'steadiness')}, {_r('coalesce(sum(d * d) / nullif(sum(v * v), 0), 0)', 'noise')} FROM t GROUP BY 1""",
)
def voice_quality(spark, d):
    return rounded(pitch.voice_quality(tables.samples(spark, d)))


@query(
    "dc_removal",
    f"""WITH {SAMPLES}, t AS (SELECT signal_id, i, x - coalesce(lag(x) OVER (PARTITION BY signal_id ORDER BY i), 0) AS d FROM s)
SELECT a.signal_id, CAST(a.i AS BIGINT) AS i, {_r('sum(b.d * power(0.995, a.i - b.i))', 'y')} FROM t AS a JOIN t AS b ON a.signal_id = b.signal_id AND b.i <= a.i GROUP BY 1, 2""",
)
def dc_removal(spark, d):
    y = filters.recursive(tables.signals(spark, d).withColumn("v", temporal.centred()), filters.dc_removal())
    return rounded(y.select("signal_id", F.posexplode("y").alias("i", "y")).withColumn("i", F.col("i").cast("long")))


_B, _A = filters.band_pass(RATE, 16.0, 2.0)


@query(
    "band_pass",
    f"""WITH RECURSIVE {SAMPLES}, x AS (SELECT signal_id, i, {_B[0]!r}::DOUBLE * v + {_B[2]!r}::DOUBLE * coalesce(lag(v, 2) OVER (PARTITION BY signal_id ORDER BY i), 0) AS u FROM s),
t AS (SELECT signal_id, i, u AS y, 0.0::DOUBLE AS z FROM x WHERE i = 0 UNION ALL SELECT x.signal_id, x.i, x.u - ({_A[1]!r}::DOUBLE) * t.y - ({_A[2]!r}::DOUBLE) * t.z, t.y FROM t JOIN x ON x.signal_id = t.signal_id AND x.i = t.i + 1)
SELECT signal_id, CAST(i AS BIGINT) AS i, {_r('y', 'y')} FROM t""",
)
def band_pass(spark, d):
    y = filters.recursive(tables.signals(spark, d), (_B, _A))
    return rounded(y.select("signal_id", F.posexplode("y").alias("i", "y")).withColumn("i", F.col("i").cast("long")))


@query(
    "resampled",
    f"""WITH {SAMPLES}, g AS (SELECT signal_id, count(*) AS n FROM s GROUP BY 1), k AS (SELECT signal_id, n, k, round(k * (n - 1) / 31.0, 9) AS pos FROM g, (SELECT unnest(range(0, 32)) AS k))
SELECT k.signal_id, CAST(k AS BIGINT) AS k, {_r('a.v + (b.v - a.v) * (pos - floor(pos))', 'y')} FROM k JOIN s AS a ON a.signal_id = k.signal_id AND a.i = floor(pos) JOIN s AS b ON b.signal_id = k.signal_id AND b.i = least(floor(pos) + 1, n - 1)""",
)
def resampled(spark, d):
    return rounded(filters.resampled(tables.signals(spark, d), 32))


@query(
    "spectral_peaks",
    f"""WITH {SPECTRA}, t AS (SELECT *, lag(mag) OVER w AS a, lead(mag) OVER w AS c FROM p WINDOW w AS (PARTITION BY frame ORDER BY bin)), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY mag DESC, bin) AS rank FROM t WHERE mag > a AND mag > c)
SELECT signal_id, frame, CAST(bin AS BIGINT) AS bin, {_r('mag', 'mag')}, {_r('bin + coalesce((c - a) / nullif(2 * (2 * mag - a - c), 0), 0)', 'place')}, CAST(rank AS BIGINT) AS rank FROM k WHERE rank <= 5""",
)
def spectral_peaks(spark, d):
    return rounded(peaks.spectral_peaks(tables.spectra(spark, d)))


@query(
    "harmonic_product",
    f"""WITH {SPECTRA}, h AS (SELECT a.signal_id, a.frame, a.bin, round(2 * (ln(greatest(a.mag, 1e-10)) + ln(greatest(b.mag, 1e-10)) + ln(greatest(c.mag, 1e-10))), 9) AS s FROM p AS a JOIN p AS b ON b.frame = a.frame AND b.bin = 2 * a.bin JOIN p AS c ON c.frame = a.frame AND c.bin = 3 * a.bin WHERE a.bin > 0)
SELECT signal_id, frame, CAST(bin AS BIGINT) AS bin, {_r('s', 'strength')} FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY s DESC, bin) AS k FROM h) WHERE k = 1""",
)
def harmonic_product(spark, d):
    return rounded(peaks.harmonic_product(tables.spectra(spark, d)))


@query(
    "spectral_contrast",
    f"""WITH {SPECTRA}, b AS (SELECT *, CASE WHEN bin < 8 THEN 0 WHEN bin < 16 THEN 1 WHEN bin < 32 THEN 2 ELSE 3 END AS band FROM p),
o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY frame, band) AS n FROM b WINDOW w AS (PARTITION BY frame, band ORDER BY mag)),
g AS (SELECT signal_id, frame, band, avg(CASE WHEN k > n - ceil(0.2 * n) THEN mag END) AS top, avg(CASE WHEN k <= ceil(0.2 * n) THEN mag END) AS low FROM o GROUP BY 1, 2, 3)
SELECT signal_id, frame, CAST(band AS BIGINT) AS band, {_r('10 * log10((top + 1e-10) / (low + 1e-10))', 'contrast', 5)} FROM g""",
)
def spectral_contrast(spark, d):
    return rounded(peaks.spectral_contrast(tables.spectra(spark, d)), 5)


_NET = ", ".join(f"({pc}, {x}::DOUBLE, {y}::DOUBLE)" for pc in range(12) for x, y in [tonal.tonnetz_point(pc)])


@query("tonnetz", f"WITH {_CHROMA}, t(pc, x, y) AS (VALUES {_NET}) SELECT signal_id, {_r('sum(e * x)', 'x')}, {_r('sum(e * y)', 'y')} FROM c JOIN t USING (pc) GROUP BY 1")
def tonnetz(spark, d):
    return rounded(tonal.tonnetz(_chroma(spark, d)))


@query(
    "chroma_statistics",
    f"""WITH {_CHROMA}, t AS (SELECT a.signal_id, sum(CASE WHEN a.e > 0.2 AND b.e > 0.2 THEN a.e * b.e ELSE 0 END) AS t FROM c AS a JOIN c AS b ON a.signal_id = b.signal_id AND (b.pc - a.pc + 12) % 12 IN (1, 6, 11) GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY round(e, 9) DESC, pc) AS k FROM c)
SELECT signal_id, CAST(max(CASE WHEN k = 1 THEN pc END) AS INTEGER) AS dominant, {_r('max(e)', 'strength')}, {_r('-sum(CASE WHEN e > 0 THEN e * log2(e) ELSE 0 END)', 'entropy')}, {_r('least(any_value(t), 1.0)', 'tension')} FROM k JOIN t USING (signal_id) GROUP BY 1""",
)
def chroma_statistics(spark, d):
    return rounded(tonal.chroma_statistics(_chroma(spark, d)))


@query(
    "silhouettes",
    f"""WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.id, a.label, b.label AS other, sum(power(list_distance(a.v, b.v), 2)) AS s, count(*) AS n FROM v AS a, v AS b GROUP BY 1, 2, 3),
m AS (SELECT id, label, max(CASE WHEN other = label THEN n END) AS own, max(CASE WHEN other = label THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM p GROUP BY 1, 2)
SELECT id, label, {_r('CASE WHEN own > 1 THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0) ELSE 0 END', 'silhouette')} FROM m""",
)
def silhouettes(spark, d):
    return rounded(clustering.silhouettes(tables.vectors(spark, d)))


@query("k_means", "SELECT count(*) AS vectors, CAST(10 AS BIGINT) AS clusters, count(*) AS nearest FROM embeddings WHERE embedding IS NOT NULL")
def k_means(spark, d):
    """One row: vectors, clusters, and vectors that no other cluster's mean is nearer to than their own's."""
    v = tables.vectors(spark, d)
    got = clustering.k_means(v, 10)
    labelled = v.drop("label").join(got.withColumnRenamed("cluster", "label"), "id")
    c = matching.centres(labelled)
    x = matching.meet(labelled.select("id", "label", "v"), c.select(F.col("label").alias("other"), "c"), "other").withColumn("d", distance.euclidean(F.col("v"), F.col("c")))
    g = x.groupBy("id").agg(F.min("d").alias("least"), F.min(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("own"), F.count("*").alias("k"))
    return g.agg(F.count("*").alias("vectors"), F.max("k").alias("clusters"), F.sum(F.when(F.col("own") <= F.col("least") + 1e-6, 1).otherwise(0)).alias("nearest"))


SOUND = 8000.0
_HZ = SOUND / WIDTH
_CENTROID = f"""cb AS (SELECT unnest(range(0, {WIDTH // 2 + 1})) AS bin), cm AS (SELECT signal_id, frame, bin, sqrt(power(sum(x * cos(bin * j * 2 * pi() / {WIDTH})), 2) + power(sum(x * sin(bin * j * 2 * pi() / {WIDTH})), 2)) AS m FROM f, cb GROUP BY 1, 2, 3),
cs AS (SELECT signal_id, sum(bin * {_HZ!r}::DOUBLE * m) / nullif(sum(m), 0) AS centroid FROM cm GROUP BY 1)"""


@query(
    "content_types",
    f"""WITH {SAMPLES}, {FRAMES}, {_CENTROID}, b AS ({ORACLES['signal_profile']}), q AS (SELECT signal_id, r AS harmonic FROM ({ORACLES['autocorrelation_pitch']})), t AS (SELECT signal_id, silence FROM ({ORACLES['frame_activity']})),
g AS (SELECT b.signal_id, CASE WHEN zcr < 0.1 THEN 2.0 ELSE 0 END + CASE WHEN harmonic > 0.3 THEN 2.0 ELSE 0 END + CASE WHEN stability > 0.5 THEN 1.0 ELSE 0 END + CASE WHEN range_db > 20 THEN 1.0 ELSE 0 END AS music,
 CASE WHEN zcr > 0.05 AND zcr < 0.3 THEN 2.0 ELSE 0 END + CASE WHEN round(centroid, 6) > 800 AND round(centroid, 6) < 3000 THEN 2.0 ELSE 0 END + CASE WHEN harmonic < 0.2 THEN 1.0 ELSE 0 END + CASE WHEN silence > 0.1 AND silence < 0.4 THEN 1.0 ELSE 0 END AS speech,
 CASE WHEN energy_variance > 0.3 THEN 2.0 ELSE 0 END + CASE WHEN range_db > 30 THEN 1.5 ELSE 0 END + CASE WHEN stability < 0.4 THEN 1.0 ELSE 0 END AS sports FROM b LEFT JOIN q USING (signal_id) LEFT JOIN t USING (signal_id) LEFT JOIN cs USING (signal_id)),
u AS (SELECT signal_id, CAST(music AS DOUBLE) AS music, CAST(speech AS DOUBLE) AS speech, CAST(sports AS DOUBLE) AS sports, 0.9::DOUBLE * CAST(speech AS DOUBLE) AS talk FROM g), w AS (SELECT *, greatest(music, speech, sports, talk) AS m FROM u)
SELECT signal_id, {_r('music', 'music')}, {_r('speech', 'speech')}, {_r('sports', 'sports')}, {_r('talk', 'talk')}, CASE WHEN m <= 0 THEN 'unknown' WHEN music = m THEN 'music' WHEN speech = m THEN 'news' WHEN sports = m THEN 'sports' ELSE 'talk' END AS content_type FROM w""",
)
def content_types(spark, d):
    x = tables.samples(spark, d)
    p = rounded(temporal.profile(x, WIDTH, HOP).withColumn("energy_variance", F.round("energy_variance", 3)))
    h = QUERIES["autocorrelation_pitch"](spark, d).select("signal_id", F.col("r").alias("harmonic"))
    t = rounded(rhythm.activity(x, WIDTH, HOP)).select("signal_id", "silence")
    m = spectrum.dft(x, WIDTH, HOP).withColumn("m", F.sqrt("power"))
    c = m.groupBy("signal_id").agg(F.round(F.sum(F.col("bin") * _HZ * F.col("m")) / F.nullif(F.sum("m"), F.lit(0.0)), 6).alias("centroid"))
    return rounded(content.content_types(p.join(h, "signal_id", "left").join(t, "signal_id", "left").join(c, "signal_id", "left")))
