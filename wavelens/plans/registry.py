"""Queries of the signal operators and the DuckDB SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral, windows
from ..functions.distance import METRICS
from ..operators import alignment, matching, spectrum, stats, temporal, tonal
from ..sources import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RATE, WIDTH, HOP, BINS = 128.0, 16, 8, 64

SAMPLES = "s AS (SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v, value - avg(value) OVER (PARTITION BY user_id) AS x FROM events)"
FRAMES = f"""n AS (SELECT signal_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT signal_id, unnest(range(0, (n - {WIDTH}) // {HOP} + 1)) AS frame FROM n WHERE n >= {WIDTH}),
f AS (SELECT k.signal_id, k.frame, s.i - k.frame * {HOP} AS j, s.x FROM k JOIN s ON s.signal_id = k.signal_id AND s.i BETWEEN k.frame * {HOP} AND k.frame * {HOP} + {WIDTH - 1}),
fe AS (SELECT signal_id, frame, sqrt(sum(x * x) / {WIDTH}) AS energy FROM f GROUP BY 1, 2)"""
SPECTRA = "p AS (SELECT label AS signal_id, vec_id AS frame, unnest(range(0, len(embedding))) AS bin, abs(CAST(unnest(embedding) AS DOUBLE)) AS mag FROM embeddings)"
VECTORS = "e AS (SELECT vec_id AS id, label, unnest(range(0, len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _frame_rows(spark, d):
    return temporal.frame_energy(tables.samples(spark, d), WIDTH, HOP)


@query(
    "signal_profile",
    f"""WITH {SAMPLES}, {FRAMES},
c AS (SELECT signal_id, x, lag(x) OVER (PARTITION BY signal_id ORDER BY i) AS b FROM s),
a AS (SELECT signal_id, count(*) AS n, coalesce(sum(CASE WHEN b IS NOT NULL AND (x >= 0) <> (b >= 0) THEN 1.0 ELSE 0.0 END) / nullif(count(*) - 1, 0), 0) AS zcr, sqrt(sum(x * x) / count(*)) AS rms, max(abs(x)) AS peak,
 coalesce(20 * log10(max(CASE WHEN abs(x) > 1e-10 THEN abs(x) END) / min(CASE WHEN abs(x) > 1e-10 THEN abs(x) END)), 0) AS range_db FROM c GROUP BY 1),
g AS (SELECT signal_id, var_pop(energy * energy) AS ev, greatest(0, 1 - coalesce(stddev_pop(energy * energy) / nullif(avg(energy * energy), 0), 0)) AS st FROM fe GROUP BY 1)
SELECT a.signal_id, CAST(n AS BIGINT) AS n, {_r('zcr', 'zcr')}, {_r('rms', 'rms')}, {_r('peak', 'peak')}, {_r('coalesce(peak / nullif(rms, 0), 0)', 'crest')}, {_r('range_db', 'range_db')}, {_r('coalesce(ev, 0)', 'energy_variance', 3)}, {_r('coalesce(st, 1)', 'stability')}
FROM a LEFT JOIN g USING (signal_id)""",
)
def signal_profile(spark, d):
    p = temporal.profile(tables.samples(spark, d), WIDTH, HOP)
    return rounded(p.withColumn("energy_variance", F.round("energy_variance", 3)))


@query(
    "frame_energy",
    f"""WITH {SAMPLES}, {FRAMES},
z AS (SELECT signal_id, frame, sum(CASE WHEN (x >= 0) <> (b >= 0) THEN 1.0 ELSE 0.0 END) / {WIDTH - 1} AS zcr FROM (SELECT *, lag(x) OVER (PARTITION BY signal_id, frame ORDER BY j) AS b FROM f) WHERE b IS NOT NULL GROUP BY 1, 2)
SELECT fe.signal_id, CAST(fe.frame AS BIGINT) AS frame, {_r('energy', 'energy')}, {_r('zcr', 'zcr')}, {_r('20 * log10(greatest(energy, 1e-10))', 'log_energy')},
 {_r('coalesce(energy - lag(energy) OVER (PARTITION BY fe.signal_id ORDER BY fe.frame), 0)', 'delta')} FROM fe JOIN z USING (signal_id, frame)""",
)
def frame_energy(spark, d):
    return rounded(_frame_rows(spark, d))


@query(
    "energy_statistics",
    f"""WITH {SAMPLES}, {FRAMES}, q AS (SELECT signal_id, energy, energy / nullif(sum(energy) OVER (PARTITION BY signal_id), 0) AS p FROM fe)
SELECT signal_id, {_r('avg(energy)', 'mean')}, {_r('coalesce(var_samp(energy), 0)', 'variance')}, {_r('-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END)', 'entropy')}, {_r('min(energy)', 'low')}, {_r('max(energy)', 'high')} FROM q GROUP BY 1""",
)
def energy_statistics(spark, d):
    return rounded(temporal.energy_statistics(tables.samples(spark, d), WIDTH, HOP))


@query(
    "silence_segments",
    f"""WITH {SAMPLES}, {FRAMES},
t AS (SELECT signal_id, frame, CASE WHEN round(energy, 9) < 60 THEN 'silence' ELSE 'sound' END AS kind FROM fe),
u AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY signal_id ORDER BY frame) THEN 0 ELSE 1 END AS turn FROM t),
v AS (SELECT *, sum(turn) OVER (PARTITION BY signal_id ORDER BY frame) AS run FROM u)
SELECT signal_id, kind, CAST(min(frame) AS BIGINT) AS first, CAST(max(frame) AS BIGINT) AS last FROM v GROUP BY signal_id, run, kind""",
)
def silence_segments(spark, d):
    return temporal.segments(_frame_rows(spark, d), F.round("energy", 9) < 60)


@query(
    "onsets",
    f"""WITH {SAMPLES}, {FRAMES},
t AS (SELECT signal_id, frame, greatest(round(coalesce(energy - lag(energy) OVER (PARTITION BY signal_id ORDER BY frame), 0), 9), 0) AS rise FROM fe),
u AS (SELECT *, lag(rise) OVER (PARTITION BY signal_id ORDER BY frame) AS b, lead(rise) OVER (PARTITION BY signal_id ORDER BY frame) AS a, avg(rise) OVER (PARTITION BY signal_id) + stddev_pop(rise) OVER (PARTITION BY signal_id) AS lim FROM t)
SELECT signal_id, CAST(frame AS BIGINT) AS frame, {_r('rise', 'strength')} FROM u WHERE rise > b AND rise >= a AND rise >= lim""",
)
def onsets(spark, d):
    return rounded(temporal.onsets(_frame_rows(spark, d).withColumn("delta", F.round("delta", 9))))


_W = "(PARTITION BY signal_id ORDER BY i"


@query(
    "smoothed_envelope",
    f"""WITH {SAMPLES}, t AS (SELECT *, lag(x) OVER {_W}) AS b, lead(x) OVER {_W}) AS a, avg(x) OVER {_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS tr, avg(x) OVER {_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ce, list_sort(list(x) OVER {_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS near FROM s),
u AS (SELECT *, coalesce(CASE WHEN b IS NULL THEN a - x WHEN a IS NULL THEN x - b ELSE (a - b) / 2 END, 0) AS dd FROM t)
SELECT signal_id, CAST(i AS BIGINT) AS i, {_r('tr', 'trailing', 5)}, {_r('ce', 'centred', 5)}, {_r('near[(len(near) + 2) // 2]', 'median', 5)}, {_r('sqrt(x * x + dd * dd)', 'envelope', 5)} FROM u""",
)
def smoothed_envelope(spark, d):
    return rounded(temporal.smoothed(tables.samples(spark, d)).select("signal_id", "i", "trailing", "centred", "median", "envelope"), 5)


@query("pre_emphasis", f"WITH {SAMPLES} SELECT signal_id, CAST(i AS BIGINT) AS i, {_r('v - 0.97 * coalesce(lag(v) OVER ' + _W + '), 0)', 'y')} FROM s")
def pre_emphasis(spark, d):
    return rounded(temporal.pre_emphasis(tables.samples(spark, d), value="v").select("signal_id", "i", "y"))


@query(
    "normalized_samples",
    f"""WITH {SAMPLES}, g AS (SELECT signal_id, avg(v) AS m, coalesce(stddev_samp(v), 0) AS sd, min(v) AS lo, max(v) AS hi, sqrt(sum(v * v)) AS l2, max(abs(v)) AS pk, sqrt(avg(v * v)) AS rm FROM s GROUP BY 1)
SELECT signal_id, CAST(i AS BIGINT) AS i, {_r('coalesce((v - m) / nullif(sd, 0), 0)', 'z')}, {_r('coalesce((v - lo) / nullif(hi - lo, 0), 0)', 'unit')}, {_r('coalesce(v / nullif(l2, 0), 0)', 'energy')}, {_r('coalesce(v / nullif(pk, 0), 0)', 'peak')}, {_r('coalesce(v / nullif(rm, 0), 0)', 'rms')} FROM s JOIN g USING (signal_id)""",
)
def normalized_samples(spark, d):
    return rounded(temporal.normalized(tables.samples(spark, d)))


@query(
    "moments",
    f"""WITH {SAMPLES}, a AS (SELECT signal_id, v, avg(v) OVER (PARTITION BY signal_id) AS m FROM s),
b AS (SELECT signal_id, count(*) AS n, avg(v) AS mean, coalesce(var_samp(v), 0) AS variance, avg(power(v - m, 3)) AS m3, avg(power(v - m, 4)) AS m4, max(v) - min(v) AS rg FROM a GROUP BY 1)
SELECT signal_id, CAST(n AS BIGINT) AS n, {_r('mean', 'mean', 9)}, {_r('variance', 'variance', 4)}, {_r('coalesce(m3 / nullif(power(variance, 1.5), 0), 0)', 'skewness')}, {_r('coalesce(m4 / nullif(variance * variance, 0) - 3, 0)', 'kurtosis')}, {_r('rg', 'range')} FROM b""",
)
def moments(spark, d):
    return rounded(stats.moments(tables.samples(spark, d)).withColumns({"variance": F.round("variance", 4), "skewness": F.round("skewness", 6), "kurtosis": F.round("kurtosis", 6)}), 9)


_PCT = ", ".join(_r(f"quantile_cont(v, {q})", f"p{round(q * 100):02d}") for q in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))


@query(
    "percentiles",
    f"""WITH {SAMPLES} SELECT signal_id, {_PCT}, {_r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 'iqr')}, {_r('quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))', 'low_fence')},
{_r('quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))', 'high_fence')} FROM s GROUP BY 1""",
)
def percentiles(spark, d):
    return rounded(stats.percentiles(tables.samples(spark, d)))


@query(
    "entropies",
    f"""WITH {SAMPLES}, g AS (SELECT signal_id, count(*) AS n, min(v) AS lo, max(v) AS hi, ceil(sqrt(count(*))) AS bins FROM s GROUP BY 1),
h AS (SELECT signal_id, any_value(n) AS n, any_value(bins) AS bins, count(*) AS c FROM s JOIN g USING (signal_id) GROUP BY signal_id, least(coalesce(floor((v - lo) / nullif(hi - lo, 0) * bins), 0), bins - 1)),
q AS (SELECT signal_id, any_value(bins) AS bins, -sum(c / n * log2(c / n)) AS sh, sum(power(c / n, 2)) AS qq FROM h GROUP BY 1)
SELECT signal_id, CAST(bins AS BIGINT) AS bins, {_r('sh', 'shannon')}, {_r('-log2(qq)', 'renyi')}, {_r('1 - qq', 'tsallis')}, {_r('coalesce(sh / nullif(log2(bins), 0), 0)', 'evenness')} FROM q""",
)
def entropies(spark, d):
    return rounded(stats.entropies(tables.samples(spark, d)))


@query(
    "regression",
    f"""WITH {SAMPLES}, g AS (SELECT signal_id, covar_samp(v, i) AS cv, var_samp(i) AS vx, var_samp(v) AS vy, avg(i) AS mx, avg(v) AS my FROM s GROUP BY 1),
h AS (SELECT *, coalesce(cv / nullif(vx, 0), 0) AS k, coalesce(cv / nullif(sqrt(vx * vy), 0), 0) AS r FROM g)
SELECT signal_id, {_r('k', 'slope')}, {_r('my - k * mx', 'intercept')}, {_r('r', 'correlation')}, {_r('r * r', 'r2')}, {_r('coalesce(cv, 0)', 'covariance', 4)} FROM h""",
)
def regression(spark, d):
    return rounded(stats.regression(tables.samples(spark, d)).withColumn("covariance", F.round("covariance", 4)))


@query(
    "dft_power",
    f"""WITH {SAMPLES}, {FRAMES}, b AS (SELECT unnest(range(0, {WIDTH // 2 + 1})) AS bin)
SELECT signal_id, CAST(frame AS BIGINT) AS frame, CAST(bin AS BIGINT) AS bin, {_r(f'power(sum(x * cos(bin * j * 2 * pi() / {WIDTH})), 2) + power(sum(x * sin(bin * j * 2 * pi() / {WIDTH})), 2)', 'power', 3)} FROM f, b GROUP BY 1, 2, 3""",
)
def dft_power(spark, d):
    return rounded(spectrum.dft(tables.samples(spark, d), WIDTH, HOP).select("signal_id", "frame", "bin", "power"), 3)


_HZ = f"bin * {RATE} / {2 * (BINS - 1)}"


@query(
    "spectral_descriptors",
    f"""WITH {SPECTRA}, a AS (SELECT *, {_HZ} AS hz, sum(mag * mag) OVER (PARTITION BY frame ORDER BY bin) AS cum, sum(mag * mag) OVER (PARTITION BY frame) AS tot, sum(({_HZ}) * mag) OVER (PARTITION BY frame) / nullif(sum(mag) OVER (PARTITION BY frame), 0) AS c,
 CASE WHEN mag > 1e-10 AND bin > 0 THEN log10(mag) END AS ly, CASE WHEN mag > 1e-10 AND bin > 0 THEN log10({_HZ}) END AS lx FROM p),
b AS (SELECT signal_id, frame, any_value(coalesce(c, 0)) AS c, sqrt(coalesce(sum((hz - c) * (hz - c) * mag) / nullif(sum(mag), 0), 0)) AS bw, coalesce(min(CASE WHEN cum >= 0.85 * tot THEN hz END), 0) AS ro,
 CASE WHEN avg(mag) <= 1e-10 THEN 0 ELSE least(exp(avg(CASE WHEN mag > 1e-10 THEN ln(mag) END)) / avg(mag), 1) END AS fl, coalesce(max(mag) / nullif(sqrt(avg(mag * mag)), 0), 0) AS cr,
 coalesce((count(lx) * sum(lx * ly) - sum(lx) * sum(ly)) / nullif(count(lx) * sum(lx * lx) - sum(lx) * sum(lx), 0), 0) AS sl FROM a GROUP BY 1, 2)
SELECT signal_id, frame, {_r('c', 'centroid')}, {_r('bw', 'bandwidth')}, {_r('ro', 'rolloff')}, {_r('fl', 'flatness')}, {_r('CASE WHEN fl <= 1e-10 THEN -100 ELSE 10 * log10(fl) END', 'flatness_db')}, {_r('cr', 'crest')}, {_r('sl', 'slope')} FROM b""",
)
def spectral_descriptors(spark, d):
    return rounded(spectrum.descriptors(tables.spectra(spark, d), RATE))


@query(
    "spectral_flux",
    f"""WITH {SPECTRA}, o AS (SELECT label AS signal_id, vec_id AS frame, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
j AS (SELECT p.signal_id, p.frame, p.mag - q.mag AS dm FROM o JOIN p ON p.frame = o.frame JOIN p AS q ON q.frame = o.prev AND q.bin = p.bin)
SELECT signal_id, frame, {_r('sqrt(sum(CASE WHEN dm > 0 THEN dm * dm ELSE 0 END))', 'flux')}, {_r('sqrt(sum(dm * dm))', 'change')} FROM j GROUP BY 1, 2""",
)
def spectral_flux(spark, d):
    return rounded(spectrum.flux(tables.spectra(spark, d)))


_BANK = ", ".join(f"({m}, {b}, {w!r}::DOUBLE)" for m, row in enumerate(spectral.mel_bank(26, BINS, RATE)) for b, w in enumerate(row) if w)


@query(
    "mfcc",
    f"""WITH {SPECTRA}, bank(m, bin, w) AS (VALUES {_BANK}), ms AS (SELECT unnest(range(0, 26)) AS m), ks AS (SELECT unnest(range(0, 13)) AS kk),
e AS (SELECT signal_id, frame, m, sum(mag * mag * w) AS e FROM p JOIN bank USING (bin) GROUP BY 1, 2, 3), fr AS (SELECT DISTINCT signal_id, frame FROM p),
l AS (SELECT fr.signal_id, fr.frame, ms.m, ln(greatest(coalesce(e, 0), 1e-10)) AS l FROM fr CROSS JOIN ms LEFT JOIN e ON e.frame = fr.frame AND e.signal_id = fr.signal_id AND e.m = ms.m)
SELECT signal_id, frame, CAST(kk AS BIGINT) AS k, {_r("sum(l * cos(pi() * kk * (m + 0.5) / 26)) * sqrt(CASE WHEN kk = 0 THEN 1.0 ELSE 2.0 END / 26) * CASE WHEN kk = 0 THEN 1 ELSE 1 + 11 * sin(pi() * kk / 22) END", 'c', 5)} FROM l, ks GROUP BY signal_id, frame, kk""",
)
def mfcc(spark, d):
    return rounded(spectrum.cepstra(tables.spectra(spark, d), RATE, BINS), 5)


_WSQL = {
    "rectangular": "1.0", "hann": "0.5 * (1 - cos(t))", "hamming": "0.54 - 0.46 * cos(t)", "blackman": "0.42 - 0.5 * cos(t) + 0.08 * cos(2 * t)", "blackman_harris": "0.35875 - 0.48829 * cos(t) + 0.14128 * cos(2 * t) - 0.01168 * cos(3 * t)",
    "bartlett": "CASE WHEN i <= 31.5 THEN i / 31.5 ELSE 2 - i / 31.5 END", "welch": "1 - power((i - 31.5) / 31.5, 2)", "tukey": "CASE WHEN i < 16 THEN 0.5 * (1 - cos(pi() * i / 16)) WHEN i >= 48 THEN 0.5 * (1 - cos(pi() * (63 - i) / 16)) ELSE 1.0 END",
}
_WROWS = " UNION ALL ".join(f"SELECT '{k}' AS type, i, {sql} AS w FROM r" for k, sql in _WSQL.items())
_WCTE = f"r AS (SELECT i, i * 2 * pi() / 63 AS t FROM (SELECT unnest(range(0, 64)) AS i)), w AS ({_WROWS})"


@query("window_coefficients", f"WITH {_WCTE} SELECT type, CAST(i AS BIGINT) AS i, {_r('w', 'w')} FROM w")
def window_coefficients(spark, d):
    return rounded(windows.window_table(spark, 64, tuple(_WSQL)))


@query(
    "window_properties",
    f"""WITH {_WCTE}, l AS (SELECT type, list(w ORDER BY i) AS l FROM w GROUP BY 1), a AS (SELECT type, list_reduce(l, lambda x, y: x + y) AS s, list_reduce(list_transform(l, lambda x: x * x), lambda x, y: x + y) AS q FROM l)
SELECT type, {_r('q', 'energy', 9)}, {_r('s / 64', 'coherent_gain', 9)}, {_r('q / 64', 'power_gain', 9)}, {_r('10 * log10(q / 64)', 'processing_gain_db', 9)}, {_r('64 * q / (s * s)', 'enbw', 9)}, {_r('-20 * log10(abs(s / 64))', 'scallop_db', 9)}, s / 64 > 0.5 AS coherent FROM a""",
)
def window_properties(spark, d):
    return rounded(windows.properties(windows.window_table(spark, 64, tuple(_WSQL))), 9)


@query("normalized_windows", f"WITH {_WCTE} SELECT type, CAST(i AS BIGINT) AS i, {_r('w / sqrt(avg(w * w) OVER (PARTITION BY type))', 'w')} FROM w")
def normalized_windows(spark, d):
    return rounded(windows.normalized(windows.window_table(spark, 64, tuple(_WSQL))))


_CENTRE = f"{VECTORS}, ce AS (SELECT label, j, avg(x) AS c FROM e GROUP BY 1, 2)"
_PROB = """pr AS (SELECT id, label, j, CASE WHEN sx > 0 THEN px / sx ELSE 1.0 / n END AS p, CASE WHEN sc > 0 THEN pc / sc ELSE 1.0 / n END AS q FROM
 (SELECT *, greatest(x, 0) AS px, greatest(c, 0) AS pc, sum(greatest(x, 0)) OVER w AS sx, sum(greatest(c, 0)) OVER w AS sc, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY id))),
cu AS (SELECT *, sum(p - q) OVER (PARTITION BY id ORDER BY j) AS cd FROM pr)"""


@query(
    "centre_distances",
    f"""WITH {_CENTRE}, b AS (SELECT e.id, e.label, e.j, e.x, ce.c FROM e JOIN ce USING (label, j)), {_PROB},
g AS (SELECT id, any_value(label) AS label, sqrt(sum((x - c) * (x - c))) AS euclidean, sum(abs(x - c)) AS manhattan, max(abs(x - c)) AS chebyshev, power(sum(power(abs(x - c), 3)), 1.0 / 3) AS minkowski,
 1 - coalesce(sum(x * c) / nullif(sqrt(sum(x * x)) * sqrt(sum(c * c)), 0), 0) AS cosine, 1 - abs(coalesce(corr(x, c), 0)) AS pearson, sum(CASE WHEN abs(x - c) > 1e-10 THEN 1.0 ELSE 0.0 END) / count(*) AS hamming, sqrt(sum((x - c) * (x - c))) AS mahalanobis,
 1 - coalesce(sum(CASE WHEN abs(x) > 1e-10 AND abs(c) > 1e-10 THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN abs(x) > 1e-10 OR abs(c) > 1e-10 THEN 1.0 ELSE 0 END), 0), 1) AS jaccard,
 sum(coalesce(abs(x - c) / nullif(abs(x) + abs(c), 0), 0)) AS canberra, coalesce(sum(abs(x - c)) / nullif(sum(abs(x) + abs(c)), 0), 0) AS bray_curtis FROM b GROUP BY id),
h AS (SELECT id, sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END) AS kl_divergence, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) AS jensen_shannon,
 sqrt(sum(power(sqrt(p) - sqrt(q), 2))) / sqrt(2.0) AS hellinger, sum(abs(cd)) AS earth_movers, -ln(greatest(sum(sqrt(p * q)), 1e-10)) AS bhattacharyya FROM cu GROUP BY id)
SELECT id, label, {', '.join(_r(m, m) for m in METRICS)} FROM g JOIN h USING (id)""",
)
def centre_distances(spark, d):
    return rounded(matching.centre_distances(tables.vectors(spark, d)))


@query(
    "nearest_neighbours",
    f"""WITH {VECTORS}, nn AS (SELECT id, sqrt(sum(x * x)) AS l FROM e GROUP BY 1),
dd AS (SELECT q.id AS query_id, e.id AS id, sum(q.x * e.x) AS dp FROM e AS q JOIN e ON q.j = e.j AND q.id <> e.id WHERE q.id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, dd.id, round(1 - coalesce(dp / nullif(a.l * b.l, 0), 0), 9) AS distance FROM dd JOIN nn AS a ON a.id = query_id JOIN nn AS b ON b.id = dd.id)
SELECT query_id, id, {_r('distance', 'distance')}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM r) WHERE rank <= 5""",
)
def nearest_neighbours(spark, d):
    v = tables.vectors(spark, d)
    return rounded(matching.nearest(v.where("id % 20 = 0"), v, 5))


@query(
    "fingerprint_matches",
    f"""WITH {SPECTRA}, g AS (SELECT signal_id, bin, avg(mag) AS a, coalesce(stddev_samp(mag), 0) AS s FROM p GROUP BY 1, 2), l AS (SELECT signal_id, sqrt(sum(a * a + s * s)) AS l FROM g GROUP BY 1),
m AS (SELECT q.signal_id AS query_id, c.signal_id AS candidate_id, sum(q.a * c.a + q.s * c.s) AS dp FROM g AS q JOIN g AS c ON q.bin = c.bin AND q.signal_id <> c.signal_id GROUP BY 1, 2),
r AS (SELECT query_id, candidate_id, round(coalesce(dp / nullif(x.l * y.l, 0), 0), 9) AS similarity FROM m JOIN l AS x ON x.signal_id = query_id JOIN l AS y ON y.signal_id = candidate_id)
SELECT query_id, candidate_id, {_r('similarity', 'similarity')}, {_r('least(1.0, 0.5 + CASE WHEN similarity > 0.8 THEN 0.3 WHEN similarity > 0.6 THEN 0.2 ELSE 0 END + 0.05)', 'confidence')},
CASE WHEN similarity >= 0.95 THEN 'exact' WHEN similarity >= 0.85 THEN 'very_similar' WHEN similarity >= 0.75 THEN 'similar' WHEN similarity >= 0.6 THEN 'somewhat_similar' ELSE 'weak' END AS label, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS rank FROM r WHERE similarity >= 0.7) WHERE rank <= 50""",
)
def fingerprint_matches(spark, d):
    return rounded(matching.matches(matching.fingerprints(tables.spectra(spark, d))))


@query(
    "cluster_validity",
    f"""WITH {_CENTRE}, d AS (SELECT e.id, e.label, sqrt(sum((x - c) * (x - c))) AS d FROM e JOIN ce USING (label, j) GROUP BY 1, 2), per AS (SELECT label, avg(d) AS s, sum(d * d) AS ss, count(*) AS n FROM d GROUP BY 1),
cc AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM ce AS a JOIN ce AS b ON a.j = b.j AND a.label <> b.label GROUP BY 1, 2),
r AS (SELECT la, max((x.s + y.s) / m) AS r FROM cc JOIN per AS x ON x.label = la JOIN per AS y ON y.label = lb GROUP BY 1),
t AS (SELECT sum(v) AS total FROM (SELECT j, var_pop(x) * count(*) AS v FROM e GROUP BY 1)), w AS (SELECT sum(ss) AS within, sum(n) AS n, count(*) AS k FROM per)
SELECT {_r('(SELECT avg(r) FROM r)', 'davies_bouldin', 5)}, {_r('((total - within) / (k - 1)) / (within / (n - k))', 'calinski_harabasz', 5)} FROM t, w""",
)
def cluster_validity(spark, d):
    return rounded(matching.validity(tables.vectors(spark, d)), 5)


TONE = 8000.0
_PC = f"CAST((round(69 + 12 * log2(bin * {TONE / (2 * (BINS - 1))!r}e0 / 440)) % 12 + 12) % 12 AS INTEGER)"
_FRAME_CHROMA = f"""{SPECTRA}, twelve AS (SELECT unnest(range(0, 12)) AS pc), fs AS (SELECT DISTINCT signal_id, frame FROM p),
sm AS (SELECT signal_id, frame, {_PC} AS pc, sum(mag * mag) AS e FROM p WHERE bin > 0 AND bin * {TONE / (2 * (BINS - 1))!r}e0 BETWEEN 80 AND 8000 GROUP BY 1, 2, 3),
fc AS (SELECT signal_id, frame, twelve.pc AS pc, coalesce(e / sum(e) OVER (PARTITION BY signal_id, frame), 0) AS e FROM fs CROSS JOIN twelve LEFT JOIN sm USING (signal_id, frame, pc))"""
_CHROMA = f"{_FRAME_CHROMA}, ma AS (SELECT signal_id, pc, avg(e) AS a FROM fc GROUP BY 1, 2), c AS (SELECT signal_id, pc, coalesce(a / nullif(sum(a) OVER (PARTITION BY signal_id), 0), 0) AS e FROM ma)"
_KEYS = ", ".join(f"('{m}', {i}, {v})" for m, prof in (("major", tonal.MAJOR), ("minor", tonal.MINOR)) for i, v in enumerate(prof))
_CHORDS = ", ".join(f"('{q}', {w}, {i})" for q, (iv, w) in tonal.CHORDS.items() for i in iv)


def _chroma(spark, d):
    return tonal.chroma(tables.spectra(spark, d), TONE)


@query("chroma", f"WITH {_CHROMA} SELECT signal_id, CAST(pc AS INTEGER) AS pc, {_r('e', 'e')} FROM c")
def chroma(spark, d):
    return rounded(_chroma(spark, d).select("signal_id", F.posexplode("chroma").alias("pc", "e")))


@query(
    "key_estimate",
    f"""WITH {_CHROMA}, kp(mode, i, w) AS (VALUES {_KEYS}), ks AS (SELECT unnest(range(0, 12)) AS key),
s AS (SELECT signal_id, key, mode, round(corr(e, CAST(w AS DOUBLE)), 9) AS correlation FROM c, ks JOIN kp ON true WHERE kp.i = (c.pc - ks.key + 12) % 12 GROUP BY 1, 2, 3)
SELECT signal_id, CAST(key AS INTEGER) AS key, mode, {_r('correlation', 'correlation')} FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY correlation DESC, mode, key) AS k FROM s) WHERE k = 1""",
)
def key_estimate(spark, d):
    return rounded(tonal.keys(_chroma(spark, d)))


@query(
    "chord_candidates",
    f"""WITH {_CHROMA}, t(quality, w, i) AS (VALUES {_CHORDS}), rs AS (SELECT unnest(range(0, 12)) AS root), l AS (SELECT signal_id, sqrt(sum(e * e)) AS l FROM c GROUP BY 1),
s AS (SELECT c.signal_id, root, quality, round(any_value(CAST(w AS DOUBLE)) * sum(e) / any_value(l), 9) AS score FROM c JOIN l USING (signal_id), rs JOIN t ON true WHERE c.pc = (t.i + rs.root) % 12 GROUP BY 1, 2, 3)
SELECT signal_id, CAST(root AS INTEGER) AS root, quality, {_r('score', 'score')}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY score DESC, root, quality) AS rank FROM s) WHERE rank <= 5""",
)
def chord_candidates(spark, d):
    return rounded(tonal.chords(_chroma(spark, d)))


def _pairs(samples):
    ids = samples.select(F.col("signal_id").alias("query_id")).distinct()
    return ids.join(ids.select(F.col("query_id").alias("ref_id")), F.col("ref_id") == F.col("query_id") + 1)


_LAGS = f"""{SAMPLES}, lg AS (SELECT unnest(range(-8, 9)) AS lag),
c AS (SELECT q.signal_id AS query_id, r.signal_id AS ref_id, lag, count(*) AS n, coalesce(covar_pop(q.x, r.x) / nullif(sqrt(var_pop(q.x) * var_pop(r.x)), 0), 0) AS r FROM s AS q, lg JOIN s AS r ON true WHERE r.signal_id = q.signal_id + 1 AND r.i = q.i + lg.lag GROUP BY 1, 2, 3)"""


@query("lag_correlation", f"WITH {_LAGS} SELECT query_id, ref_id, CAST(lag AS BIGINT) AS lag, {_r('r', 'r')}, CAST(n AS BIGINT) AS n FROM c")
def lag_correlation(spark, d):
    s = tables.samples(spark, d)
    return rounded(alignment.lag_correlation(s, _pairs(s)))


@query(
    "best_lag",
    f"""WITH {_LAGS}, k AS (SELECT *, row_number() OVER w AS k, lead(r) OVER w AS second FROM c WINDOW w AS (PARTITION BY query_id, ref_id ORDER BY round(abs(r), 9) DESC, lag))
SELECT query_id, ref_id, CAST(lag AS BIGINT) AS lag, {_r('r', 'peak')}, {_r('coalesce(second, 0)', 'second')} FROM k WHERE k = 1""",
)
def best_lag(spark, d):
    s = tables.samples(spark, d)
    return rounded(alignment.best_lag(alignment.lag_correlation(s, _pairs(s))))


@query(
    "dtw_alignment",
    f"""WITH RECURSIVE {SAMPLES}, a AS (SELECT signal_id, list(v ORDER BY i) AS v FROM s GROUP BY 1), pr AS (SELECT q.signal_id AS query_id, r.signal_id AS ref_id, q.v AS q, r.v AS r, len(q.v) AS n, len(r.v) AS m FROM a AS q JOIN a AS r ON r.signal_id = q.signal_id + 1),
t AS (SELECT query_id, ref_id, q, r, n, m, 2 AS k, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 1 THEN abs(q[1] - r[1]) ELSE 1e300 END) AS d, list_transform(range(0, n + 1), lambda i: 1e300) AS o FROM pr
 UNION ALL SELECT query_id, ref_id, q, r, n, m, k + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN i < 1 OR k + 1 - i < 1 OR k + 1 - i > m THEN 1e300 ELSE abs(q[i] - r[k + 1 - i]) + least(d[i], d[i + 1], o[i]) END), d FROM t WHERE k < n + m)
SELECT query_id, ref_id, {_r('d[n + 1]', 'cost', 4)} FROM t WHERE k = n + m""",
)
def dtw_alignment(spark, d):
    s = tables.signals(spark, d)
    return rounded(alignment.warp(s, _pairs(s), 1 << 20).select("query_id", "ref_id", "cost"), 4)


@query(
    "stft_magnitudes",
    f"""WITH {SAMPLES}, {FRAMES}, b AS (SELECT unnest(range(0, {WIDTH // 2 + 1})) AS bin), g AS (SELECT f.signal_id, f.frame, f.j, s.v FROM f JOIN s ON s.signal_id = f.signal_id AND s.i = f.frame * {HOP} + f.j)
SELECT signal_id, CAST(frame AS BIGINT) AS frame, CAST(bin AS BIGINT) AS bin, {_r(f'sqrt(power(sum(v * cos(bin * j * 2 * pi() / {WIDTH})), 2) + power(sum(v * sin(bin * j * 2 * pi() / {WIDTH})), 2))', 'mag', 4)} FROM g, b GROUP BY 1, 2, 3""",
)
def stft_magnitudes(spark, d):
    m = spectrum.stft(tables.samples(spark, d), WIDTH, HOP)
    return rounded(m.select("signal_id", "frame", F.posexplode("m").alias("bin", "mag")).withColumn("bin", F.col("bin").cast("long")), 4)


from . import extended, further, likeness, tones, voices  # noqa: E402,F401  register their queries here
