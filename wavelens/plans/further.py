"""Queries of the further statistics, normalisations, frame figures, filters, spectral bands and metadata rules; see ``registry`` for the shared SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import spectral
from ..operators import clustering, content, filters, normalising, peaks, presets, rhythm, spectrum, stats, temporal
from ..sources import tables
from .registry import BINS, FRAMES, HOP, ORACLES, RATE, SAMPLES, SPECTRA, VECTORS, WIDTH, _frame_rows, _r, query, rounded

SHARES = (0.1, 0.5, 0.9)
_RANKED = f"{SAMPLES}, r AS (SELECT signal_id, list_sort(list(v)) AS e, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY 1)"


def _place(rule: str, q: float) -> str:
    h = stats.rank_sql(rule, q)
    a, b = f"e[CAST(floor({h}) AS INT)]", f"e[CAST(ceil({h}) AS INT)]"
    share = f"CASE WHEN ceil({h}) > floor({h}) THEN 0.5::DOUBLE ELSE 0 END" if rule == "midpoint" else f"({h} - floor({h}))"
    return _r(f"{a} + {share} * ({b} - {a})", f"{rule}_{round(q * 100):02d}")


@query("percentile_rules", f"WITH {_RANKED} SELECT signal_id, {', '.join(_place(rule, q) for rule in stats.RULES for q in SHARES)} FROM r")
def percentile_rules(spark, d):
    return rounded(stats.percentile_rules(tables.samples(spark, d), SHARES))


@query("percentile_rank", f"WITH {SAMPLES} SELECT signal_id, {_r('100 * avg(CASE WHEN v <= 50 THEN 1.0::DOUBLE ELSE 0 END)', 'rank')} FROM s GROUP BY 1")
def percentile_rank(spark, d):
    return rounded(stats.percentile_rank(tables.samples(spark, d), 50.0))


@query(
    "extremes",
    f"""WITH {SAMPLES}, q AS (SELECT signal_id, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM s GROUP BY 1)
SELECT signal_id, CAST(sum(CASE WHEN v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) THEN 1 ELSE 0 END) AS BIGINT) AS outliers, CAST(sum(CASE WHEN v < a - 3 * (b - a) OR v > b + 3 * (b - a) THEN 1 ELSE 0 END) AS BIGINT) AS extremes FROM s JOIN q USING (signal_id) GROUP BY 1""",
)
def extremes(spark, d):
    return stats.extremes(tables.samples(spark, d))


_M = ("raw2", "raw3", "central2", "central3", "central4", "absolute1", "absolute3", "cumulant4")


@query(
    "moment_shape",
    f"""WITH {_RANKED}, m AS (SELECT signal_id, avg(v) AS mean FROM s GROUP BY 1), g AS (SELECT s.signal_id, any_value(mean) AS mean, coalesce(stddev_samp(v), 0) AS sd, avg(v * v) AS raw2, avg(v * v * v) AS raw3, avg(power(v - mean, 2)) AS central2, avg(power(v - mean, 3)) AS central3,
 avg(power(v - mean, 4)) AS central4, avg(abs(v)) AS absolute1, avg(abs(v * v * v)) AS absolute3, median(v) AS med FROM s JOIN m USING (signal_id) GROUP BY 1),
h AS (SELECT signal_id, e, n, CAST(floor(0.1 * n) AS INT) AS cut, e[CAST(least(floor(0.25 * n) + 1, n) AS INT)] AS q1, e[CAST(least(floor(0.5 * n) + 1, n) AS INT)] AS q2, e[CAST(least(floor(0.75 * n) + 1, n) AS INT)] AS q3 FROM r)
SELECT signal_id, {_r('mean', 'mean', 9)}, {', '.join(_r(f'({c}) / 3141.59::DOUBLE', c, 5) for c in _M[:-1])}, {_r('(central4 - 3 * central2 * central2) / 3141.59::DOUBLE', 'cumulant4', 5)}, {_r('coalesce(central3 / nullif(sd * sd * sd, 0), 0)', 'standard3')}, {_r('coalesce(3 * (mean - med) / nullif(sd, 0), 0)', 'pearson_skewness')},
 {_r('CASE WHEN n < 4 THEN 0 ELSE coalesce((q3 + q1 - 2 * q2) / nullif(q3 - q1, 0), 0) END', 'bowley_skewness')}, {_r('list_avg(e[cut + 1:CAST(n AS INT) - cut])', 'trimmed')} FROM g JOIN h USING (signal_id)""",
)
def moment_shape(spark, d):
    m = stats.moment_shape(tables.samples(spark, d))
    m = m.withColumns({c: F.round(F.col(c) / 3141.59, 5) for c in _M} | {c: F.round(c, 6) for c in ("standard3", "pearson_skewness", "bowley_skewness", "trimmed")})
    return rounded(m, 9)


@query(
    "l_moments",
    f"""WITH {SAMPLES}, k AS (SELECT signal_id, v AS x, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY v) - 1 AS DOUBLE) AS i, CAST(count(*) OVER (PARTITION BY signal_id) AS DOUBLE) AS n FROM s), w AS (SELECT *, n - 1 - i AS j FROM k),
g AS (SELECT signal_id, any_value(n) AS n, sum(x) AS a, sum((i - j) * x) AS b, sum((j * (j - 1) / 2 - i * j + i * (i - 1) / 2) * x) AS c, sum((-j * (j - 1) * (j - 2) / 6 + i * j * (j - 1) / 2 - i * (i - 1) / 2 * j + i * (i - 1) * (i - 2) / 6) * x) AS e FROM w GROUP BY 1),
l AS (SELECT signal_id, a / n AS l1, coalesce(b / nullif(n * (n - 1), 0), 0) AS l2, coalesce(c / nullif(n * (n - 1) * (n - 2) / 2, 0), 0) AS l3, coalesce(e / nullif(n * (n - 1) * (n - 2) * (n - 3) / 6, 0), 0) AS l4 FROM g)
SELECT signal_id, {', '.join(_r(c, c) for c in ('l1', 'l2', 'l3', 'l4'))}, {_r('coalesce(l2 / nullif(l1, 0), 0)', 'ratio2')}, {_r('coalesce(l3 / nullif(l2, 0), 0)', 'ratio3')}, {_r('coalesce(l4 / nullif(l2, 0), 0)', 'ratio4')} FROM l""",
)
def l_moments(spark, d):
    return rounded(stats.l_moments(tables.samples(spark, d)))


_HIST = "least(coalesce(floor((v - lo) / nullif(hi - lo, 0) * bins), 0), bins - 1)"


@query(
    "further_entropies",
    f"""WITH {SAMPLES}, g AS (SELECT signal_id, min(v) AS lo, max(v) AS hi, ceil(sqrt(count(*))) AS bins FROM s GROUP BY 1), h AS (SELECT signal_id, any_value(bins) AS bins, CAST(count(*) AS DOUBLE) AS c FROM s JOIN g USING (signal_id) GROUP BY signal_id, {_HIST}),
a AS (SELECT signal_id, log2(any_value(bins)) AS hartley, -log2(max(c) / sum(c)) AS least_ FROM h GROUP BY 1),
df AS (SELECT signal_id, v - lag(v) OVER (PARTITION BY signal_id ORDER BY i) AS v FROM s), dd AS (SELECT * FROM df WHERE v IS NOT NULL), dg AS (SELECT signal_id, min(v) AS lo, max(v) AS hi, ceil(sqrt(count(*))) AS bins FROM dd GROUP BY 1),
dh AS (SELECT signal_id, CAST(count(*) AS DOUBLE) AS c FROM dd JOIN dg USING (signal_id) GROUP BY signal_id, {_HIST}), dr AS (SELECT signal_id, -sum(c / t * log2(c / t)) AS rate FROM (SELECT *, sum(c) OVER (PARTITION BY signal_id) AS t FROM dh) GROUP BY 1),
pr AS (SELECT signal_id, v AS x, lag(v) OVER (PARTITION BY signal_id ORDER BY i) AS b, min(v) OVER w AS lo, max(v) OVER w AS hi, greatest(2, floor(sqrt(count(*) OVER w))) AS bins FROM s WINDOW w AS (PARTITION BY signal_id)),
jo AS (SELECT signal_id, least(floor((x - lo) / ((hi - lo) / bins)), bins - 1) AS x, least(floor((b - lo) / ((hi - lo) / bins)), bins - 1) AS b, CAST(count(*) AS DOUBLE) AS c FROM pr WHERE b IS NOT NULL AND hi > lo GROUP BY 1, 2, 3),
co AS (SELECT signal_id, -sum(c / t * log2(c / m)) AS cond FROM (SELECT *, sum(c) OVER (PARTITION BY signal_id, b) AS m, sum(c) OVER (PARTITION BY signal_id) AS t FROM jo) GROUP BY 1)
SELECT a.signal_id, {_r('hartley', 'hartley')}, {_r('least_', 'least')}, {_r('coalesce(rate, 0)', 'rate')}, {_r('coalesce(cond, 0)', 'conditional')} FROM a LEFT JOIN dr USING (signal_id) LEFT JOIN co USING (signal_id)""",
)
def further_entropies(spark, d):
    return rounded(stats.further_entropies(tables.samples(spark, d)))


@query(
    "bin_counts",
    f"""WITH {_RANKED}, m AS (SELECT signal_id, avg(v) AS mean FROM s GROUP BY 1), g AS (SELECT s.signal_id, max(v) - min(v) AS rg, coalesce(stddev_samp(v), 0) AS sd, avg(power(v - mean, 3)) AS m3, avg(power(v - mean, 2)) AS m2 FROM s JOIN m USING (signal_id) GROUP BY 1),
h AS (SELECT g.*, n, e[CAST(least(floor(0.75 * n) + 1, n) AS INT)] - e[CAST(least(floor(0.25 * n) + 1, n) AS INT)] AS iqr, coalesce(m3 / nullif(power(m2, 1.5), 0), 0) AS sk, sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) AS sg FROM g JOIN r USING (signal_id))
SELECT signal_id, CAST(floor(log2(n)) + 1 AS BIGINT) AS sturges, CAST(CASE WHEN sd > 0 THEN ceil(rg / (3.49 * sd * power(n, -1e0 / 3))) ELSE 10 END AS BIGINT) AS scott, CAST(CASE WHEN iqr > 0 THEN ceil(rg / (2 * iqr * power(n, -1e0 / 3))) ELSE 10 END AS BIGINT) AS freedman,
 CAST(ceil(sqrt(n)) AS BIGINT) AS root, CAST(CASE WHEN sg > 0 THEN floor(1 + log2(n) + log2(1 + abs(sk) / sg)) ELSE 10 END AS BIGINT) AS doane FROM h""",
)
def bin_counts(spark, d):
    b = stats.bin_counts(tables.samples(spark, d).select("signal_id", "i", "v"))
    return b.select("signal_id", *(F.col(c).cast("long").alias(c) for c in ("sturges", "scott", "freedman", "root", "doane")))


_OVER = lambda x, dv, other: f"CASE WHEN abs({dv}) < 1e-10 THEN {other} ELSE ({x}) / nullif({dv}, 0) END"
_ROBUST = _OVER("v - med", "1.4826::DOUBLE * mad", "v - med")


@query(
    "scaled_samples",
    f"""WITH {SAMPLES}, g AS (SELECT signal_id, quantile_disc(v, 0.05) AS lo, quantile_disc(v, 0.95) AS hi, quantile_disc(v, 0.5) AS med, min(v) AS mn, max(v) AS mx, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, sqrt(avg(v * v)) AS rms, sqrt(sum(v * v)) AS l2, max(abs(v)) AS pk FROM s GROUP BY 1),
d AS (SELECT signal_id, quantile_disc(abs(v - med), 0.5) AS mad FROM s JOIN g USING (signal_id) GROUP BY 1)
SELECT signal_id, CAST(i AS BIGINT) AS i, {_r(_OVER('greatest(lo, least(hi, v)) - lo', 'hi - lo', 'v - lo'), 'quantile')}, {_r(_ROBUST, 'robust')}, {_r('-1 + 2 * coalesce((v - mn) / nullif(mx - mn, 0), 0)', 'span')}, {_r(_OVER('v * 0.1::DOUBLE', 'rms', 'v'), 'level')},
 {_r(f"CASE WHEN coalesce(pk / nullif(rms, 0), 0) > 10 THEN {_ROBUST} WHEN sd < 1e-6 THEN v - mean WHEN abs(mean) > 3 * sd THEN coalesce((v - mean) / nullif(sd, 0), 0) ELSE coalesce(v / nullif(l2, 0), 0) END", 'adaptive')}
FROM s JOIN g USING (signal_id) JOIN d USING (signal_id)""",
)
def scaled_samples(spark, d):
    return rounded(normalising.scaled(tables.samples(spark, d)))


@query(
    "loudness_gain",
    f"""WITH {SAMPLES}, n AS (SELECT signal_id, count(*) AS n FROM s GROUP BY 1), k AS (SELECT signal_id, unnest(range(0, (n - 16) // 4 + 1)) AS frame FROM n WHERE n >= 16), f AS (SELECT k.signal_id, k.frame, sqrt(avg(s.v * s.v)) AS e FROM k JOIN s ON s.signal_id = k.signal_id AND s.i BETWEEN k.frame * 4 AND k.frame * 4 + 15 GROUP BY 1, 2),
l AS (SELECT signal_id, -0.691 + 10 * log10(avg(e * e * power(10, -0.0691))) AS loudness FROM f WHERE e > 1e-10 GROUP BY 1)
SELECT n.signal_id, {_r('loudness', 'loudness')}, {_r('coalesce(power(10, (-23 - loudness) / 20), 1)', 'gain', 9)} FROM n LEFT JOIN l USING (signal_id)""",
)
def loudness_gain(spark, d):
    return rounded(normalising.loudness_gain(tables.samples(spark, d), -23.0, 16).withColumn("loudness", F.round("loudness", 6)), 9)


@query("frame_normalized")
def frame_normalized(spark, d):
    return normalising.by_frame(tables.samples(spark, d), WIDTH, HOP)


@query(
    "normalization_gains",
    f"""WITH {SAMPLES}, a AS (SELECT signal_id, avg(v) AS mb, coalesce(stddev_samp(v), 0) AS db, sqrt(avg(v * v)) AS rb, max(abs(v)) AS pb FROM s GROUP BY 1), y AS (SELECT signal_id, i, (v - mb) / nullif(db, 0) AS y FROM s JOIN a USING (signal_id)),
b AS (SELECT signal_id, avg(coalesce(y, 0)) AS ma, coalesce(stddev_samp(coalesce(y, 0)), 0) AS da, sqrt(avg(power(coalesce(y, 0), 2))) AS ra, max(abs(coalesce(y, 0))) AS pa FROM y GROUP BY 1)
SELECT signal_id, {', '.join(_r(a, n) for a, n in (('mb', 'mean_before'), ('db', 'deviation_before'), ('rb', 'rms_before'), ('pb', 'peak_before'), ('ma', 'mean_after'), ('da', 'deviation_after'), ('ra', 'rms_after'), ('pa', 'peak_after')))}, {_r('coalesce(ra / nullif(rb, 0), 0)', 'rms_gain')}, {_r('coalesce(pa / nullif(pb, 0), 0)', 'peak_gain')} FROM a JOIN b USING (signal_id)""",
)
def normalization_gains(spark, d):
    x = tables.samples(spark, d)
    return rounded(normalising.gains(x, temporal.normalized(x).select("signal_id", "i", F.col("z").alias("y"))))


@query("frame_kinds", f"WITH f0 AS ({ORACLES['frame_energy']}) SELECT signal_id, frame, CASE WHEN energy < 20 THEN 'silence' WHEN zcr < 0.1 THEN 'voiced' WHEN zcr < 0.4 THEN 'mixed' WHEN zcr < 0.7 THEN 'unvoiced' ELSE 'noise' END AS kind FROM f0")
def frame_kinds(spark, d):
    return temporal.frame_kinds(rounded(_frame_rows(spark, d)), 20.0).select("signal_id", "frame", "kind")


@query(
    "voice_segments",
    f"""WITH f0 AS ({ORACLES['frame_energy']}), t AS (SELECT signal_id, frame, energy >= 40 AND zcr BETWEEN 0.2 AND 0.6 AS on_ FROM f0), u AS (SELECT *, frame - row_number() OVER (PARTITION BY signal_id, on_ ORDER BY frame) AS run FROM t)
SELECT signal_id, CAST(min(frame) AS BIGINT) AS first, CAST(max(frame) AS BIGINT) AS last FROM u WHERE on_ GROUP BY signal_id, run HAVING count(*) >= 2""",
)
def voice_segments(spark, d):
    return temporal.voice_segments(rounded(_frame_rows(spark, d)), 40.0, 0.2, 0.6, 2)


@query("crossing_statistics", f"WITH f0 AS ({ORACLES['frame_energy']}), z AS (SELECT signal_id, zcr * {(WIDTH - 1) * RATE / WIDTH!r}::DOUBLE AS z FROM f0) SELECT signal_id, {_r('avg(z)', 'mean', 4)}, {_r('coalesce(var_samp(z), 0)', 'variance', 3)}, {_r('min(z)', 'low', 4)}, {_r('max(z)', 'high', 4)} FROM z GROUP BY 1")
def crossing_statistics(spark, d):
    c = temporal.crossing_statistics(rounded(_frame_rows(spark, d)), RATE, WIDTH)
    return rounded(c.withColumn("variance", F.round("variance", 3)), 4)


@query(
    "loud_crossings",
    f"""WITH {SAMPLES}, t AS (SELECT signal_id, x, lag(x) OVER (PARTITION BY signal_id ORDER BY i) AS b FROM s)
SELECT signal_id, {_r('coalesce(sum(CASE WHEN (x >= 0) <> (b >= 0) AND abs(x) > 10 AND abs(b) > 10 THEN 1.0::DOUBLE ELSE 0 END) / nullif(count(*) - 1, 0), 0)', 'zcr')} FROM t GROUP BY 1""",
)
def loud_crossings(spark, d):
    return rounded(temporal.loud_crossings(tables.samples(spark, d), 10.0))


@query(
    "energy_peaks",
    f"""WITH f0 AS ({ORACLES['frame_energy']}), t AS (SELECT *, lag(energy) OVER w AS a, lead(energy) OVER w AS b FROM f0 WINDOW w AS (PARTITION BY signal_id ORDER BY frame)) SELECT signal_id, frame, energy FROM t WHERE energy > a AND energy > b AND energy >= 60""",
)
def energy_peaks(spark, d):
    return temporal.energy_peaks(rounded(_frame_rows(spark, d)), 60.0)


@query(
    "energy_ratio",
    f"""WITH f0 AS ({ORACLES['frame_energy']}), {SAMPLES}, n AS (SELECT signal_id, count(*) AS n FROM s GROUP BY 1), k AS (SELECT signal_id, unnest(range(0, (n - {WIDTH}) // {HOP} + 1)) AS frame FROM n WHERE n >= {WIDTH}),
g AS (SELECT k.signal_id, k.frame, round(sqrt(avg(s.v * s.v)), 6) AS e FROM k JOIN s ON s.signal_id = k.signal_id AND s.i BETWEEN k.frame * {HOP} AND k.frame * {HOP} + {WIDTH - 1} GROUP BY 1, 2)
SELECT signal_id, frame, {_r('CASE WHEN e > 1e-10 THEN energy / e ELSE 0 END', 'ratio')} FROM f0 JOIN g USING (signal_id, frame)""",
)
def energy_ratio(spark, d):
    x = tables.samples(spark, d)
    raw = temporal.frame_rows(x, WIDTH, HOP, "v").withColumn("energy", F.round("energy", 6))
    return rounded(temporal.energy_ratio(rounded(_frame_rows(spark, d)), raw))


@query("onset_density", f"WITH o AS (SELECT signal_id, count(*) AS k FROM ({ORACLES['onsets']}) GROUP BY 1), n AS (SELECT user_id AS signal_id, count(*) AS n FROM events GROUP BY 1) SELECT signal_id, CAST(coalesce(k, 0) AS BIGINT) AS onsets, {_r(f'coalesce(k, 0) * {RATE}::DOUBLE / n', 'density')} FROM n LEFT JOIN o USING (signal_id)")
def onset_density(spark, d):
    on = temporal.onsets(_frame_rows(spark, d).withColumn("delta", F.round("delta", 9)))
    o = temporal.onset_density(on, tables.samples(spark, d), RATE)
    return rounded(o.withColumn("onsets", F.col("onsets").cast("long")))


@query(
    "spaced_onsets",
    f"""WITH RECURSIVE o AS ({ORACLES['onsets']}), k AS (SELECT signal_id, min(frame) AS frame FROM o GROUP BY 1 UNION ALL SELECT k.signal_id, (SELECT min(o.frame) FROM o WHERE o.signal_id = k.signal_id AND o.frame >= k.frame + 3) FROM k WHERE k.frame IS NOT NULL)
SELECT o.signal_id, o.frame, strength FROM k JOIN o ON o.signal_id = k.signal_id AND o.frame = k.frame""",
)
def spaced_onsets(spark, d):
    on = temporal.onsets(_frame_rows(spark, d).withColumn("delta", F.round("delta", 9)))
    return rounded(temporal.spaced(on, 3))


_LOUD = f"""{SAMPLES}, n AS (SELECT signal_id, count(*) AS n FROM s GROUP BY 1), k AS (SELECT signal_id, unnest(range(0, (n - 16) // 4 + 1)) AS frame FROM n WHERE n >= 16),
f AS (SELECT k.signal_id, k.frame, 20 * log10(greatest(sqrt(avg(s.x * s.x)), 1e-10)) AS e FROM k JOIN s ON s.signal_id = k.signal_id AND s.i BETWEEN k.frame * 4 AND k.frame * 4 + 15 GROUP BY 1, 2)"""


@query(
    "loudness_range",
    f"""WITH {_LOUD}, l AS (SELECT signal_id, list_sort(list(e)) AS e FROM f GROUP BY 1), h AS (SELECT signal_id, e[CAST(floor(0.1 * (len(e) - 1)) AS INT) + 1] AS lo, e[CAST(floor(0.95 * (len(e) - 1)) AS INT) + 1] AS hi FROM l)
SELECT signal_id, {_r('lo', 'low_db')}, {_r('hi', 'high_db')}, {_r('hi - lo', 'range_lu')}, {_r('CASE WHEN lo > 1e-10 AND hi > 1e-10 THEN 20 * log10(hi / lo) ELSE 0 END', 'ratio_db')} FROM h""",
)
def loudness_range(spark, d):
    return rounded(rhythm.loudness_range(tables.samples(spark, d)))


_SECONDS = HOP / 32.0


@query(
    "tempo_autocorrelation",
    f"""WITH e AS (SELECT signal_id, frame, energy AS e FROM ({ORACLES['frame_energy']})), lg AS (SELECT unnest(range({int(60 / 180 / _SECONDS)}, {int(60 / 60 / _SECONDS) + 1})) AS lag), p AS (SELECT signal_id, avg(e * e) AS p FROM e GROUP BY 1),
r AS (SELECT a.signal_id, lag, round(coalesce(avg(a.e * b.e) / nullif(any_value(p), 0), 0), 9) AS r FROM e AS a JOIN p ON p.signal_id = a.signal_id, lg JOIN e AS b ON true WHERE b.signal_id = a.signal_id AND b.frame = a.frame + lag GROUP BY 1, 2)
SELECT signal_id, CAST(lag AS BIGINT) AS lag, {_r('r', 'r')}, {_r(f'60 / (lag * {_SECONDS}::DOUBLE)', 'tempo')} FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY r DESC, lag) AS k FROM r) WHERE k = 1""",
)
def tempo_autocorrelation(spark, d):
    return rounded(rhythm.tempo_by_autocorrelation(rounded(_frame_rows(spark, d)), _SECONDS))


@query("tempo_agreement", f"WITH a AS ({ORACLES['tempo']}), b AS ({ORACLES['tempo_autocorrelation']}) SELECT signal_id, {_r('(a.tempo + b.tempo) / 2', 'tempo')}, {_r('greatest(0, 1 - abs(a.tempo - b.tempo) / 50)', 'confidence')}, {_r('abs(a.tempo - b.tempo)', 'spread')} FROM a JOIN b USING (signal_id)")
def tempo_agreement(spark, d):
    from .registry import QUERIES

    return rounded(rhythm.tempo_agreement(QUERIES["tempo"](spark, d), tempo_autocorrelation(spark, d)))


@query(
    "attack_decay",
    f"""WITH e AS (SELECT signal_id, frame, round(energy, 6) AS e FROM ({ORACLES['frame_energy']})), t AS (SELECT *, lag(e) OVER w AS a, lead(e) OVER w AS b, max(frame) OVER (PARTITION BY signal_id) AS fin, max(CASE WHEN e <= 6 THEN frame END) OVER (PARTITION BY signal_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM e WINDOW w AS (PARTITION BY signal_id ORDER BY frame)),
p AS (SELECT * FROM t WHERE a < e AND e > b AND e >= 60), g AS (SELECT p.signal_id, p.frame, min(e.frame) AS t FROM p JOIN e ON e.signal_id = p.signal_id AND e.frame > p.frame AND e.e <= 0.1 * p.e GROUP BY 1, 2)
SELECT p.signal_id, p.frame, CAST(p.frame - coalesce(q, 0) AS BIGINT) AS attack, CAST(coalesce(t, fin) - p.frame AS BIGINT) AS decay FROM p LEFT JOIN g USING (signal_id, frame)""",
)
def attack_decay(spark, d):
    return rhythm.attack_decay(tables.samples(spark, d), 60.0, WIDTH, HOP)


@query(
    "overlap_added",
    f"""WITH {SAMPLES}, {FRAMES} SELECT signal_id, CAST(frame * {HOP} + j AS BIGINT) AS i, {_r(f"sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {WIDTH - 1})))", 'y', 5)} FROM f GROUP BY 1, 2""",
)
def overlap_added(spark, d):
    f = temporal.framed(tables.samples(spark, d), WIDTH, HOP)
    from ..functions import windows

    return rounded(temporal.overlap_added(windows.windowed(f, "hann", WIDTH).withColumnRenamed("f", "y"), HOP), 5)


@query("delayed", f"WITH {SAMPLES} SELECT signal_id, CAST(i AS BIGINT) AS i, {_r('0.75::DOUBLE * coalesce(lag(x, 2) OVER w, 0) + 0.25::DOUBLE * coalesce(lag(x, 3) OVER w, 0)', 'y', 9)} FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY i)")
def delayed(spark, d):
    return rounded(temporal.delayed(tables.samples(spark, d), 2.25).select("signal_id", "i", "y"), 9)


@query("downsampled", f"WITH {SAMPLES}, n AS (SELECT *, count(*) OVER (PARTITION BY signal_id) AS n FROM s) SELECT signal_id, CAST(i // 4 AS BIGINT) AS i, v FROM n WHERE i % 4 = 0 AND i // 4 < n // 4")
def downsampled(spark, d):
    return filters.downsampled(tables.samples(spark, d), 4).withColumn("i", F.col("i").cast("long"))


@query(
    "interpolated",
    f"""WITH {SAMPLES}, g AS (SELECT signal_id, list(v ORDER BY i) AS e, count(*) AS n FROM s GROUP BY 1), k AS (SELECT signal_id, e, n, k, k * ((n - 1) / 37e0) AS p FROM g, (SELECT unnest(range(0, 38)) AS k) WHERE n >= 4),
q AS (SELECT *, CAST(trunc(p) AS INT) AS i, p - trunc(p) AS t FROM k), h AS (SELECT *, e[i] AS a, e[i + 1] AS b, e[i + 2] AS c, e[i + 3] AS z FROM q)
SELECT signal_id, CAST(k AS BIGINT) AS k, {_r('CASE WHEN p <= 1 THEN e[i + 1] WHEN p >= n - 2 THEN e[n] ELSE ((-a + 3 * b - 3 * c + z) / 2) * t * t * t + (a - 2.5::DOUBLE * b + 2 * c - z / 2) * t * t + (c - a) / 2 * t + b END', 'y')} FROM h""",
)
def interpolated(spark, d):
    y = filters.interpolated(tables.signals(spark, d).where(F.size("v") >= 4), 38, "cubic")
    return rounded(y.select("signal_id", F.posexplode("y").alias("k", "y")).withColumn("k", F.col("k").cast("long")))


_SECTIONS = {"dc_removal": filters.dc_removal(), "band_pass": filters.band_pass(RATE, 16.0, 2.0), "emphasis": filters.emphasis(0.97)}


def _response_sql(b, a) -> tuple[str, str]:
    part = lambda c, f: " + ".join(f"({float(v)!r})::DOUBLE * {f}({k} * w)" for k, v in enumerate(c))
    return part(b, "cos"), part(b, "sin"), part(a, "cos"), part(a, "sin")


_RESP = " UNION ALL ".join(f"SELECT '{n}' AS filter, f, {p[0]} AS br, -({p[1]}) AS bi, {p[2]} AS ar, -({p[3]}) AS ai FROM w" for n, s in _SECTIONS.items() for p in [_response_sql(*s)])


@query(
    "filter_responses",
    f"""WITH w AS (SELECT k * {RATE / 2 / 32!r}::DOUBLE AS f, k * {RATE / 2 / 32!r}::DOUBLE * 2 * pi() / {RATE}::DOUBLE AS w FROM (SELECT unnest(range(1, 33)) AS k)), h AS ({_RESP}), c AS (SELECT filter, f, (br * ar + bi * ai) / (ar * ar + ai * ai) AS re, (bi * ar - br * ai) / (ar * ar + ai * ai) AS im FROM h)
SELECT filter, f AS frequency, {_r('sqrt(re * re + im * im)', 'magnitude')}, {_r('CASE WHEN f < 64 AND sqrt(re * re + im * im) > 1e-6 THEN atan2(im, re) ELSE 0 END', 'phase', 5)} FROM c""",
)
def filter_responses(spark, d):
    r = filters.responses(spark, _SECTIONS, RATE, 33).where("frequency > 0")
    r = r.withColumn("phase", F.when((F.col("frequency") < 64) & (F.col("magnitude") > 1e-6), F.round("phase", 5)).otherwise(0.0))
    return rounded(r)


@query(
    "best_emphasis",
    f"""WITH {SAMPLES}, t AS (SELECT signal_id, v, lag(v) OVER (PARTITION BY signal_id ORDER BY i) AS b FROM s), g AS (SELECT signal_id, count(*) AS n, sum(v * v) AS r0, sum(v * b) AS r1 FROM t GROUP BY 1)
SELECT signal_id, {_r('CASE WHEN n < 2 OR r0 = 0 THEN 0.97 ELSE greatest(0.8, least(0.99, r1 / r0)) END', 'coefficient')} FROM g""",
)
def best_emphasis(spark, d):
    return rounded(filters.best_emphasis(tables.samples(spark, d)))


_BARK = ", ".join(f"({m}, {b}, {w!r}::DOUBLE)" for m, row in enumerate(spectral.bark_bank(12, BINS, 16000.0)) for b, w in enumerate(row) if w)


@query(
    "bark_bands",
    f"""WITH {SPECTRA}, bank(m, bin, w) AS (VALUES {_BARK}), ms AS (SELECT unnest(range(0, 12)) AS m), fr AS (SELECT DISTINCT signal_id, frame FROM p), e AS (SELECT signal_id, frame, m, sum(mag * mag * w) AS e FROM p JOIN bank USING (bin) GROUP BY 1, 2, 3)
SELECT fr.signal_id, fr.frame, CAST(ms.m AS INTEGER) AS band, {_r('coalesce(e, 0)', 'energy')} FROM fr CROSS JOIN ms LEFT JOIN e ON e.frame = fr.frame AND e.signal_id = fr.signal_id AND e.m = ms.m""",
)
def bark_bands(spark, d):
    return rounded(spectrum.bark_spectra(tables.spectra(spark, d), 16000.0, BINS, 12))


@query("power_levels", f"WITH {SPECTRA} SELECT signal_id, frame, CAST(bin AS INTEGER) AS bin, {_r('mag * mag', 'power')}, {_r('10 * log10(greatest(mag * mag, 1e-10))', 'db')} FROM p")
def power_levels(spark, d):
    return rounded(spectrum.power_levels(tables.spectra(spark, d)))


@query("bin_series", f"WITH {SPECTRA} SELECT signal_id, frame, {_r('mag', 'v')} FROM p WHERE bin = 7")
def bin_series(spark, d):
    return rounded(spectrum.bin_series(tables.spectra(spark, d), 7))


def _flat(cond: str) -> str:
    a = f"avg(CASE WHEN {cond} THEN mag END)"
    return f"coalesce(CASE WHEN {a} <= 1e-10 THEN 0 ELSE least(exp(avg(CASE WHEN {cond} AND mag > 1e-10 THEN ln(mag) END)) / {a}, 1) END, 0)"


_TB = 20000.0 / (2 * (BINS - 1))
_B1, _B2, _B3 = (min(BINS - 1, math.floor(hz / _TB)) for hz in (1000, 4000, 8000))


@query(
    "flatness_figures",
    f"""WITH {SPECTRA}, f AS (SELECT signal_id, frame, {_flat('true')} AS f, {_flat(f'bin <= {_B1}')} AS low, {_flat(f'bin BETWEEN {_B1} AND {_B2}')} AS mid, {_flat(f'bin BETWEEN {_B2} AND {_B3}')} AS high FROM p GROUP BY 1, 2),
g AS (SELECT signal_id, avg(low) AS low, avg(mid) AS mid, avg(high) AS high, avg(f) AS mean, var_pop(f) AS variance, avg(CASE WHEN f < 0.2 THEN 1.0::DOUBLE ELSE 0 END) AS tonal FROM f GROUP BY 1)
SELECT signal_id, {', '.join(_r(c, c) for c in ('low', 'mid', 'high', 'mean', 'variance', 'tonal'))}, CASE WHEN mean < 0.2 AND variance < 0.01 THEN 'music' WHEN mean < 0.35 AND variance > 0.01 THEN 'speech' WHEN mean > 0.6 THEN 'noise' ELSE 'mixed' END AS kind FROM g""",
)
def flatness_figures(spark, d):
    return rounded(spectrum.flatness_figures(tables.spectra(spark, d), 20000.0))


@query("contrast_statistics", f"WITH c AS ({ORACLES['spectral_contrast']}) SELECT signal_id, band, {_r('avg(contrast)', 'mean', 4)}, {_r('coalesce(var_samp(contrast), 0)', 'variance', 3)} FROM c GROUP BY 1, 2")
def contrast_statistics(spark, d):
    c = peaks.contrast_statistics(rounded(peaks.spectral_contrast(tables.spectra(spark, d)), 5))
    return rounded(c.withColumn("variance", F.round("variance", 3)), 4)


@query(
    "spectrum_shares",
    f"""WITH {SPECTRA}, n AS (SELECT signal_id, frame, sum(CASE WHEN bin < {BINS // 4} THEN mag * mag ELSE 0 END) / nullif(sum(mag * mag), 0) AS low, sum(CASE WHEN bin >= {BINS // 4} THEN mag * mag ELSE 0 END) / nullif(sum(mag * mag), 0) AS high FROM p GROUP BY 1, 2),
t AS (SELECT *, lag(mag) OVER w AS a, lag(mag, 2) OVER w AS aa, lead(mag) OVER w AS c, lead(mag, 2) OVER w AS cc FROM p WINDOW w AS (PARTITION BY frame ORDER BY bin)), k AS (SELECT frame, bin, min(bin) OVER (PARTITION BY frame) AS f FROM t WHERE mag > a AND mag > aa AND mag > c AND mag > cc),
h AS (SELECT frame, avg(CASE WHEN abs(CAST(bin AS DOUBLE) / f - round(CAST(bin AS DOUBLE) / f)) < 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS h FROM k WHERE bin > f GROUP BY 1)
SELECT signal_id, n.frame, {_r('coalesce(low, 0)', 'low')}, {_r('coalesce(high, 0)', 'high')}, {_r('coalesce(h, 0)', 'harmonic')} FROM n LEFT JOIN h ON h.frame = n.frame""",
)
def spectrum_shares(spark, d):
    return rounded(content.spectrum_shares(tables.spectra(spark, d)))


def _parts_sql(text: str, lists: tuple) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'''contains({text}, '{p}')''' for p in parts)} THEN '{kind}'" for kind, parts in lists)
    return f"CASE {cases} WHEN contains({text}, 'talk') AND NOT contains({text}, 'sports') THEN 'talk' ELSE 'unknown' END"


_NAMED_SQL = "CASE " + " ".join(f"WHEN lower(nm) = '{k}' THEN '{v}'" for k, v in content.NAMED.items()) + " ELSE 'unknown' END"


@query(
    "metadata_types",
    f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN split_part(text, ' ', 1) END AS nm, source AS genre, lang AS station, substr(text, 1, 400) AS url FROM documents),
u AS (SELECT *, {_parts_sql("lower(trim(coalesce(genre, '')))", content.GENRES)} AS g, {_parts_sql("concat(lower(trim(coalesce(station, ''))), ' ', lower(coalesce(url, '')))", content.STATIONS)} AS st FROM t)
SELECT doc_id, CASE WHEN nm <> '' THEN {_NAMED_SQL} WHEN genre <> '' AND g <> 'unknown' THEN g ELSE st END AS content_type, CASE WHEN nm <> '' THEN 'content_type' WHEN genre <> '' AND g <> 'unknown' THEN 'genre' WHEN station <> '' THEN 'station' ELSE 'url_pattern' END AS source FROM u""",
)
def metadata_types(spark, d):
    """Documents stand for streams here: their source for the genre, their language for the station, their opening for the address."""
    t = tables.table(spark, d, "documents")
    t = t.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.split_part("text", F.lit(" "), F.lit(1))).alias("content_type_name"), F.col("source").alias("genre"), F.col("lang").alias("station"), F.substring("text", 1, 400).alias("url"))
    return content.metadata_types(t).select("doc_id", "content_type", "source")


_WEIGHTS = ", ".join(f"('{k}', '{f}', {w}::DOUBLE)" for k, e in presets.COMPARISON_WEIGHTS.items() for f, w in e.items())


@query("comparison_weights", f"SELECT * FROM (VALUES {_WEIGHTS}) AS t(content_type, feature, weight)")
def comparison_weights(spark, d):
    return presets.weights(spark)


_PROFILE_ROWS = ", ".join("('" + k + "', " + ", ".join(str(p[n]).lower() for n in ("mfcc", "chroma", "contrast", "harmonic", "speech", "temporal")) + f", {p['threshold']}::DOUBLE)" for k, p in presets.PROFILES.items())


@query("content_profiles", f"SELECT * FROM (VALUES {_PROFILE_ROWS}) AS t(content_type, mfcc, chroma, contrast, harmonic, speech, temporal, threshold)")
def content_profiles(spark, d):
    return presets.profiles(spark)


@query(
    "cluster_sizes",
    f"""WITH {VECTORS}, ce AS (SELECT label, j, avg(x) AS c FROM e GROUP BY 1, 2), d AS (SELECT e.id, e.label, sqrt(sum((x - c) * (x - c))) AS d FROM e JOIN ce USING (label, j) GROUP BY 1, 2)
SELECT label, count(*) AS n, {_r('avg(d * d)', 'variance')}, {_r('max(d)', 'radius')}, {_r('sum(d * d)', 'inertia', 4)} FROM d GROUP BY 1""",
)
def cluster_sizes(spark, d):
    c = clustering.cluster_sizes(tables.vectors(spark, d))
    return rounded(c.withColumn("inertia", F.round("inertia", 4)))


@query(
    "density_clusters",
    """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), near AS (SELECT a.id AS a, b.id AS b FROM v AS a JOIN v AS b ON a.id <> b.id AND list_distance(a.v, b.v) <= 1.2),
core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 4), link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id), lab AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1),
edge AS (SELECT a AS id, min(cluster) AS c FROM near JOIN lab ON lab.id = near.b GROUP BY 1)
SELECT v.id, CAST(coalesce(lab.cluster, edge.c, -1) AS BIGINT) AS cluster FROM v LEFT JOIN lab ON lab.id = v.id LEFT JOIN edge ON edge.id = v.id""",
)
def density_clusters(spark, d):
    return clustering.dbscan(tables.vectors(spark, d), 1.2, 4)
