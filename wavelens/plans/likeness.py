"""Queries of comparisons and alignment scores; see ``registry`` for the shared SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, clustering, matching, rhythm, temporal
from ..sources import tables
from .registry import _LAGS, _pairs, BINS, HOP, ORACLES, RATE, SAMPLES, TONE, VECTORS, WIDTH, _frame_rows, _r, query, rounded

_PEAK = f"""{_LAGS}, pk AS (SELECT query_id, ref_id, lag AS pa, r AS peak FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ref_id ORDER BY round(abs(r), 9) DESC, lag) AS k FROM c) WHERE k = 1),
ms AS (SELECT c.query_id, c.ref_id, any_value(pa) AS lag, any_value(peak) AS peak, max(CASE WHEN lag <> pa THEN {{'m': round(abs(r), 9), 'k': -lag, 'r': r}} END).r AS second, sqrt(avg(CASE WHEN abs(lag - pa) > 5 THEN r * r END)) AS noise, max(CASE WHEN abs(lag - pa) > 10 THEN abs(r) END) AS side,
 max(CASE WHEN lag = pa + 1 THEN r END) AS af, max(CASE WHEN lag = pa - 1 THEN r END) AS be, max(n) AS n FROM c JOIN pk ON pk.query_id = c.query_id AND pk.ref_id = c.ref_id GROUP BY 1, 2),
pm AS (SELECT query_id, ref_id, lag, peak, coalesce(second, 0) AS second, CASE WHEN noise IS NULL THEN 0 WHEN noise < 1e-10 THEN 'inf'::DOUBLE ELSE 20 * log10(nullif(abs(peak), 0) / noise) END AS snr_db, coalesce(2 * peak - be - af, 0) AS sharpness, CASE WHEN side >= 1e-10 THEN 20 * log10(nullif(abs(peak), 0) / side) END AS sidelobe_db,
 CASE WHEN n <= 2 THEN 1.0 ELSE CASE WHEN abs(peak) >= 1 THEN 0.01 WHEN abs(peak) * sqrt(n - 2) / sqrt(1 - peak * peak) > 2 THEN 0.01 WHEN abs(peak) * sqrt(n - 2) / sqrt(1 - peak * peak) > 1.5 THEN 0.05 WHEN abs(peak) * sqrt(n - 2) / sqrt(1 - peak * peak) > 1 THEN 0.1 ELSE 0.5 END END::DOUBLE AS p_value FROM ms)"""


@query("peak_measures", f"WITH {_PEAK} SELECT query_id, ref_id, CAST(lag AS BIGINT) AS lag, {_r('peak', 'peak')}, {_r('second', 'second')}, {_r('snr_db', 'snr_db', 5)}, {_r('sharpness', 'sharpness')}, {_r('coalesce(sidelobe_db, 0)', 'sidelobe_db', 5)}, CAST(p_value AS DOUBLE) AS p_value FROM pm")
def peak_measures(spark, d):
    s = tables.samples(spark, d)
    m = alignment.peak_measures(alignment.lag_correlation(s, _pairs(s)))
    m = m.withColumn("sidelobe_db", F.coalesce("sidelobe_db", F.lit(0.0)))  # 0: no lag far enough away
    return rounded(m.withColumns({c: F.round(c, 5) for c in ("snr_db", "sidelobe_db")}))


_P = "abs(peak)"


@query(
    "lag_scores",
    f"""WITH {_PEAK}, q AS (SELECT *, {_P} + CASE WHEN {_P} >= 0.6 THEN 0.5 * ({_P} - 0.6) ELSE 0 END AS p1, {_P} + CASE WHEN {_P} >= 0.6 THEN 0.4 * ({_P} - 0.6) ELSE 0 END AS p2, coalesce(abs(second) / nullif({_P}, 0), 0) AS rv, CASE WHEN lag < 0 THEN -lag / 8e0 ELSE 0 END AS back FROM pm)
SELECT query_id, ref_id, CAST(lag AS BIGINT) AS lag, {_r(f'lag / {RATE}::DOUBLE', 'offset_s')}, {_r(_P, 'similarity')},
 {_r(f"CASE WHEN {_P} < 0.1 THEN 0 ELSE greatest(0, least(0.95, 0.55 * p1 + 0.22 * least(0.9, 8 * sharpness) + 0.12 * CASE WHEN sidelobe_db > 0 THEN least(0.8, sidelobe_db / 15) ELSE 0 END + 0.06 * CASE WHEN snr_db > 0 THEN least(0.7, snr_db / 25) ELSE 0 END + 0.0075 + CASE WHEN {_P} >= 0.75 THEN 0.12 WHEN {_P} >= 0.6 THEN 0.08 ELSE 0 END - CASE WHEN rv > 0.7 THEN 0.25 * (rv - 0.7) ELSE 0 END)) END", 'confidence')},
 {_r(f"CASE WHEN {_P} < 0.08 THEN 0 ELSE greatest(0, least(1, 0.50 * p2 + 0.25 * least(0.85, 5 * sharpness) + 0.15 * CASE WHEN sidelobe_db > 0 THEN least(0.7, sidelobe_db / 20) ELSE 0 END + 0.10 * CASE WHEN snr_db > 0 THEN least(0.6, snr_db / 30) ELSE 0 END + CASE WHEN {_P} >= 0.7 THEN 0.10 WHEN {_P} >= 0.55 THEN 0.06 ELSE 0 END - CASE WHEN back > 0.9 THEN 4 * (back - 0.9) ELSE 0 END)) END", 'quality')}
FROM q""",
)
def lag_scores(spark, d):
    s = tables.samples(spark, d)
    m = alignment.peak_measures(alignment.lag_correlation(s, _pairs(s)))
    return rounded(alignment.lag_scores(m, 8, 1, RATE).select("query_id", "ref_id", "lag", "offset_s", "similarity", "confidence", "quality"))


def _variant(name: str, col: str):
    return f"""WITH {SAMPLES}, lg AS (SELECT unnest(range(-8, 9)) AS lag)
SELECT q.signal_id AS query_id, r.signal_id AS ref_id, CAST(lag AS BIGINT) AS lag, {_r(f'coalesce(sum(q.{col} * r.{col}) / nullif(sqrt(sum(q.{col} * q.{col}) * sum(r.{col} * r.{col})), 0), 0)', 'r')}, count(*) AS n FROM s AS q, lg JOIN s AS r ON true WHERE r.signal_id = q.signal_id + 1 AND r.i = q.i + lg.lag GROUP BY 1, 2, 3"""


@query("normalized_correlation", _variant("normalized", "v"))
def normalized_correlation(spark, d):
    s = tables.samples(spark, d)
    return rounded(alignment.lag_correlation(s, _pairs(s), value="v", kind="normalized"))


@query("zero_normalized_correlation", _variant("zero", "x"))
def zero_normalized_correlation(spark, d):
    s = tables.samples(spark, d)
    return rounded(alignment.lag_correlation(s, _pairs(s), value="v", kind="zero"))


@query("warp_scores")
def warp_scores(spark, d):
    s = tables.signals(spark, d)
    return alignment.summary(alignment.warp_scores(s, _pairs(s)))


@query("hybrid_alignment")
def hybrid_alignment(spark, d):
    x = tables.samples(spark, d)
    lags = alignment.lag_scores(alignment.peak_measures(alignment.lag_correlation(x, _pairs(x))), 8)
    return alignment.hybrid(lags, alignment.warp_scores(tables.signals(spark, d), _pairs(x)))


@query("best_alignment")
def best_alignment(spark, d):
    """Energies aligned by lag against values aligned by warping: the better scored result of every pair."""
    e = rounded(_frame_rows(spark, d)).select("signal_id", F.col("frame").alias("i"), F.col("energy").alias("x"))
    lags = alignment.lag_scores(alignment.peak_measures(alignment.lag_correlation(e, _pairs(e), 3)), 3, HOP, RATE).select("query_id", "ref_id", F.lit("corr_energy").alias("feature"), F.col("lag").cast("double").alias("offset"), "similarity", "confidence", "quality")
    s = tables.signals(spark, d)
    warps = alignment.warp_scores(s, _pairs(s)).select("query_id", "ref_id", F.lit("dtw_chroma").alias("feature"), "offset", "similarity", "confidence", "quality")
    return alignment.summary(alignment.best_alignment(lags.unionByName(warps)))


@query(
    "aligned_samples",
    f"""WITH b AS ({ORACLES['best_lag']}), {SAMPLES}, j AS (SELECT b.query_id, b.ref_id, q.i AS qi, q.x AS q, r.x AS r FROM b JOIN s AS q ON q.signal_id = b.query_id JOIN s AS r ON r.signal_id = b.ref_id AND r.i = q.i + b.lag), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY qi) - 1 AS k, count(*) OVER (PARTITION BY query_id) AS n FROM j)
SELECT query_id, ref_id, CAST(k - CASE WHEN n > 8 THEN 4 ELSE 0 END AS BIGINT) AS k, {_r('q', 'q', 9)}, {_r('r', 'r', 9)} FROM k WHERE n <= 8 OR k BETWEEN 4 AND n - 5""",
)
def aligned_samples(spark, d):
    x = tables.samples(spark, d)
    best = alignment.best_lag(alignment.lag_correlation(x, _pairs(x)))
    return rounded(alignment.aligned(x, best, 4), 9)


@query(
    "offset_consistency",
    f"""WITH b AS ({ORACLES['best_lag']}) SELECT query_id, ref_id, {_r('CAST(lag AS DOUBLE)', 'mean')}, 0.0::DOUBLE AS deviation, {_r('CAST(lag AS DOUBLE)', 'median')}, 0.0::DOUBLE AS spread, 1.0::DOUBLE AS consistency FROM b""",
)
def offset_consistency(spark, d):
    """Best lags of several trials with no noise at all agree; tests add noise."""
    x = tables.samples(spark, d)
    best = alignment.best_lag(alignment.lag_correlation(x, _pairs(x))).select("query_id", "ref_id", F.col("lag").cast("double").alias("offset"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("trial"))
    return rounded(alignment.offset_consistency(best))


@query(
    "distance_matrix",
    f"""WITH {VECTORS} SELECT a.id AS a, b.id AS b, {_r('sqrt(sum((a.x - b.x) * (a.x - b.x)))', 'distance')} FROM e AS a JOIN e AS b ON a.j = b.j AND a.id < b.id WHERE a.label = 0 AND b.label = 0 GROUP BY 1, 2""",
)
def distance_matrix(spark, d):
    """All pairs of the vectors labelled 0."""
    return rounded(matching.distance_matrix(tables.vectors(spark, d).where("label = 0")))


def _temporal(spark, d):
    x = tables.samples(spark, d)
    p = rounded(temporal.profile(x, WIDTH, HOP).select("signal_id", "range_db"))
    a = rounded(rhythm.activity(x, WIDTH, HOP)).select("signal_id", "silence")
    f = rounded(_frame_rows(spark, d))
    level = f.groupBy("signal_id").agg(F.avg("energy").alias("level_mean"), F.coalesce(F.stddev_samp("energy"), F.lit(0.0)).alias("level_dev"))
    on = temporal.onsets(_frame_rows(spark, d).withColumn("delta", F.round("delta", 9)))
    o = rounded(temporal.onset_density(on, x, RATE)).select("signal_id", "density")
    return p.join(a, "signal_id").join(level, "signal_id").join(o, "signal_id")


def _features(spark, d):
    return matching.signal_features(tables.spectra(spark, d), TONE, BINS, temporal=_temporal(spark, d))


@query("batch_compare")
def batch_compare(spark, d):
    return matching.batch_compare(_features(spark, d))


@query("best_matches")
def best_matches(spark, d):
    return matching.best_matches(matching.batch_compare(_features(spark, d))).select("query_id", "candidate_id", "similarity", "confidence", "label", "rank")


@query("similarity_statistics", f"WITH m AS ({ORACLES['fingerprint_matches']}) SELECT {_r('avg(similarity)', 'mean', 5)}, min(similarity) AS low, max(similarity) AS high, quantile_disc(similarity, 0.5) AS median, {_r('stddev_samp(similarity)', 'deviation', 5)}, {_r('avg(confidence)', 'confidence', 5)}, count(*) AS n FROM m")
def similarity_statistics(spark, d):
    from .registry import QUERIES

    s = matching.similarity_statistics(QUERIES["fingerprint_matches"](spark, d))
    return s.select(*((F.round(c, 5) + F.lit(0.0)).alias(c) if c in ("mean", "deviation", "confidence") else F.col(c) for c in s.columns))


@query(
    "spectral_coherence",
    f"""WITH e AS ({ORACLES['spectral_descriptors']}), k AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY frame) AS k FROM e), j AS (SELECT a.signal_id AS query_id, b.signal_id AS ref_id, abs(corr(a.centroid, b.centroid)) AS x, abs(corr(a.rolloff, b.rolloff)) AS y FROM k AS a JOIN k AS b ON b.signal_id = a.signal_id + 1 AND b.k = a.k GROUP BY 1, 2)
SELECT query_id, ref_id, {_r('(x + y) / 2', 'coherence', 4)} FROM j""",
)
def spectral_coherence(spark, d):
    s = tables.spectra(spark, d)
    ids = s.select(F.col("signal_id").alias("query_id")).distinct()
    pairs = ids.join(ids.select(F.col("query_id").alias("ref_id")), F.col("ref_id") == F.col("query_id") + 1)
    return rounded(matching.spectral_coherence(s, pairs, RATE), 4)


@query("medoid_clusters")
def medoid_clusters(spark, d):
    return clustering.k_medoids(tables.vectors(spark, d).where("label = 0"), 3)


@query("hierarchical_clusters")
def hierarchical_clusters(spark, d):
    return clustering.hierarchical(tables.vectors(spark, d).where("label = 0"), 4)


@query("gaussian_mixture")
def gaussian_mixture(spark, d):
    return clustering.gaussian_mixture(tables.vectors(spark, d).withColumn("v", F.slice("v", 1, 4)), 3, restarts=1)


