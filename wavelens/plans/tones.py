"""Queries of chroma frames, keys, chords, profiles, the tone network and pitch-class profiles from peaks; see ``registry`` for the shared SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import peaks, tonal
from ..sources import tables
from .registry import _CHORDS, _CHROMA, _FRAME_CHROMA, _chroma, BINS, ORACLES, TONE, _r, query, rounded


def _frames(spark, d):
    return tonal.frame_chroma(tables.spectra(spark, d), TONE)


@query("frame_chroma", f"WITH {_FRAME_CHROMA} SELECT signal_id, frame, CAST(pc AS INTEGER) AS pc, {_r('e', 'e')} FROM fc")
def frame_chroma(spark, d):
    return rounded(_frames(spark, d).select("signal_id", "frame", F.posexplode("chroma").alias("pc", "e")))


@query("chroma_frame_statistics", f"WITH {_FRAME_CHROMA} SELECT signal_id, CAST(pc AS INTEGER) AS pc, {_r('avg(e)', 'mean')}, {_r('var_pop(e)', 'variance')}, {_r('sum(e)', 'energy')} FROM fc GROUP BY 1, 2")
def chroma_frame_statistics(spark, d):
    return rounded(tonal.chroma_frame_statistics(_frames(spark, d)))


@query(
    "vector_figures",
    f"""WITH {_FRAME_CHROMA}, n AS (SELECT *, sum(e) OVER w AS t, max(e) OVER w AS top, lag(e) OVER o AS a, lead(e) OVER o AS b, first_value(e) OVER w2 AS f, last_value(e) OVER w2 AS l FROM fc WINDOW w AS (PARTITION BY frame), o AS (PARTITION BY frame ORDER BY pc), w2 AS (PARTITION BY frame ORDER BY pc ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT signal_id, frame, {_r('sqrt(sum(e * e))', 'energy')}, {_r('coalesce(sum(e * pc) / nullif(any_value(t), 0), 0)', 'centroid')}, {_r('coalesce(-sum(CASE WHEN e > 0 THEN e / t * log2(e / t) END), 0)', 'entropy')}, {_r('var_pop(e)', 'spread')}, CAST(min(CASE WHEN e = top THEN pc END) AS INTEGER) AS dominant,
 CAST(sum(CASE WHEN e > coalesce(a, l) AND e > coalesce(b, f) THEN 1 ELSE 0 END) AS INTEGER) AS peaks, {_r('avg(CASE WHEN e < 0.01 * top THEN 1.0::DOUBLE ELSE 0 END)', 'sparsity')}, {_r('1 / (1 + var_pop(e))', 'uniformity')} FROM n GROUP BY 1, 2""",
)
def vector_figures(spark, d):
    return rounded(tonal.vector_figures(_frames(spark, d)))


@query("smoothed_chroma", f"WITH {_FRAME_CHROMA} SELECT signal_id, frame, CAST(pc AS INTEGER) AS pc, {_r('avg(e) OVER (PARTITION BY signal_id, pc ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'e')} FROM fc")
def smoothed_chroma(spark, d):
    return rounded(tonal.smoothed_chroma(_frames(spark, d)).select("signal_id", "frame", F.posexplode("chroma").alias("pc", "e")))


_ALL_KEYS = ", ".join(f"('{n}', '{m}', {i}, {v!r})" for n, pair in tonal.PROFILES.items() for m, prof in zip(("major", "minor"), pair) for i, v in enumerate(prof))


@query(
    "key_profiles",
    f"""WITH {_CHROMA}, kp(profile, mode, i, w) AS (VALUES {_ALL_KEYS}), ks AS (SELECT unnest(range(0, 12)) AS key),
s AS (SELECT signal_id, profile, key, mode, round(coalesce(corr(e, CAST(w AS DOUBLE)), 0), 9) AS correlation FROM c, ks JOIN kp ON true WHERE kp.i = (c.pc - ks.key + 12) % 12 GROUP BY 1, 2, 3, 4)
SELECT signal_id, profile, CAST(key AS INTEGER) AS key, mode, {_r('correlation', 'correlation')} FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, profile ORDER BY correlation DESC, mode, key) AS k FROM s) WHERE k = 1""",
)
def key_profiles(spark, d):
    c = _chroma(spark, d)
    out = None
    for name in tonal.PROFILES:
        k = tonal.keys(c, profile=name).withColumn("profile", F.lit(name))
        out = k if out is None else out.unionByName(k)
    return rounded(out)


_KP = ", ".join(f"('{m}', {i}, {v!r})" for m, prof in (("major", tonal.MAJOR), ("minor", tonal.MINOR)) for i, v in enumerate(prof))
_FK = f"""{_FRAME_CHROMA}, kp(mode, i, w) AS (VALUES {_KP}), ks AS (SELECT unnest(range(0, 12)) AS key),
ksc AS (SELECT signal_id, frame, key, mode, round(coalesce(corr(e, CAST(w AS DOUBLE)), 0), 9) AS r FROM fc, ks JOIN kp ON true WHERE kp.i = (fc.pc - ks.key + 12) % 12 GROUP BY 1, 2, 3, 4),
fk AS (SELECT signal_id, frame, key, mode, r FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, frame ORDER BY r DESC, mode, key) AS k FROM ksc) WHERE k = 1)"""
_NAMES = "[" + ", ".join(f"'{n}'" for n in tonal.NAMES) + "]"


@query(
    "key_figures",
    f"""WITH {_FK}, sc AS (SELECT signal_id, frame, list_reverse_sort(list(r)) AS l, sum(CASE WHEN r > 0 THEN r END) AS t, sum(CASE WHEN r > 0 THEN r * log2(r) END) AS g FROM ksc GROUP BY 1, 2), v AS (SELECT signal_id, frame, var_pop(e) AS v FROM fc GROUP BY 1, 2)
SELECT fk.signal_id, fk.frame, CAST(key AS INTEGER) AS key, mode, {_r('r', 'correlation')}, CASE WHEN r < 0.5 THEN 'Unknown' ELSE {_NAMES}[key + 1] || ' ' || mode END AS name, {_r('CASE WHEN r > 0 THEN (r - l[2]) / r ELSE 0 END', 'clarity')}, {_r(f'CASE WHEN t > 0 THEN (log2(t) - g / t) / {math.log2(24)!r} ELSE 0 END', 'ambiguity')}, {_r('1 - 1 / (1 + v)', 'tonality')}
FROM fk JOIN sc USING (signal_id, frame) JOIN v USING (signal_id, frame)""",
)
def key_figures(spark, d):
    return rounded(tonal.key_figures(_frames(spark, d)))


def _frame_keys(spark, d):
    return tonal.key_figures(_frames(spark, d))


_MI = "CASE mode WHEN 'major' THEN 1 ELSE 0 END"


@query(
    "global_key",
    f"""WITH {_FK}, vt AS (SELECT signal_id, key, mode, coalesce(sum(CASE WHEN r > 0.5 THEN r END), 0) AS s, count(*) AS n FROM fk GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY round(s, 9) DESC, key, mode) AS k, sum(s) OVER w AS t, sum(n) OVER w AS nn, max(n) OVER w AS mx FROM vt WINDOW w AS (PARTITION BY signal_id))
SELECT signal_id, CAST(key AS INTEGER) AS key, mode, {_r('coalesce(s / nullif(t, 0), 0)', 'confidence')}, {_r('s / nn', 'strength')}, {_r('CAST(mx AS DOUBLE) / nn', 'stability')} FROM k WHERE k = 1""",
)
def global_key(spark, d):
    return rounded(tonal.global_key(_frame_keys(spark, d)))


@query(
    "key_transitions",
    f"""WITH {_FK}, t AS (SELECT signal_id, frame, key, mode, r, lag(key) OVER w AS fkey, lag(mode) OVER w AS fmode, lag(r) OVER w AS fr FROM fk WINDOW w AS (PARTITION BY signal_id ORDER BY frame)), u AS (SELECT *, (key - fkey + 12) % 12 AS up FROM t WHERE r > 0.5 AND fr > 0.5),
x AS (SELECT *, CASE WHEN up = 0 AND mode = fmode THEN 'same_key' WHEN up = 0 THEN 'parallel' WHEN mode <> fmode AND up = CASE fmode WHEN 'major' THEN 9 ELSE 3 END THEN 'relative' WHEN mode = fmode AND up = 7 THEN 'dominant' WHEN mode = fmode AND up = 5 THEN 'subdominant' ELSE 'distant' END AS kind FROM u),
y AS (SELECT *, CASE WHEN kind IN ('same_key', 'parallel') THEN 0 WHEN kind <> 'distant' THEN 1 ELSE least(up, 12 - up) END AS distance FROM x)
SELECT signal_id, frame, CAST(fkey AS INTEGER) AS from_key, fmode AS from_mode, CAST(key AS INTEGER) AS key, mode, kind, CAST(distance AS INTEGER) AS distance, {_r('1 / (1 + CAST(distance AS DOUBLE))', 'strength')}, {_r('(r + fr) / 2', 'confidence')} FROM y""",
)
def key_transitions(spark, d):
    return rounded(tonal.key_transitions(_frame_keys(spark, d)))


@query("modulations")
def modulations(spark, d):
    return tonal.modulations(_frames(spark, d))


_CHORD_CTE = f"""t(quality, w, i) AS (VALUES {_CHORDS}), rs AS (SELECT unnest(range(0, 12)) AS root), l2 AS (SELECT signal_id, frame, sqrt(sum(e * e)) AS l FROM fc GROUP BY 1, 2),
cs AS (SELECT fc.signal_id, fc.frame, root, quality, round(coalesce(any_value(CAST(w AS DOUBLE)) * sum(e) / nullif(any_value(l), 0), 0), 9) AS score FROM fc JOIN l2 USING (signal_id, frame), rs JOIN t ON true WHERE fc.pc = (t.i + rs.root) % 12 GROUP BY 1, 2, 3, 4),
cr AS (SELECT *, row_number() OVER (PARTITION BY signal_id, frame ORDER BY score DESC, root, quality) AS rank FROM cs),
cf AS (SELECT signal_id, frame, max(CASE WHEN rank = 1 THEN root END) AS root, max(CASE WHEN rank = 1 THEN quality END) AS quality, max(CASE WHEN rank = 1 THEN score END) AS score, max(CASE WHEN rank = 2 THEN score END) AS second FROM cr WHERE rank <= 2 GROUP BY 1, 2),
ch AS (SELECT *, {_NAMES}[root + 1] || CASE WHEN quality = 'major' THEN '' ELSE ' ' || quality END AS name FROM cf)"""
_CONS = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in tonal.CONSONANCE.items())
_ROLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tonal.ROLES.items())


@query(
    "chord_figures",
    f"""WITH {_FRAME_CHROMA}, {_CHORD_CTE}, tn AS (SELECT a.signal_id, a.frame, least(sum(CASE WHEN a.e > 0.2 AND b.e > 0.2 THEN a.e * b.e ELSE 0 END), 1) AS t FROM fc AS a JOIN fc AS b ON a.signal_id = b.signal_id AND a.frame = b.frame AND (b.pc - a.pc + 12) % 12 IN (1, 6, 11) GROUP BY 1, 2)
SELECT ch.signal_id, ch.frame, CAST(root AS INTEGER) AS root, quality, name, {_r('score', 'score')}, {_r('score - second', 'clarity')}, CASE quality {_CONS} END AS consonance, CASE quality {_ROLES} ELSE 'other' END AS role, {_r('t', 'tension')} FROM ch JOIN tn USING (signal_id, frame)""",
)
def chord_figures(spark, d):
    return rounded(tonal.chord_figures(_frames(spark, d)).drop("extensions"))


@query(
    "chord_progression",
    f"""WITH {_FRAME_CHROMA}, {_CHORD_CTE}, g AS (SELECT *, lag(name) OVER (PARTITION BY signal_id ORDER BY frame) AS was FROM ch), q AS (SELECT signal_id, quality, row_number() OVER (PARTITION BY signal_id ORDER BY count(*) DESC, quality) AS k FROM ch GROUP BY 1, 2)
SELECT g.signal_id, count(*) AS chords, CAST(sum(CASE WHEN was <> name THEN 1 ELSE 0 END) AS BIGINT) AS changes, {_r('avg(score)', 'mean_score')}, any_value(q.quality) AS common_quality FROM g JOIN q ON q.signal_id = g.signal_id AND q.k = 1 GROUP BY 1""",
)
def chord_progression(spark, d):
    return rounded(tonal.progression(tonal.chord_figures(_frames(spark, d))))


@query(
    "chord_transitions",
    f"""WITH {_FRAME_CHROMA}, {_CHORD_CTE}, g AS (SELECT signal_id, name, lag(name) OVER (PARTITION BY signal_id ORDER BY frame) AS was FROM ch) SELECT signal_id, was || ' -> ' || name AS step, count(*) AS n FROM g WHERE was IS NOT NULL GROUP BY 1, 2""",
)
def chord_transitions(spark, d):
    return tonal.transitions(tonal.chord_figures(_frames(spark, d)))


_INV = ", ".join(f"('{q}', {w}, {k}, {iv[k]}, {i}, {1.5 if k and i == iv[k] else 1.0})" for q, (iv, w) in tonal.CHORDS.items() for k in range(len(iv)) for i in iv)


@query(
    "chord_inversions",
    f"""WITH {_FRAME_CHROMA}, b AS (SELECT signal_id, frame, min(CASE WHEN e = top THEN pc END) AS low, sqrt(sum(e * e)) AS l FROM (SELECT *, max(e) OVER (PARTITION BY frame) AS top FROM fc) GROUP BY 1, 2), t(quality, w, inversion, base, i, g) AS (VALUES {_INV}), rs AS (SELECT unnest(range(0, 12)) AS root),
s AS (SELECT fc.signal_id, fc.frame, any_value(low) AS low, root, quality, inversion, round(coalesce(any_value(CAST(w AS DOUBLE)) * sum(e * CAST(g AS DOUBLE)) / nullif(any_value(l), 0), 0), 9) AS score FROM fc JOIN b USING (signal_id, frame), rs JOIN t ON true WHERE (rs.root + t.base) % 12 = b.low AND fc.pc = (t.i + rs.root) % 12 GROUP BY 1, 2, 4, 5, 6)
SELECT signal_id, frame, CAST(low AS INTEGER) AS low, CAST(root AS INTEGER) AS root, quality, CAST(inversion AS INTEGER) AS inversion, {_r('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY signal_id, frame ORDER BY score DESC, inversion, root, quality) AS k FROM s) WHERE k = 1""",
)
def chord_inversions(spark, d):
    f = _frames(spark, d)
    return rounded(tonal.inversions(f.withColumn("low", tonal.dominant(F.col("chroma"))), "low"))


_NET = ", ".join(f"({pc}, {float(x)!r}::DOUBLE, {float(y)!r}::DOUBLE)" for pc in range(12) for x, y in [tonal.tonnetz_point(pc)])


@query(
    "tonnetz_movement",
    f"""WITH {_FRAME_CHROMA}, t(pc, x, y) AS (VALUES {_NET}), pl AS (SELECT signal_id, frame, round(sum(e * x), 9) AS x, round(sum(e * y), 9) AS y FROM fc JOIN t USING (pc) GROUP BY 1, 2), d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM pl WINDOW w AS (PARTITION BY signal_id ORDER BY frame)),
g AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, lag(dx) OVER w AS px, lag(dy) OVER w AS py FROM d WINDOW w AS (PARTITION BY signal_id ORDER BY frame)), h AS (SELECT *, sqrt(px * px + py * py) AS pd FROM g),
a AS (SELECT signal_id, count(*) AS n, sum(d) AS length, max(d) AS most, avg(d) AS mean, var_pop(d) AS variance, avg(CASE WHEN d < 1 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0 END) AS smooth, sum(CASE WHEN d > 1e-10 AND pd > 1e-10 AND (dx * px + dy * py) / nullif(d * pd, 0) > 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS ahead,
 arg_max(x, frame) - arg_min(x, frame) AS ex, arg_max(y, frame) - arg_min(y, frame) AS ey FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT signal_id, {', '.join(_r(c, c, 5) for c in ('length', 'most', 'mean', 'variance'))}, {_r('1 / (1 + variance)', 'stability', 5)}, {_r('CASE WHEN length > 1e-10 THEN sqrt(ex * ex + ey * ey) / length ELSE 0 END', 'efficiency', 5)}, {_r('smooth', 'smooth', 5)}, {_r('coalesce(ahead / nullif(n - 2, 0), 0)', 'direction', 5)} FROM a""",
)
def tonnetz_movement(spark, d):
    t = rounded(tonal.tonnetz(_frames(spark, d)), 9)
    return rounded(tonal.tonnetz_movement(t), 5)


@query(
    "network_tension",
    f"""WITH {_CHROMA}, t(pc, x, y) AS (VALUES {_NET}), q AS (SELECT a.signal_id, a.e * b.e AS w, sqrt(power(p.x - r.x, 2) + power(p.y - r.y, 2)) AS d FROM c AS a JOIN c AS b ON a.signal_id = b.signal_id AND a.pc < b.pc JOIN t AS p ON p.pc = a.pc JOIN t AS r ON r.pc = b.pc WHERE a.e * b.e > 1e-10)
SELECT signal_id, {_r('sum(w * d) / sum(w)', 'tension')}, {_r('sum(CASE WHEN d <= 1.5 THEN w ELSE 0 END) / sum(w)', 'consonance')}, {_r('1 - sum(CASE WHEN d <= 1.5 THEN w ELSE 0 END) / sum(w)', 'dissonance')} FROM q GROUP BY 1""",
)
def network_tension(spark, d):
    return rounded(tonal.network_tension(_chroma(spark, d)))


@query("harmonic_regions")
def harmonic_regions(spark, d):
    return tonal.harmonic_regions(_chroma(spark, d), 0.08)


_A = "2 * pi() * pc / 12"


@query(
    "profile_figures",
    f"""WITH {_CHROMA}, m AS (SELECT signal_id, atan2(sum(e * sin({_A})), sum(e * cos({_A}))) AS a, sum(e) AS t FROM c GROUP BY 1), ce AS (SELECT signal_id, CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END * 6 / pi() AS m, t FROM m),
g AS (SELECT c.signal_id, -sum(CASE WHEN e > 1e-10 THEN e * log2(e) ELSE 0 END) AS entropy, any_value(m) AS centroid, sqrt(sum(e * power(least(abs(pc - m), 12 - abs(pc - m)), 2)) / any_value(t)) AS spread, 1 - sqrt(avg(power(e - 1e0 / 12, 2))) * 12 AS uniformity, corr(e, exp(-0.3::DOUBLE * ((pc * 7) % 12))) AS fifths, any_value(t) AS t FROM c JOIN ce USING (signal_id) GROUP BY 1),
l AS (SELECT signal_id, list(e ORDER BY pc) AS e FROM c GROUP BY 1), rr AS (SELECT unnest(range(0, 12)) AS r),
h AS (SELECT signal_id, max(e[r + 1] * e[(r + 7) % 12 + 1]) AS td, max(power(e[r + 1] * e[(r + 4) % 12 + 1] * e[(r + 7) % 12 + 1], 1e0 / 3)) AS mj, max(power(e[r + 1] * e[(r + 3) % 12 + 1] * e[(r + 7) % 12 + 1], 1e0 / 3)) AS mn, max(e[r + 1] + e[(r + 2) % 12 + 1] + e[(r + 4) % 12 + 1] + e[(r + 5) % 12 + 1] + e[(r + 7) % 12 + 1] + e[(r + 9) % 12 + 1] + e[(r + 11) % 12 + 1]) AS di FROM l, rr GROUP BY 1)
SELECT signal_id, {', '.join(_r(c, c) for c in ('entropy', 'centroid', 'spread', 'uniformity', 'fifths'))}, {_r('td', 'tonic_dominant')}, {_r('mj', 'major_triad')}, {_r('mn', 'minor_triad')}, {_r('di / t', 'diatonic')} FROM g JOIN h USING (signal_id)""",
)
def profile_figures(spark, d):
    return rounded(tonal.profile_figures(_chroma(spark, d)))


@query(
    "salient_classes",
    f"""WITH {_CHROMA}, l AS (SELECT signal_id, list(e ORDER BY pc) AS l FROM c GROUP BY 1), s AS (SELECT signal_id, pc, e, (l[(pc + 1) % 12 + 1] + l[(pc + 11) % 12 + 1]) / 2 AS a FROM c JOIN l USING (signal_id) WHERE e >= 0.08)
SELECT signal_id, CAST(pc AS INTEGER) AS pc, {_r('e', 'share')}, {_r('CASE WHEN a > 1e-10 THEN e / a ELSE e END', 'salience')}, CAST(row_number() OVER (PARTITION BY signal_id ORDER BY round(e, 9) DESC, pc) AS INTEGER) AS rank FROM s""",
)
def salient_classes(spark, d):
    return rounded(tonal.salient_classes(_chroma(spark, d), 0.08))


def _chroma_pairs(spark, d):
    c = _chroma(spark, d)
    q = c.select(F.col("signal_id").alias("query_id"), F.col("chroma").alias("a"), (F.col("signal_id") + 1).alias("ref_id"))
    return q.join(c.select(F.col("signal_id").alias("ref_id"), F.col("chroma").alias("b")), "ref_id")


_CP = f"{_CHROMA}, cp AS (SELECT a.signal_id AS query_id, b.signal_id AS ref_id, a.pc AS pc, a.e AS x, b.e AS y FROM c AS a JOIN c AS b ON b.signal_id = a.signal_id + 1 AND b.pc = a.pc)"


@query(
    "profile_comparison",
    f"""WITH {_CP} SELECT query_id, ref_id, {_r('sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))', 'cosine')}, {_r('sqrt(sum((x - y) * (x - y)))', 'euclidean')}, {_r('sum(abs(x - y))', 'manhattan')}, {_r('corr(x, y)', 'correlation')}, {_r('(sum(CASE WHEN x > 1e-10 AND y > 1e-10 THEN x * ln(x / y) + y * ln(y / x) ELSE 0 END)) / 2', 'divergence')} FROM cp GROUP BY 1, 2""",
)
def profile_comparison(spark, d):
    return rounded(_chroma_pairs(spark, d).select("query_id", "ref_id", tonal.compare_profiles(F.col("a"), F.col("b")).alias("x")).select("query_id", "ref_id", "x.*"))


@query(
    "best_transposition",
    f"""WITH {_CHROMA}, ks AS (SELECT unnest(range(0, 12)) AS k), r AS (SELECT a.signal_id AS query_id, b.signal_id AS ref_id, k, round(corr(a.e, b.e), 9) AS r FROM c AS a, ks JOIN c AS b ON true WHERE b.signal_id = a.signal_id + 1 AND a.pc = (b.pc + k) % 12 GROUP BY 1, 2, 3)
SELECT query_id, ref_id, CAST(k AS INTEGER) AS shift, {_r('r', 'r')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, k) AS n FROM r) WHERE n = 1""",
)
def best_transposition(spark, d):
    b = _chroma_pairs(spark, d).select("query_id", "ref_id", tonal.best_transposition(F.col("a"), F.col("b")).alias("t"))
    return rounded(b.select("query_id", "ref_id", (-F.col("t.k")).alias("shift"), F.col("t.r").alias("r")))


@query(
    "sequence_similarity",
    f"""WITH {_FRAME_CHROMA}, k AS (SELECT signal_id, frame, row_number() OVER (PARTITION BY signal_id ORDER BY frame) - 1 AS k FROM fs), v AS (SELECT fc.signal_id, k.k, list(e ORDER BY pc) AS v FROM fc JOIN k USING (signal_id, frame) GROUP BY 1, 2),
ce AS (SELECT a.signal_id AS query_id, b.signal_id AS ref_id, a.k AS i, b.k AS j, a.v AS q, b.v AS r FROM v AS a JOIN v AS b ON b.signal_id = a.signal_id + 1), s AS (SELECT query_id, ref_id, 1 - (1 - list_dot_product(q, r) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(r, r)))) / 2 AS s FROM ce),
g AS (SELECT query_id, ref_id, avg(s) AS direct, avg(CASE WHEN s > 0.4 THEN 1.0::DOUBLE ELSE 0 END) AS bin_, max(s) AS qmax, count(*) AS n FROM s GROUP BY 1, 2), sh AS (SELECT unnest(range(0, 12)) AS k),
t AS (SELECT query_id, ref_id, sh.k AS k, sum(1 - (1 - list_dot_product(list_concat(q[sh.k + 1:12], q[1:sh.k]), r) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(r, r)))) / 2) AS t FROM ce, sh WHERE abs(i - j) <= 10 GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, ref_id ORDER BY round(t, 9) DESC, k) AS o FROM t)
SELECT query_id, ref_id, {_r('direct', 'direct')}, {_r('bin_', 'binary')}, {_r('qmax', 'qmax')}, {_r('t / n', 'oti')}, CAST(k AS INTEGER) AS shift FROM g JOIN b USING (query_id, ref_id) WHERE o = 1""",
)
def sequence_similarity(spark, d):
    f = _frames(spark, d)
    ids = f.select(F.col("signal_id").alias("query_id")).distinct()
    pairs = ids.join(ids.select(F.col("query_id").alias("ref_id")), F.col("ref_id") == F.col("query_id") + 1)
    return rounded(tonal.sequence_similarity(f, pairs))


def _neighbour_pairs(f):
    ids = f.select(F.col("signal_id").cast("long").alias("query_id")).distinct()
    return ids.join(ids.select(F.col("query_id").alias("ref_id")), F.col("ref_id") == F.col("query_id") + 1)


@query("local_alignment")
def local_alignment(spark, d):
    f = _frames(spark, d).withColumn("signal_id", F.col("signal_id").cast("long"))
    return tonal.local_alignment(f, _neighbour_pairs(f))


@query("warped_similarity")
def warped_similarity(spark, d):
    f = _frames(spark, d).withColumn("signal_id", F.col("signal_id").cast("long"))
    return tonal.warped_similarity(f, _neighbour_pairs(f))


_HZ = TONE / 2 / (BINS - 1)


@query(
    "hpcp",
    f"""WITH pk AS ({ORACLES['spectral_peaks']}), h AS (SELECT signal_id, frame, mag, place * {_HZ!r}::DOUBLE AS hz FROM pk), f AS (SELECT *, mag * mag * CASE WHEN hz < 500 THEN 2.0::DOUBLE ELSE 1 END AS w, (log2(hz / 440) * 12 + 9) - 12 * floor((log2(hz / 440) * 12 + 9) / 12) AS pc FROM h WHERE hz BETWEEN 40 AND 5000),
x AS (SELECT *, unnest(range(CAST(floor(pc - 0.5) AS BIGINT), CAST(ceil(pc + 0.5) AS BIGINT) + 1)) AS b FROM f), y AS (SELECT signal_id, frame, ((b % 12) + 12) % 12 AS b, sum(w * CASE WHEN abs(pc - b) <= 0.5 THEN greatest(0, cos(pi() * abs(pc - b))) ELSE 0 END) AS v FROM x GROUP BY 1, 2, 3),
z AS (SELECT signal_id, frame, sqrt(sum(v * v)) AS n FROM y GROUP BY 1, 2), tw AS (SELECT unnest(range(0, 12)) AS b)
SELECT z.signal_id, z.frame, CAST(tw.b AS INTEGER) AS pc, {_r('coalesce(v / nullif(n, 0), 0)', 'e', 5)} FROM z CROSS JOIN tw LEFT JOIN y ON y.signal_id = z.signal_id AND y.frame = z.frame AND y.b = tw.b""",
)
def hpcp(spark, d):
    p = rounded(peaks.spectral_peaks(tables.spectra(spark, d)))
    h = tonal.hpcp(p, TONE, BINS)
    return rounded(h.select("signal_id", "frame", F.posexplode("chroma").alias("pc", "e")), 5)


@query("constant_q")
def constant_q(spark, d):
    s = tables.signals(spark, d)
    return tonal.constant_q(s, 800.0, 32, 110.0, 380.0, q=8.0)


