"""Distances and similarities of two vectors, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import dot, let, mean, safe, squares, total


def _pair(a: Column, b: Column, f) -> Column:
    return total(F.zip_with(a, b, f))


def probability(a: Column) -> Column:
    """Positive part scaled to sum 1; uniform if there is none."""
    positive = F.transform(a, lambda v: F.greatest(v, F.lit(0.0)))
    return let(positive, lambda pos: let(total(pos), lambda s: let(1.0 / F.size(pos), lambda u: F.transform(pos, lambda v: F.when(s > 0, v / F.nullif(s, F.lit(0.0))).otherwise(u)))))


def euclidean(a, b):
    return F.sqrt(_pair(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a, b):
    return _pair(a, b, lambda x, y: F.abs(x - y))


def chebyshev(a, b):
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a, b, p: float = 3.0):
    return F.pow(_pair(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1 / p))


def cosine_similarity(a, b):
    return safe(dot(a, b), F.sqrt(squares(a)) * F.sqrt(squares(b)))


def cosine(a, b):
    return 1 - cosine_similarity(a, b)


def pearson_correlation(a, b):
    around = lambda x: let(x, lambda y: let(mean(y), lambda m: F.transform(y, lambda v: v - m)))
    return let(around(a), lambda da: let(around(b), lambda db: safe(dot(da, db), F.sqrt(squares(da)) * F.sqrt(squares(db)))))


def pearson(a, b):
    return 1 - F.abs(pearson_correlation(a, b))


def hamming(a, b):
    return _pair(a, b, lambda x, y: F.when(F.abs(x - y) > 1e-10, 1.0).otherwise(0.0)) / F.size(a)


def canberra(a, b):
    return _pair(a, b, lambda x, y: safe(F.abs(x - y), F.abs(x) + F.abs(y)))


def bray_curtis(a, b):
    return safe(_pair(a, b, lambda x, y: F.abs(x - y)), _pair(a, b, lambda x, y: F.abs(x) + F.abs(y)))


def jaccard(a, b):
    """1 - share of the positions that hold more than 1e-10 in both among those that do in either; 0 if there are none."""
    on = lambda x: F.abs(x) > 1e-10
    either = _pair(a, b, lambda x, y: F.when(on(x) | on(y), 1.0).otherwise(0.0))
    return F.when(either > 0, 1 - safe(_pair(a, b, lambda x, y: F.when(on(x) & on(y), 1.0).otherwise(0.0)), either)).otherwise(0.0)


def mahalanobis(a, b):
    """The Euclidean distance: without a covariance matrix every position counts alike."""
    return euclidean(a, b)


def bhattacharyya(a, b):
    return -F.log(F.greatest(_pair(probability(a), probability(b), lambda p, q: F.sqrt(p * q)), F.lit(1e-10)))


def kl_divergence(a, b):
    return _pair(probability(a), probability(b), lambda p, q: F.when((p > 0) & (q > 0), p * F.log(p / F.nullif(q, F.lit(0.0)))).otherwise(0.0))


def jensen_shannon(a, b):
    p, q = probability(a), probability(b)
    half = lambda x, m: F.when(x > 0, x * F.log(x / F.nullif(m, F.lit(0.0)))).otherwise(0.0)
    s = _pair(p, q, lambda x, y: (half(x, (x + y) / 2) + half(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(s, F.lit(0.0)))


def hellinger(a, b):
    return F.sqrt(_pair(probability(a), probability(b), lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y)))) / 2**0.5


def earth_movers(a, b):
    """Sum of absolute differences of the cumulative distributions."""
    d = F.zip_with(probability(a), probability(b), lambda x, y: x - y)
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("s"))
    return F.aggregate(d, zero, lambda acc, v: F.struct((acc["c"] + v).alias("c"), (acc["s"] + F.abs(acc["c"] + v)).alias("s")))["s"]


METRICS = {f.__name__: f for f in (euclidean, manhattan, chebyshev, minkowski, cosine, pearson, mahalanobis, hamming, jaccard, canberra, bray_curtis, kl_divergence, jensen_shannon, hellinger, bhattacharyya, earth_movers)}
