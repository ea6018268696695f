"""Comparison of vectors and fingerprints: distances to centres, nearest neighbours, weighted matches, cluster indices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blocks as blocks_of
from ..functions import distance as dist
from ..functions import spectral as sp
from ..functions.arrays import safe
from . import presets, spectrum, tonal

BROADCAST_ROWS, BLOCK = 100_000, 2_000


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast only if counted and small."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def meet(queries: DataFrame, rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Every query with every row, block by block: rows are dealt by ``key`` into blocks of about ``block``, and each query goes once to every block,
    so the work is spread evenly and neither side has to fit anywhere."""
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    return queries.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "_block").drop("_block")


def centres(vectors: DataFrame) -> DataFrame:
    """(label, c, n): mean vector of every label, position by position."""
    e = vectors.select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return e.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("c"), F.max("n").alias("n"))


def centre_distances(vectors: DataFrame) -> DataFrame:
    """Each vector's distance to its label's centre by every metric."""
    j = vectors.join(small(centres(vectors)), "label")
    return j.select("id", "label", *(f(F.col("v"), F.col("c")).alias(name) for name, f in dist.METRICS.items()))


def distance_matrix(vectors: DataFrame, metric=dist.euclidean, block: int = BLOCK) -> DataFrame:
    """(a, b, distance) of all pairs with a < b."""
    q = vectors.select(F.col("id").alias("a"), F.col("v").alias("p"))
    return meet(q, vectors.select(F.col("id").alias("b"), F.col("v").alias("q")), "b", block).where("a < b").select("a", "b", metric(F.col("p"), F.col("q")).alias("distance"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric=dist.cosine, block: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest other vectors of every query, over all pairs; each block gives its own k first.

    By cosine, blocks of vectors (about ``block``, unless told otherwise 2,000 to 65,536) meet chunks of at most about 32,768 queries, and each meeting is a matrix
    product; vectors that are null or empty are left out, and a null component counts as zero, as in SQL. Other metrics go pair by pair.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    if metric is not dist.cosine:
        d = meet(q, vectors.select("id", "v"), "id", block or BLOCK).where("id <> query_id").select("query_id", "id", F.round(metric(F.col("q"), F.col("v")), 9).alias("distance"))
        return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    rows, asked = (x.where("id IS NOT NULL AND size(v) > 0").select("id", "v") for x in (vectors, queries))
    n = rows.count()
    block = block or min(max(-(-n // 32), BLOCK), 1 << 16)
    blocks, chunks = max(1, -(-n // block)), max(1, -(-asked.count() // (1 << 15)))
    dealt = lambda df, own, of, other, others, side: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(of))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select(F.col("_block").cast("long"), F.col("_chunk").cast("long"), F.lit(side).alias("side"), "id", "v")
    both = dealt(rows, "_block", blocks, "_chunk", chunks, 0).unionByName(dealt(asked, "_chunk", chunks, "_block", blocks, 1))
    kind = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", kind), T.StructField("distance", T.DoubleType())])

    def near(t: pa.Table) -> pa.Table:
        side, ids, v = t["side"].to_numpy(), t["id"].to_numpy(), blocks_of.matrix(t["v"])
        order = np.unique(ids, return_inverse=True)[1]
        a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        i, j, d = blocks_of.nearest_by_cosine(v[a], order[a], v[b], order[b], k)
        return pa.table({"query_id": t["id"].take(pa.array(a[i])), "id": t["id"].take(pa.array(b[j])), "distance": pa.array(d)})

    d = both.groupBy("_block", "_chunk").applyInArrow(near, schema)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fingerprints(spectra: DataFrame) -> DataFrame:
    """(signal_id, f, frames): means and sample deviations of every bin over a signal's frames."""
    e = spectra.select("signal_id", F.posexplode("m").alias("j", "x")).groupBy("signal_id", "j").agg(F.avg("x").alias("a"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
    g = e.groupBy("signal_id").agg(F.sort_array(F.collect_list(F.struct("j", "a", "s"))).alias("r"), F.max("n").alias("frames"))
    return g.select("signal_id", F.concat(F.transform("r", lambda x: x["a"]), F.transform("r", lambda x: x["s"])).alias("f"), "frames")


#: The least similarity of each label, best first.
LABELS = ((0.95, "exact"), (0.85, "very_similar"), (0.75, "similar"), (0.6, "somewhat_similar"))


def match_label(s):
    out = F.when(F.lit(False), "")
    for least, name in LABELS:
        out = out.when(s >= least, name)
    return out.otherwise("weak")


def matches(prints: DataFrame, threshold: float = 0.7, most: int = 50, block: int = BLOCK) -> DataFrame:
    """(query_id, candidate_id, similarity, confidence, label, rank): ranked other fingerprints at or above the threshold."""
    q = prints.select(F.col("signal_id").alias("query_id"), F.col("f").alias("q"))
    j = meet(q, prints.select(F.col("signal_id").alias("candidate_id"), "f"), "candidate_id", block).where("candidate_id <> query_id")
    j = j.select("query_id", "candidate_id", F.round(dist.cosine_similarity(F.col("q"), F.col("f")), 9).alias("similarity"))
    s = F.col("similarity")
    conf = F.least(F.lit(1.0), 0.5 + F.when(s > 0.8, 0.3).when(s > 0.6, 0.2).otherwise(0.0) + 0.05)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "candidate_id")
    return j.where(s >= threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "candidate_id", "similarity", conf.alias("confidence"), match_label(s).alias("label"), "rank")


def signal_features(spectra: DataFrame, rate: float, bins: int, coefficients: int = 13, temporal: DataFrame | None = None) -> DataFrame:
    """One nested row a signal: (signal_id, frames, mfcc, spectral, chroma, harmonic, temporal).

    mfcc holds the means and sample deviations of the coefficients; spectral and harmonic the mean and deviation of centroid, rolloff and flux, and of the strongest
    bin and its strength; chroma the mean vector; temporal (null without such a row) the scalars range_db, silence and density, and the mean and deviation
    of the level, from a frame (signal_id, range_db, silence, density, level_mean, level_dev). Everything is averaged by partial aggregates.
    """
    both = lambda c: (F.avg(c).alias(f"{c}_m"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_s"))
    pair = lambda c: F.array(F.col(f"{c}_m"), F.col(f"{c}_s"))
    top = F.array_max("m")
    s = spectra.select("signal_id", "frame", sp.centroid("m", rate).alias("centroid"), sp.rolloff("m", rate).alias("rolloff"), top.alias("strength"), (F.array_position("m", top) - 1).cast("double").alias("place"), sp.mfcc("m", rate, bins, coefficients=coefficients).alias("c"))
    s = s.select("*", *(F.col("c")[k].alias(f"c{k}") for k in range(coefficients)))
    names = ["centroid", "rolloff", "strength", "place"] + [f"c{k}" for k in range(coefficients)]
    g = s.groupBy("signal_id").agg(F.count("*").alias("frames"), *(x for c in names for x in both(c)))
    flux = spectrum.flux(spectra).groupBy("signal_id").agg(*both("flux"))
    c = tonal.chroma(spectra, rate)
    j = g.join(flux, "signal_id", "left").join(c, "signal_id", "left")
    mfcc = F.array(*(F.col(f"c{k}_m") for k in range(coefficients)), *(F.col(f"c{k}_s") for k in range(coefficients)))
    spectral = F.struct(pair("centroid").alias("centroid"), pair("rolloff").alias("rolloff"), F.when(F.col("flux_m").isNotNull(), pair("flux")).alias("flux"))
    out = j.select("signal_id", "frames", mfcc.alias("mfcc"), spectral.alias("spectral"), "chroma", F.struct(pair("strength").alias("ratio"), pair("place").alias("pitch")).alias("harmonic"))
    if temporal is None:
        return out.withColumn("temporal", F.lit(None).cast("struct<range_db:double,silence:double,density:double,level:array<double>>"))
    t = temporal.select("signal_id", F.struct("range_db", "silence", F.col("density").cast("double").alias("density"), F.array("level_mean", "level_dev").alias("level")).alias("temporal"))
    return out.join(t, "signal_id", "left")


def scalar_similarity(a: Column, b: Column) -> Column:
    """1 - difference over the larger magnitude, at least 0; 1 for two zeros."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.nullif(top, F.lit(0.0))))


def _mean_of(parts: list[Column]) -> Column:
    """Mean of the values that are not null."""
    n = sum(F.when(p.isNotNull(), 1).otherwise(0) for p in parts)
    return sum(F.coalesce(p, F.lit(0.0)) for p in parts) / F.nullif(n.cast("double"), F.lit(0.0))


def group_similarities(a: str, b: str) -> dict[str, Column]:
    """Similarity of each feature group of two nested rows (prefixes of their columns); null where either lacks the group."""
    col = lambda side, path: F.col(f"{side}{path}")
    cos = lambda path: F.when(col(a, path).isNotNull() & col(b, path).isNotNull(), dist.cosine_similarity(col(a, path), col(b, path)))
    scalar = lambda path, positive: F.when((col(a, path) > 0) & (col(b, path) > 0) if positive else col(a, path).isNotNull() & col(b, path).isNotNull(), scalar_similarity(col(a, path), col(b, path)))
    return {
        "mfcc": cos("mfcc"), "spectral": _mean_of([cos(f"spectral.{c}") for c in ("centroid", "rolloff", "flux")]), "chroma": cos("chroma"),
        "temporal": _mean_of([scalar("temporal.range_db", True), scalar("temporal.silence", False), scalar("temporal.density", True), cos("temporal.level")]), "harmonic": _mean_of([cos("harmonic.ratio"), cos("harmonic.pitch")]),
    }


GROUPS = ("mfcc", "spectral", "chroma", "temporal", "harmonic")


def compared(pairs: DataFrame, content: str = "unknown", same_type: Column | None = None, filtered: bool = False) -> DataFrame:
    """Compares pairs of nested rows, whose columns begin with q_ and c_: a similarity a group, the weighted mean of those present, confidence,
    availability, noise and label.

    Weights are those of the query's content type. Confidence is 0.5, plus 0.3 above a similarity of 0.8 or 0.2 above 0.6, 0.1 for the same type, 0.05 a group, a tenth of the
    availability (share of six groups) less a tenth of the noise (deviation of the groups' similarities), within 0 and 1. With ``filtered`` a pair of different types has similarity 0 and confidence 0.25.
    """
    same = F.lit(True) if same_type is None else same_type
    w = presets.of(presets.COMPARISON_WEIGHTS, content)
    s = pairs.select("*", *(c.alias(f"s_{k}") for k, c in group_similarities("q_", "c_").items()))
    here = [F.col(f"s_{k}").isNotNull() for k in GROUPS]
    n = sum(F.when(h, 1).otherwise(0) for h in here)
    weight = sum(F.when(h, w[k]).otherwise(0.0) for h, k in zip(here, GROUPS))
    value = sum(F.coalesce(F.col(f"s_{k}") * w[k], F.lit(0.0)) for k in GROUPS)
    s = s.withColumns({"_n": n, "similarity": F.round(safe(value, weight), 9), "_same": same})
    mean = sum(F.coalesce(F.col(f"s_{k}"), F.lit(0.0)) for k in GROUPS) / F.nullif(F.col("_n").cast("double"), F.lit(0.0))
    square = sum(F.when(h, (F.col(f"s_{k}") - mean) * (F.col(f"s_{k}") - mean)).otherwise(0.0) for h, k in zip(here, GROUPS))
    s = s.withColumn("noise", F.when(F.col("_n") == 0, 0.5).when(F.col("_n") == 1, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(square / F.nullif(F.col("_n") - 1, F.lit(0))))))
    s = s.withColumn("availability", F.col("_n") / 6)
    x = F.col("similarity")
    conf = 0.5 + F.when(x > 0.8, 0.3).when(x > 0.6, 0.2).otherwise(0.0) + F.when(F.col("_same"), 0.1).otherwise(0.0) + 0.05 * F.col("_n") + 0.1 * F.col("availability") - 0.1 * F.col("noise")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))
    if filtered:
        s, conf = s.withColumn("similarity", F.when(F.col("_same"), x).otherwise(0.0)), F.when(F.col("_same"), conf).otherwise(0.25)
    return s.withColumns({"confidence": conf, "label": match_label(F.col("similarity"))}).drop("_n", "_same")


def batch_compare(features: DataFrame, queries: DataFrame | None = None, content: str = "unknown", block: int = BLOCK) -> DataFrame:
    """(query_id, candidate_id, similarities, ...): every query's nested row compared with every other signal's, without a threshold."""
    side = lambda df, p, name: df.select(F.col("signal_id").alias(name), *(F.col(c).alias(f"{p}{c}") for c in df.columns if c != "signal_id"))
    q, c = side(features if queries is None else queries, "q_", "query_id"), side(features, "c_", "candidate_id")
    pairs = meet(q, c, "candidate_id", block).where("query_id <> candidate_id")
    return compared(pairs, content).select("query_id", "candidate_id", *(f"s_{k}" for k in GROUPS), "similarity", "confidence", "availability", "noise", "label")


def best_matches(comparisons: DataFrame, threshold: float = 0.75, most: int = 50) -> DataFrame:
    """The comparisons at or above the threshold with their rank by similarity (ties by candidate), at most ``most`` a query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "candidate_id")
    return comparisons.where(F.col("similarity") >= threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def similarity_statistics(comparisons: DataFrame) -> DataFrame:
    """One row: mean, least, most, median (the lower of two) and sample deviation of the similarities, mean confidence, and their number."""
    x = F.col("similarity")
    return comparisons.agg(F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY similarity)").alias("median"), F.stddev_samp(x).alias("deviation"), F.avg("confidence").alias("confidence"), F.count("*").alias("n"))


def spectral_coherence(spectra: DataFrame, pairs: DataFrame, rate: float) -> DataFrame:
    """(query_id, ref_id, coherence): mean magnitude of the correlations of two signals' centroids and rolloffs, frame by frame in order; 0.5 where neither is defined."""
    w = Window.partitionBy("signal_id").orderBy("frame")
    s = spectra.select("signal_id", F.row_number().over(w).alias("k"), sp.centroid("m", rate).alias("a"), sp.rolloff("m", rate).alias("b"))
    q = pairs.join(s.select(F.col("signal_id").alias("query_id"), "k", F.col("a").alias("qa"), F.col("b").alias("qb")), "query_id")
    j = q.join(s.select(F.col("signal_id").alias("ref_id"), "k", F.col("a").alias("ra"), F.col("b").alias("rb")), ["ref_id", "k"])
    sound = lambda a, b: F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.abs(F.corr(a, b)))
    return j.groupBy("query_id", "ref_id").agg(F.coalesce(_mean_of([sound("qa", "ra"), sound("qb", "rb")]), F.lit(0.5)).alias("coherence"))


def validity(vectors: DataFrame) -> DataFrame:
    """One row: Davies-Bouldin and Calinski-Harabasz indices of the labelling."""
    c = centres(vectors)
    d = vectors.join(small(c), "label").select("label", "n", "c", dist.euclidean(F.col("v"), F.col("c")).alias("d"))
    per = d.groupBy("label").agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"), F.max("n").alias("n"), F.first("c").alias("c"))
    a = per.select(F.col("label").alias("la"), F.col("s").alias("sa"), F.col("c").alias("ca"))
    b = per.select(F.col("label").alias("lb"), F.col("s").alias("sb"), F.col("c").alias("cb"))
    r = meet(a, b, "lb").where("la <> lb").groupBy("la").agg(F.max(safe(F.col("sa") + F.col("sb"), dist.euclidean(F.col("ca"), F.col("cb")))).alias("r"))
    db = r.agg(F.avg("r").alias("davies_bouldin"))
    whole = vectors.select(F.posexplode("v").alias("j", "x")).groupBy("j").agg((F.var_pop("x") * F.count("*")).alias("t")).agg(F.sum("t").alias("total"))
    ch = per.agg(F.sum("ss").alias("within"), F.sum("n").alias("n"), F.count("*").alias("k")).join(F.broadcast(whole), F.lit(True))  # one row each
    ch = ch.select(safe((F.col("total") - F.col("within")) / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("calinski_harabasz"))
    return db.join(F.broadcast(ch), F.lit(True))
