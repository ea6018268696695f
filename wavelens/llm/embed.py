"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors form one class with a count. Every class is put into one bucket of each table, by the signs of its products
with the table's random hyperplanes; within a bucket all cosines are computed in double precision, block by block. A pair
that meets in several tables counts in the first only, which both sides can tell from their sign codes, so link counts are
sums and no pair ever leaves its block; for the components a block emits a spanning forest of its links.

The number of planes grows with the logarithm of the number of classes, so that unrelated vectors share a bucket with a
bounded number of others, and the number of tables follows from it so that a pair at the threshold is missed with a
probability of at most ``miss``. A bucket beyond ``block`` classes is cut into chunks; each pair of chunks is a group of
its own, so a dense cluster is spread over many tasks and none holds more than two chunks.

Vectors that are null, zero, or hold a null or non-finite component, and rows without an id, link with nothing. Vectors of
different lengths are never compared. Repeated rows count as further vectors of their class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

_BUCKET = 256  # classes that share a bucket by chance, about


def plan(classes: int, threshold: float, miss: float) -> tuple[int, int]:
    """Planes a table, and tables."""
    bits = min(30, max(6, round(math.log2(max(classes, 1) / _BUCKET + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def sign_codes(v: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """(rows, tables) codes of unit vectors."""
    signs = (v @ planes(v.shape[1], tables, bits, seed) > 0).reshape(len(v), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _groups_by_dim(batch: pa.RecordBatch, at: int):
    sizes = np.diff(batch.column(at).offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(sizes == dim))) if len(np.unique(sizes)) > 1 else batch


def bucket_rows(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """(bucket, rep): the buckets of every class."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for dim, part in _groups_by_dim(batch, 1):
                codes = sign_codes(_unit(_matrix(part.column(1), dim)), tables, bits, seed)
                bucket = ((dim * tables + np.arange(tables)) << bits) + codes
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), tables))], ["bucket", "rep"])

    return classes.select("rep", "v").mapInArrow(run, "bucket long, rep long")


def _forest(near: np.ndarray, rep: np.ndarray) -> list[tuple[int, int]]:
    todo, out = np.ones(len(rep), bool), []
    for seed in range(len(rep)):
        if todo[seed]:
            todo[seed], front = False, [seed]
            while front:
                at = front.pop()
                got = np.flatnonzero(near[at] & todo)
                todo[got] = False
                out.extend((int(rep[at]), int(rep[x])) for x in got)
                front.extend(got.tolist())
    return out


def block_links(dealt: DataFrame, threshold: float, tables: int, bits: int, seed: int) -> DataFrame:
    """(src, dst, n): for each block links that connect what it links (n null), and each class's linked rows (dst null)."""

    def one(key, rows):
        bucket, i, j = key
        rep, weight, chunk = (np.concatenate([r[k] for r in rows]) for k in (0, 1, 2))
        v = _unit(np.concatenate([r[3] for r in rows]))
        near = v @ v.T >= threshold
        np.fill_diagonal(near, False)
        if i != j:
            near &= chunk[:, None] != chunk[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            return [], []
        codes = sign_codes(v, tables, bits, seed)
        table = (bucket >> bits) % tables
        if table:
            met = np.zeros(len(a), bool)
            for t in range(table):
                met |= codes[a, t] == codes[b, t]
            near[a[met], b[met]] = False
        counts = near @ weight
        return _forest(near, rep), [(int(r), int(c)) for r, c in zip(rep, counts) if c]

    def run(batches):
        key, rows, src, dst, n = None, [], [], [], []

        def close():
            if key is not None and sum(len(r[0]) for r in rows) > 1:
                links, counts = one(key, rows)
                for x, y in links:
                    src.append(x), dst.append(y), n.append(None)
                for x, c in counts:
                    src.append(x), dst.append(None), n.append(c)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(n, pa.int64())], ["src", "dst", "n"])
            for x in (src, dst, n):
                x.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(k[a].tolist())
                if now != key:
                    close()
                    key, rows = now, []
                part = batch.slice(a, b - a)
                dim = len(part.column(6)[0])
                rows.append((part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_numpy(), _matrix(part.column(6), dim)))
            if len(src) > 20_000:
                yield flush()
        close()
        yield flush()

    return dealt.mapInArrow(run, "src long, dst long, n long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, miss: float = 0.02, seed: int = 20240, block: int = 256) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    scratch = Scratch(df.sparkSession, "embed")
    rows = df.select(F.col(key).alias("_id"), F.col(vector).alias("_v"))
    fine = F.expr("_id IS NOT NULL AND _v IS NOT NULL AND size(_v) > 0 AND forall(_v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(_v, x -> x <> 0)")
    good = rows.where(F.coalesce(fine, F.lit(False)))
    classes = scratch.save(good.groupBy("_v").agg(F.min("_id").cast("long").alias("rep"), F.count("*").alias("w")).withColumnRenamed("_v", "v"))
    bits, tables = plan(classes.count(), threshold, miss)
    buckets = scratch.save(bucket_rows(classes, tables, bits, seed))
    crowded = scratch.save(buckets.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > 1).select("bucket", F.ceil(F.col("m") / block).cast("int").alias("c")))
    placed = buckets.join(crowded, "bucket").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("c")).cast("int"))
    pairs = F.expr("transform(sequence(0, c - 1), o -> named_struct('i', least(o, chunk), 'j', greatest(o, chunk)))")
    placed = placed.select("rep", "bucket", "chunk", F.explode(pairs).alias("p"))
    dealt = placed.join(classes, "rep").select("bucket", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "rep", "w", "chunk", "v")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = scratch.save(block_links(dealt, threshold, tables, bits, seed))
    counts = found.where("n IS NOT NULL").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("others"))
    labels = connected_components(found.where("dst IS NOT NULL").select("src", "dst"), scratch).select(F.col("node").alias("rep"), "component")
    named = classes.join(counts, "rep", "left").join(labels, "rep", "left")
    named = named.select(F.col("v").alias("_c"), (F.coalesce("others", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(named, F.col("_v") == F.col("_c")).select("_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fine, F.lit(False))).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("_id").alias(key), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))
