"""Shared pieces: table access, tables in the shared folder, and text batches for Arrow functions."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            folder = jvm_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="wavelens-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder


class Scratch:
    """Intermediate tables written to the shared folder, so that a lost executor costs no recomputation of what came before.

    A superseded table is dropped at once; what a returned frame still reads goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        fs, path = self._path(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, path: str):
        sc = self.spark.sparkContext
        hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(sc._jsc.hadoopConfiguration()), hpath

    def save(self, df: DataFrame, **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._wavelens_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that later ones supersede."""
        for df in frames:
            path = getattr(df, "_wavelens_path", None)
            if path:
                fs, hpath = self._path(path)
                fs.delete(hpath, True)


#: Bits of one bitmap, bits a key gets, and the most bitmaps a sieve has (4 KB each, 8 MB in all).
_BITMAP, _PER_KEY, _MOST = 1 << 15, 12, 2048


def _position(column: str, i: int) -> str:
    return f"pmod(shiftrightunsigned(xxhash64('bits', `{column}`), {15 * i}), {_BITMAP})"


def sieve(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """A Bloom filter of a frame's keys as rows (bucket, bits), bits as an array of longs, with the number of buckets; its size is bounded whatever the number of keys."""
    buckets = min(_MOST, max(1, -(-keys.count() * _PER_KEY // _BITMAP)))
    words = _BITMAP // 64
    at = keys.select(F.expr(f"pmod(xxhash64('sieve', `{column}`), {buckets})").alias("bucket"), F.explode(F.array(*(F.expr(_position(column, i)) for i in range(4)))).alias("p"))
    ones = at.select("bucket", F.expr("shiftright(p, 6)").alias("w"), F.expr("shiftleft(1L, int(p % 64))").alias("b"))
    none = keys.sparkSession.range(buckets * words).select(F.expr(f"id div {words}").alias("bucket"), F.expr(f"id % {words}").alias("w"), F.lit(0).cast("long").alias("b"))
    full = ones.unionByName(none).groupBy("bucket", "w").agg(F.bit_or("b").alias("b"))
    return full.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("r")).select("bucket", F.transform("r", lambda x: x["b"]).alias("bits")), buckets


def sift(df: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """The frame with a boolean column: false where the key is not in ``keys`` (a column of the same name), true where it is or, seldom, only seems to be.

    Rows found false need no join, so a join that follows moves only the others.
    """
    bitmaps, buckets = sieve(keys, column)
    bucket, bits = unique_name(df, "_bucket"), unique_name(df, "_bits")
    marked = df.withColumn(bucket, F.expr(f"pmod(xxhash64('sieve', `{column}`), {buckets})"))
    joined = marked.join(F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))), bucket, "left")
    test = " AND ".join(f"(get(`{bits}`, int(shiftright({p}, 6))) & shiftleft(1L, int({p} % 64))) <> 0" for p in (_position(column, i) for i in range(4)))
    return joined.withColumn(name, F.expr(f"coalesce({test}, false)")).drop(bucket, bits)


def without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is not among the frame ``keys`` (its column has the same name); only rows that seem to be move for the exact join."""
    maybe = unique_name(df, "_maybe")
    marked = sift(df, column, keys, maybe)
    rest = marked.where(F.col(maybe)).join(keys.hint("merge"), column, "left_anti")
    return marked.where(~F.col(maybe)).drop(maybe).unionByName(rest.drop(maybe))


@lru_cache(1)
def _trim():
    """The C library's call that gives freed memory back, or None where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its tasks, and what it keeps counts beside the next operator's."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def text_slices(batch: pa.RecordBatch, column: str, budget: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts a batch into row ranges of about ``budget`` text bytes; yields each with its texts as UTF-8 (null: empty).

    Only one range at a time is made into Python objects, and freed memory is given back after each batch.
    """
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n + 64
        if size >= budget or i == len(sizes) - 1:
            yield batch.slice(start, i + 1 - start), [x or b"" for x in values.slice(start, i + 1 - start).cast(pa.large_binary()).to_pylist()]
            start, size = i + 1, 0
    release()


def unique_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def ascii_lower(column: str | F.Column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of an undirected graph of long ids given as (src, dst): returns (node, component), the component being its smallest node.

    Alternates the large-star and small-star steps of the known distributed algorithm; each is one aggregate with map-side
    combining and one join on the node, so a node with very many links is split by the adaptive skew join. Every round is a
    table in the shared folder. Nodes without links do not appear; self links and nulls are ignored.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    e = scratch.save(e)
    state = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.where("u <> v").distinct())
        scratch.drop(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or now[0] == 0:
            break
        state = tuple(now)
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


