"""SimHash near-duplicate detection by deletion-variant signatures.

Words are the runs of bytes other than ASCII white space of the text with A-Z lower-cased; features are the three-word
shingles, repeats included (fewer words: the whole sequence). A bit of the 64-bit fingerprint is set if it is set in more
than half of the shingles' XXH64 hashes. A text without words has fingerprint zero and links like any other.

Two fingerprints that differ in at most two bits differ in at most one bit in one of two 32-bit segments. Each distinct
fingerprint is indexed under its 64 one-wildcard variants (segment, wildcard bit, the segment without that bit); equal
variants meet, and the pairs of a group are verified by counting differing bits. A fingerprint gives each of the 64
(segment, bit) slots one row, so no variant can hold more than a 64th of the index, however many copies a text has.
Within a group only a spanning forest of its links is kept. Groups with more than ``group`` fingerprints are not paired at
all: their members meet once more under every whole fingerprint at distance one or zero. All that meet under such a centre
are within two bits of each other, and any two within two bits share a centre, so linking each to the smallest is exact
and never forms pairs.

Nulls count as empty texts. Rows with equal texts share one fingerprint; the class is named by its smallest id. A null id
gets its class's component and never names one. An empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, text_slices, unique_name, without

_CHUNK = 1 << 16  # shingles whose bits are unpacked at once


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one UTF-8 text as an unsigned 64-bit number."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    w = min(words, len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - w + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[w - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed 64-bit number."""
    schema = T.StructType([df.schema[key], T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, text):
                fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def variants(reps: DataFrame) -> DataFrame:
    """(slot_key, fp, rep): the 64 one-wildcard segment variants of every fingerprint."""
    i = F.col("i")
    seg = F.when(i < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    bit = F.expr("shiftleft(1L, i % 32)")
    masked = seg.bitwiseAND(F.bitwise_not(bit))
    return reps.select("fp", "rep", F.explode(F.expr("sequence(0, 63)")).alias("i")).select((i.cast("long") * F.lit(1 << 32) + masked).alias("slot_key"), "fp", "rep")


def _spanning(fp: np.ndarray, rep: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a small group that connect all that its verified pairs connect."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= bits
    todo, out = np.ones(len(fp), bool), []
    for seed in range(len(fp)):
        if todo[seed]:
            todo[seed], front = False, [seed]
            while front:
                at = front.pop()
                for nxt in np.flatnonzero(near[at] & todo).tolist():
                    todo[nxt] = False
                    out.append((int(rep[at]), int(rep[nxt])))
                    front.append(nxt)
    return out


def links(reps: DataFrame, scratch: Scratch, bits: int = 2, group: int = 128) -> DataFrame:
    """(src, dst): links between the representatives of distinct fingerprints, enough to connect all within ``bits`` <= 2."""
    if not 0 <= bits <= 2:
        raise ValueError("two segments with one wildcard find at most two differing bits")
    schema = "src long, dst long, crowded boolean, fp long"

    def run(batches):
        key, fps, repids, crowded = None, [], [], False
        src, dst, flag, val = [], [], [], []

        def close():
            if not crowded and len(fps) > 1:
                for a, b in _spanning(np.array(fps, np.int64).view(np.uint64), np.array(repids), bits):
                    src.append(a), dst.append(b), flag.append(False), val.append(0)

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(flag, pa.bool_()), pa.array(val, pa.int64())], ["src", "dst", "crowded", "fp"])
            for x in (src, dst, flag, val):
                x.clear()
            return out

        for batch in batches:
            k = batch.column(0).to_numpy()
            f, r = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if k[a] != key:
                    close()
                    key, fps, repids, crowded = k[a], [], [], False
                fps.extend(f[a:b].tolist()), repids.extend(r[a:b].tolist())
                if crowded or len(fps) > group:
                    crowded = True
                    for x, y in zip(fps, repids):
                        src.append(y), dst.append(y), flag.append(True), val.append(x)
                    fps, repids = [], []
            if len(src) > 50_000:
                yield flush()
        close()
        yield flush()

    indexed = variants(reps).repartition("slot_key").sortWithinPartitions("slot_key")
    found = scratch.save(indexed.mapInArrow(run, schema))
    near = found.where("not crowded").select("src", "dst")
    centres = found.where("crowded").select("fp", F.col("src").alias("rep")).distinct()
    flips = F.expr("transform(sequence(0, 64), i -> if(i = 64, fp, fp ^ shiftleft(1L, i)))")
    balls = centres.select("rep", F.explode(flips).alias("centre"))
    first = balls.groupBy("centre").agg(F.min("rep").alias("dst"))
    if bits < 2:  # then a shared centre is no proof
        own = centres.select(F.col("rep").alias("src"), F.explode(F.expr("transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))")).alias("other")).where(F.lit(bits == 1))
        crowd = own.join(centres.select(F.col("fp").alias("other"), F.col("rep").alias("dst")), "other").select("src", "dst")
    else:
        crowd = balls.join(first, "centre").select(F.col("rep").alias("src"), "dst").where("src <> dst").distinct()
    return near.unionByName(crowd)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2, group: int = 128) -> DataFrame:
    """(key, fingerprint, component_id) for every row: 16 hex digits, and the smallest id reachable over links."""
    scratch = Scratch(df.sparkSession, "simhash")
    fps = scratch.save(fingerprints(df, key, text, words))
    reps = scratch.save(fps.groupBy("fp").agg(F.min(key).cast("long").alias("rep")))
    labels = connected_components(links(reps.where("rep is not null"), scratch, bits, group), scratch)
    named = reps.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(named, F.col("fp") == F.col("_fp"))
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2, group: int = 128) -> DataFrame:
    """One row of every group with all its columns: that with the smallest id. Rows without an id come after all others; of rows that share the id, any one is taken.

    Rows go by numbers of their own, so repeated and null ids are rows like others.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    row, fp = unique_name(df, "_row"), unique_name(df, "_fp")

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        parts = text_slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t")
        return pa.array(np.array([fingerprint(t, words) for _, part in parts for t in part], np.uint64).view(np.int64))

    rows = scratch.save(df.withColumns({row: F.monotonically_increasing_id(), fp: of(text)}))
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(row).alias("row"))
    reps = scratch.save(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first")))
    nodes = reps.select("fp", F.col("first.row").alias("rep"))
    labels = connected_components(links(nodes, scratch, bits, group), scratch)
    kept = reps.join(labels, F.col("first.row") == F.col("node"), "left").groupBy(F.coalesce("component", "first.row")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    others = scratch.save(rows.select(row).join(kept, row, "left_anti"))
    return without(rows.drop(fp), row, others).select(df.columns)
