"""Exact removal of repeated byte strings by sorted suffixes.

Every byte that lies in a string of ``length`` bytes which also starts in a document with a smaller id is removed. Strings
are judged on the input and never cross documents; texts are UTF-8 bytes.

Only some suffixes are sorted. Every window of ``length`` bytes is represented by its leading suffix: the start, within the
window, of the 16-byte token whose hash is smallest (the leftmost of equals). Equal windows choose equal tokens, so windows
can only be equal among suffixes that begin with the same token, and consecutive windows of a document mostly share one.

1. Each document's tokens are gathered; those that occur in one document only cannot begin a repeated window. Documents
   are first compared within their task, so a token of very many documents is sent once a task.
2. Suffixes that begin with a repeated token, with the bytes of their windows, are range-partitioned by leading bytes at
   sampled splitters. Stretches that are equal within a task are sent for their smallest document alone; in the others all
   windows are repeated.
3. Splitters fall between tokens, so equal windows are never on two sides of a boundary. Each run of equal tokens has its
   windows sorted by a multikey quicksort on eight bytes at a time that drops windows as soon as they are alone.
4. The smallest document of each group of equal windows decides; documents get back one bit a window.

Null texts are empty. A null id neither removes nor loses anything. Rows with equal ids do not remove from each other.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_slices

TOKEN = 16
_POS = np.uint64((1 << 24) - 1)
#: Windows whose leading tokens are sought at a time; with the bytes of the last one fewer than ``_POS``.
PIECE = 1 << 23


def _words(buf: bytes) -> np.ndarray:
    """The eight bytes from each position on, big-endian."""
    n = len(buf)
    return np.ndarray((n,), ">u8", buf + b"\0" * 8, strides=(1,)).astype(np.uint64)


def segments(texts: list[bytes], length: int):
    """For a run of texts: joined bytes, and arrays (text, first window, last window, suffix start, token hash) of stretches of windows with one leading suffix."""
    buf = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.maximum(sizes - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not counts.sum():
        return buf, begin, none, none, none, none, none.astype(np.uint64)
    found = []
    for lo in range(0, len(buf), PIECE):
        s, doc = _windows(begin, counts, lo, lo + PIECE)
        if not len(s):
            continue
        h = _token_hashes(buf[lo : lo + PIECE + length - 1])
        a = _leading(h, length - TOKEN + 1)[s - lo]
        first = _heads(a, doc)
        last = np.concatenate([first[1:], [len(s)]]) - 1
        found.append((doc[first], s[first], s[last], a[first] + lo, h[a[first]]))
    doc, s1, s2, a, h = (np.concatenate(x) for x in zip(*found))
    first = _heads(a, doc)  # a stretch may go on in the next piece
    last = np.concatenate([first[1:], [len(a)]]) - 1
    return buf, begin, doc[first], s1[first], s2[last], a[first], h[first]


def _windows(begin: np.ndarray, counts: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that start in bytes lo to hi - 1 of the joined texts, and their texts."""
    from_, to = (np.searchsorted(begin, x, side) for x, side in ((lo, "right"), (hi, "left")))
    at = np.arange(from_ - 1, min(to, len(counts)))
    first = np.maximum(begin[at], lo)
    n = np.maximum(np.minimum(begin[at] + counts[at], hi) - first, 0)
    s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return s, np.repeat(at, n)


def _heads(a: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))


def _token_hashes(buf: bytes) -> np.ndarray:
    """A hash of the sixteen bytes from each position on."""
    w = _words(buf)
    tail = np.zeros_like(w)
    tail[:-8] = w[8:]
    with np.errstate(over="ignore"):
        h = (w * np.uint64(0x9E3779B97F4A7C15)) ^ ((tail + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _leading(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of the span hashes from each position on, the leftmost of equals; for fewer than 2^24 hashes."""
    m = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        m[:-reach] = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if span > reach:
        m[: -(span - reach)] = np.minimum(m[: -(span - reach)], m[span - reach :])
    return (m & _POS).astype(np.int64)


def _slices(batches, budget=1 << 22):
    """Rows of (key columns..., text) in runs of a few MB."""
    for batch in batches:
        yield from text_slices(batch, "text", budget)


def repeated_tokens(rows: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(doc, h): the leading tokens of each document that other documents have too.

    A task sends a token once, for its first document; those of its further documents are known to be repeated, as is the
    first then, and are dealt anywhere.
    """

    def gather(batches):
        held: list[tuple] = []
        size = 0

        def close():
            h, d = (np.concatenate([x[i] for x in held]) for i in range(2))
            held.clear()
            o = np.lexsort((d, h))
            h, d = h[o], d[o]
            keep = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            h, d = h[keep].view(np.int64), d[keep]
            head = np.concatenate([[True], h[1:] != h[:-1]])
            more = np.concatenate([~head[1:], [False]])  # a head that others in this task follow
            known = ~head | (head & more)
            for sel, at in ((head, h), (known, d)):
                yield pa.RecordBatch.from_arrays([pa.array(at[sel]), pa.array(h[sel]), pa.array(d[sel]), pa.array(np.full(sel.sum(), at is d))], ["k", "h", "doc", "known"])

        for part, texts in _slices(batches):
            _, _, doc, _, _, _, h = segments(texts, length)
            if len(h):
                held.append((h, part.column(0).to_numpy()[doc]))
                size += len(h)
            if size > 4_000_000:
                yield from close()
                size = 0
        if held:
            yield from close()

    def meet(batches):
        prev = None  # the last row of the batch before, still undecided, and whether it equals its predecessor
        for batch in batches:
            if batch.num_rows:
                known = batch.column(3).to_numpy(zero_copy_only=False)
                h, d = (batch.column(i).to_numpy() for i in (1, 2))
                if known.any():
                    yield pa.RecordBatch.from_arrays([pa.array(d[known]), pa.array(h[known])], ["doc", "h"])
                h, d = h[~known], d[~known]
                if not len(h):
                    continue
                if prev is not None:
                    h, d = np.concatenate([[prev[0]], h]), np.concatenate([[prev[1]], d])
                same = h[1:] == h[:-1]
                shared = np.concatenate([[prev is not None and prev[2]], same])
                shared[:-1] |= same
                prev = (h[-1], d[-1], bool(shared[-1]))
                out = shared[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(d[:-1][out]), pa.array(h[:-1][out])], ["doc", "h"])
        if prev is not None and prev[2]:
            yield pa.RecordBatch.from_arrays([pa.array([prev[1]]), pa.array([prev[0]])], ["doc", "h"])

    dealt = rows.mapInArrow(gather, "k long, h long, doc long, known boolean").repartition("k").sortWithinPartitions("known", "h")
    return scratch.save(dealt.mapInArrow(meet, "doc long, h long"))


def splitters(rows: DataFrame, length: int, buckets: int, sample: int = 2000) -> list[int]:
    """Leading eight bytes that cut the suffixes of a bounded sample of documents into equal parts."""

    def lead(batches):
        for part, texts in _slices(batches):
            buf, _, _, _, _, a, _ = segments([t[:20000] for t in texts], length)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array((_words(buf)[a] ^ np.uint64(1 << 63)).view(np.int64)[::8])], ["lead"])

    few = rows.orderBy(F.xxhash64("doc", "tid")).limit(sample)
    qs = [i / buckets for i in range(1, buckets)]
    return sorted(set(few.mapInArrow(lead, "lead long").approxQuantile("lead", qs, 0.001 / max(1, buckets // 16)))) if buckets > 1 else []


def removed_windows(rows: DataFrame, tokens: DataFrame, length: int) -> DataFrame:
    """(doc, tid, ord, mask): for each stretch of a document with repeated windows, a bit a window that an earlier document has."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array([int(x) for x in splitters(rows, length, buckets)], np.int64)
    per = tokens.groupBy("doc").agg(F.collect_set("h").alias("hs")).select(F.col("doc").alias("_d"), "hs")
    found = rows.join(per, F.col("doc") == F.col("_d")).select("doc", "tid", "hs", "text").sortWithinPartitions("doc")
    names = ["part", "doc", "tid", "ord", "off", "seg", "mask"]
    schema = "part int, doc long, tid int, ord int, off int, seg binary, mask long"


    def emit(batches):
        seen: dict[bytes, tuple[int, int]] = {}
        size = 0
        for part, texts in _slices(batches):
            buf, _, doc, s1, s2, a, h = segments(texts, length)
            wanted = part.column(2).flatten().to_numpy()  # a repeated token is wanted by all documents that have it
            pick = np.flatnonzero(np.isin(h.view(np.int64), wanted))
            if not len(pick):
                continue
            begin = np.searchsorted(doc, np.arange(len(texts)))  # each document's first stretch
            doc, s1, s2, a, order = doc[pick], s1[pick], s2[pick], a[pick], pick - begin[doc[pick]]
            d, t = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
            segs = [buf[x:y] for x, y in zip(s1.tolist(), (s2 + length).tolist())]
            state = np.zeros(len(segs), np.int8)  # 0: skip, 1: send, 2: all windows are repeated
            for i, (seg, own) in enumerate(zip(segs, zip(d.tolist(), t.tolist()))):
                before = seen.setdefault(seg, own)
                if before is own:
                    state[i] = 1
                    size += len(seg) + 200
                elif before != own:
                    state[i] = 2 if before[0] < own[0] else 1
            lead = (_words(buf)[a] ^ np.uint64(1 << 63)).view(np.int64)
            for code in (1, 2):
                at = np.flatnonzero(state == code)
                if len(at):
                    send = code == 1
                    zero = np.zeros(len(at), np.int64)
                    where = np.searchsorted(cuts, lead[at], "right") if send else d[at] % max(1, buckets)
                    mask = zero if send else (np.int64(1) << (s2 - s1 + 1)[at]) - 1
                    cols = [pa.array(where, pa.int32()), pa.array(d[at]), pa.array(t[at], pa.int32()), pa.array(order[at], pa.int32()), pa.array((a - s1)[at], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([segs[i] for i in at.tolist()] if send else [None] * len(at), pa.binary()), pa.array(mask)], names)
            if size > 96 << 20:
                seen.clear()
                size = 0

    def settle(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            ready = batch.filter(pa.compute.is_null(batch.column(5)))
            if ready.num_rows:
                yield ready.select(["doc", "tid", "ord", "mask"])
            batch = batch.filter(pa.compute.is_valid(batch.column(5)))
            if not batch.num_rows:
                continue
            if size > 60_000:  # cut at the last change of token
                new = np.flatnonzero((_tokens(batch) != _tokens(held[-1].slice(held[-1].num_rows - 1))).any(1))
                cut = int(new[0]) if len(new) else batch.num_rows
                if cut:
                    held.append(batch.slice(0, cut))
                if cut == batch.num_rows:
                    continue
                yield from decide(held, length)
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from decide(held, length)

    dealt = found.mapInArrow(emit, schema).repartitionById(max(1, buckets), "part").sortWithinPartitions(F.expr(f"substring(seg, off + 1, {TOKEN})"))
    return dealt.mapInArrow(settle, "doc long, tid int, ord int, mask long")


def _tokens(batch) -> np.ndarray:
    """The leading tokens of a bucket's rows, two words each."""
    pairs = zip(batch.column(5).to_pylist(), batch.column(4).to_pylist())
    return np.frombuffer(b"".join([s[o : o + TOKEN] for s, o in pairs]), ">u8").reshape(-1, TOKEN // 8)


def decide(held: list[pa.RecordBatch], length: int):
    """The masks of a bucket's rows, in order of their tokens."""
    t = pa.Table.from_batches(held).combine_chunks()
    doc, token = t.column(1).to_numpy(), _tokens(t)
    off = t.column(4).to_numpy().astype(np.int64)
    segs = t.column(5).to_pylist()
    # of equal stretches only the smallest document's is sorted; in the others all windows are repeated
    first: dict[bytes, int] = {}
    for i in np.argsort(doc, kind="stable").tolist():
        first.setdefault(segs[i], i)
    size = np.array([len(x) for x in segs], np.int64)
    head = np.array([first[x] for x in segs])
    bit = np.where(doc[head] < doc, (np.int64(1) << (size - length + 1)) - 1, 0)
    run = np.concatenate([[0], np.cumsum((token[1:] != token[:-1]).any(1))])
    own = np.flatnonzero(head == np.arange(len(segs)))
    own = own[np.bincount(run[own], minlength=run[-1] + 1)[run[own]] > 1]  # tokens with one stretch are settled
    if len(own):
        buf = b"".join([segs[i] for i in own.tolist()])
        n, begin = size[own] - length + 1, np.cumsum(size[own]) - size[own]
        row = np.repeat(np.arange(len(own)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        d = doc[own][row]
        least = repeated(run[own][row] * length + off[own][row] - step, begin[row] + step, _words(buf), length, d)
        gone = np.flatnonzero(least < d)
        np.bitwise_or.at(bit, own[row[gone]], np.int64(1) << step[gone])
        # rows that share stretch and document share its mask
        bit |= np.where(doc[head] == doc, bit[head], 0)
    hit = np.flatnonzero(bit)
    if len(hit):
        yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(t.column(2).to_numpy()[hit]), pa.array(t.column(3).to_numpy()[hit]), pa.array(bit[hit])], ["doc", "tid", "ord", "mask"])


def repeated(label: np.ndarray, start: np.ndarray, words: np.ndarray, length: int, doc: np.ndarray) -> np.ndarray:
    """Smallest document of each window's group of equal windows: a multikey quicksort, eight bytes a character.

    ``label`` parts the windows beforehand. After each character windows that are alone leave, so later ones sort few.
    """
    least = doc.copy()
    live = np.arange(len(label))
    depths = [*range(0, length - 7, 8), length - 8]
    for depth in [None, *depths]:
        if not len(live):
            return least
        if depth is None:
            o = np.argsort(label, kind="stable")
            live, label = live[o], label[o]
            new = label[1:] != label[:-1]
        else:
            ch = words[start[live] + depth]
            o = np.lexsort((ch, label))
            live, label, ch = live[o], label[o], ch[o]
            new = (label[1:] != label[:-1]) | (ch[1:] != ch[:-1])
        label = np.concatenate([[0], np.cumsum(new)])
        many = np.concatenate([~new, [False]]) | np.concatenate([[False], ~new])
        live, label = live[many], label[many]
    if len(live):
        heads = np.concatenate([[0], np.flatnonzero(label[1:] != label[:-1]) + 1])
        low = np.minimum.reduceat(doc[live], heads)
        least[live] = np.repeat(low, np.diff(np.concatenate([heads, [len(live)]])))
    return least


def cut_texts(texts: list[bytes], masks: list[dict[int, int]], length: int) -> list[tuple[bytes, int, int]]:
    """What is left of each text, the bytes removed and the runs they form; masks by number of stretch."""
    out = [(t, 0, 0) for t in texts]
    some = [i for i, m in enumerate(masks) if m]
    if not some:
        return out
    buf, begin, doc, s1, s2, _, h = segments([texts[i] for i in some], length)
    heads = np.searchsorted(doc, np.arange(len(some) + 1))
    for j, i in enumerate(some):
        lo, hi = int(heads[j]), int(heads[j + 1])
        bits = dict(masks[i])
        key = h[lo:hi]
        u, inv, count = np.unique(key, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[inv] > 1)  # a stretch that returns in the text was sent once
        first: dict[bytes, int] = {}
        for k in again.tolist():
            k0 = first.setdefault(buf[s1[lo + k] : s2[lo + k] + length], k)
            if k0 in bits:
                bits[k] = bits[k0]
        at = np.fromiter(bits.keys(), np.int64, len(bits))
        mask = np.fromiter(bits.values(), np.int64, len(bits))
        x = s1[lo + at] - begin[j]
        n = s2[lo + at] - s1[lo + at] + 1
        size = len(texts[i])
        gone = np.zeros(size + 1, np.int64)
        full = mask == (np.int64(1) << n) - 1
        np.add.at(gone, x[full], 1)
        np.add.at(gone, x[full] + n[full] + length - 1, -1)
        rest = np.flatnonzero(~full)
        if len(rest):
            r, c = np.nonzero((mask[rest][:, None] >> np.arange(length - TOKEN + 1)) & 1)
            start = x[rest][r] + c
            np.add.at(gone, start, 1)
            np.add.at(gone, start + length, -1)
        covered = np.cumsum(gone[:-1]) > 0
        left = np.frombuffer(texts[i], np.uint8)[~covered].tobytes()
        out[i] = (left, int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()))
    return out


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): every row's text without its repeated bytes, as binary."""
    if not TOKEN + 7 < length <= TOKEN + 62:
        raise ValueError("length must be 24 to 78 bytes")
    scratch = Scratch(df.sparkSession, "suffix")
    rows = df.select(F.col(key).cast("long").alias("doc"), F.hash(F.coalesce(text, F.lit(""))).alias("tid"), F.col(text).alias("text"))
    sound = rows.where("doc IS NOT NULL AND text IS NOT NULL").where(F.octet_length("text") >= length)
    tokens = repeated_tokens(sound, scratch, length)
    _free(df.sparkSession)
    masks = scratch.save(removed_windows(sound, tokens, length))
    scratch.drop(tokens)
    _free(df.sparkSession)
    per = masks.groupBy("doc", "tid").agg(F.collect_list(F.struct("ord", "mask")).alias("m")).select(F.col("doc").alias("_d"), F.col("tid").alias("_t"), F.col("m.ord").alias("ords"), F.col("m.mask").alias("masks"))
    whole = rows.join(per, (F.col("doc") == F.col("_d")) & (F.col("tid") == F.col("_t")), "left").select("doc", "ords", "masks", "text")

    def cut(batches):
        for part, texts in _slices(batches):
            ords, masks = (part.column(i).to_pylist() for i in (1, 2))
            got = cut_texts(texts, [dict(zip(o, m)) if o else {} for o, m in zip(ords, masks)], length)
            cols = [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [key, "n_bytes", "n_removed", "n_spans", "kept"])

    return whole.mapInArrow(cut, f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept binary")


def _free(spark) -> None:
    """Lets the shuffle files of finished steps go before the next ones are written."""
    for _ in range(2):  # a dependency goes in one collection, its files after the next
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The result with the kept bytes as their SHA-256."""
    return df.select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
