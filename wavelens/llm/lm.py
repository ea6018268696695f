"""Cross-entropy difference of two matched n-gram models.

Tokens are the UTF-16 code units of a text, with start and end marks, so every character of every script is told apart; both
models are interpolated four-gram models with absolute discounting over one shared vocabulary, the tokens of the whole corpus.
The background model counts every document, the target model the target documents. The two therefore differ in size; that
alone would lift every document's target loss, so the difference is normalised: a document's score is the mean over its tokens of
background loss minus target loss, in nats, less the same mean over all tokens of the corpus. It is 0 for text as likely under
the target as the corpus is on average, and the higher, the more it resembles the target.

All n-grams of all documents are counted, without cut-offs; lower orders are sums over the four-grams. Each task sends a
four-gram once, with its count. The model is a table of one row per distinct four-gram with its two losses. Its ``broadcast_rows``
most frequent rows are sent to the workers; a document's sums over them are made in place, and its other four-grams, if the model
has more rows, are joined with the rest of the table. No four-gram of that rest is frequent, so the join has no hot key.

Target documents are found by id. A Bloom filter of the target's ids, of bounded size, lets only their texts (and few others)
move for the exact join; all other texts are read where they are.

Null texts are empty; an empty text still has its end mark. Rows with equal ids are scored apart; a target id marks all its rows.
With no target document the target model knows the vocabulary only, and with an empty table nothing is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, sift, text_slices, unique_name

ORDER, DISCOUNT, FLOOR = 4, 0.75, 0.5
BEGIN, END = 2, 3
BROADCAST_ROWS = 2_000_000


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four-gram before and with each token (16 bits a token), and the text each belongs to."""
    pad, end = chr(BEGIN) * (ORDER - 1), chr(END)
    units = [(pad + t.decode("utf-8", "replace") + end).encode("utf-16-le") for t in texts]
    c = np.frombuffer(b"".join(units), np.uint16).astype(np.uint64)
    key = c.copy()
    for i in range(1, ORDER):
        key[i:] |= c[:-i] << np.uint64(16 * i)
    size = np.array([len(u) // 2 for u in units])
    text = np.repeat(np.arange(len(texts)), size)
    at = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
    own = at >= ORDER - 1
    return key[own].view(np.int64), text[own]


def count(df: DataFrame, text: str = "text", name: str = "n") -> DataFrame:
    """(g, n): every four-gram of the frame's texts with its count, one row a task."""

    def run(batches):
        held = []

        def merge():
            g, n = (np.concatenate([x[i] for x in held]) for i in range(2))
            u, inv = np.unique(g, return_inverse=True)
            held[:] = [(u, np.bincount(inv, n, len(u)).astype(np.int64))]

        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                held.append(np.unique(grams(texts)[0], return_counts=True))
                if len(held) > 16:
                    merge()
                if len(held[0][0]) > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop(0)], ["g", name])
        if held:
            merge()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["g", name])

    return df.select(F.col(text).alias("text")).mapInArrow(run, f"g long, {name} long")


def losses(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, bg, tg): each four-gram's loss under the background and the target model, in nats."""
    level = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):  # the counts of shorter n-grams
        mask = (1 << (16 * n)) - 1
        level[n] = scratch.save(level[n + 1].select(F.col("g").bitwiseAND(F.lit(mask)).alias("g"), "bg", "tg").groupBy("g").agg(F.sum("bg").alias("bg"), F.sum("tg").alias("tg")))
    size = level[1].agg(F.count("*").alias("v"), F.sum("bg").alias("bg"), F.sum("tg").alias("tg")).first()
    v = size.v or 1
    prob = level[1].select("g", *(((F.col(m) + FLOOR) / F.lit(float((size[m] or 0) + FLOOR * v))).alias(f"p_{m}") for m in ("bg", "tg")))
    for n in range(2, ORDER + 1):
        low = (1 << (16 * (n - 1))) - 1
        here = level[n].select("g", "bg", "tg", F.shiftrightunsigned("g", 16).alias("h"), F.col("g").bitwiseAND(F.lit(low)).alias("s"))
        ctx = here.groupBy("h").agg(*(f for m in ("bg", "tg") for f in (F.sum(m).alias(f"c_{m}"), F.sum((F.col(m) > 0).cast("long")).alias(f"n_{m}"))))
        lower = prob.select(F.col("g").alias("s"), *(F.col(f"p_{m}").alias(f"q_{m}") for m in ("bg", "tg")))
        joined = here.join(ctx, "h").join(lower, "s")
        p = lambda m: F.when(F.col(f"c_{m}") > 0, (F.greatest(F.col(m) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"n_{m}") * F.col(f"q_{m}")) / F.col(f"c_{m}")).otherwise(F.col(f"q_{m}"))
        prob = scratch.save(joined.select("g", *(p(m).alias(f"p_{m}") for m in ("bg", "tg"))))
    return prob.select("g", (-F.log("p_bg")).alias("bg"), (-F.log("p_tg")).alias("tg"))


class _Table:
    """The model as sorted arrays, looked up through a prefix index."""

    def __init__(self, g: np.ndarray, bg: np.ndarray, tg: np.ndarray):
        o = np.argsort(g)
        self.g, self.bg, self.tg = g[o], bg[o], tg[o]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, inv = np.unique(key, return_inverse=True)
        at = np.searchsorted(self.g, u)
        return self.bg[at][inv], self.tg[at][inv]


def corpus_offset(counts: DataFrame, model: DataFrame) -> float:
    """Mean over all tokens of the corpus of background loss minus target loss."""
    got = counts.select("g", F.col("bg").alias("n")).join(model, "g").agg(F.sum(F.col("n") * (F.col("bg") - F.col("tg"))).alias("s"), F.sum("n").alias("n")).first()
    return got.s / got.n if got.n else 0.0


def cross_entropy_difference(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, n_tokens, loss_background, loss_target, score) of every row; ``target`` is a frame with the target documents' texts."""
    scratch = Scratch(df.sparkSession, "lm")
    both = count(df, text, "bg").select("g", "bg", F.lit(0).cast("long").alias("tg")).unionByName(count(target, text, "tg").select("g", F.lit(0).cast("long").alias("bg"), "tg"))
    counts = scratch.save(both.groupBy("g").agg(F.sum("bg").alias("bg"), F.sum("tg").alias("tg")).where("bg > 0"))
    model = scratch.save(losses(counts, scratch))
    offset = corpus_offset(counts, model)
    rows = model.count()
    head = model
    if rows > broadcast_rows:
        head = model.join(counts.select("g", F.col("bg").alias("n")).orderBy(F.desc("n"), "g").limit(broadcast_rows), "g", "left_semi")
        head = scratch.save(head)
    known = _send(df.sparkSession, head)
    row = unique_name(df, "row")
    sums = df.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias(row), F.col(text).alias("text")).mapInArrow(_sums(known, row), _schema(df, key, row))
    if rows > broadcast_rows:  # the frame is read again from the table, so that the row numbers are fixed
        sums = scratch.save(sums)
        rest = sums.where("g IS NOT NULL").select("k", row, "g", "n").join(model, "g").select("k", row, "n", (F.col("n") * F.col("bg")).alias("bg"), (F.col("n") * F.col("tg")).alias("tg"))
        sums = sums.where("g IS NULL").select("k", row, "n", "bg", "tg").unionByName(rest).groupBy("k", row).agg(*(F.sum(c).alias(c) for c in ("n", "bg", "tg")))
    b, t = F.col("bg") / F.col("n"), F.col("tg") / F.col("n")
    return sums.select(F.col("k").alias(key), F.col("n").alias("n_tokens"), b.alias("loss_background"), t.alias("loss_target"), (b - t - F.lit(offset)).alias("score"))


def _send(spark, model: DataFrame):
    """The model's rows, sorted, as a broadcast."""
    t = model.toArrow()
    order = np.argsort(t.column(0).to_numpy())
    return spark.sparkContext.broadcast(tuple(t.column(i).to_numpy()[order] for i in range(3)))


def _schema(df: DataFrame, key: str, row: str) -> T.StructType:
    return T.StructType([T.StructField("k", df.schema[key].dataType), T.StructField(row, T.LongType()), T.StructField("g", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bg", T.DoubleType()), T.StructField("tg", T.DoubleType())])


def _sums(known, row: str):
    """For every row its tokens and losses over the known four-grams (g null), and its other four-grams with their counts."""

    def run(batches):
        g0, bg0, tg0 = known.value
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                g, at = grams(texts)
                u, inv = np.unique(g, return_inverse=True)
                i = np.minimum(np.searchsorted(g0, u), max(len(g0) - 1, 0))
                have = g0[i] == u if len(g0) else np.zeros(len(u), bool)
                b, t = (np.where(have, x[i] if len(x) else 0.0, 0.0)[inv] for x in (bg0, tg0))
                own = have[inv]
                n = np.bincount(at[own], minlength=len(texts))
                sums = [np.bincount(at, x, len(texts)) for x in (b, t)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.nulls(len(texts), pa.int64()), pa.array(n, pa.int64()), *map(pa.array, sums)], ["k", row, "g", "n", "bg", "tg"])
                if not have.all():
                    pair, n = np.unique(np.stack([at[~own], inv[~own]]), axis=1, return_counts=True)
                    at_, zero = pa.array(pair[0]), pa.array(np.zeros(len(n)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at_), part.column(1).take(at_), pa.array(u[pair[1]]), pa.array(n, pa.int64()), zero, zero], ["k", row, "g", "n", "bg", "tg"])

    return run


def targets(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text") -> DataFrame:
    """(text): the texts of the documents that are labelled 1."""
    good = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    maybe = sift(docs.select(F.col(key).alias("k"), F.col(text).alias("text")), "k", good, "maybe").where("maybe").select("k", "text")
    return maybe.join(good.hint("merge"), "k", "left_semi").select(F.col("text").alias(text))
