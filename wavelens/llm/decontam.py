"""Benchmark decontamination over a distributed positional inverted index.

Words are maximal runs of ASCII digits, letters and all non-ASCII characters after lower-casing A-Z. The index stores, for
every term that occurs in the benchmark, its postings (term_id, row, pos) over the whole corpus; other terms cannot be part of
a match. A window is ten consecutive words of an item, or all words of a shorter one. Every window is looked up by its two terms
with the fewest postings: a posting of the rarest, moved back by the term's offset in the item, proposes an alignment of item
and row, which stays only if the second rarest term's list, adjusted by its own offset, holds the row at the expected place.
The alignments left are intersected with the offset-adjusted postings of all other terms of the item, and a maximal run of
consecutive matches that is at least a window long is an exact phrase match. Every window has a rarest term, so no occurrence
is missed; windows are never compared with documents one by one, and only rare postings and those of rows with an alignment move.

A proximity match is a place where the three terms of an item with the fewest postings (all, if it has fewer) stand within
``slop`` words, in any order; the smallest span at each posting is exact.

Only DataFrame functions run here. Rows are matched each by itself under a number of its own, so null and repeated ids do no
harm: a row counts its own words only. Nulls have no words. Items without words match nothing; an empty benchmark leaves every
document clean. Other columns of the documents, of any name, have no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, sift

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A small side is sent to all executors only below this many rows of numbers.
BROADCAST_ROWS = 200_000


def words(column: str) -> F.Column:
    """The words of a text, in order."""
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(column), F.lit(""))), _NO_WORD), lambda w: w != "")


def _small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast only if it has been counted and is small."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def item_terms(items: DataFrame, scratch: Scratch, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_no, item_id, n, pos, term, term_id): every word of every distinct item; item_no tells repeated ids apart."""
    uniq = items.select(F.col(item).alias("item_id"), words(text).alias("w")).distinct().where(F.size("w") > 0)
    flat = scratch.save(uniq.select(F.xxhash64("item_id", "w").alias("item_no"), "item_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "term")))
    ids = flat.select("term").distinct().select("term", F.xxhash64("term").alias("term_id"))
    return scratch.save(flat.join(ids, "term"))


#: Numbers that grow slowly along a file are stored as differences.
_DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#row": "false", "parquet.enable.dictionary#pos": "false"}


def build_index(docs: DataFrame, terms: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings (term_id, row, pos) of the given distinct terms (term, term_id), and (row, doc_id, n_words) for every row.

    Both come from one table, written once: a row's word count is its posting without a term. So rows keep their numbers.
    """
    tokens = docs.select(F.col(key).alias("doc_id"), words(text).alias("w"), F.monotonically_increasing_id().alias("row"))
    size = F.struct(F.size("w").alias("pos"), F.lit(None).cast("string").alias("term"))
    listed = F.concat(F.array(size), F.transform("w", lambda w, i: F.struct(i.alias("pos"), w.alias("term"))))
    flat = tokens.select("doc_id", "row", F.explode(listed).alias("x")).select(F.when(F.col("x.term").isNull(), F.col("doc_id")).alias("doc_id"), "row", "x.pos", "x.term")
    known = _small(terms.select("term", "term_id"))
    table = scratch.save(flat.join(known, "term", "left").where("term IS NULL OR term_id IS NOT NULL").select("term_id", "row", "pos", "doc_id"), **_DELTAS)
    return table.where("term_id IS NOT NULL").select("term_id", "row", "pos"), table.where("term_id IS NULL").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))


def term_counts(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """(term_id, df): the number of postings of every term."""
    return scratch.save(postings.groupBy("term_id").agg(F.count("*").alias("df")))


def phrase_matches(postings: DataFrame, items: DataFrame, counts: DataFrame, scratch: Scratch, window: int = 10) -> DataFrame:
    """(row, item_id, start, end): maximal runs of a row's words [start, end) that match an item and hold a window of it."""
    ranked = items.join(_small(counts), "term_id", "left").select("item_no", "item_id", "n", "pos", "term_id", F.coalesce("df", F.lit(0)).alias("df"))
    # the two rarest positions of each window, named by the window's first position; a window of one word has one
    span = Window.partitionBy("item_no").orderBy("pos").rowsBetween(0, window - 1)
    rare = F.slice(F.array_sort(F.collect_list(F.struct("df", "pos", "term_id")).over(span)), 1, 2)
    first = ranked.withColumn("rare", rare).where((F.col("pos") == 0) | (F.col("pos") <= F.col("n") - window)).withColumn("other", F.element_at("rare", -1))
    anchors = first.where("rare[0].df > 0").select("item_no", F.col("rare")[0]["pos"].alias("at"), F.col("rare")[0]["term_id"].alias("term_id"), F.col("other.pos").alias("at2"), F.col("other.term_id").alias("term2"))
    anchors = scratch.save(anchors.distinct())
    proposed = postings.join(_small(anchors), "term_id").select("row", "item_no", (F.col("pos") - F.col("at")).alias("shift"), (F.col("pos") - F.col("at") + F.col("at2")).alias("pos"), F.col("term2").alias("term_id")).where("pos >= 0")
    lists = postings.join(_small(anchors.select(F.col("term2").alias("term_id")).distinct()), "term_id", "left_semi")
    placed = scratch.save(proposed.join(lists.hint("merge"), ["row", "pos", "term_id"]).select("row", "item_no", "shift").distinct())
    near = sift(postings, "row", placed.select("row").distinct(), "maybe").where("maybe").drop("maybe")
    want = placed.join(_small(items.select("item_no", "item_id", "n", F.col("pos").alias("ipos"), "term_id")), "item_no").select("row", "item_no", "item_id", "n", "shift", "term_id", (F.col("shift") + F.col("ipos")).alias("pos")).where("pos >= 0")
    met = want.join(near, ["row", "pos", "term_id"]).select("row", "item_no", "item_id", "n", "shift", "pos")
    # consecutive matches of one alignment form islands: their position less their rank is the same
    rank = Window.partitionBy("row", "item_no", "shift").orderBy("pos")
    islands = met.withColumn("island", F.col("pos") - F.row_number().over(rank)).groupBy("row", "item_no", "item_id", "n", "shift", "island")
    runs = islands.agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return runs.where(F.col("end") - F.col("start") >= F.least(F.lit(window), F.col("n"))).select("row", "item_id", "start", "end").distinct()


def proximity_matches(postings: DataFrame, items: DataFrame, counts: DataFrame, slop: int = 20, rarest: int = 3) -> DataFrame:
    """(row, item_id, start, span): the narrowest place in a row where the ``rarest`` least frequent terms of an item stand within ``slop`` words."""
    rank = Window.partitionBy("item_no").orderBy("df", "term")
    picked = items.select("item_no", "item_id", "term", "term_id").distinct().join(_small(counts), "term_id", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("k", F.row_number().over(rank)).where(F.col("k") <= rarest)
    whole = picked.withColumn("need", F.count("*").over(Window.partitionBy("item_no"))).withColumn("least", F.min("df").over(Window.partitionBy("item_no"))).where("least > 0")
    hits = postings.join(_small(whole.select("item_no", "item_id", "term_id", "k", "need")), "term_id")
    # the last place of every term up to each posting: the narrowest span that ends there starts at the earliest of them
    so_far = Window.partitionBy("row", "item_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("k") == k, F.col("pos")), ignorenulls=True).over(so_far).alias(f"l{k}") for k in range(1, rarest + 1)]
    spans = hits.select("row", "item_no", "item_id", "pos", "need", *last).where(" AND ".join(f"(need < {k} OR l{k} IS NOT NULL)" for k in range(1, rarest + 1)))
    start = F.least(*(F.col(f"l{k}") for k in range(1, rarest + 1)), F.col("pos"))
    near = spans.select("row", "item_id", start.alias("start"), (F.col("pos") - start + 1).alias("span")).where(F.col("span") <= slop)
    best = near.groupBy("row", "item_id").agg(F.min(F.struct("span", "start")).alias("b"))
    return best.select("row", "item_id", "b.start", "b.span")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, slop: int = 20) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, n_near) for every document row; n_near counts items with a proximity match."""
    scratch = Scratch(docs.sparkSession, "decontam")
    terms = item_terms(items, scratch, item, item_text)
    postings, sizes = build_index(docs, terms.select("term", "term_id").distinct(), scratch, key, text)
    counts = term_counts(postings, scratch)
    found = scratch.save(phrase_matches(postings, terms, counts, scratch, window))
    hit = found.select("row", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    which = found.select("row", F.col("item_id").cast("string").alias("item_id")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    close = proximity_matches(postings, terms, counts, slop).groupBy("row").agg(F.count("*").alias("n_near"))
    out = sizes.join(hit.join(which, "row"), "row", "left").join(close, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("doc_id").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("ids", none)), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
