"""The corpus pipeline: toxicity, SimHash near-duplicates, benchmark decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. The
first three drop rows, the fourth rewrites texts, the last returns token digests.

Every row is decided by itself: null ids, ids that several rows share, and rows that repeat are rows like others, and of rows
that repeat in full one stays. Null and empty texts are near-duplicates of each other; an empty table gives an empty result.
Further columns, of any name, are carried to the last stage, which returns its digests only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from wavelens.llm import bpe, decontam, pii, simhash
from wavelens.llm import toxicity as tox
from wavelens.llm.common import Scratch, table, unique_name, without
from wavelens.llm.queries import pii_key


def drop_toxic(spark, docs, sf_dir):
    """Keeps the rows whose score stays below 0.3."""
    model = tox.fit_on(docs, table(spark, sf_dir, "labels"))
    return tox.score(docs, model, out="_score").where("_score < 0.3").drop("_score")


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps one row of every group, the one with the smallest id.

    Groups follow the contract of ``op1``: three-word shingles and two differing bits. Copies with more edits than that stay.
    """
    return simhash.keep_first(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Keeps the rows in which no benchmark window occurs; each row goes by its own id and text."""
    own = unique_name(docs, "_own")
    marked = docs.withColumn(own, F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")))
    hit = decontam.contamination(marked.select(own, "text"), table(spark, sf_dir, "benchmark"), key=own).where("contaminated").select(own).distinct()
    return without(marked, own, Scratch(spark, "decontam").save(hit)).select(docs.columns)


def replace_personal_data(spark, docs, sf_dir):
    """Puts surrogates in the texts and counts their characters anew."""
    out = pii.replace(docs, pii_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def encode(spark, docs, sf_dir):
    """Token digests of every text."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode),
]
#: Kernels, fingerprints and merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
