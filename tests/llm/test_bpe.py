import random

import public_tokenizers
import pytest
import tiktoken

from wavelens.llm import bpe
from wavelens.llm.common import table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ByteBPE(PATH).ranks, special_tokens={})


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    parts = list("ab's'tvremld  \n\t\r0123.,!?é　\x1c一١") + ["'re", "'ll", "'s", "''", " '", "\U000105c0", "\U00010d40"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["a" * 5000, "ab" * 400, " " * 300, "", "'s", "''s"]
    coder = bpe.ByteBPE(PATH)
    for t, (ids, offsets) in zip(texts, coder.encode([t.encode() for t in texts])):
        assert ids == library.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()
        assert offsets[0] == 0 and offsets[-1] == len(t.encode())


def test_documents_and_edges(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents")
    want = {r.doc_id: len(library.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in bpe.token_digests(docs, PATH).collect()} == want
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "word " * 30000, 7)], "doc_id long, text string, token_ids int")
    out = {r.doc_id: r for r in bpe.decode_documents(bpe.encode_documents(df, PATH), PATH).collect()}
    assert [bytes(out[i].decoded) for i in (1, 2, 3)] == [b"", b"", b"word " * 30000] and out[1].token_ids == []
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0
