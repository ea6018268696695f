import hashlib
import random

import pytest

from wavelens.llm import suffix
from wavelens.llm.common import table


def brute(rows, n=50):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first.setdefault(b[i : i + n], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - n + 1):
                if first[b[i : i + n]] < d:
                    gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in suffix.digest(suffix.deduplicate(df)).collect()), key=str)


def test_documents_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert sum(r[2] for r in want) > 0
    assert got(docs) == want


def test_edges(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [
        (1, None), (2, ""), (3, "short"), (4, base), (5, base), (6, base[100:149]), (7, base[100:150]), (8, "x" + base[60:300] + "y" + base[20:90]), (9, "a" * 1000), (10, "a" * 300 + "b" + "a" * 49),
        (11, "abcde" * 200), (12, "zz" + "abcde" * 30), (None, base), (13, "ä" * 60), (14, "ß" + "ä" * 25), (4, base), (15, base[:200] + "Ω" + base[200:]), (-3, "q" * 20 + base[300:380]), (16, "w" * 5000 + base),
    ]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, doc int, n_bytes int")
    assert got(df) == brute(rows)
    assert suffix.deduplicate(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix.deduplicate(df, length=10)


def test_text_over_16_mib_that_repeats_a_passage_at_its_end(spark):
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=400))
    filler = rng.randbytes((1 << 23) + 3000).hex()  # no 50 bytes of it are in the passage
    texts = [passage, filler + passage + filler[:5000], filler[-300:] + passage[:100]]
    buf, begin, doc, s1, s2, a, _ = suffix.segments([t.encode() for t in texts], 50)
    assert ((a >= s2) & (a <= s1 + 50 - suffix.TOKEN)).all() and (s2[:-1] + 1 == s1[1:])[doc[:-1] == doc[1:]].all()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r for r in suffix.deduplicate(df).collect()}
    assert [(r.n_removed, r.n_spans) for r in (out[0], out[1], out[2])] == [(0, 0), (400, 1), (400, 1)]
    assert bytes(out[1].kept) == (filler + filler[:5000]).encode() and bytes(out[2].kept) == b""
