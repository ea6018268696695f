import math
from collections import Counter

import pytest

from wavelens.llm import lm
from wavelens.llm.common import table


def units(t):
    """UTF-16 code units, a character each."""
    raw = (t or "").encode("utf-16-le")
    return "".join(chr(raw[i] + 256 * raw[i + 1]) for i in range(0, len(raw), 2))


def brute(rows):
    rows = [(d, units(t), m) for d, t, m in rows]
    models = []
    for marks in ([True] * len(rows), [bool(m) for _, _, m in rows]):
        c = [Counter() for _ in range(5)]
        for (_, t, _), use in zip(rows, marks):
            s = "\2\2\2" + t + "\3"
            for i in range(3, len(s)):
                for n in range(1, 5):
                    c[n][s[i - n + 1 : i + 1]] += use
        models.append(c)
    vocab = len(models[0][1])

    def p(c, g):
        if len(g) == 1:
            return (c[1][g] + lm.FLOOR) / (sum(c[1].values()) + lm.FLOOR * vocab)
        ctx = [v for k, v in c[len(g)].items() if k[:-1] == g[:-1] and v]
        q = p(c, g[1:])
        return (max(c[len(g)][g] - lm.DISCOUNT, 0) + lm.DISCOUNT * len(ctx) * q) / sum(ctx) if ctx else q

    out = {}
    for d, t, _ in rows:
        s = "\2\2\2" + t + "\3"
        ls = [-sum(math.log(p(c, s[i - 3 : i + 1])) for i in range(3, len(s))) / (len(s) - 3) for c in models]
        out[d] = (len(s) - 3, ls[0], ls[1], ls[0] - ls[1])
    offset = sum(v[0] * v[3] for v in out.values()) / max(1, sum(v[0] for v in out.values()))
    return {d: (*v[:3], v[3] - offset) for d, v in out.items()}


@pytest.mark.parametrize("bound", [lm.BROADCAST_ROWS, 20, 0])
def test_matches_brute_force(spark, bound):
    rows = [(1, "the cat sat on the mat", True), (2, "a dog ate the cat", False), (3, None, None), (4, "", True), (5, "ünï \U0001f600 code the", False), (6, "the the the", True), (7, "\U0001f601\U00020000 the", True), (8, "\U0001f601\U00020000 the", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t boolean").selectExpr("*", "1 AS row", "2 AS score")
    got = {r.doc_id: tuple(r)[1:] for r in lm.cross_entropy_difference(df, df.where("t"), broadcast_rows=bound).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for d in want:
        assert got[d] == pytest.approx(want[d], abs=1e-9)
    assert lm.cross_entropy_difference(df.limit(0), df.limit(0), broadcast_rows=bound).count() == 0


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, "ab " * 200_000, True), (2, "ab", False), (2, "ab", False), (None, "zz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    got = lm.cross_entropy_difference(df, df.where("t")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 600_001), (2, 3), (2, 3)]
    assert len({tuple(r) for r in got if r.doc_id == 2}) == 1


def test_targets_are_the_documents_labelled_1(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    want = sorted(r.text or "" for r in docs.collect() if r.doc_id in good)
    assert sorted(r.text or "" for r in lm.targets(docs, labels).collect()) == want and want


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = lm.cross_entropy_difference(docs, lm.targets(docs, table(spark, sf_dir, "labels"))).collect()
    assert len(got) == docs.count() and all(math.isfinite(r.score) for r in got)
