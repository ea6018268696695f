import zlib

import numpy as np

from wavelens.llm import toxicity
from wavelens.llm.common import table


def test_kernel_matches_its_definition():
    from itertools import combinations

    def slow(a, b):
        total = 0.0
        for i in combinations(range(len(a)), 4):
            for j in combinations(range(len(b)), 4):
                if all(a[x] == b[y] for x, y in zip(i, j)):
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    for a, b in (("stupid", "stuupid"), ("idiot", "idxiot"), ("abcd", "abcd"), ("abcabc", "acbcab"), ("abc", "abcd")):
        got = toxicity.kernel(toxicity.codes([a], 8, -1), toxicity.codes([b], 9, -2))[0]
        assert abs(got - slow(a, b)) < 1e-4


def test_strings_rejoin_torn_words():
    assert {"idiot", "moron", "stupid"} <= toxicity.strings("an i d i o t, mo-ron and st.up.id")
    assert toxicity.strings("") == set() == toxicity.strings("a .. b")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    truth = {r.doc_id: r.toxic for r in labels.collect() if got[r.doc_id].held_out}
    right = np.mean([got[i].predicted == y for i, y in truth.items()])
    assert right > 0.9
    found = [got[i].predicted for i, y in truth.items() if y]
    assert np.mean(found) > 0.5


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "word " * 30000, 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, none).collect()
    assert len(rows) == 3 and all(r.score < 0.3 for r in rows)
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def slow_kernel(a, b, order):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), order):
        for j in combinations(range(len(b)), order):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def slow_feature(s, t):
    order = min(len(t), toxicity.ORDER)
    k = slow_kernel(s, t, order) / np.sqrt(max(slow_kernel(s, s, order) * slow_kernel(t, t, order), 1e-30))
    rest, it = len(s) - len(t), iter(s)
    if 0 < rest <= max(1, len(t) // 4) and all(c in it for c in t):
        k = max(k, toxicity.DECAY**rest)
    return min(k, 1.0) ** toxicity.POWER


def test_features_match_brute_force():
    rng = np.random.default_rng(5)
    marks = ["idiot", "bum", "stupid", "scum", "moron", "abcabcab"]
    words = ["idxiot", "oron", "bum", "buum", "sum", "stuupid", "idiots", "abxcabcab", "zzz", "scummy"] + ["".join(rng.choice(list("abcdimnoprstu"), rng.integers(3, 10))) for _ in range(150)]
    got = toxicity.Landmarks(marks).compare(sorted(set(words)))
    for w in set(words):
        want = {j: v for j, t in enumerate(marks) if (v := slow_feature(w, t)) >= toxicity.FLOOR}
        have = dict(got.get(w, []))
        assert all(abs(have.get(j, 0.0) - v) < 1e-3 for j, v in want.items() if v > toxicity.FLOOR + 1e-3), w
        assert all(abs(v - want.get(j, v)) < 1e-3 for j, v in have.items()), w


def test_inserted_letters_and_short_insults():
    rng = np.random.default_rng(2)
    clean = ["".join(rng.choice(list("bcdfglmnprstvz")) + rng.choice(list("aeiou")) for _ in range(rng.integers(2, 5))) for _ in range(300)]
    bad = ["idiot", "moron", "stupid", "scum", "bum"]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 12))
        if i % 4 == 0:
            words[3:5] = rng.choice(bad, 2)
        texts.append(" ".join(words)), labels.append(int(i % 4 == 0))
    scorer = toxicity.fit(texts, labels).scorer()
    said = lambda w: scorer.scores([" ".join([*clean[:3], w, *clean[3:6]])])[0]
    assert all(said(w) >= 0.3 for w in ("idiot", "bum", "idxiot", "moxron", "stuxpid", "scxum", "i.d.i.o.t", "id1ot"))
    assert np.mean([scorer.scores([t])[0] >= 0.3 for t, y in zip(texts, labels) if not y]) < 0.02


def test_labels_and_rows_that_repeat(spark):
    docs = spark.createDataFrame([(1, "fine words", "a"), (1, "fine words", "b"), (2, "fine words", "c"), (None, "fine words", "d")], "doc_id long, text string, _y string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1
    assert toxicity.score(docs, toxicity.fit_on(docs, labels)).columns == ["doc_id", "text", "_y", "score"]
