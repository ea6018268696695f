import hashlib
import itertools
import random
import re

from wavelens.llm import decontam
from wavelens.llm.common import table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = tokens(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w, hit, ids = tokens(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    ids |= got
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def brute_near(docs, items, slop=20):
    """Items whose three rarest terms stand within slop words, by every combination of their places."""
    places = [(d, {}) for d, _ in docs]
    df = {}
    for (_, at), (_, t) in zip(places, docs):
        for p, w in enumerate(tokens(t)):
            at.setdefault(w, []).append(p)
            df[w] = df.get(w, 0) + 1
    picks = {(i, tuple(sorted(set(tokens(t)), key=lambda w: (df.get(w, 0), w))[:3])) for i, t in items if tokens(t)}
    return [(d, len({i for i, ws in picks if all(w in at for w in ws) and min(max(c) - min(c) + 1 for c in itertools.product(*(at[w] for w in ws))) <= slop})) for d, at in places]


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in decontam.contamination(d, i).collect()}
    assert got == brute(docs, items)


def test_documents_match_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    check(spark, docs, items)
    assert sum(v[4] for v in brute(docs, items).values()) > 0


def test_edges(spark):
    item = "One two three four five six seven eight nine ten eleven twelve"
    docs = [
        (1, None), (2, ""), (3, item), (4, item.upper() + "!!" + item), (5, "x " * 40 + "two, THREE four five-six seven eight nine ten eleven y"),
        (6, "a a a a a a a a a a a a a a"), (7, "Ä b"), (8, "tiny item here and tiny item"), (9, "word " * 20000 + item), (10, item[:40]),
    ]
    items = [(1, item), (2, None), (3, ""), (4, "tiny item"), (5, "a " * 11), (12, item + " thirteen"), (7, "ä b"), (8, "tiny item")]
    check(spark, docs, items)
    check(spark, docs[:3], [(2, None)])
    assert decontam.contamination(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_rows_are_matched_each_by_itself(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(None, item), (None, "clean words"), (7, item + " x"), (7, "nothing here"), (7, item + " x")]
    i = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' AS row", "1 AS pos", "2 AS n_hit")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in decontam.contamination(d, i).collect())
    assert got == [(0, 2, 0, False), (0, 10, 10, True), (7, 2, 0, False), (7, 11, 10, True), (7, 11, 10, True)]


def test_proximity(spark):
    words = [f"w{i}" for i in range(12)]
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(90, "alpha " + "x " * 17 + "beta gamma"), (91, "alpha " + "x " * 18 + "beta gamma"), (92, "gamma beta alpha"), (93, None)]
    items = [(1, "gamma beta alpha"), (2, "w1 w2"), (3, "w3"), (4, "w4 w5 w6 w7"), (5, "w1 unseen"), (6, "")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_near) for r in decontam.contamination(d, i).collect())
    assert got == sorted(brute_near(docs, items))
    assert [n for d, n in got if d >= 90] == [1, 0, 1, 0]
