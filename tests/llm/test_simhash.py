import random

from wavelens.llm import simhash
from wavelens.llm.common import table


def brute(fps: dict[int, int], bits=2):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_documents_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fps = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in docs.collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = brute(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_links_small_and_crowded_groups(spark):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(4)]
    fps = {}
    for i in range(400):
        f = random.choice(base)
        for _ in range(random.randint(0, 5)):
            f ^= 1 << random.randrange(64)
        fps[i] = f
    by_fp = {}
    for i, f in fps.items():
        by_fp.setdefault(f, i)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for f, i in by_fp.items()]
    reps = spark.createDataFrame(rows, "fp long, rep long")
    want = brute({i: f for f, i in by_fp.items()})
    for group in (2, 128):
        scratch = simhash.Scratch(spark, "t")
        labels = simhash.connected_components(simhash.links(reps, scratch, group=group), scratch)
        got = {r.node: r.component for r in labels.collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "y"), (4, "A b C d", "z"), (5, "a B c D", "z"), (6, "word " * 30000, "z"), (7, "é É", "q"), (None, "a b c d", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert len(got) == 8
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 1, 1] and got[1].fingerprint == "0" * 16
    assert got[5].component_id == 4 and got[None].component_id == 4
    assert got[7].component_id == 7
    assert simhash.near_duplicates(df.limit(0)).count() == 0
