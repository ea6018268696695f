import numpy as np

from wavelens.llm import embed


def brute(ids, m, threshold=0.9):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    parent = dict(zip(ids, ids))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(near)):
        x, y = find(ids[a]), find(ids[b])
        parent[max(x, y)] = min(x, y)
    return near.sum(1), [find(i) for i in ids]


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 64))
    m = np.concatenate([rng.standard_normal((600, 64)), centres.repeat(8, 0) + 0.3 * rng.standard_normal((320, 64)), centres[:1].repeat(400, 0) + 0.1 * rng.standard_normal((400, 64)), centres[1:2].repeat(30, 0)]).astype(np.float32)
    ids = rng.permutation(len(m)).tolist()
    df = spark.createDataFrame([(int(i), [float(x) for x in v], "x") for i, v in zip(ids, m)], "vec_id long, embedding array<float>, rep string")
    for block in (64, 4096):
        got = {r.vec_id: r for r in embed.near_duplicates(df, block=block).collect()}
        links, comp = brute(ids, m.astype(float))
        assert len(got) == len(ids)
        have = sum(got[i].n_links for i in ids)
        assert all(got[i].n_links <= n for i, n in zip(ids, links.tolist()))
        assert have >= 0.97 * links.sum()
        same = np.mean([got[i].component_id == c for i, c in zip(ids, comp)])
        assert same > 0.97
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [1e-30, 2e-30]), (11, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (12, [2.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i in (1, 2, 3, 4, 5, 6, 11, 12):
        assert got[i] == (0, i, True)
    for i in (7, 8, 9, 10):
        assert got[i] == (3, 7, i == 7)
    assert got[None] == (0, None, False)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Planted pairs at cosines 0.90 to 0.92 share a bucket of some table, with the planes and tables chosen for so many classes."""
    rng = np.random.default_rng(11)
    for classes in (100, 10_000, 1_000_000):
        bits, tables = embed.plan(classes, 0.9, 0.02)
        for cosine in (0.90, 0.91, 0.92):
            a = rng.standard_normal((2000, 64))
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            n = rng.standard_normal(a.shape)
            n -= (n * a).sum(1, keepdims=True) * a
            n /= np.linalg.norm(n, axis=1, keepdims=True)
            b = cosine * a + np.sqrt(1 - cosine**2) * n
            met = (embed.sign_codes(a, tables, bits, 20240) == embed.sign_codes(b, tables, bits, 20240)).any(1)
            assert met.mean() >= 0.95, (classes, cosine, met.mean())


def test_planted_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(12)
    a = rng.standard_normal((400, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.standard_normal(a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.92, (400, 1))
    m = np.concatenate([a, c * a + np.sqrt(1 - c * c) * n])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed.near_duplicates(df).collect()}
    assert np.mean([got[400 + i].component_id == i for i in range(400)]) >= 0.95
