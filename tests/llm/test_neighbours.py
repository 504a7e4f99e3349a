import numpy as np
import pytest

from trawl.llm import neighbours as N


def footrule(a, b):
    n = len(a)
    place = lambda x, p: x.index(p) if p in x else n
    return sum(abs(place(a, p) - place(b, p)) for p in {*a, *b})


def test_footrule_by_definition():
    rng = np.random.default_rng(0)
    q = np.array([rng.permutation(12)[:5] for _ in range(9)], np.int32)
    d = np.array([rng.permutation(12)[:5] for _ in range(7)], np.int32)
    got = N.footrule_similarity(q, d)
    want = np.array([[footrule(list(x), list(y)) for y in d] for x in q])
    assert np.array_equal(30 - 2 * got, want)  # 2 * (5 + 4 + 3 + 2 + 1)


def test_footrule_bound_loses_few():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1400, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    strict, loose = (N.least_common(x[:300], x[300:], c, 6, 8) for c in (0.98, 0.7))
    assert strict > loose >= 1 and N.least_common(x[:300], x[300:320], 0.9, 6, 8) == 1 and N.least_common(x[:300], x[300:], -2.0, 6, 8) == 1


def test_only_picked_pairs_are_compared():
    rng = np.random.default_rng(2)
    perm = np.array([rng.permutation(9)[:4] for _ in range(40)], np.int32)
    close = N.footrule_similarity(perm, perm)
    assert np.array_equal(N.Pick(5, None).mask(perm, perm), close >= 5)
    assert N.Pick(0, 3).mask(perm, perm) is None and N.Pick(1, 40).mask(perm, perm) is None
    first = N.Pick(1, 3).mask(perm, perm)
    assert (first.sum(1) >= 3).all() and all(close[i][first[i]].min() > close[i][~first[i]].max() for i in range(40))  # ties stay
    x = rng.normal(size=(40, 6)).astype(np.float32)
    ids = np.arange(40)
    for pick in (N.Pick(5, None), N.Pick(9, None), N.Pick(1, 3), N.Pick(0, None)):
        for least in (-2.0, 0.3):
            mask = pick.mask(perm, perm)
            got = {(a, b) for a, b in zip(*(c.to_pylist() for c in N._found(ids, perm, x, ids, perm, x, 50, pick, least).columns[:2]))}
            want = {(a, b) for a in range(40) for b in range(40) if a != b and (mask is None or mask[a, b]) and x[a] @ x[b] >= max(least, -2)}
            assert got == want


def data(n=1500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 10):  # groups of near copies
        x[i + 1 : i + 4] = x[i] + rng.normal(size=(3, dim)) * 0.12
    x[n // 3 : n // 3 + 40] = x[n // 3]  # and of copies
    return x.astype(np.float32)


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u.astype(np.float64) @ u.T
    np.fill_diagonal(c, -2)
    return c


@pytest.fixture(scope="module")
def tables(spark):
    x = data()
    rows = [(i, "g", v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, namespace string, vector array<float>").repartition(6), spark.createDataFrame([("g", 16)], "namespace string, dimensions int")


def test_pairs_against_brute_force(tables):
    x, df, names = tables
    c = brute(x, 10)
    got = {tuple(r) for r in N.similar_pairs(df, names).collect()}
    copies = set(range(500, 540))
    want = set()
    for i in range(len(x)):
        for j in np.nonzero(c[i] >= 0.9)[0]:
            if not {i, int(j)} <= copies:
                if (c[i] > c[i, j]).sum() < 10:
                    want.add((min(i, int(j)), max(i, int(j))))
    assert len(want - got) <= 0.01 * len(want)
    assert all(c[a, b] >= 0.9 - 1e-5 for a, b in got)
    # of forty copies each has ten neighbours, those of lowest id
    mine = {p for p in got if set(p) <= copies}
    assert mine == {(a, b) for a in range(500, 511) for b in range(a + 1, 540) if a < 510 or b == 510} & mine and len(mine) > 300


def test_recall_of_the_query_set(tables):
    x, df, names = tables
    c = brute(x, 10)
    got: dict[int, list] = {}
    for r in N.neighbours(df, names, every=50, pivots=32, probes=16, rerank=512).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["cosine"]))
    assert set(got) == set(range(0, 1500, 50))
    hit = 0
    for i, found in got.items():
        assert [f[0] for f in sorted(found)] == list(range(1, 11))
        least = np.sort(c[i])[-10] - 1e-6
        hit += sum(c[i, j] >= least for _, j, _ in found)
    assert hit / (10 * len(got)) >= 0.9


def test_blocks_lose_no_pair(tables):
    _, df, names = tables
    v = N.usable(df, names).drop("print")
    whole = N.PermutationIndex(v, pivots=16).search_all(5, 10_000, 0.9)
    blocked = N.PermutationIndex(v, pivots=16, block=60).search_all(10_000, 10_000, 0.9)
    a, b = ({(r["a"], r["b"]) for r in d.collect()} for d in (whole, blocked))
    assert a <= b


def test_ties_come_by_id(spark):
    names = spark.createDataFrame([("g", 2)], "namespace string, dimensions int")
    df = spark.createDataFrame([(i, "g", [1.0, 1.0]) for i in (5, 3, 9, 1)], "id long, namespace string, vector array<float>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in N.neighbours(df, names, k=2).collect()}
    assert got == {(1, 1): 3, (1, 2): 5, (3, 1): 1, (3, 2): 5, (5, 1): 1, (5, 2): 3, (9, 1): 1, (9, 2): 3}


def test_many_near_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x[::3] = rng.normal(size=64) + rng.normal(size=(2000, 64)) * 0.23  # a third of the rows, cosine about 0.95
    x = x.astype(np.float32)
    names = spark.createDataFrame([("g", 64)], "namespace string, dimensions int")
    df = spark.createDataFrame([(i, "g", v.tolist()) for i, v in enumerate(x)], "id long, namespace string, vector array<float>").repartition(4)
    c = brute(x, 10)
    want = {(i, int(j)) for i in range(0, 6000, 3) for j in np.argsort(-c[i])[:10]}
    assert 0.94 < np.median(c[::3, ::3]) < 0.96 and min(c[p] for p in want) >= 0.9
    got = {(r["id"], r["neighbour"]) for r in N.neighbours(df, names, least=0.9).collect()}
    assert len(want & got) >= 0.999 * len(want)
    asked = {(r["id"], r["neighbour"]) for r in N.neighbours(df, names, least=0.9, every=60, lists=4, rerank=128).collect()}
    assert len({p for p in want if p[0] % 60 == 0} & asked) >= 0.999 * 10 * 100


def test_recall_of_all_vectors_of_any_cosine(spark):
    """Every vector asks for its 10 nearest, by the defaults, where vectors have structure: 150 clusters in 24 dimensions."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(150, 24))[rng.integers(0, 150, 3000)] + rng.normal(size=(3000, 24)) * 0.5).astype(np.float32)
    names = spark.createDataFrame([("g", 24)], "namespace string, dimensions int")
    df = spark.createDataFrame([(i, "g", v.tolist()) for i, v in enumerate(x)], "id long, namespace string, vector array<float>").repartition(4)
    c = brute(x, 10)
    want = {(i, int(j)) for i in range(3000) for j in np.argsort(-c[i])[:10]}
    got = {(r["id"], r["neighbour"]) for r in N.neighbours(df, names).collect()}
    assert len(got) == 30_000 and len(want & got) >= 0.9 * len(want)
