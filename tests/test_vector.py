import numpy as np
import pytest

from trawl.operators import vector


def brute(x, names, asked, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for n, ns, q in asked:
        c = np.round(u @ (q / np.linalg.norm(q)), 6)
        rows = [i for i in range(len(x)) if ns is None or names[i] == ns]
        for rank, i in enumerate(sorted(rows, key=lambda i: (-c[i], i))[:k]):
            out.add((n, i, rank))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    x[40:60] = x[40]  # ties
    names = ["ab"[i % 2] for i in range(900)]
    rows = [(i, names[i], v.tolist()) for i, v in enumerate(x)] + [(5000, "a", [0.0] * 8), (5001, "a", None), (5002, "a", [1.0] * 7), (5003, "a", [float("nan")] * 8), (None, "a", [1.0] * 8)]
    return x, names, spark.createDataFrame(rows, "id long, namespace string, vector array<float>").repartition(5)


def rows(df):
    return {(r["qseq"], r["id"], r["rank"]) for r in df.collect()}


def test_nearest(tables):
    x, names, df = tables
    x = x.astype(np.float32).astype(np.float64)
    asked = [(0, "a", x[3]), (1, "b", x[40]), (2, "a", x[40]), (3, "a", np.zeros(8)), (4, "c", x[1])]
    assert rows(vector.nearest(df, asked, 7)) == brute(x, names, asked[:3], 7)
    with pytest.raises(ValueError):
        vector.nearest(df, [(i, "a", x[0]) for i in range(1025)], 3)


def test_any_number_of_queries(spark, tables, monkeypatch):
    x, names, df = tables
    monkeypatch.setattr(vector, "BLOCK_ROWS", 200)
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 150)
    x = x.astype(np.float32).astype(np.float64)
    asked = [(i, names[i], x[i]) for i in range(0, 900, 2)] + [(i + 10_000, names[i], x[i]) for i in range(900)]
    queries = spark.createDataFrame([(n, ns, v.tolist()) for n, ns, v in asked], "qseq long, namespace string, vector array<double>")
    assert rows(vector.nearest_of(df, queries, 5)) == brute(x, names, asked, 5) and len(asked) > vector.MAX_BATCH
    assert vector.nearest_of(df, queries.where("false"), 5).count() == 0 and vector.nearest_of(df.where("false"), queries, 5).count() == 0


def test_cells(spark, tables):
    x, names, df = tables
    cells = vector.Cells.of(df)
    placed = cells.placed(df).cache()
    assert placed.where("cell IS NULL").count() == 3 and placed.where("id = 5002 AND cell IS NOT NULL").count() == 1
    x = x.astype(np.float32).astype(np.float64)
    asked = [(i, names[i], x[i]) for i in range(0, 900, 90)]
    want = brute(x, names, asked, 10)
    share = []
    for probes in (1, 12, 1000):
        some = placed.where(placed["cell"].isin(cells.near(asked[:1], probes)))
        got = rows(vector.nearest(some, asked[:1], 10))
        share.append(len({p[:2] for p in got} & {p[:2] for p in want if p[0] == 0}) / 10)
    assert share[0] <= share[1] <= share[2] == 1.0
    hits = 0
    for q in asked:  # the recall at a fifth of the cells
        some = placed.where(placed["cell"].isin(cells.near([q], 12)))
        hits += len({p[:2] for p in rows(vector.nearest(some, [q], 10))} & {p[:2] for p in want if p[0] == q[0]})
    assert hits / (10 * len(asked)) >= 0.9 and len(asked) == 10
    assert vector.Cells.of(df.where("false")).near(asked, 3) == []
