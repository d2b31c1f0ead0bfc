import numpy as np

from foldstream.llm.neighbours import CentroidGraph, Lists, balanced_centroids, nearest

EVERY = "_id % 5 = 0"
SCHEMA = "vec_id long, embedding array<float>, score string"


def plain(rows, k):
    """Result over (id, vector) rows by comparing all of them."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for i, v in rows:
        if i % 5 == 0:
            scored = {(-float(np.dot(np.array(v, float), np.array(w, float))), j) for j, w in rows if j != i}
            out[i] = [j for _, j in sorted(scored)[:k]]
    return out


def table(rows):
    got = {}
    for r in sorted(rows):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_all_lists_give_the_exact_result(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(40)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows] + [(0, x[0].tolist(), "again")], SCHEMA)
    got = nearest(df, EVERY, 7, how=Lists(list_rows=20, probes=1000, beam=1000, ratio=100.0, part_rows=16, query_rows=8))
    assert table(got.collect()) == plain(rows, 7)


def test_recall_and_balance(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 2500)] + 0.3 * rng.normal(size=(2500, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = table(nearest(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), EVERY, 10,
                        how=Lists(list_rows=40, probes=24)).collect())
    expected = plain(rows, 10)
    assert np.mean([len(set(got[q]) & set(expected[q])) / 10 for q in expected]) >= 0.9
    centroids = balanced_centroids(x.astype(float), 32, 0)
    assert len(centroids) == 32
    graph = CentroidGraph(centroids, 8, 0)
    found, _ = graph.search(x[:200].astype(float), 16)
    exact = np.argsort(((x[:200, None].astype(float) - centroids[None]) ** 2).sum(axis=2), axis=1)[:, 0]
    assert (found[:, 0] == exact).mean() > 0.95


def test_recall_holds_with_many_lists(spark):
    """Vectors without clusters and far more lists than the least number of probes, queries of a cell in blocks."""
    x = np.random.default_rng(2).normal(size=(4000, 24))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = table(nearest(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), EVERY, 10,
                        how=Lists(list_rows=16, probes=8, sure=4, visit_rows=50)).collect())
    close = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(close, -9)
    expected = np.argsort(-close, axis=1)[:, :10]
    assert len(got) == 800 and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(expected[i].tolist())) / 10 for i in got]) >= 0.93


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (5, [0.0, 2.0], "b"), (6, [1.0, 0.0], None), (7, None, "c"), (8, [], "c"), (9, [0.0, 0.0], "c"),
            (10, [nan, 1.0], "c"), (15, [inf, 1.0], "c"), (20, [None, 1.0], "c"), (25, [1.0, 2.0, 3.0], "c"), (None, [1.0, 1.0], "c"),
            (0, [1.0, 0.0], "a")]
    got = table(nearest(spark.createDataFrame(rows, SCHEMA), EVERY, 20).collect())
    assert got == {0: [6, 5], 5: [0, 6]}
    assert nearest(spark.createDataFrame([], SCHEMA), EVERY, 20).count() == 0
    assert nearest(spark.createDataFrame([(0, [1.0], "x")], SCHEMA), EVERY, 20).count() == 0
