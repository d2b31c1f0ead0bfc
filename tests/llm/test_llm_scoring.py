import numpy as np
from llm_data import docs, no_docs
from pyspark.sql import functions as F

from foldstream.llm import scoring


def test_pool_adjacent():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v, w = rng.random(30), rng.random(30) + 0.1
        got = scoring.pool_adjacent(v, w)
        assert (np.diff(got) >= 0).all()
        # least squares over non-decreasing fits: max over starts of min over ends of the mean
        mean = lambda a, b: np.average(v[a:b + 1], weights=w[a:b + 1])
        expected = [max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
        assert np.allclose(got, expected)


def test_partition_sums_equal_one_pass(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((200, len(scoring.STATISTICS))), rng.integers(0, 2, 200).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "_stats array<double>, _label double").repartition(150)
    got = scoring._partition_sums(df, len(scoring.STATISTICS), lambda a, b: (a * b[:, None]).sum(axis=0))
    assert np.allclose(got, (x * y[:, None]).sum(axis=0))


def test_labels_are_learned(spark):
    good = [(i, f"this is text number {i} with words and sense. it goes on {i}.", 1) for i in range(60)]
    bad = [(i, f"BUY### NOW&&& {i}$$$ " * 5, 0) for i in range(60, 120)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    out = scoring.train_and_score(rows.select("doc_id", "text"), rows.select("doc_id", "quality"), F.col("doc_id") % 3 != 1)
    for r in out.collect():
        assert r["predicted"] == int(r["doc_id"] < 60) and 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] % 3 == 1)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, None), (9, 5), (99, 1), (None, 1), (7, 0)], "doc_id long, quality int")
    out = scoring.train_and_score(docs(spark), labels, F.lit(True)).collect()
    assert len(out) == 11 and all(0 <= r["score"] <= 1 for r in out)
    none = labels.where("false")
    assert {r["score"] for r in scoring.train_and_score(docs(spark), none, F.lit(True)).collect()} == {0.5}
    assert scoring.train_and_score(no_docs(spark), labels, F.lit(True)).count() == 0


def test_held_out_accuracy(spark):
    from foldstream.llm.queries import op6_scoring

    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op6_scoring(spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in rows) >= 0.93 * len(rows)
