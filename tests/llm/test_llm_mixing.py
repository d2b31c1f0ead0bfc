import re

import numpy as np
from llm_data import docs, no_docs
from pyspark.sql import functions as F

from foldstream.llm.common import word_count
from foldstream.llm.mixing import flight, landing, mix, plan, source_targets


def test_word_count(spark):
    texts = ["", " ", "a", " a", "a ", "\ta\nb\v\fc\r", "a b c\x1cd", "\n\n", "é 漢", None, "a\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", word_count(F.col("t")).alias("n"))
    for row in df.collect():
        assert row["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", row["t"] or "")), repr(row["t"])


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 500):
        p, size = rng.random(n), rng.integers(0, 5, n)
        out = flight(p, size, rng)
        assert ((out == 0) | (out == 1)).sum() >= n - 2
        assert np.isclose(out.sum(), p.sum()) and np.isclose((out * size).sum(), (p * size).sum())
        assert set(np.unique(landing(out, size.astype(float)))) <= {0.0, 1.0}


def test_flight_is_balanced_on_average():
    rng = np.random.default_rng(2)
    p, size = np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3]), np.array([1, 2, 3, 4, 5, 6])
    mean = np.mean([flight(p, size, rng) for _ in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def shared(sizes, weights, budget=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    total, out = sum(sizes) * budget, [0.0] * len(sizes)
    full = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(most * sizes[i] for i in full)
        for i in free:
            out[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if out[i] > most * sizes[i]]
        if not over:
            return out
        for i in over:
            full.add(i)
            out[i] = most * sizes[i]


def test_targets(spark):
    sizes = {"b": 100, "a": 7, "é": 900, "C": 40, None: 300, "z": 0}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "_source string, _words long")
    got = {r["_source"]: r["_target"] for r in source_targets(rows).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    expected = shared([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, t in zip(order, expected):
        assert np.isclose(got[s], t), s


def test_mix_meets_targets_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "s%d" % min(int(rng.exponential(1.5)), 4)) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = plan(df, block_rows=100).collect()
    assert sorted(plan(df.repartition(7), block_rows=100).collect()) == sorted(first)
    by = {}
    for r in first:
        target, taken, size = by.setdefault(r["_source"], [r["_target"], 0, 0])
        by[r["_source"]] = [target, taken + r["_copies"] * r["_size"], size + r["_size"]]
        assert 0 <= r["_copies"] <= 2
    assert len(first) == 2500 and len(by) == 5
    for target, taken, size in by.values():
        assert abs(taken - target) <= 30  # one document
    mixed = mix(df)
    assert mixed.columns == df.columns
    total = mixed.select(F.sum(word_count(F.col("text")))).first()[0]
    assert abs(total - 1.5 * sum(v[2] for v in by.values())) < 150


def test_awkward_rows(spark):
    got = plan(docs(spark)).collect()
    assert len(got) == 11
    assert {r["_size"] for r in got if r["_id"] in (3, 4, 5)} == {0}
    assert sum(r["_source"] is None for r in got) == 2
    assert mix(docs(spark)).columns == docs(spark).columns
    assert plan(no_docs(spark)).count() == 0 and mix(no_docs(spark)).count() == 0


def test_equal_rows_are_one_decision(spark):
    """Many equal rows of one document: their source comes near its target and no block holds them."""
    df = spark.range(3_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"))
    df = df.unionByName(spark.range(50).select((F.col("id") + 100).alias("doc_id"), F.lit("x y").alias("text"), F.lit("b").alias("source")))
    taken = plan(df, block_rows=100).collect()
    assert len(taken) == 3_050
    for source in ("a", "b"):
        own = [r for r in taken if r["_source"] == source]
        assert abs(sum(r["_size"] * r["_copies"] for r in own) - own[0]["_target"]) <= 3
        assert {r["_copies"] for r in own} <= {0, 1, 2}
    assert sum(r["_copies"] for r in plan(df, block_rows=100).collect()) == sum(r["_copies"] for r in taken)
