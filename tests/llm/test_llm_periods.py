"""Runs against all periods of all stretches of words."""

import random

import numpy as np
from llm_data import docs, no_docs
from pyspark.sql import functions as F

from foldstream.llm import periods
from foldstream.llm import queries


def all_runs(words, least, times=2):
    """Every maximal stretch of each period, the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, n_, q) for (s, n_), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def run(word_lists, least=2):
    doc = np.repeat(np.arange(len(word_lists)), [len(w) for w in word_lists])
    got = periods.runs_of(np.array([x for w in word_lists for x in w], np.int64), doc, periods.RunRules(least=least))
    begin = np.r_[0, np.cumsum([len(w) for w in word_lists])]
    return [[tuple(r) for r in (got[(got[:, 0] >= begin[i]) & (got[:, 0] < begin[i + 1])] - [begin[i], 0, 0]).tolist()]
            for i in range(len(word_lists))]


def test_random_words_of_small_alphabets():
    rng = random.Random(5)
    for round_ in range(400):
        lists = []
        for _ in range(rng.randint(1, 6)):
            n, letters = rng.randint(0, 70), rng.randint(1, 4)
            words = [rng.randrange(letters) for _ in range(n)]
            if rng.random() < 0.5 and n:  # plant periods, also nested ones
                for _ in range(rng.randint(1, 3)):
                    a, p = rng.randrange(n), rng.randint(1, 12)
                    for i in range(a + p, min(n, a + p * rng.randint(2, 5) + rng.randint(0, 3))):
                        words[i] = words[i - p]
            lists.append(words)
        least = rng.choice([2, 2, 5, 12])
        assert run(lists, least) == [all_runs(w, least) for w in lists], (round_, lists, least)


def test_squares_across_progressions():
    """Squares of every odd length meet where two stretches of one period join out of step."""
    lists = [([0, 1] * m + [0]) + ([0, 1] * k + [0]) for m in range(12) for k in range(12)]
    lists += [[0] * m + [1] + [0] * k + [1] + [0] * j for m in range(6) for k in range(6) for j in range(6)]
    lists += [([0, 1, 0] * m + [0, 1]) * 3 + [0, 1, 0] * k for m in range(6) for k in range(6)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    lists += fib
    assert run(lists) == [all_runs(w, 2) for w in lists]


def test_texts(spark):
    one = "a b c d " * 20
    data = [(1, "x y z"), (2, one), (3, None), (4, ""), (5, " \n"), (6, "w " * 5_000), (7, "w " * 11), (8, "w " * 12),
            (9, "p q\tr\ns t u " * 2 + "p q r\x0bs é é"), (2, one), (10, " ".join(f"w{i}" for i in range(30_000)) + " k l m" * 9)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], [tuple(x) for x in r["_periods"]["runs"]], bytes(r["_periods"]["collapsed"]).decode())
                 for r in periods.with_runs(df).collect())
    want = []
    for id_, text in data:
        words = (text or "").split()
        runs = all_runs(words, 12) if len(words) < 10_000 else [(30_000, 27, 3)]
        want.append((id_, runs, " ".join(collapsed(words, runs))))
    assert got == sorted(want)


def test_awkward_rows(spark):
    found = periods.collapse(docs(spark))
    assert found.columns == docs(spark).columns and found.count() == docs(spark).count()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, docs(spark).collect()))  # none of them has a run
    assert periods.with_runs(no_docs(spark)).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    """The whole query: planted periods, counts, the longest run and both digests."""
    from hashlib import sha256
    from zlib import crc32

    rng = random.Random(11)
    data = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 150)))) for i in range(400)]
    data += [(1_000 + i, f"  lead {i}\tx\n" + "r s t " * i) for i in range(9)] + [(2_000, None), (2_001, ""), (None, "u v " * 8)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.op11_periods(spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    planted = 0
    for id_, text in data:
        words = (text or "").split()
        if id_ is not None and words and crc32(str(id_).encode()) % 10 == 0:
            g, n = crc32(str(id_).encode()) // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = all_runs(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        assert got[id_] == {
            "doc_id": id_, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": 1000 * best[1] // best[2] if runs else None,
            "runs_sha256": sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            "collapsed_sha256": sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()}
    assert planted > 20


def test_periodic_from(spark):
    df = spark.createDataFrame([(list("abcdefgh"), 3, 2), (list("abc"), 0, 1), (list("ab"), 1, 1)], "w array<string>, a int, p int")
    got = [r[0] for r in df.select(periods.periodic_from(F.col("w"), F.col("a"), F.col("p"))).collect()]
    assert got == [list("abcdeded"), list("aaa"), list("ab")]
