import corpus_pipeline
import pytest
from llm_data import docs, no_docs, prose

import __spark_entry__
from foldstream.llm import simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    clean = [(i, prose(60 + i, 50 + i), "en", f"s{i % 3}", 0) for i in range(30)]
    junk = [(100, "spam eggs " * 100, "en", "s0", 0), (101, "too short", "en", "s1", 0)]
    copies = [(200 + i, prose(60, 50), "en", "s2", 0) for i in range(5)]
    secret = [(300, prose(80, 999) + " token = 0123456789abcdef0123456789abcdef", "en", "s0", 0)]
    df = spark.createDataFrame(clean + junk + copies + secret, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_take_effect(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None
    before = spark.read.parquet(f"{folder}/documents.parquet")
    one, two, three, four, five = stages.values()
    good = one(spark, before, folder)
    assert {100, 101} == {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in good.select("doc_id").collect()}
    single = two(spark, good, folder)
    ids = sorted(r[0] for r in single.select("doc_id").collect())
    # by brute force over the fingerprints
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    prints = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    expected, done = [], []
    for i in sorted(prints):
        if not any(bin(prints[i] ^ prints[j]).count("1") <= 2 for j in done):
            expected.append(i)
        done.append(i)
    assert ids == expected and not {200, 201} & set(ids)
    clean = three(spark, single, folder)
    found = {r["doc_id"]: r for r in clean.collect()}
    assert found[300]["text"].endswith(" <SECRET>") and found[300]["n_chars"] == len(found[300]["text"])
    assert all(found[i]["text"] == texts[i] for i in ids if i != 300)
    mixed = four(spark, clean, folder)
    assert good.columns == single.columns == clean.columns == mixed.columns == before.columns
    rows = mixed.collect()
    assert {r["doc_id"] for r in rows} <= set(ids) and max(rows.count(r) for r in rows) <= 2
    size = sum(len(found[i]["text"].split()) for i in ids)
    assert abs(sum(len(r["text"].split()) for r in rows) - 1.5 * size) < 100
    assert five(spark, mixed, folder).count() == len(rows)


def test_run_is_registered(spark, folder):
    out = __spark_entry__.queries()["pipeline"](spark, folder)
    assert out.count() > 30 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    names = [q for q in __spark_entry__.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_awkward_rows(spark, tmp_path):
    for make in (docs, no_docs):
        df = make(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, "")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns
            path = str(tmp_path / f"{make.__name__}-{name}")
            out.write.parquet(path)
            df = spark.read.schema(out.schema).parquet(path)
        assert (df.count() == 0) == (make is no_docs)
