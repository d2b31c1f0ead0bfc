"""Line dedup against a plain walk over all lines."""

import hashlib

import pytest
from llm_data import docs, no_docs, rows as awkward
from pyspark.sql import functions as F

from foldstream.llm import lines


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def expected(data, least_docs, keep_first=False):
    """(id, text) rows -> kept texts, in order."""
    holders, first = {}, {}
    for id_, text in data:
        for pos, line in enumerate((text or "").split("\n")):
            k = key(line)
            if k:
                holders.setdefault(k, set()).add(id_)
                at = (id_ is not None, id_ or 0, pos)
                first[k] = min(first.get(k, at), at)
    out = []
    for id_, text in data:
        kept, dropped = [], 0
        for pos, line in enumerate((text or "").split("\n")):
            k = key(line)
            gone = bool(k) and len(holders[k]) >= least_docs
            if gone and keep_first and first[k] == (id_ is not None, id_ or 0, pos):
                gone = False
            dropped += gone
            if not gone:
                kept.append(line)
        out.append((id_, dropped, "\n".join(kept)))
    return out


def texts():
    hot = "  Shared Licence LINE\t"
    data = [(i, f"own {i}\n{hot}\n\n  \nshared licence line\nother {i % 3}\nÉclair {i}") for i in range(12)]
    data += [(20, None), (21, ""), (22, "\n"), (23, "\n\nshared licence line"), (None, "shared licence line\nx"),
             (24, "shared licence line"), (25, "é\n É"), (3, data[3][1]), (3, data[3][1]), (3, "two rows, one id\nother 0"),
             (26, "\n".join(["shared licence line", "kept"] * 400)), (27, "one line, no other " * 3_000)]
    return data


@pytest.mark.parametrize(("least", "keep_first"), [(10, False), (2, False), (2, True), (4, True)])
def test_whole_result(spark, least, keep_first):
    data = texts()
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = lines.with_bitmaps(df, least_docs=least, keep_first=keep_first).select(
        "doc_id", lines.line_count("_keep").alias("n"), lines.dropped_count("_keep").alias("d"), lines.kept_text(F.col("text"), F.col("_keep")).alias("t"))
    got = sorted(((r["doc_id"], r["d"], r["t"]) for r in found.collect()), key=repr)
    assert got == sorted(expected(data, least, keep_first), key=repr)
    assert {r["n"] for r in found.collect()} >= {1, 7, 800}


def test_bitmaps_are_run_lengths(spark):
    data = [(i, "a\nb\nb\nc") for i in range(3)] + [(9, "b\nz")]
    df = spark.createDataFrame([(i, t.replace("a", f"a{i}").replace("c", f"c{i}")) for i, t in data], "doc_id long, text string")
    got = {r["doc_id"]: r["_keep"] for r in lines.with_bitmaps(df, least_docs=3).collect()}
    assert got == {0: [1, 2, 1], 1: [1, 2, 1], 2: [1, 2, 1], 9: [0, 1, 1]}


def test_a_hot_key_is_spread_over_ranges(spark):
    """One line in every document: the ranges cut inside the key, and nothing of it meets in one task."""
    df = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot\nown "), F.col("id").cast("string")).alias("text"))
    firsts = lines.first_occurrences(lines.line_hashes(df).where(F.col("_pos") == 0))
    sizes = firsts.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and sum(r["count"] for r in sizes) == 4_000
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "hashpartitioning" not in plan


def test_awkward_rows(spark):
    found = lines.drop_frequent_lines(docs(spark), least_docs=2)
    assert found.columns == docs(spark).columns
    data = [(r[0], r[1]) for r in awkward()]
    want = sorted(((i, None if t is None else w) for (i, t), (_, _, w) in zip(data, expected(data, 2), strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == want
    assert lines.drop_frequent_lines(no_docs(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    df = lines.with_bitmaps(spark.createDataFrame(texts(), "doc_id long, text string"))
    plan = df.select(F.sha2(lines.kept_text(F.col("text"), F.col("_keep")), 256))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    digest = df.where("doc_id = 22").select(F.sha2(lines.kept_text(F.col("text"), F.col("_keep")), 256)).first()[0]
    assert digest == hashlib.sha256(b"\n").hexdigest()
