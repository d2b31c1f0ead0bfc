import numpy as np
from llm_data import docs, no_docs, prose

from foldstream.llm.chunking import GEAR, ChunkRules, cut, gear_hash, with_repeats, without_repeats


def test_rolling_hash():
    data = np.frombuffer(prose(30).encode(), np.uint8)
    h, rolled = 0, []
    for b in data:
        h = ((h << 1) + int(GEAR[b])) & 0xFFFFFFFF
        rolled.append(h)
    assert gear_hash(data).tolist() == rolled


def test_chunks():
    rules, text = ChunkRules(), prose(500).encode()
    ends = cut(text)
    sizes = np.diff(ends)
    assert ends[0] == 0 and ends[-1] == len(text) and sizes.max() <= rules.most and sizes[:-1].min() >= rules.least
    assert cut(b"") == [0] and cut(b"a" * 200)[-1] == 200
    # an insertion moves the boundaries behind it, and soon no other
    moved = {e - 7 for e in cut(b"insert " + text)}
    assert len(moved & set(ends)) > 0.9 * len(ends)


def test_passages(spark):
    passage = prose(60, 77)
    rows = [(i, prose(40, 100 + i) + " " + (passage + " " if i in (2, 5, 9) else "") + prose(40, 300 + i)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in with_repeats(df).collect():
        assert (len(r["_passages"]) > 0) == (r["doc_id"] in (2, 5, 9))
        for p in r["_passages"]:
            found = r["text"].encode()[p["start"]:p["stop"]].decode()
            assert found in passage or len(found) - len(passage) < 40
            assert p["stop"] - p["start"] > 0.7 * len(passage) and p["first"] == (r["doc_id"] == 2)
    cleaned = {r["doc_id"]: r["text"] for r in without_repeats(df).collect()}
    assert all((cleaned[i] == t) == (i not in (5, 9)) for i, t in rows)
    assert all(len(cleaned[i]) < len(t) - 0.7 * len(passage) for i, t in rows if i in (5, 9))


def test_all_long_shared_passages_are_found(spark):
    """Against all 51-word windows of the smallest table."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    seen, long_, short = {}, set(), set()
    for width, hit in ((51, long_), (10, short)):
        for r in df.collect():
            words = r["text"].split()
            for i in range(len(words) - width + 1):
                other = seen.setdefault(tuple(words[i:i + width]), r["doc_id"])
                if other != r["doc_id"]:
                    hit.update((other, r["doc_id"]))
    flagged = {r["doc_id"] for r in with_repeats(df).collect() if r["_passages"]}
    assert len(long_ - flagged) <= 0.01 * len(long_) and flagged <= short


def test_every_chunk_keeps_a_holder(spark):
    """Document 2 joins a passage of document 1 with one that only later documents have: it keeps the second one."""
    a, b = prose(60, 901), prose(60, 902)
    rows = [(1, a + " " + prose(30, 1)), (2, prose(30, 2) + " " + a + " " + b + " " + prose(30, 3)), (3, prose(30, 4) + " " + a + " " + b),
            (4, prose(30, 5) + " é" + b + "é " + prose(30, 6))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cleaned = {r["doc_id"]: r["text"].encode() for r in without_repeats(df).collect()}
    left = b"\n".join(cleaned.values())
    for _, text in rows:
        data = text.encode()
        ends = cut(data)
        assert all(data[x:y] in left for x, y in zip(ends, ends[1:]))
    assert a.encode() in cleaned[1] and b.encode()[70:-70] in cleaned[2] and b.encode()[70:-70] not in cleaned[3] + cleaned[4]
    firsts = [p["first"] for p in {r["doc_id"]: r["_passages"] for r in with_repeats(df).collect()}[2]]
    assert firsts == [False, True]


def test_awkward_rows(spark):
    got = {r["doc_id"]: r["_passages"] for r in with_repeats(docs(spark)).collect()}
    assert len(got[1]) == 1 and got[1][0]["first"] and not got[2][0]["first"]
    assert got[3] == got[4] == got[5] == got[8] == [] and len(got[None]) == 1
    assert with_repeats(docs(spark)).count() == 11
    assert without_repeats(docs(spark)).columns == docs(spark).columns and without_repeats(docs(spark)).count() == 11
    assert with_repeats(no_docs(spark)).count() == 0 and without_repeats(no_docs(spark)).count() == 0
