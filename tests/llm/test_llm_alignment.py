"""Alignment against byte offsets counted one by one."""

import random
from collections import Counter
from hashlib import sha256
from pathlib import Path

import numpy as np
import public_tokenizers
from llm_data import docs, no_docs, prose
from pyspark.sql import functions as F

from foldstream.llm import alignment, queries

A, B = public_tokenizers.path(queries.ALIGNED_A), public_tokenizers.path(queries.ALIGNED_B)


def groups_of(a_lens, b_lens):
    """Pairs of token index lists, cut where both sides end."""
    out, i, j, x, y, now = [], 0, 0, 0, 0, ([], [])
    while i < len(a_lens) or j < len(b_lens):
        if x <= y and i < len(a_lens):
            x += a_lens[i]
            now[0].append(i)
            i += 1
        else:
            y += b_lens[j]
            now[1].append(j)
            j += 1
        if x == y:
            out.append(now)
            now = ([], [])
    return out


def test_groups_of_random_cuts():
    rng = random.Random(3)
    for _ in range(300):
        total, sides = rng.randint(1, 80), []
        for _ in range(2):
            cuts = sorted({total, *(rng.randint(1, total) for _ in range(rng.randint(0, 30)))})
            sides.append(np.diff([0, *cuts]).tolist())
        want = [[g for g, held in enumerate(groups_of(*sides)) for _ in held[s]] for s in (0, 1)]
        got = alignment.group_numbers(*(np.cumsum(s) for s in sides))
        assert [g.tolist() for g in got] == want


def expected(data):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    found = []
    for _, text in data:
        groups = []
        if text:
            whole = (" " + text).encode()
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bx = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
            by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(bx) == whole == b"".join(by):
                groups = [([x[i] for i in p], [y[j] for j in q]) for p, q in groups_of([len(t) for t in bx], [len(t) for t in by])]
        found.append(groups)
    links = [Counter((i, j) for p, q in groups for i in p for j in q) for groups in found]
    docs_of = Counter(pair for own in links for pair in own)
    most = {}
    for (i, _), n in docs_of.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for (id_, _), groups, own in zip(data, found, links, strict=True):
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((id_, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(own.values()),
                    sum(n for pair, n in own.items() if docs_of[pair] == most[pair[0]]),
                    sum(n * docs_of[pair] for pair, n in own.items()), sha256(text.encode()).hexdigest() if groups else ""))
    return out


def test_query_against_brute_force(spark, tmp_path):
    data = [(1, prose(300, 5)), (2, None), (3, ""), (4, " "), (5, "a\r\n\tb  c   d\n\n"), (6, "naïve 漢字 😀 été ½ ①"), (7, "a" * 3_000),
            (8, "1234567 89,012.5 <|endoftext|> </s> <unk> <0x41>"), (9, "▁x ▁"), (10, "x=====----++++    y"),
            (11, prose(300, 5)), (11, prose(300, 5)), (None, "null id"), (12, "é ﬁ   　 ​"), (13, prose(5_000, 2))]
    rng = random.Random(1)
    data += [(100 + i, " ".join(rng.choice(["the", "house", "running", "Übergröße", "x9", "no-one", "...", "0x1F"]) for _ in range(40))) for i in range(60)]
    spark.createDataFrame(data, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_alignment(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected(data), key=repr)
    assert sum(r[1] > 0 for r in got) > 65


def test_large_counts_take_the_shuffled_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("foldstream.llm.common.BROADCAST_ROWS", 0)
    data = [(i, f"{prose(30, i)} shared words") for i in range(20)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in queries.op12_alignment(spark, str(tmp_path)).collect()) == sorted(expected(data))


def test_lexicon_names_the_pairs(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog")], "doc_id long, text string")
    found = alignment.align(df, A, B)
    words = alignment.lexicon(found, alignment.pair_size(B))
    tables = alignment.Aligner(alignment.ByteLevel(Path(A).read_bytes()), alignment.Pieces(Path(B).read_bytes()))
    named = {(tables.a.tokens[r["a_id"]], tables.b.tokens[r["b_id"]]): (r["docs"], r["best"]) for r in words.collect()}
    assert named == {(b" the", b" the"): (2, True), (b" cat", b" cat"): (1, True), (b" dog", b" dog"): (1, True)}
    assert alignment.scored(found, words).select(F.sum("n_best"), F.sum("count_sum")).first()[:] == (4, 6)


def test_awkward_rows(spark):
    found = alignment.align(docs(spark), A, B)
    assert found.count() == docs(spark).count()
    assert {r["doc_id"]: r["n_groups"] for r in found.where("n_groups = 0").collect()} == {3: 0, 4: 0}
    assert alignment.align(no_docs(spark), A, B).collect() == []


def test_stretches_are_encoded_once_and_as_in_whole_texts(monkeypatch):
    """Words met before are not encoded again, also when most are forgotten in between; texts come out as if encoded whole."""
    files = [Path(p).read_bytes() for p in (A, B)]
    tables = alignment.Aligner(alignment.ByteLevel(files[0]), alignment.Pieces(files[1]))
    assert tables.cuts
    rng = random.Random(5)
    signs = [" ", "  ", "\n", "\r\n", " \r", "\t", "a", "don't", "'ll", "12", "½", ".", ",", "　", "\x85", "\x1c", "▁", "日本", "<s>", "{", "́", "x"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))).encode() for _ in range(400)] + [None, b"", b" ", b"a ", b"\xff a", b"ok"]
    whole = alignment.Aligner(alignment.ByteLevel(files[0]), alignment.Pieces(files[1]))
    whole.cuts = False
    expected = [c.to_pylist() for c in whole.align(texts)]
    assert [c.to_pylist() for c in tables.align(texts)] == expected and 100 < sum(n > 0 for n in expected[0]) < 400
    words = b"the cat and the dog"
    first = [c.to_pylist() for c in tables.align([words])]
    encoded = []
    both = [c.to_pylist() for c in whole.align([words, words + b" ran"])]
    plain = tables.encode
    monkeypatch.setattr(tables, "encode", lambda some, *more: encoded.extend(some) or plain(some, *more))
    assert [c.to_pylist() for c in tables.align([words, words + b" ran"])] == both
    assert encoded == [" ran"]
    monkeypatch.setattr(alignment, "MOST_STRETCHES", 8)
    for _ in range(3):
        assert [c.to_pylist() for c in tables.align([words])] == first and len(tables.number) <= 12
    assert [c.to_pylist() for c in tables.align(texts)] == expected
