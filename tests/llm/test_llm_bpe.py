import hashlib
import random
import struct
import sys
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import docs, no_docs, prose

from foldstream.llm import bpe, common

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
CODEC = bpe.Codec(RANKS, PATTERN)
KNOWN = tiktoken.Encoding("known", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    ids = CODEC.encode(text)
    assert ids == KNOWN.encode_ordinary(text) and CODEC.decode(ids) == text


def test_pieces_of_tokens():
    rng, tokens = random.Random(0), list(RANKS)
    for _ in range(4000):
        piece = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 7)))
        assert list(CODEC.transducer.run(piece)) == KNOWN._encode_single_piece(piece)


@pytest.mark.parametrize("text", ["<|endoftext|> don't", " " * 500, "a" * 3000, "é" * 700, "՘\U0003d000x 1²", "\x1c\x85\xa0 x",
                                  prose(4000), "".join(map(chr, range(0x3000)))])
def test_odd_texts(text):
    assert CODEC.encode(text) == KNOWN.encode_ordinary(text)


def test_tables_of_bounded_size(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 20)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 20)
    monkeypatch.setattr(bpe, "MOST_PIECES", 5)
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 7)
    small = bpe.Codec(RANKS, PATTERN)
    text = prose(400) + " " + "xyzzy" * 60
    assert small.encode(text) == KNOWN.encode_ordinary(text)


def test_utf8_stream():
    rng = random.Random(1)
    for _ in range(500):
        whole = "".join(rng.choice("aé漢😀") for _ in range(10)).encode()
        if rng.random() < 0.5:
            whole = bytes(rng.choice([0x61, 0xC3, 0xA9, 0xE6, 0xBC, 0xF0, 0x9F, 0xED, 0xA0, 0xFF]) for _ in range(12))
        stream, parts, at = bpe.Utf8Stream(), [], 0
        while at < len(whole):
            step = rng.randrange(1, 4)
            parts.append(stream.feed(whole[at:at + step]))
            at += step
        parts.append(stream.finish())
        assert b"".join(parts) == whole
        assert "".join(p.decode("utf-8", "replace") for p in parts) == whole.decode("utf-8", "replace")


def test_awkward_rows(spark):
    got = {r["doc_id"]: r["_bpe"] for r in bpe.encode_digest(docs(spark), RANKS, PATTERN).collect()}
    for r in docs(spark).collect():
        ids = KNOWN.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs(spark), RANKS, PATTERN), RANKS, PATTERN, into="again")
    assert all(r["again"] == (r["text"] or "") for r in back.collect())
    assert bpe.encode_digest(no_docs(spark), RANKS, PATTERN).count() == 0


def test_a_worker_keeps_the_tables_of_one_operator():
    made = []

    def tables(key):
        return common.worker_tables(key, lambda: made.append(key) or [key])

    try:
        assert tables("a") is tables("a") and made == ["a"]
        tables("b")
        assert list(common._held()) == ["b"]
        keeping = common.text_udf(lambda texts: [len(t) for t in texts], "long", pa.int64(), keeps_tables=True)
        keeping.__closure__[0].cell_contents.func(pa.array([b"x", None]))
        assert list(common._held()) == ["b"]
        other = common.text_udf(lambda texts: [len(t) for t in texts], "long", pa.int64())
        assert other.__closure__[0].cell_contents.func(pa.array([b"x", None])).to_pylist() == [1, 0]
        assert not common._held()
    finally:
        common.release_tables()


def test_patterns_take_little_memory():
    """Building the classes of all code points held a string for each of them: 129 MB a worker."""
    tracemalloc.start()
    wide = bpe.plain_pattern(PATTERN, sys.maxunicode)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    letters = bpe.plain_pattern(r"\p{L}", 0xFFFF)
    assert bpe.plain_pattern(r"\p{L}", bpe.POINTS_AT_ONCE * 16 - 1) == letters and len(wide) > len(letters)
