"""Repeated passages across documents by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where its top bits are zero, so boundaries depend on the last
32 bytes alone and come back at the same places of a passage wherever it stands and whatever was inserted before it.
Chunks are compared by 128-bit digests. A digest seen in documents with different ids is a repeat; runs of adjacent
repeated chunks that are long enough are repeated passages. Of every chunk the first document (least id) keeps it: a run
that holds chunks first seen here and others is split between them, so each chunk stays somewhere.

How often a digest occurs is an aggregate, combined before the shuffle, so a chunk that stands in a third of all
documents costs its partition no more than any other; the digests found are joined back to the chunks.

Defined results: null and empty texts have no chunks and no passages. Rows with one id count as one document, whose
copies of a passage are no repeat. A null id is an id of its own, the least. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstream.llm.common import identity_columns, staged

#: One random word per byte value.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), seed=1) for i in range(256)], np.uint32)
WINDOW = 32
NO_ID = -(2**63)


@dataclass(frozen=True)
class ChunkRules:
    """bits: a chunk ends every 2 ** bits bytes on average; least, most: bounds of its size in bytes.
    run_bytes, run_chunks: from which a run of repeated chunks is a repeated passage. Between them, a passage of 50
    words that two documents share has several whole chunks of its own, while chance repeats of a few words do not count.
    """

    bits: int = 5
    least: int = 16
    most: int = 64
    run_bytes: int = 96
    run_chunks: int = 2


def gear_hash(data: np.ndarray) -> np.ndarray:
    """For every byte the rolling hash of the WINDOW bytes that end there: the sum of GEAR[b] << distance."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cut(text: bytes, rules: ChunkRules = ChunkRules()) -> list[int]:
    """Ends of the chunks, with 0 in front."""
    if not text:
        return [0]
    hashed = gear_hash(np.frombuffer(text, np.uint8))
    ends, last, n = [0], 0, len(text)
    for at in (np.nonzero(hashed >> np.uint32(32 - rules.bits) == 0)[0] + 1).tolist():
        while at - last > rules.most:
            last += rules.most
            ends.append(last)
        if at - last >= rules.least:
            ends.append(at)
            last = at
    while n - last > rules.most:
        last += rules.most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


#: Chunks handed on at once.
ROWS_AT_ONCE = 200_000


def chunks(rows: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """(_id, _row_a, _text as binary) -> a row per chunk: its digest _h1, _h2, and where it stands. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_h1", "_h2", "_id", "_row_a", "_start", "_stop"]
        digests, ids, keys, starts, stops = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            out = pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                                   pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=names)
            for held in (digests, ids, keys, starts, stops):
                held.clear()
            return out

        for batch in batches:
            for id_, key, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "_row_a", "_text")), strict=True):
                ends = cut(text or b"", rules)
                for at in range(0, len(ends) - 1, ROWS_AT_ONCE):
                    a, b = ends[at:-1][:ROWS_AT_ONCE], ends[at + 1:][:ROWS_AT_ONCE]
                    digests += [xxhash.xxh3_128_digest(text[x:y]) for x, y in zip(a, b, strict=True)]
                    starts += a
                    stops += b
                    ids += [id_] * len(a)
                    keys += [key] * len(a)
                    if len(starts) >= ROWS_AT_ONCE:
                        yield flush()
        yield flush()

    return rows.mapInArrow(run, "_h1 long, _h2 long, _id long, _row_a long, _start int, _stop int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ChunkRules = ChunkRules()) -> DataFrame:
    """One row for each different row of `docs` with a repeated passage: _row_a, _row_b, _passages.

    _passages: array of (start, stop, first) in bytes of the UTF-8 text; first: this document keeps the passage.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.col(f"`{text_col}`").cast("binary").alias("_text"), *identity_columns(docs))
    # both hashes of a row fit in one key: rows that agree in it hold the same text, or collide once in 2 ** 64
    made = chunks(rows.select("_id", F.xxhash64("_row_a", "_row_b").alias("_row_a"), "_text"), rules)
    seen = made.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
    shared = staged(seen.where("_first != _last").drop("_last"), "shared-chunks")
    hits = made.join(shared, ["_h1", "_h2"]).select("_row_a", "_start", "_stop", (F.col("_id") == F.col("_first")).alias("_own"))
    by_row = hits.groupBy("_row_a").agg(F.array_sort(F.collect_set(F.struct("_start", "_stop", "_own"))).alias("_hits"))

    def passages(found: pa.Array) -> pa.Array:
        return pa.array([_runs(x, rules) for x in found.to_pylist()], _PASSAGES)

    passages.__annotations__ = {"found": pa.Array, "return": pa.Array}
    runs = F.arrow_udf(passages, "array<struct<start:int,stop:int,first:boolean>>").asNondeterministic()
    return by_row.select("_row_a", runs("_hits").alias("_passages")).where(F.size("_passages") > 0)


_PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("first", pa.bool_())]))


def _runs(hits: list[dict], rules: ChunkRules) -> list[dict]:
    """Runs of adjacent repeated chunks that are long enough, split where chunks that were first here meet others."""
    out, run = [], []
    for hit in [*hits, None]:
        if run and (hit is None or hit["_start"] != run[-1]["_stop"]):
            start, stop = run[0]["_start"], run[-1]["_stop"]
            if stop - start >= rules.run_bytes and len(run) >= rules.run_chunks:
                for own, part in groupby(run, key=lambda x: x["_own"]):
                    held = list(part)
                    out.append({"start": held[0]["_start"], "stop": held[-1]["_stop"], "first": own})
            run = []
        if hit is not None:
            run.append(hit)
    return out


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "_passages",
                 rules: ChunkRules = ChunkRules()) -> DataFrame:
    """All columns and the repeated passages of each document, an empty array if it has none."""
    found = repeats(docs, id_col, text_col, rules)
    a, b = identity_columns(docs)
    keyed = docs.withColumn("_row_a", F.xxhash64(a, b))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    none = F.array().cast("array<struct<start:int,stop:int,first:boolean>>")
    return keyed.join(found, "_row_a", "left").select(*columns, F.coalesce("_passages", none).alias(into))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: ChunkRules = ChunkRules()) -> DataFrame:
    """The documents, columns unchanged, with every repeated passage cut out except in the first document that has it."""
    def strip(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            kept, at = [], 0
            for span in spans or []:
                if not span["first"]:
                    start, stop = span["start"], span["stop"]
                    # a chunk may end inside a character, which then stays whole beside the cut
                    while start < stop and text[start] & 0xC0 == 0x80:
                        start += 1
                    while start < stop < len(text) and text[stop] & 0xC0 == 0x80:
                        stop -= 1
                    kept.append(text[at:start])
                    at = stop
            out.append(None if text is None else text.decode() if not at else b"".join([*kept, text[at:]]).decode("utf-8", "ignore"))
        return pa.array(out, pa.string())

    strip.__annotations__ = {"texts": pa.Array, "found": pa.Array, "return": pa.Array}
    marked = with_repeats(docs, id_col, text_col, "_passages", rules)
    cleaned = F.arrow_udf(strip, "string")(F.col(f"`{text_col}`").cast("binary"), F.col("_passages"))
    return marked.select(*(cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
