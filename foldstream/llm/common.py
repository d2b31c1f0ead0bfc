"""Small helpers shared by the operators on text tables."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstream.session import scratch_path

#: What separates words: space, and the five controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many rows of a few numbers each may be broadcast.
BROADCAST_ROWS = 200_000
TEXTS_AT_ONCE = 512
#: Bytes a writer holds back for a row group, and rows of an Arrow batch of texts (see `small_batches`).
ROW_GROUP_BYTES, ROWS_A_BATCH = 32 << 20, 512


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder: later steps reread them and never recompute them."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS_A_BATCH) -> Iterator[None]:
    """What is executed inside hands rows to Python so many at a time: with texts in them, batches of Spark's usual
    10,000 rows take hundreds of MB outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    parts = F.size(F.split(text, SPACES, -1)).cast("long")
    edges = text.rlike(r"^[\x20\x09-\x0D]").cast("long") + text.rlike(r"[\x20\x09-\x0D]\z").cast("long")
    # a text of spaces only splits into two empty parts, an empty one into one
    return F.coalesce(F.when(text.rlike(WORD), parts - edges), F.lit(0).cast("long"))


def small_or_not(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marked for broadcast if it is counted to be small; otherwise Spark shuffles it."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _held() -> dict[Hashable, Any]:
    """What this process keeps from task to task. Functions come with each task anew, so their own module can't keep it."""
    name = "_foldstream_worker_tables"
    if name not in sys.modules:
        sys.modules[name] = ModuleType(name)
        sys.modules[name].tables = {}
    return sys.modules[name].tables


def release_tables() -> None:
    """Give the memory of kept tables back to the system."""
    held = _held()
    if not held:
        return
    held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def worker_tables(key: Hashable, make: Callable[[], Any]) -> Any:
    """Tables that are costly to build, kept in a worker process: those of one key at a time."""
    held = _held()
    if key not in held:
        release_tables()
        held[key] = make()
    return held[key]


def text_udf(fn: Callable[[list[bytes]], Iterable], returns: str, arrow_type: pa.DataType, keeps_tables: bool = False):
    """Column function over a text column cast to binary.

    `fn` gets a list of texts (null as an empty text), some at a time so that few are held twice, and gives one value
    each. Marked as non-deterministic so that Spark never evaluates it twice for one row. Spark hands a worker process from
    job to job: unless `fn` itself uses `worker_tables`, what an operator before kept there goes first.
    """
    def run(texts: pa.Array) -> pa.Array:
        if not keeps_tables:
            release_tables()
        done = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            done += fn([b or b"" for b in texts.slice(at, TEXTS_AT_ONCE).to_pylist()])
        return pa.array(done, type=arrow_type)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    made = F.arrow_udf(run, returns).asNondeterministic()
    return lambda text: made(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def identity_columns(df: DataFrame) -> list[Column]:
    """Two hashes, 96 bits, over all columns of a row: equal rows and only those share them."""
    cols = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    nulls = [c.isNull() for c in cols]
    return [F.xxhash64(*cols, *nulls).alias("_row_a"), F.hash(*nulls, *cols).alias("_row_b")]


def apply_copies(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of `df` as often as `decisions` says.

    `decisions` has one row for each different row of `df` that stays: _row_a, _row_b (see
    `identity_columns`), _rows (how often the row occurs in `df`), _copies (how often it shall occur,
    over 0). Rows and decisions, both one for each row, meet in a shuffle. Rows that occur once are repeated in place; only
    repeated rows are brought together once more.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.select("*", *identity_columns(df)).join(decisions, ["_row_a", "_row_b"])
    single = keyed.where("_rows = 1")
    many = keyed.where("_rows > 1").dropDuplicates(["_row_a", "_row_b"])
    either = single if decisions.where("_rows > 1").isEmpty() else single.unionByName(many)
    return either.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*columns)
