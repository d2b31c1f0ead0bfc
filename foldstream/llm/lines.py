"""Line dedup with DataFrame functions only: range-partitioned hashes, first occurrences, keep bitmaps.

A line's key is the line without the spaces at its ends, A-Z in lower case. 128 bits of hash stand for it. Lines are
written once as (hash, document, position). They are range-partitioned by (hash, document), so a key that stands in
very many documents is spread over many tasks, and sorted by position below that: the first row of each (hash,
document) is the key's first occurrence there, and it is taken while the rows stream by. Per key, the number of documents
and the first of all occurrences are aggregates of those, combined before they are shuffled.

What comes back per document is no text but its keep bitmap, run-length coded: the lengths of its stretches of lines,
kept and dropped in turn, the first kept (perhaps 0). `kept_text` applies one to a text.

Defined results: a null or empty text is one empty line. Empty keys are never counted and their lines stay. Rows with one id
count as one document for a key, each with a bitmap of its own; a null id is an id of its own, the least. Other columns
play no part. An empty table stays empty.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstream.llm.common import small_or_not, staged

BLANKS = " \t\n\x0b\x0c\r"
LEAST_DOCS = 10
LEAST_CHARS = 1
#: Rows of a range partition: (hash, document, position), some 40 bytes each.
ROWS_PER_RANGE = 2_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["_h1", "_h2"]
_ROW = ["_row_a", "_row_b"]


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits over a row's id and text: rows that share them get the same bitmap anyway."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(id_, text, text.isNull()).alias("_row_a"), F.xxhash64(F.lit(1), text, id_, id_.isNull()).alias("_row_b")]


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keys(text: Column) -> Column:
    # A-Z alone change, so the text may be lowered before it is split
    return F.transform(_split(F.translate(text, _UPPER, _LOWER)), lambda line: F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(_h1, _h2, _doc, _row_a, _row_b, _pos) of every line whose key counts."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_doc"), *_row_key(id_col, text_col), F.posexplode(_keys(F.col(f"`{text_col}`"))).alias("_pos", "_key"))
    long_enough = F.length("_key") >= max(least_chars, 1)
    return rows.where(long_enough).select(F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2"), "_doc", *_ROW, "_pos")


def first_occurrences(lines: DataFrame, rows: int | None = None) -> DataFrame:
    """The first line of each key in each document: _h1, _h2, _doc, _pos."""
    n = lines.count() if rows is None else rows
    least = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.select(*_KEY, "_doc", "_pos").repartitionByRange(max(least, ceil(n / ROWS_PER_RANGE)), *_KEY, "_doc")
    # the range partitioning serves the window; only the sort below it is added
    here = W.partitionBy(*_KEY, "_doc").orderBy("_pos")
    return ranged.withColumn("_nth", F.row_number().over(here)).where("_nth = 1").drop("_nth")


def key_counts(firsts: DataFrame) -> DataFrame:
    """Per key the number of documents that hold it and where it stands first, by document and position."""
    return firsts.groupBy(*_KEY).agg(F.count("*").alias("_docs"), F.min(F.struct("_doc", "_pos")).alias("_first"))


def _bitmap(dropped: str, n_lines: str) -> Column:
    """Run lengths, kept and dropped in turn, from the ascending positions of dropped lines.

    Only a stored column and lambda variables stand inside the lambdas, so the cost is linear in the positions.
    """
    at = F.col(dropped)
    begins = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    after = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1))
    runs = F.arrays_zip(after.alias("free"), begins.alias("begin"), ends.alias("end"))
    n = F.col(n_lines)
    return F.flatten(F.transform(runs, lambda r: F.when(r["begin"].isNull(), F.array(n - r["free"])).otherwise(
        F.array(r["begin"] - r["free"], r["end"] - r["begin"] + 1))))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS,
                 least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """One row for each different (id, text) that loses lines: _row_a, _row_b and `_gone`, the ascending positions lost.

    A key that `least_docs` documents or more hold loses all its lines; with `keep_first` the first one of all stays.
    """
    lines = staged(line_hashes(docs, id_col, text_col, least_chars), "lines")
    counts = key_counts(first_occurrences(lines)).where(F.col("_docs") >= least_docs)
    counts = staged(counts.select(*_KEY, F.col("_first._doc").alias("_in"), F.col("_first._pos").alias("_at")), "frequent-lines")
    hit = lines.join(small_or_not(counts), _KEY)
    if keep_first:
        hit = hit.where(~(F.col("_doc").eqNullSafe(F.col("_in")) & (F.col("_pos") == F.col("_at"))))
    # positions of one text: repeated rows add nothing to the set
    return hit.groupBy(*_ROW).agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "_keep",
                 least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """All columns and the keep bitmap of each row, as an array of run lengths."""
    gone = staged(keep_bitmaps(docs, id_col, text_col, least_docs, least_chars, keep_first), "bitmaps")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    n_lines = F.size(_split(F.col(f"`{text_col}`"))).alias("_n_lines")
    # the number of lines is read in several places, so it is a column of its own
    joined = docs.select(*columns, *_row_key(id_col, text_col), n_lines).join(small_or_not(gone), _ROW, "left")
    bitmap = F.when(F.col("_gone").isNull(), F.array("_n_lines")).otherwise(_bitmap("_gone", "_n_lines"))
    return joined.select(*columns, bitmap.alias(into))


def line_count(bitmap: Column | str) -> Column:
    return F.aggregate(bitmap, F.lit(0).cast("long"), lambda s, x: s + x)


def dropped_count(bitmap: Column | str) -> Column:
    return line_count(F.filter(bitmap, lambda x, i: i % 2 == 1))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The kept lines joined by newlines; a null text is one empty line."""
    keep = F.flatten(F.transform(bitmap, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.filter(F.arrays_zip(_split(text).alias("line"), keep.alias("keep")), lambda x: x["keep"])
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.size(bitmap) == 1, whole).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS,
                        least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """The documents, columns unchanged, without the lines that the bitmaps drop; null texts stay null."""
    marked = with_bitmaps(docs, id_col, text_col, "_keep", least_docs, least_chars, keep_first)
    text = F.col(f"`{text_col}`")
    cleaned = F.when(text.isNotNull(), kept_text(text, F.col("_keep")))
    return marked.select(*(cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
