"""The registered queries of this subpackage: each applies one operator to a whole table and derives digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstream.llm import alignment, bpe, chunking, language, lines, mixing, neighbours, periods, quality, scoring, secrets, simhash, warc
from foldstream.llm.common import staged

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ALIGNED_A, ALIGNED_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.plan(table(spark, sf_dir, "documents"))
    return taken.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op2_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    ranks = bpe.read_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_digest(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "_bpe.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs).select("doc_id", "_quality.*")


def _remainder(n: int):
    """crc32 of the document's id, as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = language.train(docs.where(_remainder(4) != 2))
    found = language.identify(docs.select("doc_id", "text"), field)
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"),
                        F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0, 20)


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _remainder(3) != 1)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{secrets.KINDS[kind]}")

    base = F.filter("_spans", lambda x: x["kind"] < 3)
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(secrets.written(base), 256).alias("base_sha256"),
                        secrets.written("_spans").alias("spans"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the bytes under passages that other documents have too, of those the bytes that would be cut, and
    the passages as start:stop in bytes of the UTF-8 text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = chunking.with_repeats(docs)

    def total(spans):
        return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])

    return found.select(
        "doc_id", F.size("_passages").cast("long").alias("n_passages"), total(F.col("_passages")).alias("repeat_bytes"),
        total(F.filter("_passages", lambda x: ~x["first"])).alias("cut_bytes"),
        F.array_join(F.transform("_passages", lambda x: F.concat_ws(":", x["start"], x["stop"])), ",").alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_and_read(table(spark, sf_dir, "pages"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document (by its id's crc32) becomes periodic from some word on; its words are joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(planted, periods.words_of(F.col("text")))
    known = docs.select("doc_id", "text", words.alias("_words"), F.floor(h / 10).alias("_g"))
    n, g = F.size("_words"), F.col("_g")
    known = known.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    known = known.withColumn("_p", F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + g % 8)).cast("int"))
    changed = F.array_join(periods.periodic_from(F.col("_words"), F.col("_a"), F.col("_p")), " ")
    return known.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.with_runs(_with_planted_periods(table(spark, sf_dir, "documents"))).drop("text")
    found = found.withColumn("_best", periods.longest("_periods.runs"))
    written = F.array_join(F.transform("_periods.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    ended = F.when(F.size("_periods.runs") > 0, F.concat(written, F.lit("\n"))).otherwise(F.lit(""))
    exponent = F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long")
    return found.select("doc_id", F.size("_periods.runs").cast("long").alias("n_runs"), "_best.*", exponent.alias("exponent_milli"),
                        F.sha2(ended, 256).alias("runs_sha256"), F.sha2("_periods.collapsed", 256).alias("collapsed_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    a_path, b_path = a_path or public_tokenizers.path(ALIGNED_A), b_path or public_tokenizers.path(ALIGNED_B)
    found = alignment.align(table(spark, sf_dir, "documents"), a_path, b_path)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    # stored once with a number for each row; the digest is all that is needed of the groups
    held = staged(found.withColumn("groups_sha256", digest).drop("groups").withColumn("_row", F.monotonically_increasing_id()), "aligned")
    words = staged(alignment.lexicon(held, alignment.pair_size(b_path)), "lexicon")
    return alignment.scored(held, words).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", lines.line_count("_keep").alias("n_lines"), lines.dropped_count("_keep").alias("n_dropped"),
                        F.sha2(lines.kept_text(F.col("text"), F.col("_keep")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_neighbours": op5_neighbours,
    "op6_scoring": op6_scoring,
    "op7_secrets": op7_secrets,
    "op8_simhash": op8_simhash,
    "op9_chunking": op9_chunking,
    "op10_warc": op10_warc,
    "op11_periods": op11_periods,
    "op12_alignment": op12_alignment,
    "op13_lines": op13_lines,
}
