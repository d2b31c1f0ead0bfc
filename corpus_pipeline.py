"""From raw documents to token counts, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written as Parquet and read
again. All but the last return the columns of documents. A null, empty or very long text, a null in another column,
repeated rows and extra columns are handled as the operator of each stage documents; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstream.llm import bpe, mixing, quality, secrets, simhash
from foldstream.llm.common import staged

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or repeat long passages of their own go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: the smallest id."""
    return simhash.keep_one_alike(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a placeholder; n_chars follows, if the table has it."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").contains(secrets.PLACEHOLDER), F.length("text").cast(kind))
                            .otherwise(F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents stay, are repeated once, or go."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    found = bpe.encode_digest(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", "source", "_bpe.*")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Suffix arrays, component search and the cube method have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
