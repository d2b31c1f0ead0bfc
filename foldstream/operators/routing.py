"""Tagged rows: splitting, guarding, dispatching and joining streams of mixed kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstream.sources.text import PULL, PUSH, require


def split_tagged(df: DataFrame, left: str, tag: str = "kind") -> tuple[DataFrame, DataFrame]:
    """(rows tagged `left`, all other rows)."""
    is_left = F.col(tag).eqNullSafe(F.lit(left))
    return df.where(is_left), df.where(~is_left)


def guard_kinds(df: DataFrame, allowed: list[str], tag: str = "kind") -> DataFrame:
    """The same rows; the job fails on a tag that is not allowed."""
    return df.where(require(F.col(tag).isin(allowed), F.concat(
        F.lit("kind not supported: "), F.coalesce(F.col(tag), F.lit("(missing)")))))


def message_counts(messages: DataFrame) -> DataFrame:
    """Pushes and pulls each key receives; partial counts go before the shuffle."""
    guarded = guard_kinds(messages, [PULL, PUSH])
    return guarded.groupBy("dest").agg(
        F.count_if(F.col("kind") == PULL).alias("pulls"), F.count_if(F.col("kind") == PUSH).alias("pushes"))


def union_outputs(server: DataFrame, worker: DataFrame) -> DataFrame:
    """Bag union of what both sides emit."""
    return server.unionByName(worker, allowMissingColumns=True)


def dispatch_inputs(inputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixed worker input (kind, key, ...) to (requests, pushes of user vectors, item vectors).

    A user vector becomes a push with source -1.
    """
    kinds = ["request", "user", "item"]
    guarded = guard_kinds(inputs, kinds)
    of = {k: guarded.where(F.col("kind") == k) for k in kinds}
    pushes = of["user"].select(F.lit(PUSH).alias("kind"), F.lit(-1).cast("bigint").alias("src"),
                               F.col("key").alias("dest"), "vec", "seq")
    return of["request"], pushes, of["item"].select(F.col("key").alias("id"), "vec", "seq")
