"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstream.llm.common import staged


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node hands its neighbours (the larger ones, or the smaller ones and itself) to the least of them.

    The least neighbour is an aggregate, so a node with very many links costs no task all of them.
    """
    if larger:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_of(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root) for every node that has one; root is the least node of its component.

    Alternating large and small stars (Kiveris et al., 2014) until the links no longer change; the number of
    rounds grows with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    now = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    was = state(now)
    while was[0]:
        now = staged(_stars(_stars(now, larger=True), larger=False), "edges")
        is_ = state(now)
        if is_ == was:
            break
        was = is_
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
