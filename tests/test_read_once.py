from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foldstream import queries
from foldstream.operators import evaluation


def counted(spark, df):
    """The rows, and a count of how often they were computed."""
    seen = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.coalesce(1).mapInPandas(note, df.schema), seen


@pytest.fixture
def lists(spark):
    ranks = [(u, 10 * u + r, r) for u in range(5) for r in range(1, 4)]
    return spark.createDataFrame(ranks, "user_id bigint, item_id bigint, rank int")


def test_lists_are_found_once(spark, lists):
    targets = spark.createDataFrame([(0, 1), (0, 99), (3, 32)], "user_id bigint, item_id bigint")
    ranks, seen = counted(spark, lists)
    found = {r.user_id: r.dcg for r in evaluation.list_gain(ranks, targets).collect()}
    assert seen.value == 15 and [u for u, dcg in found.items() if dcg > 0] and len(found) == 5
    ranks, seen = counted(spark, lists)
    asked = targets.withColumn("eval_id", F.col("item_id"))
    assert evaluation.target_gain(asked, ranks, "ascending").count() == 3 and seen.value == 15


def test_lines_are_joined_once(spark, tmp_path, monkeypatch):
    orders = [(o, o % 3, datetime(1995, 1, 1 + o)) for o in range(8)]
    lines = [(o, 5 * o + n, n, 1, 2.0, 3.0) for o in range(8) for n in range(3)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_suppkey bigint, l_quantity double, l_extendedprice double"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    arrive, read = queries._arrive, []

    def noted(spark, pieces, writer):
        read.extend(f for p in pieces for f in p.inputFiles())
        return arrive(spark, pieces, writer)

    monkeypatch.setattr(queries, "_arrive", noted)
    found = queries.dense_ids_stream(spark, str(tmp_path)).collect()
    assert sorted(r.eval_id for r in found) == list(range(24))
    assert read and not [f for f in read if "lineitem.parquet" in f or "orders.parquet" in f]
