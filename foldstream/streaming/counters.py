"""Numbers and counts carried from micro-batch to micro-batch, written by batch id so that a batch may run again."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from foldstream.operators.evaluation import latency_report
from foldstream.operators.ids import numbered
from foldstream.session import read_small, write_small
from foldstream.streaming.run import each_batch


def dense_ids_stream(rows: DataFrame, order: Sequence[str], out: str, checkpoint: str, id_col: str = "eval_id") -> DataStreamWriter:
    """Writer, not yet started, that numbers rows 0, 1, 2, ...: inside a micro-batch in the order of `order`.

    Below `out`, `batch=N` holds the rows and `next/N.json` the first number after them. A batch starts from its
    predecessor's file, so one that runs again gives the same numbers.
    """
    spark = rows.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        first = json.loads(read_small(spark, f"{out}/next/{batch_id - 1}.json"))["next"] if batch_id else 0
        known, n = numbered(batch, order, "_row")
        known.withColumn(id_col, F.col("_row") + first).drop("_row").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        write_small(spark, f"{out}/next/{batch_id}.json", json.dumps({"next": first + n}))

    return each_batch(rows, process, checkpoint)


def latency_counts(entered: DataFrame, left: DataFrame, group: str, out: str, checkpoint: str, within: str) -> DataStreamWriter:
    """Writer, not yet started, of how often each (group, latency in seconds) came up, a file for each micro-batch.

    entered: (eval_id, group, entered timestamp); left: (eval_id, left timestamp). An event that leaves later than `within`
    after it entered is not counted. Counts of different batches add up, so they are all the report needs.
    """
    a = entered.select("eval_id", group, "entered").withWatermark("entered", "0 seconds")
    b = left.select(F.col("eval_id").alias("out_id"), "left").withWatermark("left", "0 seconds")
    gap = F.expr(f"left >= entered and left <= entered + interval {within}")
    took = F.unix_seconds(F.col("left").cast("timestamp")) - F.unix_seconds(F.col("entered").cast("timestamp"))
    both = a.join(b, (F.col("eval_id") == F.col("out_id")) & gap).select(group, took.alias("latency"))

    def process(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy(group, "latency").agg(F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    return each_batch(both, process, checkpoint)


def latency_so_far(spark: SparkSession, out: str, group: str, percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """The report of `latency_stats` over all micro-batches written so far."""
    kept = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return latency_report(kept.groupBy(group, "latency").agg(F.sum("n").alias("n")), group, percents)
