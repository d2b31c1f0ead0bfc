"""Dense ids in a given order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstream.session import staged

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low bits


def numbered(df: DataFrame, order: Sequence[str], id_col: str,
             n_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Add 0, 1, 2, ... in the order of `order`, with no global window; also the number of rows.

    Range partitioning on all order columns splits a frequent leading value over partitions. The
    sorted rows are written once; one row count per partition then gives the offsets.
    """
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sorted_rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # as Parquet, so that later steps read the columns they need
    ordered = staged(sorted_rows.select("*", F.spark_partition_id().alias("_part"), local.alias("_row")), "numbered")
    parts = ordered.groupBy("_part").count().collect()  # <= n rows

    offsets, total = [], 0
    for row in sorted(parts):
        offsets.append((row["_part"], total))
        total += row["count"]
    # <= n rows, one per partition
    starts = F.broadcast(spark.createDataFrame(offsets, "_part int, _start bigint"))
    with_ids = ordered.join(starts, "_part").select((F.col("_start") + F.col("_row")).alias(id_col), *df.columns)
    return with_ids, total


def dense_ids(df: DataFrame, order: Sequence[str], id_col: str = "eval_id",
              n_partitions: int | None = None) -> DataFrame:
    return numbered(df, order, id_col, n_partitions)[0]
