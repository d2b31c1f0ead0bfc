"""Running values per key when one key may hold a large part of all rows.

A plain window puts all rows of a key in one task. Here the order column is cut at quantiles into
segments of bounded size, so the unit of work is (key, segment). Segment totals are small; their
running values are carried into the segments.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_SEGMENT = 5_000_000

SEGMENT = "_segment"
_OPS = {"sum": F.sum, "min": F.min, "max": F.max}


def with_segment(df: DataFrame, order: str, rows_per_segment: int = ROWS_PER_SEGMENT) -> tuple[DataFrame, int]:
    """Add an int segment that never decreases in `order` (a numeric column)."""
    n = ceil(df.count() / rows_per_segment)
    if n <= 1:
        return df.withColumn(SEGMENT, F.lit(0)), 1
    inner = df.approxQuantile(order, [i / n for i in range(1, n)], 1.0 / (4 * n))
    splits = [-inf, *sorted(set(inner)), inf]
    cut = Bucketizer(splits=splits, inputCol=order, outputCol=SEGMENT).transform(df)
    return cut.withColumn(SEGMENT, F.col(SEGMENT).cast("int")), len(splits) - 1


def _combine(op: str, carried: Column, local: Column) -> Column:
    if op == "sum":
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    return F.least(carried, local) if op == "min" else F.greatest(carried, local)


def running_by_key(df: DataFrame, keys: Sequence[str], order: str,
                   values: dict[str, tuple[str, Column]],
                   rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Add, per key and in `order`, the running value (this row included) of each expression.

    `values` maps an output name to (operation, expression), operation one of sum, min, max.
    `order` should be unique within a key. Rows with a null key are one group, as in any window.
    """
    keys = list(keys)
    cut, n = with_segment(df, order, rows_per_segment)
    if n == 1:
        upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select("*", *(_OPS[op](e).over(upto).alias(name) for name, (op, e) in values.items()))

    upto = W.partitionBy(*keys, SEGMENT).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = cut.select("*", *(_OPS[op](e).over(upto).alias(name) for name, (op, e) in values.items()))
    totals = cut.groupBy(*keys, SEGMENT).agg(*(_OPS[op](e).alias(f"_t_{name}") for name, (op, e) in values.items()))
    before = W.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, SEGMENT, *(
        _OPS[op](F.col(f"_t_{name}")).over(before).alias(f"_c_{name}") for name, (op, _) in values.items()))
    same = reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, SEGMENT]])
    joined = local.alias("l").join(carried.alias("c"), same, "left")
    kept = [F.col(f"l.{c}") for c in df.columns]
    return joined.select(*kept, *(
        _combine(op, F.col(f"_c_{name}"), F.col(f"l.{name}")).alias(name) for name, (op, _) in values.items()))


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, name: str = "rn",
                rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """1-based position of each row within its key."""
    return running_by_key(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, rows_per_segment)
