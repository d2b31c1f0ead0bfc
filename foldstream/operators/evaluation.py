"""From scored lists to a metric per time slot."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstream.functions.metrics import discount, ideal_dcg, ndcg_ratio, reciprocal_log_gain
from foldstream.operators.lookup import lookup_join
from foldstream.operators.retrieval import ranked
from foldstream.operators.segments import ROWS_PER_SEGMENT, SEGMENT, row_numbers, running_by_key, with_segment
from foldstream.session import staged

# Fixed values of an evaluation whose request was not found.
NO_ITEM = -1
NO_TS = -1


# --- requests and answers -------------------------------------------------------------------


def correlate_requests(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers (eval_id, ...) with their request's item_id and ts, or -1 and -1 without one.

    Evaluation ids are unique on both sides, so no key of this join is hot.
    """
    found = answers.join(requests.select("eval_id", "item_id", "ts"), "eval_id", "left")
    return found.withColumns({"item_id": F.coalesce("item_id", F.lit(NO_ITEM)), "ts": F.coalesce("ts", F.lit(NO_TS))})


Callback = Callable[[dict, tuple], list[tuple]]


def co_process(first: DataFrame, second: DataFrame, key: str, seq: str, on_first: Callback, on_second: Callback,
               schema: str, partitions: int | None = None) -> DataFrame:
    """Two inputs through one pair of callbacks with state per key.

    `on_first(state, row)` and `on_second(state, row)` see a key's rows of both inputs in `seq` order
    and return output rows; `state` is a dict of their own. Rows stream through sorted partitions:
    a key's rows are never held together. All rows of one key go through one task, because order
    matters to the callbacks; use it on keys that are bounded, such as evaluation ids.
    """
    left, right = first.columns, second.columns
    tagged = (
        first.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"), F.struct(*left).alias("_a"))
        .unionByName(second.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"), F.struct(*right).alias("_b")),
                     allowMissingColumns=True))
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for batch in batches:
            out = []
            for k, a, b in zip(batch["_key"], batch["_a"], batch["_b"]):
                if k != current:
                    current, state = k, {}
                out.extend(on_first(state, a) if a is not None else on_second(state, b))
            yield pd.DataFrame(out, columns=names)

    spread = tagged.repartition(partitions, "_key") if partitions else tagged.repartition("_key")
    return spread.sortWithinPartitions("_key", "_seq").mapInPandas(run, schema)


# --- merging partial evaluations ------------------------------------------------------------


def merge_evaluations(evaluations: DataFrame, k: int, distinct: bool = False) -> DataFrame:
    """Partial evaluations of one request to (eval_id, target_id, ts, rank, item_id, score).

    evaluations: (eval_id, item_id, ts, topk array<struct<item_id, score>>), one row per shard. The
    target and time are the greatest of the parts, because parts without the request say -1.
    """
    heads = evaluations.groupBy("eval_id").agg(F.max("item_id").alias("target_id"), F.max("ts").alias("ts"))
    entries = evaluations.select("eval_id", F.explode("topk").alias("p")).select("eval_id", "p.item_id", "p.score")
    if distinct:
        entries = entries.dropDuplicates(["eval_id", "item_id", "score"])
    # a request has at most shards * workerK entries
    return heads.join(ranked(entries, k, ["eval_id"]), "eval_id", "left")


def recommendations(merged: DataFrame, order: str = "descending") -> DataFrame:
    """Merged rows to one row per request: (target_id, topk array<bigint>, eval_id, ts)."""
    if order not in ("ascending", "descending"):
        raise ValueError(f"order: {order}")
    place = F.col("rank") if order == "descending" else -F.col("rank")
    entry = F.when(F.col("rank").isNotNull(), F.struct(place.alias("at"), "item_id"))
    packed = merged.groupBy("eval_id", "target_id", "ts").agg(F.sort_array(F.collect_list(entry)).alias("l"))
    return packed.select("target_id", F.transform("l", lambda x: x["item_id"]).alias("topk"), "eval_id", "ts")


def target_gain(requests: DataFrame, ranks: DataFrame, order: str = "descending") -> DataFrame:
    """Single-target nDCG of each request (user_id, item_id, ts and any eval_id) in its user's list.

    ranks: (user_id, item_id, rank), k rows per user. Only the target's rank is joined, so lists are
    not copied to the requests. "ascending" counts positions from the worst item of the list.
    """
    place = F.col("rank")
    if order == "ascending":
        # lists are dear to find: they are gone through once
        ranks = ranks.withColumn("length", F.count(F.lit(1)).over(W.partitionBy("user_id")))
        place = F.col("length") - F.col("rank") + 1
    elif order != "descending":
        raise ValueError(f"order: {order}")
    kept = [c for c in ("eval_id", "ts") if c in requests.columns]
    asked = requests.select(*kept, "user_id", "item_id")  # a request is shuffled: no more than is needed
    found = asked.join(ranks.select("user_id", "item_id", place.alias("position")), ["user_id", "item_id"], "left")
    return found.select(*kept, reciprocal_log_gain(F.col("position")).alias("ndcg"))


# --- many targets ---------------------------------------------------------------------------


def list_gain(ranks: DataFrame, targets: DataFrame, by: str = "user_id") -> DataFrame:
    """(by, dcg, idcg, ndcg) of ranked lists against sets of targets, both in long form.

    ranks: (by, item_id, rank); targets: (by, item_id), distinct. A user's targets may be many and
    are never gathered: hits are a semi join, the ideal needs only their number.
    """
    ranks = staged(ranks, "ranks")  # read twice, and dear to find
    hits = ranks.join(targets.select(by, "item_id"), [by, "item_id"], "left_semi")
    gains = hits.groupBy(by).agg(F.sum(discount(F.col("rank"))).alias("dcg"))
    sizes = ranks.groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("k"))
    wanted = targets.groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("wanted"))
    joined = sizes.join(wanted, by, "left").join(gains, by, "left")
    gain = F.coalesce("dcg", F.lit(0.0))
    ideal = ideal_dcg(F.coalesce("wanted", F.lit(0)), F.col("k"))
    return joined.select(by, gain.alias("dcg"), ideal.alias("idcg"), ndcg_ratio(gain, ideal).alias("ndcg"))


# --- slots and windows ----------------------------------------------------------------------


def time_slot(ts: Column, length: int = 86400) -> Column:
    """Slot number; integer division truncates toward zero."""
    return F.call_function("div", ts, F.lit(length))


def slot_report(results: DataFrame, length: int = 86400) -> DataFrame:
    """Results (ndcg, ts) to (time_slot, ndcg, n): the average and count of each slot."""
    return results.groupBy(time_slot(F.col("ts"), length).alias("time_slot")).agg(
        F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("n"))


def count_window(df: DataFrame, keys: Sequence[str], order: str, n: int, aggs: Sequence[Column],
                 rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Tumbling windows of `n` rows per key: (keys..., window, aggs...).

    A window that does not fill up is not emitted.
    """
    numbered = row_numbers(df, keys, order, "_rn", rows_per_segment)
    window = F.floor((F.col("_rn") - 1) / F.lit(n)).alias("window")
    filled = numbered.groupBy(*keys, window).agg(*aggs, F.count(F.lit(1)).alias("_n"))
    return filled.where(F.col("_n") == n).drop("_n")


def session_by_key(df: DataFrame, key: str, arrival_us: str, gap_seconds: int, value: str,
                   rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Sessions per key: rows at most `gap_seconds` apart. (key, start_us, end_us, n, total).

    `arrival_us` is the arrival time in microseconds. Sessions are found inside segments of bounded
    size; only the first and last session of each segment can continue in a neighbour, and only
    those are merged across segments.
    """
    gap = gap_seconds * 1_000_000
    cut, _ = with_segment(df.select(key, arrival_us, value), arrival_us, rows_per_segment)
    inside = W.partitionBy(key, SEGMENT).orderBy(arrival_us)
    opens = F.when(F.col(arrival_us) - F.lag(arrival_us).over(inside) <= gap, 0).otherwise(1)
    numbered = cut.withColumn("_opens", opens).withColumn(
        "_s", F.sum("_opens").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    sessions = numbered.groupBy(key, SEGMENT, "_s").agg(
        F.min(arrival_us).alias("start_us"), F.max(arrival_us).alias("end_us"),
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))

    ends = W.partitionBy(key, SEGMENT)
    marked = sessions.withColumn("_edge", (F.col("_s") == 1) | (F.col("_s") == F.max("_s").over(ends)))
    out = [key, "start_us", "end_us", "n", "total"]
    whole = marked.where(~F.col("_edge")).select(*out)
    # at most two rows per key and segment
    along = W.partitionBy(key).orderBy("start_us")
    breaks = F.when(F.col("start_us") - F.lag("end_us").over(along) <= gap, 0).otherwise(1)
    merged = (
        marked.where(F.col("_edge")).withColumn("_breaks", breaks)
        .withColumn("_g", F.sum("_breaks").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy(key, "_g")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
             F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    return whole.unionByName(merged.select(*out))


# --- latency --------------------------------------------------------------------------------


def latency_stats(entered: DataFrame, left: DataFrame, group: str, percents: Sequence[int] = (50, 95, 99),
                  rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Latency per group: (group, n, mean, lo, hi, p50, ...).

    entered: (eval_id, group, ts_in), unique on eval_id; left: (eval_id, ts_out). Percentiles are
    exact (the least value with that share of rows at or below it) and come from counts per
    distinct latency, so a group's rows are never gathered; counts run up over segments of bounded size.
    """
    both = lookup_join(left.select("eval_id", "ts_out"), entered.select("eval_id", group, "ts_in"), "eval_id", "inner")
    counts = both.groupBy(group, (F.col("ts_out") - F.col("ts_in")).alias("latency")).agg(F.count(F.lit(1)).alias("n"))
    return latency_report(counts, group, percents, rows_per_segment)


def latency_report(counts: DataFrame, group: str, percents: Sequence[int] = (50, 95, 99),
                   rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """The same from (group, latency, n), one row per group and latency."""
    counts = staged(counts, "latencies")
    totals = counts.groupBy(F.col(group).alias("_group")).agg(F.sum("n").alias("all"))
    share = running_by_key(counts, [group], "latency", {"upto": ("sum", F.col("n"))}, rows_per_segment)
    share = share.join(totals, F.col(group).eqNullSafe(F.col("_group")))
    return share.groupBy(group).agg(
        F.sum("n").alias("n"), (F.sum(F.col("latency") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("latency").alias("lo"), F.max("latency").alias("hi"),
        *(F.min(F.when(F.col("upto") * 100 >= F.col("all") * p, F.col("latency"))).alias(f"p{p}") for p in percents))
