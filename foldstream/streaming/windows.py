"""Windows and joins on streams. Watermarks are there to bound state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldstream.operators.evaluation import NO_ITEM, NO_TS, slot_report


def count_windows(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, window, total) each time a key has received `n` more rows; keeps fewer than n rows."""

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, held = state.get if state.exists else (0, [])
        window, held = int(window), [float(v) for v in held]
        for batch in batches:
            values = held + [float(v) for v in batch[value]]
            full = len(values) // n
            yield pd.DataFrame({
                key: [group[0]] * full,
                "window": range(window, window + full),
                "total": [sum(values[i * n:(i + 1) * n]) for i in range(full)],
            })
            window, held = window + full, values[full * n:]
        state.update((window, held))

    return rows.groupBy(key).applyInPandasWithState(
        update, f"{key} bigint, window bigint, total double", "window bigint, held array<double>",
        "append", GroupStateTimeout.NoTimeout)


def slot_sessions(results: DataFrame, slot_seconds: int = 86400, gap: str = "60 seconds", delay: str = "60 seconds") -> DataFrame:
    """Results (ndcg, ts) to (time_slot, ndcg, n), once per burst of arrivals of a slot.

    Arrival is processing time: a slot idle for longer than `gap` reports again when more comes.
    """
    arrived = results.withColumn("arrival", F.current_timestamp()).withWatermark("arrival", delay)
    slot = F.call_function("div", F.col("ts"), F.lit(slot_seconds)).alias("time_slot")
    return (arrived.groupBy(slot, F.session_window("arrival", gap).alias("session"))
            .agg(F.avg("ndcg").alias("ndcg"), F.count(F.lit(1)).alias("n"))
            .select("time_slot", "ndcg", "n"))


def sessions_stream(rows: DataFrame, key: str, time: str, gap_seconds: int, value: str, delay: str = "0 seconds") -> DataFrame:
    """`session_by_key` on a stream, in append mode: (key, start_us, end_us, n, total) once the watermark has passed a session.

    Rows at most `gap_seconds` apart belong together. A key that goes on later has a new session, with a row of its own.
    """
    at = F.unix_micros(F.col("_time"))
    stamped = rows.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", delay)
    # a session window ends before a row exactly `gap` later, which still belongs
    gap = F.session_window("_time", f"{gap_seconds} seconds 1 microseconds")
    found = stamped.groupBy(key, gap).agg(F.min(at).alias("start_us"), F.max(at).alias("end_us"),
                                          F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(key, "start_us", "end_us", "n", "total")


def slot_totals(results: DataFrame, slot_seconds: int = 86400) -> DataFrame:
    """The report over everything seen so far, for complete or update mode."""
    return slot_report(results, slot_seconds)


def correlate_requests_stream(answers: DataFrame, requests: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Stream form of `correlate_requests`.

    answers: (eval_id, answered timestamp, ...); requests: (eval_id, item_id, ts, asked timestamp).
    A request is forgotten `within` that time; an answer without one then gets -1 and -1.
    """
    a = answers.withWatermark("answered", within)
    r = requests.select(F.col("eval_id").alias("request_id"), "item_id", "ts", "asked").withWatermark("asked", within)
    gap = F.expr(f"asked >= answered - interval {within} and asked <= answered")
    joined = a.join(r, (F.col("eval_id") == F.col("request_id")) & gap, "leftOuter")
    return joined.drop("request_id", "asked").withColumns(
        {"item_id": F.coalesce("item_id", F.lit(NO_ITEM)), "ts": F.coalesce("ts", F.lit(NO_TS))})


def latency_stream(entered: DataFrame, left: DataFrame, within: str = "10 minutes") -> DataFrame:
    """(eval_id, latency in seconds) of events that leave within the time after they enter."""
    a = entered.select("eval_id", "entered").withWatermark("entered", within)
    b = left.select(F.col("eval_id").alias("out_id"), "left").withWatermark("left", within)
    gap = F.expr(f"left >= entered and left <= entered + interval {within}")
    joined = a.join(b, (F.col("eval_id") == F.col("out_id")) & gap)
    return joined.select("eval_id", (F.col("left").cast("double") - F.col("entered").cast("double")).alias("latency"))
