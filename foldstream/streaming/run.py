"""Driving batch functions from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def each_batch(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Writer, not yet started, that hands every micro-batch and its id to `process`."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)


def run_available(writer: DataStreamWriter, timeout: int | None = None) -> StreamingQuery:
    """Process what is there, in as many micro-batches as the source's limit asks for, and stop.

    Without a `timeout` in seconds a backlog may take as long as it needs.
    """
    query = writer.trigger(availableNow=True).start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream still running after {timeout} s")
    return query
