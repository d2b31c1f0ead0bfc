"""Parameter state on streams of messages (kind, src, dest, vec, seq)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldstream.operators.params import Init, _batch_totals, _plus_totals, pull_asof, push_delta
from foldstream.plans.store import ParamTable
from foldstream.session import staged
from foldstream.sources.text import PULL, PUSH
from foldstream.streaming.run import each_batch

ANSWERS = "src bigint, dest bigint, vec array<double>"


def param_state(messages: DataFrame, dim: int, init: Init) -> DataFrame:
    """Current vector of each key as a streaming aggregate (id, vec), for update or complete mode.

    Sums are built before the shuffle, so a hot key sends one row per task and micro-batch.
    """
    start = F.when(F.col("first") == PULL, init(F.col("id")))
    return _batch_totals(messages, dim, "double").select("id", _plus_totals(start, dim).alias("vec"))


def serve_from_table(messages: DataFrame, table: ParamTable, out: str, init: Init, checkpoint: str) -> DataStreamWriter:
    """Answer pulls and apply pushes in arrival order, with the vectors in `table`.

    Each micro-batch is answered by running sums over key segments, so a hot key is split. Answers
    are written below `out`, by batch id.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        wanted = staged(batch.select(F.col("dest").alias("id")).where("id is not null").distinct(), "wanted")
        params = table.read(batch_id, wanted)
        pull_asof(batch, table.dim, init, params).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        table.append(push_delta(params, batch, table.dim, init), batch_id)

    return each_batch(messages, process, checkpoint)


def _plain(vec) -> list[float] | None:
    """State is kept as plain numbers; Arrow hands over numpy ones."""
    return None if vec is None else [float(x) for x in vec]


OnPull = Callable[[int, int, list | None], tuple[list | None, list | None]]
OnPush = Callable[[int, int, list | None, list], tuple[list | None, list | None]]


def keyed_server(messages: DataFrame, on_pull: OnPull, on_push: OnPush) -> DataFrame:
    """Any server logic: answers (src, dest, vec) of callbacks run in arrival order per key.

    `on_pull(key, source, vec)` and `on_push(key, source, vec, delta)` get the key's vector (None
    at first) and return (new vector, answer or None). A key's messages of one micro-batch are
    sorted together, so limit the micro-batch at the source; sums scale better in `param_state`
    or `serve_from_table`.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        vec = _plain(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for kind, src, delta in zip(rows["kind"], rows["src"], rows["vec"]):
            if kind == PUSH:
                vec, answer = on_push(key[0], src, vec, _plain(delta))
            elif kind == PULL:
                vec, answer = on_pull(key[0], src, vec)
            else:
                raise ValueError(f"message kind not supported: {kind}")
            if answer is not None:
                out.append((key[0], src, list(answer)))
        state.update((_plain(vec),))
        yield pd.DataFrame(out, columns=["src", "dest", "vec"])

    return messages.groupBy("dest").applyInPandasWithState(
        update, ANSWERS, "vec array<double>", "append", GroupStateTimeout.NoTimeout)
