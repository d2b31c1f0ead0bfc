"""State machines per key: ordered count windows, merged evaluations, callbacks beside a model.

They run on `transformWithState`. Its state store is RocksDB, on local disk and in the checkpoint, so state is not bounded by
memory; `state_store` names it for the queries that are started inside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foldstream.operators.evaluation import NO_ITEM, NO_TS
from foldstream.sources.text import PULL, PUSH

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _as_rows(df: pd.DataFrame, columns: Sequence[str]) -> Iterator[tuple]:
    """Plain Python values, as the state store takes them."""
    for row in df[list(columns)].itertuples(index=False, name=None):
        yield tuple(x.item() if isinstance(x, np.generic) else x for x in row)


# --- count windows in order ----------------------------------------------------------------------------------


class _OrderedWindows(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then hands them on in order, `n` at a time."""

    def __init__(self, n: int, key: str, order: str, at: str, columns: list[str], schema: str, fold: Callable, out: list[str]):
        self.n, self.key, self.order, self.at = n, key, order, at
        self.columns, self.schema, self.fold, self.out = columns, schema, fold, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)  # not passed by the watermark yet
        self.open = handle.getListState("open", self.schema)  # of the window that is filling up
        self.number = handle.getValueState("number", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for batch in rows for r in _as_rows(batch, self.columns)]
        self.waiting.appendList(new)
        at = self.columns.index(self.at)
        self.handle.registerTimer(min(r[at] for r in new))
        yield from ()  # a frame without rows costs as much as one with rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        at, by = self.columns.index(self.at), self.columns.index(self.order)
        waiting = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in waiting if r[at] <= passed), key=lambda r: r[by])
        later = [r for r in waiting if r[at] > passed]
        if not ready:
            return
        self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(min(r[at] for r in later))
        held = [tuple(r) for r in self.open.get()] + ready
        full = len(held) // self.n
        rest = held[full * self.n:]
        self.open.put(rest) if rest else self.open.clear()
        if not full:
            return
        number = (self.number.get() or (0,))[0]
        # one frame for all windows: it is dear to make
        rows = pd.DataFrame(held[:full * self.n], columns=self.columns)
        out = [(key[0], number + i, *self.fold(rows.iloc[i * self.n:(i + 1) * self.n].reset_index(drop=True))) for i in range(full)]
        self.number.update((number + full,))
        yield pd.DataFrame(out, columns=self.out)


def ordered_count_windows(rows: DataFrame, key: str, order: str, time: str, n: int, fold: Callable[[pd.DataFrame], tuple],
                          returns: str, delay: str = "0 seconds") -> DataFrame:
    """(key, window, ...) each time `n` more rows of a key are complete: `fold` maps a window's rows to the fields `returns`.

    Rows come in any order. They are put in order of `order` once the watermark, `delay` behind the latest `time`, has passed
    them, so the result does not depend on the micro-batches; `order` must not fall as `time` rises by more than the delay.
    `key` and `order` are bigint; a key's rows of a span of the delay wait together, in the state store.
    """
    at = "at_ms"
    stamped = rows.withWatermark(time, delay).withColumn(at, F.unix_millis(F.col(time).cast("timestamp")))
    kept = [f for f in stamped.drop(time).schema.fields if f.name != key]
    columns = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = f"{key} bigint, window bigint, {returns}"
    names = [c.strip().split()[0] for c in out.split(", ")]
    return stamped.groupBy(key).transformWithStateInPandas(
        _OrderedWindows(n, key, order, at, columns, schema, fold, names), out, "append", "eventtime")


# --- evaluations that come in parts ----------------------------------------------------------------------------

MERGED = "eval_id bigint, target_id bigint, ts bigint, rank int, item_id bigint, score double"


#: Evaluations share a state by a hash of their id: a call for each of them would cost far more than the merge.
EVALUATION_BUCKETS = 2048
_OPEN = "ids array<long>, seen array<long>, targets array<long>, times array<long>, sizes array<long>, items array<long>, scores array<double>"


class _MergeParts(StatefulProcessor):
    """Keeps, of each open evaluation of a bucket, the best `k` of what has come so far; after `parts` parts a list is complete."""

    def __init__(self, parts: int, k: int):
        self.parts, self.k = parts, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _OPEN)

    def _read(self) -> dict[int | None, tuple[int, int, int, list[tuple[int, float]]]]:
        held = self.open.get()
        if held is None:
            return {}
        *heads, sizes, items, scores = held
        best, found, at = list(zip(items, scores)), {}, 0
        for e, n, target, ts, size in zip(*heads, sizes, strict=True):
            found[e] = (n, target, ts, best[at:at + size])
            at += size
        return found

    def _write(self, held: dict[int | None, tuple[int, int, int, list[tuple[int, float]]]]) -> None:
        if not held:
            self.open.clear()
            return
        seen, targets, times, lists = (list(x) for x in zip(*held.values()))
        self.open.update((list(held), seen, targets, times, [len(x) for x in lists],
                          [i for x in lists for i, _ in x], [score for x in lists for _, score in x]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._read(), []
        for batch in rows:
            named = (e if there else None for e, there in zip(batch["eval_id"].tolist(), batch["named"].tolist(), strict=True))
            for e, item, at, items, scores in zip(named, batch["item_id"], batch["ts"], batch["items"], batch["scores"], strict=True):
                n, target, ts, best = held.pop(e, (0, NO_ITEM, NO_TS, []))
                n, target, ts = n + 1, max(target, int(item)), max(ts, int(at))
                best = best + [(int(i), float(x)) for i, x in zip(items.tolist(), scores.tolist(), strict=True)]
                best = sorted(best, key=lambda x: (-x[1], x[0]))[:self.k]
                if n == self.parts:
                    out += [(e, target, ts, rank, *x) for rank, x in enumerate(best, 1)]
                else:
                    held[e] = n, target, ts, best
        self._write(held)
        if out:
            found = pd.DataFrame(out, columns=[c.split()[0] for c in MERGED.split(", ")])
            yield found.assign(eval_id=pd.array([row[0] for row in out], dtype="Int64"))


def merge_evaluations_stream(evaluations: DataFrame, parts: int, k: int) -> DataFrame:
    """Partial evaluations (eval_id, item_id, ts, topk) to ranked lists, each as soon as its `parts` parts are there.

    Parts may come in any micro-batch and order; the state of an evaluation is its k best so far and is dropped once the list
    is complete. The target and its time come from the part that knows them. The open evaluations of a bucket are read and
    written together.
    """
    e = F.col("eval_id").cast("bigint")
    bucketed = evaluations.select(
        F.pmod(F.xxhash64(e), F.lit(EVALUATION_BUCKETS)).alias("bucket"), F.coalesce(e, F.lit(0)).alias("eval_id"), e.isNotNull().alias("named"),
        "item_id", "ts", F.col("topk")["item_id"].alias("items"), F.col("topk")["score"].alias("scores"))
    return bucketed.groupBy("bucket").transformWithStateInPandas(_MergeParts(parts, k), MERGED, "append", "none")


# --- callbacks beside a model ----------------------------------------------------------------------------------

OnInput = Callable[[int, dict, list | None], tuple[list | None, list[tuple]]]


class _WithModel(StatefulProcessor):
    def __init__(self, on_input: OnInput, columns: list[str], order: str, out: list[str]):
        self.on_input, self.columns, self.order, self.out = on_input, columns, order, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "vec array<double>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for vec in initialState["vec"]:
            self.model.update(([float(x) for x in vec],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.model.get()
        vec = None if held is None else [float(x) for x in held[0]]
        out = []
        # a micro-batch of one key is put in order; limit the micro-batch at the source
        got = [dict(zip(self.columns, row)) for batch in rows for row in zip(*(batch[c].tolist() for c in self.columns), strict=True)]
        for row in sorted(got, key=lambda row: row[self.order]):
            vec, said = self.on_input(int(key[0]), row, vec)
            out += said
        if vec is not None:
            self.model.update(([float(x) for x in vec],))
        if out:
            yield pd.DataFrame(out, columns=self.out)


def model_callbacks(inputs: DataFrame, key: str, order: str, on_input: OnInput, returns: str,
                    model: DataFrame | None = None) -> DataFrame:
    """`on_input(key, row, vector or None)` gives the key's new vector and rows (of `returns`) to emit, for every input in order.

    model: (id, vec), the vectors that are there before the first input; it becomes the stream's initial state and is not read
    again after a restart.
    """
    names = [c.strip().split()[0] for c in returns.split(", ")]
    start = None if model is None else model.select(F.col("id").cast("bigint").alias(key), "vec").groupBy(key)
    return inputs.groupBy(key).transformWithStateInPandas(
        _WithModel(on_input, inputs.columns, order, names), returns, "append", "none", initialState=start)


def answer_or_add(key: int, row: dict, vec: list | None) -> tuple[list | None, list[tuple]]:
    """Pulls are answered with the vector as it is (nothing, if there is none), pushes are added to it."""
    if row["kind"] == PULL:
        return vec, [] if vec is None else [(key, int(row["src"]), [float(x) for x in vec])]
    if row["kind"] != PUSH:
        raise ValueError(f"message kind not supported: {row['kind']}")
    delta = [float(x) for x in row["vec"]]
    return delta if vec is None else [a + b for a, b in zip(vec, delta, strict=True)], []
