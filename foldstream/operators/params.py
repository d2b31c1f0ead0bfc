"""Keyed parameter tables (id, vec) and the messages that read and change them.

A message table has (kind, src, dest, vec, seq): `dest` is the parameter key, `seq` the arrival
order. An initialiser is a function from a key column to a vector column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstream.functions.vectors import no_nan
from foldstream.operators.lookup import lookup_join
from foldstream.operators.segments import ROWS_PER_SEGMENT, SEGMENT, running_by_key, with_segment
from foldstream.sources.text import PULL, PUSH

Init = Callable[[Column], Column]


def _checked(vec: Column, dim: int) -> Column:
    wrong = F.concat(F.lit(f"vector length is not {dim}: "), F.size(vec).cast("string"))
    return F.when(vec.isNull() | (F.size(vec) == dim), vec).otherwise(F.raise_error(wrong).cast("array<double>"))


def vector_sum(df: DataFrame, key: str, dim: int, vec: str = "vec", carry: str | None = None) -> DataFrame:
    """Element-wise sum per key, as (id, vec), with the one value of a column `carry` that is not null.

    One sum per component keeps one row per vector and lets the partial aggregate shrink a hot key
    before the shuffle.
    """
    more = [carry] if carry else []
    checked = df.select(F.col(key).alias("id"), _checked(F.col(vec), dim).alias("v"), *more)
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dim)]
    packed = F.array(*(F.col(f"s{i}") for i in range(dim)))
    return checked.groupBy("id").agg(*sums, *(F.max(c).alias(c) for c in more)).select("id", no_nan(packed).alias("vec"), *more)


def vector_sum_any(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """The same for vectors of any (equal per key) length, through rows of components."""
    fields = df.select(F.col(key).alias("id"), F.size(vec).alias("size"), F.posexplode(vec).alias("pos", "val"))
    sums = fields.groupBy("id", "pos").agg(F.sum("val").alias("val"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    # one group holds the components of one summed vector
    packed = sums.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("f"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    vector = F.transform("f", lambda x: x["val"])
    same = F.when(F.col("lo") == F.col("hi"), vector).otherwise(
        F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))
    return packed.select("id", no_nan(same).alias("vec"))


def pull_or_init(pulls: DataFrame, params: DataFrame, init: Init, hot: Sequence = ()) -> DataFrame:
    """Answer each pull (src, dest) with its key's vector, or the initial one if there is none."""
    found = lookup_join(pulls.select("src", "dest"), params.select(F.col("id").alias("dest"), "vec"),
                        "dest", "left", hot)
    # in its own step: inside an initialiser's lambda "dest" could mean the renamed column
    answered = found.withColumn("vec", F.coalesce("vec", init(F.col("dest"))))
    return answered.select(F.col("dest").alias("src"), F.col("src").alias("dest"), "vec")


def append_initialised(params: DataFrame, pulls: DataFrame, init: Init) -> DataFrame:
    """The table after the pulls: keys seen for the first time are kept with their initial vector."""
    new = pulls.select(F.col("dest").alias("id")).distinct().join(params, "id", "left_anti")
    return params.select("id", "vec").unionByName(new.select("id", init(F.col("id")).alias("vec")))


def opened_by_pull(messages: DataFrame) -> DataFrame:
    """(dest, pulled_first): whether the first message of each key was a pull."""
    first = F.min_by("kind", "seq")
    return messages.groupBy("dest").agg((first == PULL).alias("pulled_first"))


def pull_asof(messages: DataFrame, dim: int, init: Init, params: DataFrame | None = None,
              rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """What each pull sees: the start value of its key plus all earlier pushes.

    The start value is the key's row in `params`, else the initial vector when the key's first
    message is a pull, else nothing.
    """
    delta = _checked(F.col("vec"), dim)
    running = {f"v{i}": ("sum", F.coalesce(F.get(delta, F.lit(i)), F.lit(0.0))) for i in range(dim)}
    # struct minimum picks the kind of the earliest message so far, which is the key's first one
    running["first"] = ("min", F.struct("seq", "kind"))
    seen = running_by_key(messages, ["dest"], "seq", running, rows_per_segment).where(F.col("kind") == PULL)
    start = F.when(F.col("first.kind") == PULL, init(F.col("dest")))
    if params is not None:
        seen = lookup_join(seen, params.select(F.col("id").alias("dest"), F.col("vec").alias("known")), "dest")
        start = F.coalesce("known", start)
    value = F.array(*(F.col(f"v{i}") + F.coalesce(F.get(start, F.lit(i)), F.lit(0.0)) for i in range(dim)))
    return seen.withColumn("vec", no_nan(value)).select(
        F.col("dest").alias("src"), F.col("src").alias("dest"), "seq", "vec")


def with_precision(vec: Column, delta_precision: str) -> Column:
    """Deltas as they are, or rounded to single precision first ("float")."""
    if delta_precision == "float":
        return F.transform(vec, lambda x: x.cast("float").cast("double"))
    if delta_precision != "double":
        raise ValueError(f"delta_precision: {delta_precision}")
    return vec


def _batch_totals(messages: DataFrame, dim: int, delta_precision: str) -> DataFrame:
    """(id, first, pushes, s0, s1, ...): kind of the first message, number and sum of pushes."""
    v = _checked(with_precision(F.col("vec"), delta_precision), dim)
    return (
        messages.select("kind", "seq", F.col("dest").alias("id"), v.alias("v"))
        .groupBy("id")
        .agg(F.min_by("kind", "seq").alias("first"), F.count_if(F.col("kind") == PUSH).alias("pushes"),
             *(F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dim)))
    )


def _plus_totals(start: Column, dim: int) -> Column:
    return no_nan(F.array(*(
        F.coalesce(F.get(start, F.lit(i)), F.lit(0.0)) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(dim))))


def push_merge(params: DataFrame, messages: DataFrame, dim: int, init: Init | None = None,
               delta_precision: str = "double") -> DataFrame:
    """The table after a batch of messages: set if absent, else add.

    A key that is absent and pulled first starts from `init`.
    """
    totals = _batch_totals(messages, dim, delta_precision)
    start = F.col("vec")
    if init is not None:
        start = F.coalesce(start, F.when(F.col("first") == PULL, init(F.col("id"))))
    present = start.isNotNull() | (F.col("pushes") > 0)
    return (params.select("id", "vec").join(totals, "id", "full_outer").where(present)
            .select("id", _plus_totals(start, dim).alias("vec")))


def push_delta(params: DataFrame, messages: DataFrame, dim: int, init: Init,
               delta_precision: str = "double") -> DataFrame:
    """What `push_merge` adds to the table, as (id, vec) for changed keys only."""
    totals = _batch_totals(messages, dim, delta_precision)
    known = params.select("id", F.lit(True).alias("known"))
    start = F.when(F.col("known").isNull() & (F.col("first") == PULL), init(F.col("id")))
    return (totals.join(known, "id", "left").where(start.isNotNull() | (F.col("pushes") > 0))
            .select("id", _plus_totals(start, dim).alias("vec")))


def item_set(params: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite vectors: of several updates (id, vec, seq) to an id the last one wins."""
    last = updates.groupBy("id").agg(F.max_by("vec", "seq").alias("new"))
    return params.join(last, "id", "full_outer").select("id", F.coalesce("new", "vec").alias("vec"))


Update = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _fold_runs(update: Update, starts: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """One vector per run of rows, a run beginning where `starts` is true: neighbours are combined until one is left."""
    while True:
        first = np.nonzero(starts)[0]
        place = np.arange(len(starts)) - first[np.cumsum(starts) - 1]
        keep = place % 2 == 0
        left = np.nonzero(keep[:-1] & ~starts[1:])[0]
        if not len(left):
            return vecs
        # components first, so that an update may name them
        vecs[left] = np.asarray(update(vecs[left].T, vecs[left + 1].T)).T
        starts, vecs = starts[keep], vecs[keep]


def _fold_sorted(update: Update) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fold rows that arrive sorted by (id, segment); holds one batch and one vector more."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the run that the next batch may go on with: id, segment, vector
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vec")
            flat, lengths = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths()
            if vectors.null_count or len(lengths.unique()) != 1 or (last is not None and len(last[2]) != lengths[0].as_py()):
                raise ValueError("vectors are null or of different lengths")
            ids, segments = batch.column("id").to_numpy(zero_copy_only=False), batch.column(SEGMENT).to_numpy(zero_copy_only=False)
            vecs = flat.reshape(len(ids), -1).astype(float)
            if last is not None:
                ids, segments = np.concatenate([[last[0]], ids]), np.concatenate([[last[1]], segments])
                vecs = np.concatenate([last[2][None, :], vecs])
            starts = np.concatenate([[True], (ids[1:] != ids[:-1]) | (segments[1:] != segments[:-1])])
            done = _fold_runs(update, starts, vecs)
            ids, segments = ids[starts], segments[starts]
            last = ids[-1], segments[-1], done[-1]
            yield _folded(ids[:-1], segments[:-1], done[:-1])
        if last is not None:
            yield _folded(np.array([last[0]]), np.array([last[1]]), last[2][None, :])

    return fold


def _folded(ids: np.ndarray, segments: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(vecs) + 1, dtype=np.int32) * vecs.shape[1]
    return pa.record_batch({"id": pa.array(ids, pa.int64()), SEGMENT: pa.array(segments, pa.int32()),
                            "vec": pa.ListArray.from_arrays(offsets, vecs.ravel())})


def param_fold(pushes: DataFrame, update: Update, init: Init | None = None,
               rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """State of each key after folding its pushes (dest, vec, seq) in order with `update`.

    `update(old, delta)` must be associative: a key's rows are folded in segments and the partial results are folded
    again, so that a hot key is not left to one task. Inside a task neighbours are combined, many at once: `update` gets
    arrays whose first axis is the vector's, so `old[0]` holds the first components. Vectors are of one length, ids not null. Use
    `streaming.params.keyed_server` for an update that is not. With `init` the fold starts from the
    key's initial vector, without from the first push.
    """
    cut, _ = with_segment(pushes.select(F.col("dest").alias("id"), "vec", "seq"), "seq", rows_per_segment)
    schema = f"id bigint, {SEGMENT} int, vec array<double>"
    fold = _fold_sorted(update)
    part = (cut.repartition("id", SEGMENT).sortWithinPartitions("id", SEGMENT, "seq")
            .mapInArrow(fold, schema))
    if init is not None:
        seeds = pushes.select(F.col("dest").alias("id")).distinct()
        part = part.unionByName(seeds.select("id", F.lit(-1).alias(SEGMENT), init(F.col("id")).alias("vec")))
    # at most one row per key and segment is left
    whole = part.withColumn("_order", F.col(SEGMENT)).withColumn(SEGMENT, F.lit(0))
    return (whole.repartition("id").sortWithinPartitions("id", "_order").drop("_order")
            .mapInArrow(fold, schema).select("id", "vec"))


def sync_answers(messages: DataFrame, dim: int, init: Init,
                 rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Answers of the synchronous server: a pull locks its key until the next push.

    Pulls that find the key locked wait in order. The number of pulls in the system is a walk
    reflected at zero, so running sums and a running minimum give every answer without replaying
    the messages: the j-th pull of a key is answered on arrival when nothing is outstanding, else
    by the push that completes the pull before it. Pulls still waiting have `answered_at` null.
    """
    step = F.when(F.col("kind") == PULL, 1).otherwise(-1).cast("bigint")
    delta = _checked(F.col("vec"), dim)
    walk = running_by_key(messages, ["dest"], "seq", {
        "level": ("sum", step), "pull_no": ("sum", (F.col("kind") == PULL).cast("bigint")),
        "first": ("min", F.struct("seq", "kind")),
        **{f"v{i}": ("sum", F.coalesce(F.get(delta, F.lit(i)), F.lit(0.0))) for i in range(dim)},
    }, rows_per_segment)
    low = running_by_key(walk, ["dest"], "seq", {"low": ("min", F.col("level"))}, rows_per_segment)
    floor = F.least(F.col("low"), F.lit(0))
    outstanding = F.col("level") - floor
    # a push that found nothing outstanding sets a new minimum below zero and completes no pull
    idle_pushes = -floor
    pushes_so_far = F.col("pull_no") - F.col("level")
    start = F.when(F.col("first.kind") == PULL, init(F.col("dest")))
    value = F.array(*(F.col(f"v{i}") + F.coalesce(F.get(start, F.lit(i)), F.lit(0.0)) for i in range(dim)))
    state = low.select("kind", "src", "dest", "seq", "pull_no", outstanding.alias("outstanding"),
                       idle_pushes.alias("idle"), (pushes_so_far - idle_pushes).alias("completed"),
                       no_nan(value).alias("value"))
    pulls = state.where(F.col("kind") == PULL)
    # `completed` also stays the same on idle pushes; the first row with a count is the one that set it
    completing = state.where(F.col("kind") == PUSH).groupBy("dest", F.col("completed").alias("pull_no")).agg(
        F.min("seq").alias("push_seq"), F.min_by("value", "seq").alias("push_value"))
    waiting = pulls.withColumn("previous", F.col("pull_no") - 1).alias("p").join(
        completing.alias("c"),
        (F.col("p.dest") == F.col("c.dest")) & (F.col("p.previous") == F.col("c.pull_no")), "left")
    at_once = F.col("p.outstanding") == 1
    return waiting.select(
        F.col("p.dest").alias("src"), F.col("p.src").alias("dest"), F.col("p.seq").alias("seq"),
        F.when(at_once, F.col("p.seq")).otherwise(F.col("push_seq")).alias("answered_at"),
        F.when(at_once, F.col("p.value")).otherwise(F.col("push_value")).alias("vec"))


def components(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Rows (keys..., pos, val) of a vector column."""
    return df.select(*keys, F.posexplode(vec).alias("pos", "val"))
