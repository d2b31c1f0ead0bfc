"""Mixing sources to target weights by balanced sampling with the cube method.

Every source gets a target in words. A document of a source with ratio r = target / words is taken floor(r) times for
sure and once more with the probability that is left. The cube method rounds those probabilities to 0 or 1: three
undecided documents at a time move along the null space of the two balancing equations (words, documents), by random
steps with mean zero, until one of them is decided. That keeps both totals. It runs in blocks of a bounded number of
documents of one source; at most two documents of a block stay undecided. Those are gathered into blocks again, and so on
up to one block a source. There a dozen documents of all sizes are kept back; with the two that stay undecided they are
the landing problem, whose roundings are compared one by one.

Blocks, orders and random numbers follow from the rows alone, so reruns agree.

Defined results: a null or empty text has size 0; its copies take no words. A null source is a source of its own, the
last one. Of equal rows whole shares are taken for sure and one of them is decided on. Sources without words have the target 0. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstream.llm.common import apply_copies, identity_columns, small_or_not, staged, word_count
from foldstream.operators.ids import numbered

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2.0
#: Documents of a source that one task rounds together.
BLOCK_ROWS = 2_000
#: Documents of a source kept back for the landing, whose 2 ** (LANDING_ROWS + 2) roundings are compared.
LANDING_ROWS = 12
_NEAR = 1e-9


# --- targets ---------------------------------------------------------------------------------------------------


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(_source, size) rows -> _source, _docs, _size, _target.

    Targets share `budget` times all sizes by weight; one stops at `most` times its source's size and the excess is shared
    again by weight. Each round of sharing is one aggregate over the sources.
    """
    sources = sized.groupBy("_source").agg(F.count("*").alias("_docs"), F.sum("_words").alias("_size"))
    sources = staged(numbered(sources.withColumn("_none", F.col("_source").isNull()), ["_none", "_source"], "_at")[0], "sources")
    weight = F.element_at(F.lit(list(weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("_weight", weight).withColumn("_cap", F.col("_size") * F.lit(float(most)))
    total = float(sources.agg(F.sum("_size")).first()[0] or 0) * budget
    level = 0.0  # words for each unit of weight
    while True:
        at_cap = F.col("_cap") <= level * F.col("_weight")
        full, open_, n = sources.agg(
            F.coalesce(F.sum(F.when(at_cap, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at_cap, F.col("_weight"))), F.lit(0.0)), F.count(F.when(at_cap, 1))).first()
        new = max(level, (total - full) / open_) if open_ else level
        if new == level:
            break
        level = new
    target = F.least("_cap", F.lit(level) * F.col("_weight")) if open_ else F.col("_cap")
    return sources.select("_source", "_docs", "_size", target.alias("_target"))


# --- the cube method -------------------------------------------------------------------------------------------


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the probabilities until at most two are undecided; sum(p) and sum(p * size) stay."""
    p = p.astype(float).copy()
    values, sizes = p.tolist(), size.astype(float).tolist()
    draws = iter(())
    held: list[int] = []
    for i, v in enumerate(values):
        if v <= _NEAR or v >= 1 - _NEAR:
            values[i] = round(v)
            continue
        held.append(i)
        while len(held) >= 3:
            a, b, c = held[-3:]
            x, y, z = sizes[a], sizes[b], sizes[c]
            step = (z - y, x - z, y - x)  # orthogonal to (1, 1, 1) and to the sizes
            if step == (0.0, 0.0, 0.0):
                step = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for j, d in zip((a, b, c), step, strict=True):
                if d > 0:
                    up, down = min(up, (1 - values[j]) / d), min(down, values[j] / d)
                elif d < 0:
                    up, down = min(up, -values[j] / d), min(down, (values[j] - 1) / d)
            draw = next(draws, None)
            if draw is None:
                draws = iter(rng.random(4096).tolist())
                draw = next(draws)
            by = up if draw * (up + down) < down else -down
            for j, d in zip((a, b, c), step, strict=True):
                v = values[j] + by * d
                values[j] = 0.0 if v <= _NEAR else 1.0 if v >= 1 - _NEAR else v
            held[-3:] = [j for j in (a, b, c) if 0.0 < values[j] < 1.0]
    return np.array(values)


def reserve(p: np.ndarray, size: np.ndarray, count: int) -> np.ndarray:
    """Undecided documents kept for the landing: their sizes are spread over all sizes."""
    open_ = np.nonzero((p > _NEAR) & (p < 1 - _NEAR))[0]
    by_size = open_[np.argsort(size[open_], kind="stable")]
    at = np.unique(np.linspace(0, len(by_size) - 1, min(count, len(by_size))).astype(int)) if len(by_size) else []
    return np.sort(by_size[at])


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the few that are left: of all roundings the one that is nearest in words and documents together,
    both relative to what one document weighs."""
    left = np.nonzero((p > 0) & (p < 1))[0]
    codes = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    off = codes - p[left]
    words, docs = np.abs(off @ size[left]), np.abs(off.sum(axis=1))
    mean = max(float(size[left].mean()), 1.0) if len(left) else 1.0
    cost = words / mean + 0.1 * docs
    out = p.copy()
    out[left] = codes[int(np.argmin(np.round(cost, 9)))]
    return out


_DECIDED = "_row_a long, _row_b int, _id long, _at_source long, _words long, _p double, _rows long"


def _cube_block(seed: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, block, last = (k.as_py() for k in key)
        t = pa.Table.from_batches(list(batches)).select([c.split()[0] for c in _DECIDED.split(", ")])  # BLOCK_ROWS or so
        # long documents first: those that stay undecided at the end are short, so little has to land
        t = t.sort_by([("_words", "descending"), ("_row_a", "ascending"), ("_row_b", "ascending"), ("_p", "ascending")])
        size = t["_words"].to_numpy()
        rng = np.random.default_rng([seed, source & (2**63 - 1), block])
        p = t["_p"].to_numpy().copy()
        if last:
            kept = reserve(p, size, LANDING_ROWS)
            others = np.delete(np.arange(len(p)), kept)
            p[others] = flight(p[others], size[others], rng)
            p = landing(p, size.astype(float))
        else:
            p = flight(p, size, rng)
        yield from t.set_column(5, "_p", pa.array(p)).to_batches()

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def cube(rows: DataFrame, block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """Rows (_row_a, _row_b, _id, _at_source, _words, _p, _rows) with every _p moved to 0 or 1, balanced within _at_source."""
    done, level = None, 0
    while True:
        counts = rows.groupBy("_at_source").agg(F.count("*").alias("_n")).withColumn(
            "_blocks", F.ceil(F.col("_n") / block_rows).cast("long")).drop("_n")
        counts = small_or_not(staged(counts, "block-counts"))
        blocked = rows.join(counts, "_at_source").withColumn(
            "_block", F.pmod(F.xxhash64("_row_a", F.lit(seed + level)), F.col("_blocks"))).withColumn("_last", F.col("_blocks") == 1)
        fields = [c.split()[0] for c in _DECIDED.split(", ")]
        moved = staged(blocked.select(*fields, "_block", "_last").groupBy("_at_source", "_block", "_last")
                       .applyInArrow(_cube_block(seed + level), _DECIDED), "cube")
        open_ = (F.col("_p") > 0) & (F.col("_p") < 1)
        decided = moved.where(~open_)
        done = decided if done is None else done.unionByName(decided)
        rows, level = moved.where(open_), level + 1
        if rows.isEmpty():
            return done


# --- the mix ---------------------------------------------------------------------------------------------------


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: _row_a, _row_b (its identity), _id, _size, _source, _source_size, _target, _copies."""
    sized = staged(docs.select(*identity_columns(docs), F.col(f"`{id_col}`").cast("long").alias("_id"),
                               F.col(f"`{source_col}`").alias("_source"), word_count(F.col(f"`{text_col}`")).alias("_words")), "sized")
    # the source's number, from its name: the cube needs no order of sources
    targets = staged(source_targets(sized, weights, budget, most).withColumn("_at_source", F.xxhash64("_source", F.col("_source").isNull())), "targets")
    joined = (sized.withColumn("_at_source", F.xxhash64("_source", F.col("_source").isNull()))
              .join(small_or_not(targets.drop("_source")), "_at_source"))
    ratio = F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(F.lit(0.0))
    share = F.greatest(ratio - F.floor(ratio + _NEAR), F.lit(0.0))
    # of equal rows a whole number is taken for sure; what is left of them is one undecided row, so they never fill a block
    units = joined.groupBy("_row_a", "_row_b", "_id", "_at_source", "_words").agg(F.count("*").alias("_rows"), F.first(share).alias("_share"))
    units = staged(units.withColumn("_all", F.col("_share") * F.col("_rows")).withColumn(
        "_p", F.greatest(F.col("_all") - F.floor(F.col("_all") + _NEAR), F.lit(0.0))).drop("_all", "_share"), "units")
    fields = [c.split()[0] for c in _DECIDED.split(", ")]
    rounded = cube(units.where(f"_p > {_NEAR}").select(*fields), block_rows)
    sure = units.where(f"_p <= {_NEAR}").select(*fields).withColumn("_p", F.lit(0.0))
    both = sure.unionByName(rounded).join(small_or_not(targets), "_at_source")
    base = F.floor(ratio + _NEAR).cast("long")
    more = F.floor(share * F.col("_rows") + _NEAR).cast("long") + F.col("_p").cast("long")
    # one row for each of the equal ones, the first of which are taken once more
    each = both.select("*", base.alias("_base"), more.alias("_more"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("_nth"))
    return each.select("_row_a", "_row_b", "_id", F.col("_words").alias("_size"), "_source", F.col("_size").alias("_source_size"), "_target",
                       (F.col("_base") + (F.col("_nth") <= F.col("_more")).cast("long")).alias("_copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """The documents of the mix, columns unchanged, each as often as it was taken."""
    taken = plan(docs, id_col, text_col, source_col, weights, budget, most)
    rows = taken.groupBy("_row_a", "_row_b").agg(F.count("*").alias("_rows"), F.sum("_copies").alias("_copies"))
    return apply_copies(docs, rows.where("_copies > 0"))
