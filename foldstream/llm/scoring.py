"""Document quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

A text becomes a few statistics of its words, lines and characters. Cosines of random projections of them approximate a
Gaussian kernel. Ridge weights solve the normal equations, whose two sums every partition adds up for itself; the
partial sums meet in a tree. Raw scores are calibrated by isotonic regression over a histogram of scores of labelled
documents that the fit did not see, and interpolated between its steps so that order is kept.

All labelled rows take part in the fit; nothing is sampled.

Defined results: null and empty texts have all statistics zero and are scored as such. Repeated rows are scored one by
one. Labels that are null or neither 0 nor 1 are left out, as are labels of unknown documents; a document with several
labels counts once for each. Without labels of both values every score is the mean label, or 0.5 if there is none. Other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstream.llm.common import staged, text_udf

STATISTICS = ["log_words", "word_length", "long_words", "short_words", "types", "top_word", "line_words", "dup_lines", "digits",
              "capitals", "capital_words", "punctuation", "symbols", "symbol_words", "bars", "ends", "spaces", "entropy",
              "beyond_ascii", "repeat_next"]
_DIGITS, _CAPITALS = b"0123456789", bytes(range(65, 91))
_PUNCTUATION, _SYMBOLS = b".,;:!?'\"()-", b"#*$%&|<>@=+^~_/\\{}[]`"


@dataclass(frozen=True)
class Kernel:
    """features: cosines. width: of the Gaussian, in standard deviations of the statistics. ridge: penalty as a share of the
    rows. bins: histogram of raw scores. seed: of the projections."""

    features: int = 192
    width: float = 4.0
    ridge: float = 1e-4
    bins: int = 400
    seed: int = 5


def statistics(text: bytes) -> list[float]:
    """Statistics of a UTF-8 text, in the order of STATISTICS; shares lie between 0 and 1."""
    found = text.split()
    n = len(found)
    if not n:
        return [0.0] * len(STATISTICS)
    size = len(text)
    lengths = [len(w) for w in found]
    of_type = pd.Series(found).value_counts(sort=False).to_numpy()
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda chars: 1 - len(text.translate(None, chars)) / size
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    p = counts[counts > 0] / size
    capitals = sum(map(bytes.isupper, found))
    marked = sum(1 for w in found if len(w.translate(None, _SYMBOLS)) < len(w))
    same = sum(1 for a, b in zip(found, found[1:]) if a == b)
    return [float(np.log1p(n)), min(sum(lengths) / n / 20, 2.0), sum(1 for x in lengths if x > 12) / n,
            sum(1 for x in lengths if x < 4) / n, len(of_type) / n, int(of_type.max()) / n,
            min(float(np.log1p(n / len(lines))) / 8, 2.0), 1 - len(set(lines)) / len(lines), share(_DIGITS), share(_CAPITALS),
            capitals / n, share(_PUNCTUATION), share(_SYMBOLS), marked / n, found.count(b"|") / n,
            sum(1 for x in lines if x.rstrip()[-1:] in b".!?") / len(lines), sum(counts[[9, 10, 11, 12, 13, 32]]) / size,
            float(-(p * np.log2(p)).sum()) / 8, float(counts[128:].sum()) / size, same / n]


def with_statistics(docs: DataFrame, text_col: str = "text", into: str = "_stats") -> DataFrame:
    """All columns and the statistics as an array of doubles. No shuffle."""
    udf = text_udf(lambda texts: [statistics(t) for t in texts], "array<double>", pa.list_(pa.float64()))
    return docs.select("*", udf(F.col(f"`{text_col}`")).alias(into))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


@dataclass
class Model:
    """What scoring needs: a few hundred numbers per feature."""

    mean: np.ndarray
    spread: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None
    constant: float
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.spread) @ self.project + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.cosines(x) @ self.weights, -0.5, 1.5) if self.weights is not None else np.full(len(x), self.constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip(np.interp(raw, *self.steps) if self.steps is not None else raw, 0.0, 1.0)


def _tree_sum(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of arrays `_sum`, one per partition with its number `_part`, 64 at a time, then on the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(size), 0
        for batch in batches:
            part = batch.column("_part")[0].as_py()
            for row in batch.column("_sum"):
                total += row.values.to_numpy(zero_copy_only=False)
        yield pa.record_batch([pa.array([part], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["_part", "_sum"])

    add.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    for level in (64, 64 * 64):
        parts = parts.groupBy(F.floor(F.col("_part") / level).alias("_group")).applyInArrow(add, "_part long, _sum array<double>")
    total = np.zeros(size)
    for row in parts.select("_sum").toLocalIterator():  # a row for every 4,096 partitions
        total += np.array(row["_sum"])
    return total


def _partition_sums(rows: DataFrame, size: int, of_batch) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total += of_batch(_matrix(batch.column("_stats")), batch.column("_label").to_numpy())
                some = True
        if some:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                   pa.array([total], pa.list_(pa.float64()))], names=["_part", "_sum"])

    return _tree_sum(rows.select("_stats", "_label").mapInArrow(run, "_part long, _sum array<double>"), size)


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-decreasing fit with the least weighted squared error."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.empty(0)


def fit(labelled: DataFrame, how: Kernel = Kernel()) -> Model:
    """(_stats, _label 0.0 or 1.0, _key) -> model. A fifth of the rows, by `_key`, is kept for the calibration."""
    rng, n = np.random.default_rng(how.seed), len(STATISTICS)
    project = rng.normal(size=(n, how.features)) / how.width
    phase = rng.uniform(0, 2 * np.pi, how.features)
    held_back = F.pmod(F.xxhash64("_key"), F.lit(5)) == 0

    sums = _partition_sums(labelled, 2 + 2 * n, lambda x, y: np.r_[len(x), y.sum(), x.sum(axis=0), (x * x).sum(axis=0)])
    count, ones = sums[:2]
    mean = sums[2:2 + n] / max(count, 1)
    spread = np.sqrt(np.maximum(sums[2 + n:] / max(count, 1) - mean * mean, 1e-12))
    spread = np.where(spread < 1e-5, 1.0, spread)
    model = Model(mean, spread, project, phase, None, ones / count if count else 0.5)
    if not 0 < ones < count:
        return model

    d = how.features + 1
    upper = np.triu_indices(d)

    def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.cosines(x)
        # the rarer label weighs as much as the other one
        w = np.where(y > 0.5, 0.5 / model.constant, 0.5 / (1 - model.constant))[:, None]
        return np.r_[(z.T @ (z * w))[upper], (z * w).T @ y]

    sums = _partition_sums(labelled.where(~held_back), len(upper[0]) + d, products)
    gram = np.zeros((d, d))
    gram[upper] = sums[:len(upper[0])]
    gram = gram + gram.T - np.diag(np.diag(gram))
    model.weights = np.linalg.solve(gram + how.ridge * max(count, 1) * np.eye(d) / d, sums[len(upper[0]):])

    low, width = -0.5, 2.0 / how.bins

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.minimum(((model.raw(x) - low) / width).astype(int), how.bins - 1)
        return np.r_[np.bincount(at, minlength=how.bins), np.bincount(at, y, how.bins)]

    sums = _partition_sums(labelled.where(held_back), 2 * how.bins, histogram)
    seen, good = sums[:how.bins], sums[how.bins:]
    if seen.sum() and 0 < good.sum() < seen.sum():
        at = np.nonzero(seen)[0]
        level = pool_adjacent(good[at] / seen[at], seen[at])
        middle = low + (at + 0.5) * width
        # order is kept inside a step: raw scores add a hair
        steps = level * 0.98 + 0.02 * np.clip(middle, 0, 1)
        model.steps = (np.r_[-0.5, middle, 1.5], np.r_[0.0, steps, 1.0])
    return model


def score(rows: DataFrame, model: Model, stats_col: str = "_stats", into: str = "score") -> DataFrame:
    """All columns and the score, 0 to 1. No shuffle."""
    def run(stats: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(stats)) if len(stats) else np.empty(0), pa.float64())

    run.__annotations__ = {"stats": pa.Array, "return": pa.Array}
    return rows.select("*", F.arrow_udf(run, "double").asNondeterministic()(F.col(f"`{stats_col}`")).alias(into))


def train_and_score(docs: DataFrame, labels: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality", how: Kernel = Kernel()) -> DataFrame:
    """id_col, held_out, score and predicted of every document; labels come only from rows where `may_train` (over id_col) holds."""
    stats = staged(with_statistics(docs.select(id_col, text_col), text_col).drop(text_col), "statistics")
    known = labels.where(may_train & F.col(f"`{label_col}`").isin(0, 1)).select(
        F.col(f"`{id_col}`").alias("_key"), F.col(f"`{label_col}`").cast("double").alias("_label"))
    labelled = staged(stats.select(F.col(id_col).alias("_key"), "_stats").join(known, "_key"), "labelled")
    found = score(stats, fit(labelled, how))
    return found.select(id_col, F.coalesce(~may_train, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
