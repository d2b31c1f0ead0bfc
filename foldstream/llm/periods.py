"""Runs: maximal stretches of words that repeat with a period, found with a dictionary of basic factors.

Level by level the dictionary names the factors of length L = 1, 2, 4, ...: two positions share a name if and only if
their next L words agree. Only positions whose factor occurs again are kept, so a text without long repeats has few. At
a level, the occurrences of a factor that follow each other within half its length are an arithmetic progression, whose
difference is the factor's own period; each progression is one group. Every run with a smallest period p, L <= p < 2 L, has a
pair of occurrences p apart in two different groups of one factor, and among those pairs one that starts at an occurrence
and ends at the first of a later group, or starts at the last of an earlier group and ends at an occurrence. Between the two
lie two groups at most, since groups are more than L / 2 apart and p is below 2 L. So each occurrence proposes six
distances at most, however often the factor occurs.

A proposal is a pair of positions and a period; the names of all levels, from the longest to the shortest, give how far
the equality reaches to either side. What is long enough is a run; of equal stretches the least period stays.

Defined results: a null or empty text, and one without words, has no runs and collapses to an empty text. Each text is
judged alone, so repeated rows agree, and other columns play no part. An empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstream.llm.common import SPACES, text_udf

#: Words looked at together; a longer text is looked at alone.
WORDS_AT_ONCE = 200_000
#: Groups of occurrences that a proposal may pass over to reach the next.
GROUPS_AHEAD = 3


@dataclass(frozen=True)
class RunRules:
    """A run has `least` words or more, and `times` times its period or more."""

    least: int = 12
    times: int = 2


def _dictionary(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(L, positions ascending, their names) per level, as long as a factor of length L occurs twice in a text."""
    n = len(words)
    key = doc * (int(words.max(initial=0)) + 1) + words  # words of different texts differ
    at, levels, length = np.arange(n, dtype=np.int32), [], 1
    named = np.empty(n, np.int32)
    while len(at):
        by = np.argsort(key, kind="stable")
        ordered = key[by]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        names = np.cumsum(new, dtype=np.int32) - 1
        often = np.bincount(names) > 1
        name = np.empty(len(at), np.int32)
        name[by] = names
        shared = often[name]
        at, name = at[shared], name[shared]
        if not len(at):
            break
        levels.append((length, at, name))
        # the next level: a factor is its two halves, and the second half must be shared too
        named[:] = -1
        named[at] = name
        inside = at + length < n
        at, name = at[inside], name[inside]
        second = named[at + length]
        both = (second >= 0) & (doc[at] == doc[np.minimum(at + length, n - 1)])
        at, key = at[both], name[both].astype(np.int64) * n + second[both]
        length *= 2
    return levels


def _proposals(length: int, at: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position, period) with length <= period < 2 * length, from the groups of each factor's occurrences."""
    by = np.argsort(name, kind="stable")
    pos, of = at[by].astype(np.int64), name[by]
    new = np.r_[True, (of[1:] != of[:-1]) | (2 * (pos[1:] - pos[:-1]) > length)]
    group = np.cumsum(new) - 1
    first = np.nonzero(new)[0]
    last = np.r_[first[1:], len(pos)] - 1
    starts, periods = [], []
    for ahead in range(1, GROUPS_AHEAD + 1):
        for source, step in ((first, ahead), (last, -ahead)):
            to = group + step
            fits = np.nonzero((to >= 0) & (to < len(first)))[0]
            other = source[to[fits]]
            fits, other = fits[same := of[other] == of[fits]], other[same]
            low = np.minimum(pos[fits], pos[other])
            period = np.abs(pos[other] - pos[fits])
            ok = (period >= length) & (period < 2 * length)
            starts.append(low[ok])
            periods.append(period[ok])
    return np.concatenate(starts), np.concatenate(periods)


def _reach(levels: list, n: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from (low, high) on, and how many in front of them."""
    right, left = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    named = np.full(n + 1, -1, np.int32)  # the last place stands for all positions outside
    for length, at, name in reversed(levels):
        named[:-1] = -1
        named[at] = name
        x, y = named[np.minimum(low + right, n)], named[np.minimum(high + right, n)]
        right += np.where((x >= 0) & (x == y), length, 0)
        x, y = low - left - length, high - left - length
        x, y = named[np.where(x >= 0, x, n)], named[np.where(y >= 0, y, n)]
        left += np.where((x >= 0) & (x == y), length, 0)
    return right, left


def runs_of(words: np.ndarray, doc: np.ndarray, rules: RunRules = RunRules()) -> np.ndarray:
    """Rows (start, length, period), by start, then period, of all runs in the numbered words of several texts.

    doc: the text of each word, ascending. Starts count from the first of all words.
    """
    n, none = len(words), np.empty((0, 3), np.int64)
    levels = _dictionary(words.astype(np.int64), doc.astype(np.int64)) if n else []
    found = [_proposals(*level) for level in levels]
    if not found:
        return none
    pairs = np.unique(np.stack([np.concatenate([f[i] for f in found]) for i in (1, 0)], 1), axis=0)
    if not len(pairs):
        return none
    period, low = pairs[:, 0], pairs[:, 1]
    right, left = _reach(levels, n, low, low + period)
    start, length = low - left, left + right + period
    long_enough = (length >= rules.least) & (length >= rules.times * period)
    out = np.unique(np.stack([start, length, period], 1)[long_enough], axis=0)  # sorted: the least period comes first
    if not len(out):
        return none
    out = out[np.r_[True, (out[1:, :2] != out[:-1, :2]).any(1)]]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND_ARROW = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])
FOUND = "struct<runs:array<struct<start:long,length:long,period:long>>,collapsed:binary>"


def find(texts: list[bytes], rules: RunRules = RunRules()) -> list[dict]:
    """Runs and collapsed text of each UTF-8 text."""
    out: list[dict] = []
    waiting: list[list[bytes]] = []

    def flush() -> None:
        sizes = np.array([len(w) for w in waiting], np.int64)
        flat = np.empty(int(sizes.sum()), object)
        flat[:] = [w for words in waiting for w in words]
        numbers = pd.factorize(flat)[0]
        begin = np.r_[0, np.cumsum(sizes)]
        runs = runs_of(numbers, np.repeat(np.arange(len(waiting)), sizes), rules)
        cut = np.searchsorted(runs[:, 0], begin)
        for i, words in enumerate(waiting):
            own = runs[cut[i]:cut[i + 1]] - [begin[i], 0, 0]
            kept = words
            if len(own):
                keep = _kept(len(words), own)
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            out.append({"runs": [{"start": s, "length": n, "period": p} for s, n, p in own.tolist()], "collapsed": b" ".join(kept)})
        waiting.clear()

    held = 0
    for text in texts:
        words = text.split()
        if waiting and held + len(words) > WORDS_AT_ONCE:
            flush()
            held = 0
        waiting.append(words)
        held += len(words)
    if waiting:
        flush()
    return out


def with_runs(docs: DataFrame, text_col: str = "text", into: str = "_periods", rules: RunRules = RunRules()) -> DataFrame:
    """All columns and a struct `into`: runs, an array of (start, length, period) in words by start, then period; and
    collapsed, the words that no run contains after its first period, joined by one space (UTF-8). No shuffle."""
    udf = text_udf(lambda texts: find(texts, rules), FOUND, FOUND_ARROW)
    return docs.select("*", udf(text_col).alias(into))


def longest(runs: Column | str) -> Column:
    """The longest run; of equally long ones the one that starts first, then the one of the least period. Null without runs."""
    order = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(order.isNotNull(), F.struct((-order["s"]).alias("start"), order["length"].alias("length"), (-order["p"]).alias("period")))


def collapse(docs: DataFrame, text_col: str = "text", rules: RunRules = RunRules()) -> DataFrame:
    """The documents, columns unchanged; a text with runs keeps one period of each, its words joined by one space."""
    found = with_runs(docs, text_col, "_periods", rules)
    text = F.when(F.size("_periods.runs") > 0, F.col("_periods.collapsed").cast("string")).otherwise(F.col(f"`{text_col}`"))
    return found.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def periodic_from(words: Column, start: Column, period: Column) -> Column:
    """The words, from `start` on replaced by the `period` words there, again and again."""
    return F.concat(F.slice(words, F.lit(1), start), F.slice(F.flatten(F.array_repeat(
        F.slice(words, start + 1, period), F.ceil((F.size(words) - start) / period).cast("int"))), F.lit(1), F.size(words) - start))


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")
