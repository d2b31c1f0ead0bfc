"""Quality rules: repeated passages inside a document, found with a suffix array over its words.

Words of many documents are numbered together and sorted by prefix doubling in numpy: after the round
for length k, two positions share a rank if and only if their next k words agree. The document number
leads the first rank, so positions of different documents never meet. Adjacent suffixes give the
longest common prefixes. The verdict takes, at each position, the larger common prefix with either neighbour;
the union of these spans and the longest of them decide. That is the union of the occurrences of all maximal repeated
substrings, the intervals of common prefixes whose occurrences have different words in front:
`maximal_repeats` walks them, as a reference for tests; the verdict does not come from that walk.

Defined results: a null or empty text, and one without words, has zero in every count and fails the base
rule (fewer than MIN_WORDS words). Repeated rows are judged one by one; each document is judged alone, so
other columns, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from foldstream.llm.common import text_udf

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Words sorted together; a longer document is sorted alone.
WORDS_AT_ONCE = 300_000


@dataclass(frozen=True)
class RepeatRules:
    """Limits of the verdict.

    min_repeat: words from which a repeated substring counts (the base rule has shorter ones). max_covered:
    largest fraction of words under repeats. max_longest: longest repeat in words, but a repeat is never too
    long in itself while it and its copy fill no more than `longest_share` of the document.
    """

    min_repeat: int = 16
    max_covered: float = 0.2
    max_longest: int = 100
    longest_share: float = 0.1


class SuffixArray:
    """Suffix array of several documents, as far as suffixes share `least` words or more.

    words: word numbers of all documents, one after the other; doc: their document, ascending.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, least: int = WINDOW):
        n = len(words)
        self.n, self.doc, self.words = n, doc, words
        ends = np.searchsorted(doc, doc, side="right") if n else np.empty(0, np.int64)
        self.room = (ends - np.arange(n)).astype(np.int64)  # words from here to the document's end
        key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        rank = np.zeros(n, np.int64)
        active = np.arange(n)
        active = self._refine(rank, active, key)
        self.levels: list[tuple[int, np.ndarray]] = [(1, rank.copy())]
        k = 1
        self.at_window = active if least <= 1 else None
        while len(active):
            far = active + k
            inside = self.room[active] > k
            second = np.where(inside, rank[np.minimum(far, n - 1)] + 1, 0)
            active = self._refine(rank, active, rank[active] * (n + 1) + second)
            k *= 2
            self.levels.append((k, rank.copy()))
            if k == least:
                self.at_window = active
        if self.at_window is None:
            self.at_window = active
        # suffixes that share `least` words or more with another one, in order
        self.order = self.at_window[np.argsort(rank[self.at_window], kind="stable")]
        self.lcp = self._common_prefixes()

    @staticmethod
    def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Split groups of equal rank by `key`, whose order refines the rank's; what is still shared stays active."""
        if not len(active):
            return active
        by = np.argsort(key, kind="stable")
        at, key, old = active[by], key[by], rank[active[by]]
        index = np.arange(len(at))
        new_group = np.r_[True, old[1:] != old[:-1]]
        new_part = np.r_[True, key[1:] != key[:-1]]
        group_start = np.maximum.accumulate(np.where(new_group, index, 0))
        part_start = np.maximum.accumulate(np.where(new_part, index, 0))
        rank[at] = old + part_start - group_start
        last = np.r_[new_part[1:], True]
        return at[~(new_part & last)]

    def _common_prefixes(self) -> np.ndarray:
        """Words that each suffix of `order` shares with the one before it."""
        if len(self.order) < 2:
            return np.zeros(len(self.order), np.int64)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        own, room_a, room_b = np.zeros(len(a), np.int64), self.room[a], self.room[b]
        for k, rank in reversed(self.levels):
            fits = (room_a - own >= k) & (room_b - own >= k)
            x, y = np.minimum(a + own, self.n - 1), np.minimum(b + own, self.n - 1)
            own += np.where(fits & (rank[x] == rank[y]), k, 0)
        return np.r_[0, own]

    def longest_here(self) -> np.ndarray:
        """For every position the length of the longest repeat that starts there."""
        out = np.zeros(self.n, np.int64)
        if len(self.order):
            out[self.order] = np.maximum(self.lcp, np.r_[self.lcp[1:], 0])
        return out

    def maximal_repeats(self, least: int) -> list[tuple[int, list[int]]]:
        """(length, positions) of the substrings of `least` words or more that occur at least twice and
        can be extended neither to the right nor to the left without losing an occurrence."""
        before = np.where(self.room[self.order] == self.room[np.maximum(self.order - 1, 0)] - 1,
                          self.words[np.maximum(self.order - 1, 0)], -1)
        differs = np.cumsum(np.r_[False, (before[1:] != before[:-1]) | (before[1:] == -1)]) if len(before) else before
        found, stack = [], []
        for j in range(1, len(self.order) + 1):
            length, low = (int(self.lcp[j]) if j < len(self.order) else 0), j - 1
            while stack and stack[-1][0] > length:
                was, low = stack.pop()
                if was >= least and differs[j - 1] > differs[low]:
                    found.append((was, sorted(self.order[low:j].tolist())))
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, low))
        return found


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, "
            "longest_repeat long, base_failed boolean, kept boolean")
_FIELDS = [part.split() for part in MEASURES.split(", ")]
MEASURES_ARROW = pa.struct([(n, pa.int64() if t == "long" else pa.bool_()) for n, t in _FIELDS])


def _repeats(split: list[list[bytes]], rules: RepeatRules) -> list[tuple[int, int, int]]:
    """Per document: words under repeated windows, words under repeats, longest repeat."""
    sizes = np.array([len(w) for w in split], np.int64)
    total = int(sizes.sum())
    if not total:
        return [(0, 0, 0)] * len(split)
    flat = np.empty(total, object)
    flat[:] = [w for words in split for w in words]
    numbers = pd.factorize(flat)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(split)), sizes)
    array = SuffixArray(numbers, doc)
    in_window = covered(total, array.at_window, WINDOW)
    longest = array.longest_here()
    starts = np.nonzero(longest >= rules.min_repeat)[0]
    under = covered(total, starts, longest[starts])
    most = np.zeros(len(split), np.int64)
    np.maximum.at(most, doc, np.where(longest >= rules.min_repeat, longest, 0))
    return list(zip(np.bincount(doc, in_window, len(split)).astype(int).tolist(),
                    np.bincount(doc, under, len(split)).astype(int).tolist(), most.tolist(), strict=True))


def measure(texts: list[bytes], rules: RepeatRules = RepeatRules()) -> list[dict]:
    """Counts and verdict of each UTF-8 text."""
    if rules.min_repeat < WINDOW:
        raise ValueError(f"repeats are found from {WINDOW} words on")
    out: list[dict] = []
    waiting: list[tuple[bytes, list[bytes]]] = []

    def flush() -> None:
        found = _repeats([words for _, words in waiting], rules)
        for (text, words), (window, under, longest) in zip(waiting, found, strict=True):
            n = len(words)
            lines = [line for line in text.split(b"\n") if line.strip()]
            failed = n < MIN_WORDS or 100 * window > MAX_REPEAT_PERCENT * n
            too_long = longest > rules.max_longest and 2 * longest > rules.longest_share * n
            out.append({"n_words": n, "word_chars": len(b"".join(words).decode("utf-8", "replace")),
                        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
                        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": window,
                        "covered_words": under, "longest_repeat": longest, "base_failed": failed,
                        "kept": not failed and under <= rules.max_covered * n and not too_long})
        waiting.clear()

    held = 0
    for text in texts:
        words = text.split()
        if waiting and held + len(words) > WORDS_AT_ONCE:
            flush()
            held = 0
        waiting.append((text, words))
        held += len(words)
    if waiting:
        flush()
    return out


def assess(docs: DataFrame, text_col: str = "text", into: str = "_quality",
           rules: RepeatRules = RepeatRules()) -> DataFrame:
    """All columns and a struct `into` with the counts and the verdict. No shuffle."""
    udf = text_udf(lambda texts: measure(texts, rules), f"struct<{MEASURES.replace(' ', ':').replace(',:', ',')}>",
                   MEASURES_ARROW)
    return docs.select("*", udf(text_col).alias(into))


def keep_good(docs: DataFrame, text_col: str = "text", rules: RepeatRules = RepeatRules()) -> DataFrame:
    """The documents whose verdict is to stay, columns unchanged."""
    return assess(docs, text_col, "_quality", rules).where("_quality.kept").drop("_quality")
