"""Language of the words of a text, by a linear-chain conditional random field.

Words are runs of letters. A word's score for a language is the sum of learned weights of its features: itself, its
prefixes and suffixes, its character n-grams, and for every language whether the lexicon of that language has it.
Neighbouring words share a learned transition score, so a text may switch between languages and a word of unclear
features follows its neighbours. Forward-backward gives every word's probability of each language; a document's
score is their mean.

The field is fitted on a bounded sample of labelled documents (see `Training`). Labels are per document, so the
training sequences are pieced together from stretches of documents in different languages, which teaches the
transitions.

Defined results: null texts and texts without a letter have no words: language `und`, score 0. Repeated rows are labelled
one by one. Other columns play no part in a prediction. Documents of any length are labelled whole: probabilities
are carried from block to block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstream.llm.common import small_or_not, text_udf

UNKNOWN = "und"
#: A longer run of letters, as in scripts without spaces, counts as several words of at most so many letters.
MOST_LETTERS = 40
#: Numbers that `re` counts as word characters though they are no digits: fractions, powers, Roman and circled numbers. A pattern
#: that names them all is slow, so texts that have one are cut at them beforehand.
_NUMBERS = frozenset(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_CUT = {ord(c): " " for c in _NUMBERS}
_LETTERS = re.compile(rf"[^\W\d_]{{1,{MOST_LETTERS}}}")
#: Words of a block; a document is a row of blocks.
BLOCK = 64
#: Distinct words whose scores a worker remembers.
MOST_WORDS = 200_000
#: New words scored together.
WORDS_AT_ONCE = 50_000


@dataclass(frozen=True)
class Training:
    """per_language: the most documents of a language that the fit looks at, those with the least hash of their
    text. stretch: words of a training stretch in one language. buckets: hashed features, a power of two. lexicon: frequent
    words of a language in its lexicon."""

    per_language: int = 150
    stretch: int = 24
    buckets: int = 1 << 15
    lexicon: int = 500
    rounds: int = 40
    rate: float = 0.3
    decay: float = 1e-5
    seed: int = 11


def words(text: str) -> list[str]:
    small = text.lower()
    if not small.isascii() and not _NUMBERS.isdisjoint(small):
        small = small.translate(_CUT)
    return _LETTERS.findall(small)


class Buckets(dict):
    """Bucket of a feature, remembered; the features are short, so there are not many."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def of(self, part: str) -> int:
        return zlib.crc32(part.encode()) & (self.n - 1)

    def __missing__(self, part: str) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        at = self[part] = self.of(part)
        return at


def features(word: str, buckets: Buckets, lexicons: list[frozenset[str]]) -> list[int]:
    """Buckets of a word, its affixes and n-grams; lexicon features come behind the buckets."""
    marked = f"<{word}>"
    n = len(marked)
    parts = [f"p{word[:2]}", f"p{word[:3]}", f"p{word[:4]}", f"s{word[-2:]}", f"s{word[-3:]}", f"s{word[-4:]}"]
    parts += [marked[i:i + 2] for i in range(n - 1)]
    parts += [marked[i:i + 3] for i in range(n - 2)]
    found = [buckets[x] for x in parts]
    found.append(buckets.of(f"w{word}"))
    found += [buckets.n + i for i, lexicon in enumerate(lexicons) if word in lexicon]
    return found


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


class _Letters:
    """Letters of many words as UTF-8, for sums like `zlib.crc32` over stretches of letters of all words at once."""

    def __init__(self, joined: str):
        raw = np.frombuffer(joined.encode(), np.uint8)
        self.first = np.nonzero((raw & 0xC0) != 0x80)[0]  # where a letter starts
        self.size = np.diff(np.r_[self.first, len(raw)])
        self.raw = raw
        self.wide = int(self.size.max(initial=1))

    @staticmethod
    def start(mark: str) -> np.uint32:
        """The state after a sign that stands before the letters."""
        return np.uint32(zlib.crc32(mark.encode()) ^ 0xFFFFFFFF)

    def add(self, state: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The states after one more letter each, given by place."""
        first = self.first[at]
        state = _CRC[(state ^ self.raw[first]) & 0xFF] ^ (state >> 8)
        for i in range(1, self.wide):
            more = np.nonzero(self.size[at] > i)[0]
            held = state[more]
            state[more] = _CRC[(held ^ self.raw[first[more] + i]) & 0xFF] ^ (held >> 8)
        return state


def _normal(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)


def forward_backward(emit: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray,
                     pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probabilities of the labels of every word of many sequences.

    emit: scores of all words, one sequence after the other; length: words of each sequence, over 0; trans, start: scores.
    Sequences are cut into blocks. Products of a block's steps carry probabilities over it, so the loop runs over the
    blocks of the longest sequence and over the words of a block, for all sequences at once. With `pairs` also the
    expected number of each transition.
    """
    n, k = emit.shape
    begin = np.r_[0, np.cumsum(length)[:-1]]
    blocks = -(-length // BLOCK)
    total = int(blocks.sum())
    owner = np.repeat(np.arange(len(length)), blocks)
    first_block = np.r_[0, np.cumsum(blocks)[:-1]]
    number = np.arange(total) - first_block[owner]
    at = (begin[owner] + number * BLOCK)[:, None] + np.arange(BLOCK)
    real = at < (begin + length)[owner][:, None]
    local = np.exp(emit - emit.max(axis=1, keepdims=True))
    e = np.where(real[:, :, None], local[np.minimum(at, n - 1)], 1.0)  # (blocks, words, labels)
    t = np.exp(trans - trans.max())
    # over[b]: from the labels before the block to those of its last word; words past the end change nothing
    # nothing is carried over a sequence's first block
    later = np.nonzero(number)[0]
    over = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    if len(later):
        held, real_later, e_later = over[later], real[later], e[later]
        for i in range(BLOCK):
            step = _normal((held @ t) * e_later[:, i, None, :], (1, 2))
            held = np.where(real_later[:, i, None, None], step, held)
        over[later] = held
    # before the first word stands no label: its start scores take the place of a transition
    ahead = np.empty((total, k))
    behind = np.ones((total, k))
    current = np.ones((len(length), k))
    s = np.exp(start - start.max())
    for j in range(int(blocks.max())):
        has = np.nonzero(blocks > j)[0]
        b = first_block[has] + j
        ahead[b] = current[has]
        if j == 0:
            continue_from = np.empty((len(has), k))
            state = _normal(s * e[b, 0], (1,))
            for i in range(1, BLOCK):
                nxt = _normal((state @ t) * e[b, i], (1,))
                state = np.where(real[b, i, None], nxt, state)
            continue_from[:] = state
        else:
            continue_from = _normal(np.einsum("bi,bij->bj", current[has], over[b]), (1,))
        current[has] = continue_from
    current = np.ones((len(length), k))
    for j in range(int(blocks.max()) - 1, -1, -1):
        has = np.nonzero(blocks > j)[0]
        b = first_block[has] + j
        behind[b] = current[has]
        if j:
            current[has] = _normal(np.einsum("bij,bj->bi", over[b], current[has]), (1,))
    forward, backward = np.empty((total, BLOCK, k)), np.empty((total, BLOCK, k))
    state, leads = ahead, number == 0
    for i in range(BLOCK):
        into = state @ t if i else np.where(leads[:, None], s, state @ t)
        nxt = _normal(into * e[:, i], (1,))
        state = np.where(real[:, i, None], nxt, state)
        forward[:, i] = state
    state = behind
    for i in range(BLOCK - 1, -1, -1):
        backward[:, i] = state
        state = np.where(real[:, i, None], _normal((state * e[:, i]) @ t.T, (1,)), state)
    both = _normal(forward * backward, (2,))
    expected = None
    if pairs:
        before = np.concatenate([ahead[:, None], forward[:, :-1]], axis=1)
        joint = before[:, :, :, None] * t * (e * backward)[:, :, None, :]
        joint /= np.maximum(joint.sum(axis=(2, 3), keepdims=True), 1e-300)
        counts = real.copy()
        counts[leads, 0] = False
        expected = (joint * counts[:, :, None, None]).sum(axis=(0, 1))
    return both[real], expected


@dataclass
class Field:
    """A fitted field: its labels, weights of features by label, transition and start scores, lexicons."""

    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    lexicons: list[frozenset[str]]
    buckets: Buckets

    def scores(self, word: str) -> np.ndarray:
        return self.weights.take(features(word, self.buckets, self.lexicons), axis=0).sum(axis=0)

    def scores_of(self, found: list[str]) -> np.ndarray:
        """`scores` of different words, one row each, added up in the same order."""
        n = np.array([len(w) for w in found], np.int64)
        order = np.argsort(-n, kind="stable")  # words that have a feature more are the first ones
        found, n = [found[i] for i in order], n[order]
        letters, low = _Letters("<" + "><".join(found) + ">"), np.uint32(self.buckets.n - 1)
        begin = np.cumsum(n + 2) - n - 1  # of a word's own letters
        weights = self.weights

        def of(state: np.ndarray) -> np.ndarray:
            return weights.take((state ^ np.uint32(0xFFFFFFFF)) & low, axis=0)

        def at_ends(mark: str, starts: np.ndarray, most: int) -> Iterator[np.ndarray]:
            """States after each of up to `most` letters; shorter words stay at their last one."""
            state = np.full(len(n), letters.start(mark))
            for i in range(most):
                has = int(np.searchsorted(-n, -i))  # those of more than i letters
                state[:has] = letters.add(state[:has], starts[:has] + i)
                yield state

        prefixes = list(map(of, at_ends("p", begin, 4)))
        total = prefixes[1] + prefixes[2]
        total += prefixes[3]
        for size in (2, 3, 4):
            *_, last = at_ends("s", begin + np.maximum(n - size, 0), size)
            total += of(last)
        places = np.arange(int((n + 2).sum()))
        one = letters.add(np.full(len(places), letters.start("")), places)
        two = letters.add(one[:-1], places[1:])
        three = letters.add(two[:-1], places[2:])
        for grams, less in ((two, 1), (three, 0)):
            for i in range(int(n[0]) + less):
                has = int(np.searchsorted(-n, -i + less))
                total[:has] += of(grams[begin[:has] - 1 + i])
        total += weights.take([self.buckets.of(f"w{w}") for w in found], axis=0)
        for i, lexicon in enumerate(self.lexicons):
            own = [at for at, w in enumerate(found) if w in lexicon]
            total[own] += weights[self.buckets.n + i]
        out = np.empty_like(total)
        out[order] = total
        return out

    def label(self, texts: list[str], memory: Memory) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float] | None] = [None] * len(texts)
        at, length, held = [], [], []

        def flush() -> None:
            if at:
                ids = memory.numbers(held, self.scores_of)
                chance, _ = forward_backward(memory.table[ids], np.array(length), self.trans, self.start)
                sums = np.add.reduceat(chance, np.r_[0, np.cumsum(length)[:-1]], axis=0)
                for i, mean in zip(at, sums / np.array(length)[:, None], strict=True):
                    best = int(mean.argmax())
                    out[i] = (self.labels[best], float(min(max(mean[best], 0.0), 1.0)))
            at.clear(), length.clear(), held.clear()

        for i, text in enumerate(texts):
            found = words(text)
            if not found or not self.labels:
                out[i] = (UNKNOWN, 0.0)
                continue
            held += found
            at.append(i)
            length.append(len(found))
            if len(held) > 60_000:
                flush()
        flush()
        return out


class Memory:
    """Scores of the words a worker has met, forgotten as a whole when they are too many."""

    def __init__(self, n_labels: int):
        self.number: dict[str, int] = {}
        self.table = np.zeros((1 << 14, n_labels), np.float32)

    def numbers(self, found: list[str], scores: Callable[[list[str]], np.ndarray]) -> np.ndarray:
        """Rows of the table for words; those not met before are scored together."""
        if len(self.number) > MOST_WORDS:
            self.number.clear()
        new = [w for w in set(found) if w not in self.number]
        for low in range(0, len(new), WORDS_AT_ONCE):
            some = new[low:low + WORDS_AT_ONCE]
            first, upto = len(self.number), len(self.number) + len(some)
            while upto > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first:upto] = scores(some)
            self.number.update(zip(some, range(first, upto)))
        return np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))


def fit(texts: list[str], langs: list[str], how: Training = Training()) -> Field:
    """Fit by gradient ascent (Adagrad) on the likelihood of sequences pieced together from the documents."""
    labels = sorted(set(langs))
    k, rng = len(labels), np.random.default_rng(how.seed)
    split = [words(t) for t in texts]
    counts = [Counter() for _ in labels]
    for found, lang in zip(split, langs, strict=True):
        counts[labels.index(lang)].update(found)
    lexicons = [frozenset(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:how.lexicon]) for c in counts]
    stretches = [(labels.index(lang), found[i:i + how.stretch]) for found, lang in zip(split, langs, strict=True)
                 for i in range(0, len(found), how.stretch)]
    stretches = [stretches[i] for i in rng.permutation(len(stretches))] if stretches else []
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for _, found in stretches for w in found], np.int64)
    gold = np.array([y for y, found in stretches for _ in found], np.int64)
    buckets = Buckets(how.buckets)
    lists = [features(w, buckets, lexicons) for w in number]
    word_of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature_of = np.array([f for x in lists for f in x], np.int64)
    # a sequence has eight stretches
    lengths = [sum(len(f) for _, f in stretches[i:i + 8]) for i in range(0, len(stretches), 8)]
    length = np.array([x for x in lengths if x], np.int64)
    weights = np.zeros((how.buckets + k, k))
    trans, start = np.zeros((k, k)), np.zeros(k)
    if k > 1 and len(ids):
        size = np.full(weights.shape, 1e-8), np.full(trans.shape, 1e-8), np.full(start.shape, 1e-8)
        ends = np.cumsum(length)
        firsts = np.r_[0, ends[:-1]]
        inner = np.ones(len(ids), bool)
        inner[firsts] = False
        at = np.nonzero(inner)[0]
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[at - 1], gold[at]), 1)
        for _ in range(how.rounds):
            by_word = np.stack([np.bincount(word_of, weights[feature_of, y], len(lists)) for y in range(k)], axis=1)
            chance, expected = forward_backward(by_word[ids], length, trans, start, pairs=True)
            error = -chance
            error[np.arange(len(ids)), gold] += 1
            word_error = np.stack([np.bincount(ids, error[:, y], len(lists)) for y in range(k)], axis=1)
            grads = (np.stack([np.bincount(feature_of, word_error[word_of, y], len(weights)) for y in range(k)], axis=1) / len(ids)
                     - how.decay * weights, (seen - expected) / len(ids), error[firsts].sum(axis=0) / len(ids))
            for value, grad, total in zip((weights, trans, start), grads, size, strict=True):
                total += grad * grad
                value += how.rate * grad / np.sqrt(total)
    return Field(labels, weights.astype(np.float32), trans, start, lexicons, Buckets(how.buckets))


def train(docs: DataFrame, how: Training = Training(), text_col: str = "text", lang_col: str = "lang") -> Field:
    """Fit on a bounded sample of the labelled documents: for each language those with the least hash of their text."""
    labelled = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where(
        "lang is not null and text is not null")
    labelled = labelled.withColumn("_hash", F.xxhash64("text"))
    # different texts of each language: one row per language
    counts = labelled.select("lang", "_hash").distinct().groupBy("lang").agg(F.count("*").alias("_n"))
    # about twice as many as are wanted of each language, without copies, then exactly as many
    share = 2.0 * how.per_language / F.col("_n")
    near = (labelled.join(small_or_not(counts), "lang")
            .where(F.pmod(F.col("_hash"), F.lit(1 << 24)) < share * (1 << 24)).dropDuplicates(["lang", "_hash"]))
    first = W.partitionBy("lang").orderBy(F.pmod(F.col("_hash"), F.lit(1 << 24)), "_hash")
    kept = near.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= how.per_language)
    rows = sorted(kept.select("lang", "text").collect())
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], how)


def identify(docs: DataFrame, field: Field, text_col: str = "text", into: str = "_lang") -> DataFrame:
    """All columns and a struct `into` with lang (UNKNOWN if there is no word) and score (0 to 1). No shuffle."""
    held: list[Memory] = []

    def label(texts: list[bytes]) -> list[dict]:
        if not held:
            held.append(Memory(max(len(field.labels), 1)))
        found = field.label([t.decode("utf-8", "replace") for t in texts], held[0])
        return [{"lang": lang, "score": score} for lang, score in found]

    udf = text_udf(label, "struct<lang:string,score:double>", pa.struct([("lang", pa.string()), ("score", pa.float64())]))
    return docs.select("*", udf(F.col(f"`{text_col}`")).alias(into))
