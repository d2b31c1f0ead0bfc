"""Alignment of two tokenizers: which tokens of either cover the same stretch of a text, and how often they do corpus-wide.

Both tokenizers cut the same bytes. Tokens of the one and of the other overlap where they share a byte; the components of
that are the groups between the places where both cut. Pointer jumping finds them for many texts at once: every token
points to the token of the other side that overlaps it and reaches farthest to the right, or to itself if none reaches
farther; replacing each pointer by the pointer's pointer doubles the distance covered, until every token points to the last
token of its component, whose place numbers the group. A link is a pair of token occurrences, one of each side, in one group.
Neither tokenizer joins a space with what stands before it, so texts are cut there and each different stretch is worked on once.

Per document the different pairs of ids come back with how often they are linked; a group's pairs are formed from its
different ids, with their counts multiplied. Documents that hold a pair are counted by an aggregate over the documents'
pair lists, so a pair that stands in most documents sends one row a task. The counts go back to the documents by a join, for
which they are broadcast only if they are counted to be few.

Defined results: a text that is null, empty, or that either tokenizer does not give back byte for byte has no tokens: zeros,
and no groups. Every row is a document of its own, also when it is repeated. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstream.llm.common import small_or_not, staged, worker_tables

SPACE = "▁"
#: Texts encoded together: so many, or so many bytes.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 20
#: A stretch starts with the space in front of a word and ends before the next such space. Either tokenizer cuts there (see
#: `Aligner`): the pattern of the one joins no other character with a space behind it, and no piece of the other holds both.
_STRETCHES = re.compile(r"\s+\S+(?:[^\S ]\s*\S+)*(?:\s++\Z)?|\s+")
#: Stretches that a worker remembers, and their letters; beyond either it forgets those that came up once, or all but the commonest half.
MOST_STRETCHES, MOST_LETTERS = 150_000, 4_000_000
#: Letters of new stretches that are encoded as one text.
RUN_LETTERS = 8192


# --- the two tokenizers ----------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others in
    turn from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    letters = {chr(b): b for b in own}
    for i, b in enumerate(b for b in range(256) if b not in set(own)):
        letters[chr(256 + i)] = b
    return letters


class ByteLevel:
    """A tokenizers file whose tokens are written in the byte alphabet. Special tokens in a text are plain text."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(file.decode())
        self.model.encode_special_tokens = True
        letters = byte_alphabet()
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        # the byte-level pattern alone: it takes a space together with what follows, never with what stands before it
        own = json.loads(file)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.cuts_before_space = (own["normalizer"] is None and plain.items() <= (own["pre_tokenizer"] or {}).items()
                                  and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] for x in own["added_tokens"]))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model with byte pieces. It puts the space in front by itself."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=file)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.tokens = [bytes([int(n[1:-1], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode()
                       for i, n in enumerate(names)]
        # pieces hold a space at their start only, and the texts are taken as they are: a space put in front, no other change
        self.cuts_before_space = (not any(SPACE in n.lstrip(SPACE) for n in names)
                                  and self.model.encode(" a  b ", out_type=str) == self.model.encode(" a", out_type=str) + self.model.encode(" b ", out_type=str))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


# --- groups and links of many texts at once --------------------------------------------------------------------


def group_numbers(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of either side, numbered from 0 on, from the tokens' ends; both sides end at one place."""
    if not len(a_ends):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(a_ends)
    # farthest to the right among the overlapping ones is the token that holds the last byte
    over_a, over_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)
    last = a_ends[over_b] == b_ends
    to = np.concatenate([n + over_a, np.where(last, n + np.arange(len(b_ends)), over_b)])
    while not np.array_equal(to, beyond := to[to]):
        to = beyond
    number = (np.cumsum(last) - 1)[to - n]
    return number[:n], number[n:]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][bounds])


def _ranges(begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """All places of stretches that begin there and are so long, one stretch after the other."""
    return np.arange(int(width.sum())) + np.repeat(begin - (np.cumsum(width) - width), width)


def _distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, count) of the different ids of each group."""
    key, count = np.unique(group * size + ids, return_counts=True)
    return key // size, key % size, count


def links_of(a_group: np.ndarray, a_ids: np.ndarray, b_group: np.ndarray, b_ids: np.ndarray, doc_of_group: np.ndarray,
             a_size: int, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of the different linked id pairs of each document; a pair is a id * b_size + b id."""
    ga, a, times_a = _distinct(a_group, a_ids, a_size)
    gb, b, times_b = _distinct(b_group, b_ids, b_size)
    per_group = np.bincount(gb, minlength=len(doc_of_group))
    begin = np.r_[0, np.cumsum(per_group)]
    width = per_group[ga]
    left = np.repeat(np.arange(len(ga)), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + begin[ga][left]
    doc, pair, times = doc_of_group[ga[left]], a[left] * b_size + b[right], times_a[left] * times_b[right]
    # one key in place of two: it holds, since a batch has few documents
    by = np.argsort(doc * (a_size * b_size) + pair, kind="stable")
    doc, pair, times = doc[by], pair[by], times[by]
    new = np.nonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])[0] if len(by) else np.empty(0, np.int64)
    return doc[new], pair[new], np.add.reduceat(times, new) if len(new) else times


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
_NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


class Aligner:
    """Aligns lists of texts with one pair of tokenizers.

    A text is the sequence of its stretches. Both sides cut between two stretches, so tokens, groups and links of a text are those
    of its stretches, which are encoded and aligned once and remembered. A vocabulary with pieces that hold a space behind another
    character has whole texts as its stretches.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.size = [len(side.tokens) for side in (a, b)]
        self.bytes = [np.array([len(t) for t in side.tokens], np.int64) for side in (a, b)]
        # an id as text, with what follows it: inside and at the end of its side of a group
        self.written = [np.array([f"{i}{end}" for i in range(n) for end in (",", mark)], object)
                        for n, mark in zip(self.size, "|;", strict=True)]
        self.cuts = a.cuts_before_space and b.cuts_before_space
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}  # numbered in the order in which they stand here
        self.letters = 0
        self.texts: list[str] = []  # the groups of each stretch
        self.counts = np.empty((0, 4), np.int64)  # tokens of a, of b, groups, links; -1 if it is not given back
        self.begin = np.zeros(1, np.int64)  # where the pairs of each stretch begin
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        self.hits = np.empty(0, np.int64)  # how often each came up, halved at times

    def _shrink(self) -> None:
        """Forget what came up once, and the rarest until a half is left."""
        size = np.fromiter(map(len, self.number), np.int64, len(self.number))
        order = np.argsort(-self.hits, kind="stable")
        fits = (np.arange(len(order)) < MOST_STRETCHES // 2) & (np.cumsum(size[order]) <= MOST_LETTERS // 2)
        kept = np.sort(order[fits & (self.hits[order] > 1)])
        names, width = list(self.number), np.diff(self.begin)[kept]
        self.number = {names[i]: at for at, i in enumerate(kept.tolist())}
        self.letters, self.texts = int(size[kept].sum()), [self.texts[i] for i in kept.tolist()]
        at = _ranges(self.begin[kept], width)
        self.pairs, self.times, self.counts, self.hits = self.pairs[at], self.times[at], self.counts[kept], self.hits[kept] // 2
        self.begin = np.r_[0, np.cumsum(width)]

    def _numbers(self, found: list[str]) -> np.ndarray:
        """Numbers of stretches; those not met before are aligned together."""
        if len(self.number) > MOST_STRETCHES or self.letters > MOST_LETTERS:
            self._shrink()
        new = [x for x in dict.fromkeys(found) if x not in self.number]
        if new:
            counts, texts, begin, pairs, times = self._align_stretches(new)
            self.number.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
            self.letters += sum(map(len, new))
            self.texts += texts
            self.counts = np.concatenate([self.counts, counts])
            self.begin = np.concatenate([self.begin, self.begin[-1] + begin[1:]])
            self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
            self.hits = np.r_[self.hits, np.zeros(len(new), np.int64)]
        numbers = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        self.hits += np.bincount(numbers, minlength=len(self.hits))
        return numbers

    def encode(self, stretches: list[str], letters: int = RUN_LETTERS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Of either side the ids of all stretches and how many each has, none if it does not come back byte for byte; and which
        do. All start with a space. Those that follow each other are encoded as one text of so many letters or so."""
        runs = list(_runs(stretches, letters))
        joined = ["".join(stretches[low:high]) for low, high in runs]
        both = (self.a.encode(joined), self.b.encode([x[1:] for x in joined]))
        ids, counts, kept = ([], []), ([], []), []
        for (low, high), text, *found in zip(runs, joined, *both, strict=True):
            own, plain = stretches[low:high], text.encode()
            ends = np.cumsum([len(x) if len(plain) == len(text) else len(x.encode()) for x in own])
            cut = [self._cut(side, x, plain, ends) for side, x in enumerate(found)]
            whole = cut[0] is not None and cut[1] is not None
            if not whole and len(own) > 1:
                some_ids, some_counts, some_kept = self.encode(own, 0)  # one by one
                kept.append(some_kept)
                cut = list(zip(some_ids, some_counts, strict=True))
            else:
                kept.append(np.full(len(own), whole))
                if not whole:
                    cut = [(np.empty(0, np.int64), np.zeros(1, np.int64))] * 2
            for side in (0, 1):
                ids[side].append(cut[side][0])
                counts[side].append(cut[side][1])
        none = [np.empty(0, np.int64)]
        return *([np.concatenate(x + none) for x in sides] for sides in (ids, counts)), np.concatenate(kept + [np.empty(0, bool)])

    def _cut(self, side: int, ids: list[int], plain: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a run and how many each of its stretches has, from the bytes where they end."""
        if b"".join(map((self.a, self.b)[side].tokens.__getitem__, ids)) != plain:
            return None
        ids = np.array(ids, np.int64)
        upto = np.cumsum(self.bytes[side][ids])
        count = np.searchsorted(upto, ends, side="right")
        return (ids, np.diff(count, prepend=0)) if np.array_equal(upto[count - 1], ends) else None

    def _align_stretches(self, stretches: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts, groups, where pairs begin, pairs and times of each stretch."""
        ids, counts, kept = self.encode(stretches)
        group = group_numbers(*(np.cumsum(size[i]) for size, i in zip(self.bytes, ids, strict=True)))
        begin = [np.r_[0, np.cumsum(n)] for n in counts]
        n_groups = int(group[1][-1]) + 1 if len(group[1]) else 0
        # groups of a stretch: up to the one of its last token
        upto = np.r_[0, np.maximum.accumulate(np.where(counts[1] > 0, group[1][begin[1][1:] - 1] + 1, 0))] if n_groups else np.zeros(len(stretches) + 1, np.int64)
        in_group = [np.bincount(g, minlength=n_groups) for g in group]
        n_links = _sums(in_group[0] * in_group[1], upto)
        of_group = np.repeat(np.arange(len(stretches)), np.diff(upto))
        at, pair, times = links_of(group[0], ids[0], group[1], ids[1], of_group, *self.size)
        numbers = np.stack([*counts, np.diff(upto), n_links], axis=1)
        numbers[~kept] = -1
        return numbers, self._written(ids, group, in_group, begin), np.searchsorted(at, np.arange(len(stretches) + 1)), pair, times

    def align(self, texts: list[bytes | None]) -> list[pa.Array]:
        """One array per column of ALIGNED."""
        found: list[str] = []
        n_found = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                plain = " " + text.decode("utf-8", "replace")
                if plain.encode()[1:] == text:
                    own = _STRETCHES.findall(plain) if self.cuts else [plain]
                    found += own
                    n_found[i] = len(own)
        numbers = self._numbers(found)
        doc = np.repeat(np.arange(len(texts)), n_found)
        # texts with a stretch that is not given back have no tokens
        lost = np.zeros(len(texts), bool)
        lost[doc[self.counts[numbers, 0] < 0]] = True
        there = ~lost[doc]
        doc, numbers = doc[there], numbers[there]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        written = list(map(self.texts.__getitem__, numbers.tolist()))
        groups = [";".join(written[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        # each text's different stretches with how often they stand in it, then its different pairs
        key, often = np.unique(doc * max(len(self.texts), 1) + numbers, return_counts=True)
        doc_of, stretch = np.divmod(key, max(len(self.texts), 1))
        width = self.begin[stretch + 1] - self.begin[stretch]
        at = _ranges(self.begin[stretch], width)
        # one key in place of two: it holds, since a batch has few documents
        links = np.repeat(doc_of, width) * (self.size[0] * self.size[1]) + self.pairs[at]
        times = self.times[at] * np.repeat(often, width)
        by = np.argsort(links, kind="stable")
        links, times = links[by], times[by]
        new = np.nonzero(np.r_[True, links[1:] != links[:-1]])[0] if len(links) else np.empty(0, np.int64)
        doc_of, pair = np.divmod(links[new], self.size[0] * self.size[1])
        cut = pa.array(np.searchsorted(doc_of, np.arange(len(texts) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(v.astype(np.int64))) for v in (pair, np.add.reduceat(times, new) if len(new) else times)]
        counts = self.counts[numbers]
        return [*(pa.array(_sums(counts[:, i], bounds)) for i in range(4)), pa.array(groups, pa.string()), *lists]

    def _written(self, ids: list, group: tuple, in_group: list, begin: list) -> list[str]:
        """Each document's groups as a1,a2|b1;a3|b2,b3."""
        parts = np.empty(len(ids[0]) + len(ids[1]), object)
        # a token stands behind all tokens of earlier groups, and one of b behind its group's tokens of a
        before = [np.cumsum(n) for n in in_group]
        if len(parts):
            for side, behind in ((0, before[1][group[0]] - in_group[1][group[0]]), (1, before[0][group[1]])):
                g = group[side]
                ends = np.r_[g[1:] != g[:-1], True]
                parts[np.arange(len(g)) + behind] = self.written[side][2 * ids[side] + ends]
        bounds = begin[0] + begin[1]
        return ["".join(parts[x:y].tolist())[:-1] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _runs(stretches: list[str], letters: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches that are encoded as one text, of `letters` letters or little more. A space at the end of a stretch would go
    with the next one, so such a stretch ends its run."""
    low, held = 0, 0
    for i, x in enumerate(stretches):
        held += len(x)
        if held >= letters or x[-1].isspace():
            yield low, i + 1
            low, held = i + 1, 0
    if low < len(stretches):
        yield low, len(stretches)


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of texts that are few and short enough to be worked on together; a longer text stands alone."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or b"")
        if i > low and (i - low >= TEXTS_AT_ONCE or held + size > BYTES_AT_ONCE):
            yield low, i
            low, held = i, 0
        held += size
    if low < len(texts):
        yield low, len(texts)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `id_col`, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), and the different linked id
    pairs with how often they are linked here (pairs, times; see `pair_size`). The files, a few MB, are read here and sent."""
    files = [Path(p).read_bytes() for p in (a_path, b_path)]
    sent = docs.sparkSession.sparkContext.broadcast(files)
    key = ("aligner", *(hashlib.sha256(f).hexdigest() for f in files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker process goes from task to task: the vocabularies are read once in it
        aligner = None
        for batch in batches:
            aligner = aligner or worker_tables(key, lambda: Aligner(ByteLevel(sent.value[0]), Pieces(sent.value[1])))
            texts = batch.column(1).to_pylist()
            for low, high in _pieces(texts):
                found = aligner.align(texts[low:high])
                yield pa.record_batch([batch.column(0).slice(low, high - low), *found], names=["_id", *_NAMES])

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, {ALIGNED}").withColumnRenamed("_id", id_col)


# --- counts over the corpus ------------------------------------------------------------------------------------


def pair_size(b_path: str) -> int:
    """A pair of ids is a id * pair_size + b id."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=b_path).vocab_size()


def lexicon(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, a_id, b_id, docs, best) of all linked pairs: in how many documents, and whether no pair of a_id is in more."""
    seen = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    # a token has as many partners as the other vocabulary has tokens, at most
    own = W.partitionBy("a_id")
    ids = seen.select("pair", F.call_function("div", "pair", F.lit(b_size)).alias("a_id"), (F.col("pair") % b_size).alias("b_id"), "docs")
    return ids.withColumn("best", F.col("docs") == F.max("docs").over(own))


def scored(aligned: DataFrame, words: DataFrame) -> DataFrame:
    """All columns of `aligned` without its lists, and per document n_best and count_sum over its links. `aligned` must be
    stored, since it is read twice."""
    numbered = staged(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned-rows") if "_row" not in aligned.columns else aligned
    links = numbered.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", "x.pairs", "x.times")
    held = links.join(small_or_not(words.select(F.col("pair").alias("pairs"), "docs", "best")), "pairs")
    sums = held.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return numbered.drop("pairs", "times").join(sums, "_row", "left").withColumns(
        {"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)}).drop("_row")
