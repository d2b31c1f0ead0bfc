"""Byte-level BPE: encoding with a lazily determinised transducer, decoding with a UTF-8 state machine.

Encoding. The merges decide, for every prefix of a piece, exactly one last token: the token that fits what stands before
it, that is, whose bytes together with those of the token before it are merged to just these two. A state of the
transducer is the set of prefixes that a longer token may still start from, each with its place in the tree of the
vocabulary, its last token and the tokens that not all of them share. Reading a byte gives the next state; what all live
prefixes have in common is emitted at once, so output lags by less than the longest token. States and transitions are
built when they are first met and kept in tables of bounded size.

Decoding. Token bytes are handed to a state machine for UTF-8 that releases whole characters and holds back an
unfinished one until its bytes arrive; malformed bytes are released as they are.

Defined results: a null text is an empty one and has no tokens. Repeated rows are encoded one by one, and other columns play
no part. Memory does not grow with a text: pieces and tokens of a very long one pass in blocks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstream.llm.common import text_udf, worker_tables

#: Texts with more characters are cut into pieces one by one.
LONG_TEXT = 1 << 20
PIECES_AT_ONCE = 1 << 14
POINTS_AT_ONCE = 1 << 12
#: First bytes of characters beyond the first 65,536.
FOUR_BYTES = bytes(range(0xF0, 0xF5))
MOST_STATES = 80_000
FEW_TOKENS = 16
MOST_PAIRS = 300_000
MOST_PIECES = 100_000

# Code points that are letters or numbers since Unicode 17. The tables of the library whose
# results are to be met end with Unicode 16 and take them for neither.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line has the token's bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Tokens, their tree, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.tree: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            if self.merged(token) != [rank]:
                continue  # the merges never make it; as a whole piece it is looked up
            node = 0
            for b in token:
                if b not in self.tree[node]:
                    self.tree[node][b] = len(self.tree)
                    self.tree.append({})
                    self.token_at.append(-1)
                node = self.tree[node][b]
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}  # by before << 32 | token
        # tokens further down the tree, where they are few
        self.ahead: list[list[int] | None] = [None] * len(self.tree)
        for node in range(len(self.tree) - 1, -1, -1):
            found: list[int] | None = []
            for below in self.tree[node].values():
                rest = self.ahead[below]
                if rest is None or len(found) + len(rest) >= FEW_TOKENS:
                    found = None
                    break
                found += ([self.token_at[below]] if self.token_at[below] >= 0 else []) + rest
            self.ahead[node] = found
        self._stands_for: dict[int, int] = {}
        self._first_like: dict[tuple[int, int], int] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a short piece by the merges themselves: always the pair of lowest rank, leftmost first."""
        rank_of = self.ranks.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        ranks = [rank_of(piece[i:i + 2], sys.maxsize) for i in range(len(piece) - 1)]
        while ranks:
            best = min(ranks)
            if best == sys.maxsize:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], sys.maxsize)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], sys.maxsize)
        return [self.ranks[p] for p in parts]

    def fits(self, before: int, token: int) -> bool:
        """Whether `token` may stand after `before`: the merges leave the two as they are."""
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        known = self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        self.pairs[before << 32 | token] = known
        return known


    def like(self, node: int, last: int) -> int:
        """A token that the same tokens below `node` fit after as after `last`; -1 if none of them fits.

        It keeps states apart only where their future differs.
        """
        key = node << 32 | last
        found = self._stands_for.get(key)
        if found is None:
            bits = 1
            for token in self.ahead[node]:
                fits = self.pairs.get(last << 32 | token)
                bits = bits << 1 | (self.fits(last, token) if fits is None else fits)
            none = bits == 1 << len(self.ahead[node])
            if len(self._stands_for) > MOST_PAIRS:
                self._stands_for.clear()
            if len(self._first_like) > MOST_PAIRS:
                self._first_like.clear()
            found = self._stands_for[key] = -1 if none else self._first_like.setdefault((node, bits), last)
        return found


class Transducer:
    """Bytes in, tokens out. A live prefix is (place in the tree, last token or -1, tokens not yet emitted)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1, ()),)
        self.states = [start]
        self.number = {start: 0}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        v = self.vocabulary
        tree, token_at, pairs = v.tree, v.token_at, v.pairs
        live, new = [], None
        for node, last, out in self.states[state]:
            below = tree[node].get(byte)
            if below is None:
                continue
            token = token_at[below]
            if new is None and token >= 0:
                fits = True if last < 0 else pairs.get(last << 32 | token)
                if v.fits(last, token) if fits is None else fits:
                    new = (0, token, (*out, token))
            if tree[below]:
                if last >= 0 and v.ahead[below] is not None:
                    last = v.like(below, last)
                    if last < 0:
                        continue  # no token will ever begin there
                live.append((below, last, out))
        if new is None:
            raise ValueError("the vocabulary has no token for some byte")
        live.append(new)
        shortest = min([len(x[2]) for x in live])
        common, ahead = 0, new[2]
        while common < shortest and all(x[2][common] == ahead[common] for x in live):
            common += 1
        key = tuple([(node, last, out[common:]) for node, last, out in live]) if common else tuple(live)
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        self.moves[state][byte] = move = (at, ahead[:common])
        return move

    def run(self, piece: bytes) -> tuple[int, ...]:
        whole = self.vocabulary.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.states) > MOST_STATES:
            self._reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            move = moves[state].get(byte)
            if move is None:
                if len(moves) > 2 * MOST_STATES:  # within one very long piece: begin anew from this state
                    here = self.states[state]
                    self._reset()
                    moves = self.moves
                    state = self.number.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                        moves.append({})
                move = self._move(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        return (*out, *self.states[state][-1][2])  # the last prefix is the whole piece


def plain_pattern(pattern: str, most: int) -> str:
    """The pattern with its classes of letters, numbers and spaces written out as code points, for texts with code
    points up to `most`. Short lists of ranges are much faster to match."""
    newer = {c for a, b in NEWER for c in range(a, b + 1)}
    # in blocks: a string for each of a million code points would take more memory than all tables of a worker
    every = "".join(["".join([chr(c) for c in range(at, min(at + POINTS_AT_ONCE, most + 1)) if not 0xD800 <= c <= 0xDFFF and c not in newer])
                     for at in range(0, most + 1, POINTS_AT_ONCE)])

    def ranges(prop: str) -> str:
        found = []
        for m in regex.finditer(f"{prop}+", every):
            first = last = ord(every[m.start()])
            for c in map(ord, m.group()[1:]):
                if c != last + 1:
                    found.append((first, last))
                    first = c
                last = c
            found.append((first, last))
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)

    letters, numbers, spaces = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", spaces).replace(r"\p{L}", letters).replace(r"\p{N}", numbers), pattern)
    for name, body in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
        inside = inside.replace(name, body)
    return inside


class Utf8Stream:
    """Releases whole characters of a stream of bytes; an unfinished one waits for its bytes.

    The state is how many bytes the character still lacks, with the bounds of the next one; `wait` holds its bytes.
    """

    def __init__(self):
        self.wait = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of the character at the end that lacks bytes; 0 if there is none."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            needs = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if needs <= back:
                return 0
            if back > 1:  # the second byte has narrower bounds after some leads
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> bytes:
        data = self.wait + data
        keep = self._unfinished(data)
        self.wait = data[len(data) - keep:]
        return data[:len(data) - keep]

    def finish(self) -> bytes:
        last, self.wait = self.wait, b""
        return last


class Codec:
    """Encoder and streaming decoder of one vocabulary and one pattern that cuts texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.transducer = Transducer(self.vocabulary)
        self.pattern = re.compile(plain_pattern(pattern, 0xFFFF))
        self.any_pattern = re.compile(plain_pattern(pattern, sys.maxunicode))
        self.pieces: dict[str, tuple[int, ...]] = {}  # two generations of pieces: the older one goes when the younger is full
        self.older: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Tokens of a piece that is not among the young ones."""
        found = self.older.get(piece)
        if found is None:
            found = self.transducer.run(piece.encode("utf-8"))
        if len(piece) <= 64:
            if len(self.pieces) >= MOST_PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = found  # `known` of a block under way may be the older table: slower, never wrong
        return found

    def encode_blocks(self, text: str) -> Iterator[array]:
        """Token ids, in blocks of bounded size."""
        raw = text.encode("utf-8")
        pattern = self.pattern if len(raw.translate(None, FOUR_BYTES)) == len(raw) else self.any_pattern
        if len(text) <= LONG_TEXT:
            cut: Iterable[str] = pattern.findall(text)
        else:
            cut = (m.group() for m in pattern.finditer(text))
        cut = iter(cut)
        while block := list(islice(cut, PIECES_AT_ONCE)):
            known, other = self.pieces.get, self._piece
            yield array("I", list(chain.from_iterable([known(piece) or other(piece) for piece in block])))

    def encode(self, text: str) -> list[int]:
        return [i for block in self.encode_blocks(text) for i in block]

    def decode_stream(self, blocks: Iterable[Iterable[int]]) -> Iterator[bytes]:
        """Bytes of the tokens, cut between characters."""
        of, stream = self.vocabulary.bytes_of, Utf8Stream()
        for block in blocks:
            yield stream.feed(b"".join([of[i] for i in block]))
        yield stream.finish()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(part.decode("utf-8", "replace") for part in self.decode_stream([ids]))

    def digest(self, text: str) -> dict:
        """Number of tokens, and digests of the ids and of what the decoder makes of them."""
        n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()

        def seen() -> Iterator[array]:
            nonlocal n
            for block in self.encode_blocks(text):
                n += len(block)
                raw = array("I", block)
                if sys.byteorder == "big":
                    raw.byteswap()
                ids_sha.update(raw.tobytes())
                yield block

        for part in self.decode_stream(seen()):
            text_sha.update(part)
        return {"n_tokens": n, "ids_sha256": ids_sha.hexdigest(), "decoded_sha256": text_sha.hexdigest()}


def _codec(ranks: dict[bytes, int], name: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary, so that its tables are kept from batch to batch."""
    return worker_tables((name, pattern), lambda: Codec(ranks, pattern))


DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _shared(docs: DataFrame, ranks: dict[bytes, int], pattern: str):
    name = hashlib.sha256(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: some 50,000 entries
    return lambda: _codec(sent.value, name, pattern)


def encode_digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", into: str = "_bpe") -> DataFrame:
    """All columns and a struct `into`: n_tokens, ids_sha256, decoded_sha256. No shuffle."""
    codec = _shared(docs, ranks, pattern)
    udf = text_udf(lambda texts: [codec().digest(t.decode("utf-8", "replace")) for t in texts],
                   "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>", DIGEST, keeps_tables=True)
    return docs.select("*", udf(F.col(f"`{text_col}`")).alias(into))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """All columns and the token ids as an array of ints."""
    codec = _shared(docs, ranks, pattern)
    udf = text_udf(lambda texts: [codec().encode(t.decode("utf-8", "replace")) for t in texts],
                   "array<int>", pa.list_(pa.int32()), keeps_tables=True)
    return docs.select("*", udf(F.col(f"`{text_col}`")).alias(into))


def decode(rows: DataFrame, ranks: dict[bytes, int], pattern: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """All columns and the text of the token ids; malformed bytes become the replacement character."""
    codec = _shared(rows, ranks, pattern)

    def run(ids: pa.Array) -> pa.Array:
        return pa.array([codec().decode(x or []) for x in ids.to_pylist()], pa.string())

    run.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return rows.select("*", F.arrow_udf(run, "string")(F.col(f"`{ids_col}`")).alias(into))
