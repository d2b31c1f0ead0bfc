"""Near-duplicates by SimHash fingerprints, linked by a self-join of their binary trie.

Fingerprints are sorted; a node of the trie is a run of them with a common prefix. Two nodes are visited
together with the number of bits in which their prefixes differ, and the pair is dropped as soon as that
exceeds the budget. The upper levels are Spark joins of node tables: a node with too many fingerprints is
split again and again, so a pair of nodes handed to one task has bounded size however alike the
fingerprints are. Below, a task walks its pair of nodes in numpy and keeps a spanning forest of the links,
never all pairs. The forests give connected components.

Equal fingerprints are one trie entry from the start, so copies, however many, cost nothing.

Defined results: null, empty and wordless texts have the fingerprint zero and link like any other. Repeated
rows share a fingerprint and a group. A null doc_id belongs to its group but is never its smallest id, unless
all are null. Other columns play no part.

`keep_one_alike` groups by similarity of the texts themselves: documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. At that similarity fingerprints differ in some ten bits of 64, which no trie join carries.
So fingerprints give the first links, each confirmed on the shingles, and a prefix join finds all others: two sets that
similar share one of the first n - ceil(0.8 n) + 1 of their n hashes, in any order that all sets have in common. Hashes
in many sets come last in it, and hashes whose sets are all linked already are dropped, before pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstream.llm.common import apply_copies, identity_columns, small_batches, small_or_not, staged, text_udf
from foldstream.llm.components import component_of

SEED = 42
SHINGLE = 3
BUDGET = 2
#: A node with more fingerprints than this is split before it is handed to a task.
NODE_ROWS = 65_536
LEAST_DEPTH, STEP = 4, 4
#: Node pairs that a task holds in one array.
PAIRS_AT_ONCE = 1 << 18
_BITS = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)


def shingles(text: bytes, size: int) -> list[bytes]:
    words = text.lower().split()  # bytes: only A-Z change, and only the ASCII spaces part words
    if not words:
        return []
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    if len(words) <= size:
        return [joined]
    starts = np.r_[0, ends[:-size]].tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[size - 1:] - 1).tolist(), strict=True)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned 64 bits: a bit is set if more than half of the shingles' hashes have it."""
    return _vote(shingles(text, size))


def _vote(found: list[bytes]) -> int:
    if not found:
        return 0
    votes, digest = np.zeros(64), xxhash.xxh64_digest
    for at in range(0, len(found), 1 << 16):
        block = np.frombuffer(b"".join([digest(s, SEED) for s in found[at:at + (1 << 16)]]), np.uint8)
        bits = np.unpackbits(block).reshape(-1, 64).astype(np.float32)
        votes += np.ones(len(bits), np.float32) @ bits  # exact: at most 2 ** 16 ones
    return int(_BITS[2 * votes > len(found)].sum(dtype=np.uint64))


def with_fingerprint(docs: DataFrame, text_col: str = "text", into: str = "_fp") -> DataFrame:
    """All columns and the fingerprint, its 64 bits as a long. No shuffle."""
    udf = text_udf(lambda texts: [int(np.uint64(fingerprint(t)).astype(np.int64)) for t in texts], "long", pa.int64())
    return docs.select("*", udf(text_col).alias(into))


# --- a pair of nodes inside one task ------------------------------------------------------------------------


class Forest:
    """Components of numbered items; of the links it is told, it keeps those that join two of them."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(self.root, up := self.root[self.root]):
                self.root = up


def trie_links(a: np.ndarray, b: np.ndarray | None, depth: int, used: int, budget: int = BUDGET) -> np.ndarray:
    """Component of each of the fingerprints a, then b, under links of `budget` or fewer differing bits.

    a, b: sorted, distinct, each with one prefix of `depth` bits, those prefixes differing in `used` bits.
    Without b the node is paired with itself.
    """
    both = a if b is None else np.concatenate([a, b])
    forest = Forest(len(both))
    second = (0, len(a)) if b is None else (len(a), len(both))
    # a pair: low and high end of either run, bits that differ so far, depth
    stack = [(depth, np.array([[0, len(a), *second, used]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if depth == 64:
            forest.link(pairs[:, 0], pairs[:, 2])
            continue
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if single.any():  # two single fingerprints: the rest of the bits at once
            x, y = pairs[single, 0], pairs[single, 2]
            near = np.bitwise_count(both[x] ^ both[y]) <= budget
            forest.link(x[near], y[near])
            pairs = pairs[~single]
        if not len(pairs):
            continue
        # nothing is left to learn from runs that are one component already
        mixed = _spread(forest.root, pairs)
        pairs = pairs[mixed]
        if not len(pairs):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        cut_a, cut_b = _cut(both, pairs[:, 0], pairs[:, 1], bit), _cut(both, pairs[:, 2], pairs[:, 3], bit)
        lo_a, hi_a, lo_b, hi_b, differ = pairs.T
        own = (lo_a == lo_b) & (hi_a == hi_b)
        children = [np.stack(c, 1) for c in (
            (lo_a, cut_a, lo_b, cut_b, differ), (cut_a, hi_a, cut_b, hi_b, differ), (lo_a, cut_a, cut_b, hi_b, differ + 1))]
        children.append(np.stack((cut_a, hi_a, lo_b, cut_b, differ + 1), 1)[~own])
        new = np.concatenate(children)
        new = new[(new[:, 4] <= budget) & (new[:, 1] > new[:, 0]) & (new[:, 3] > new[:, 2])]
        new = new[~((new[:, 0] == new[:, 2]) & (new[:, 1] == new[:, 3]) & (new[:, 1] - new[:, 0] == 1))]
        stack += [(depth + 1, new[at:at + PAIRS_AT_ONCE]) for at in range(0, len(new), PAIRS_AT_ONCE)]
    return forest.root


def _spread(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Which pairs of runs hold fingerprints of more than one component."""
    changes = np.r_[0, np.cumsum(root[1:] != root[:-1])]
    whole = (changes[pairs[:, 1] - 1] == changes[pairs[:, 0]]) & (changes[pairs[:, 3] - 1] == changes[pairs[:, 2]])
    return ~(whole & (root[pairs[:, 0]] == root[pairs[:, 2]]))


def _cut(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where, in each sorted run with a common prefix, the fingerprints with `bit` set begin."""
    ones = np.r_[0, np.cumsum((values & bit) != 0)]
    return high - (ones[high] - ones[low])


# --- the upper levels, in Spark ------------------------------------------------------------------------------


def trie_nodes(fps: DataFrame, node_rows: int = NODE_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """Cut the trie of distinct fingerprints (`_fp`) into nodes of at most `node_rows`.

    Gives the fingerprints with `_depth` and `_prefix` of their node, all nodes (also those that were split)
    with `_split`, and the depth of the first cut. Each further cut touches only what is still too large.
    """
    n = fps.count()
    first = min(64, max(LEAST_DEPTH, ceil(log2(max(n, 1) / node_rows)) if n > node_rows else 0))
    waiting, depth, done, nodes = fps, first, None, None
    while waiting is not None:
        here = waiting.withColumn("_depth", F.lit(depth)).withColumn("_prefix", F.shiftrightunsigned("_fp", 64 - depth))
        sizes = staged(here.groupBy("_depth", "_prefix").agg(F.count("*").alias("_n"))
                       .withColumn("_split", (F.col("_n") > 4 * node_rows) & (F.col("_depth") < 64)), "trie-nodes")
        level = sizes.drop("_n")
        nodes = level if nodes is None else nodes.unionByName(level)
        if sizes.where("_split").isEmpty():
            done = here if done is None else done.unionByName(here)
            break
        large = sizes.where("_split").select("_prefix")
        small = here.join(large, "_prefix", "left_anti")
        done = small if done is None else done.unionByName(small)
        waiting = staged(here.join(large, "_prefix", "left_semi").drop("_depth", "_prefix"), "trie-large")
        depth = min(64, depth + STEP)
    return done, nodes, first


def _flips(depth: int, budget: int) -> list[int]:
    """All masks of `depth` bits with at most `budget` bits set."""
    masks, last = [0], [0]
    for _ in range(budget):
        last = sorted({m | (1 << i) for m in last for i in range(depth) if not m >> i & 1})
        masks += last
    return masks


def node_pairs(nodes: DataFrame, first: int, budget: int = BUDGET) -> DataFrame:
    """Pairs of unsplit nodes whose prefixes differ in at most `budget` bits: _da, _pa, _db, _pb, _used.

    The frontier starts with the nodes of the first cut and their neighbours; where a node was split, the pair
    is replaced by the pairs of its children, and those beyond the budget are pruned.
    """
    top = nodes.where(F.col("_depth") == first)
    masks = F.explode(F.lit(_flips(first, budget)).cast("array<long>"))  # 2,081 at most
    a = top.select(F.col("_depth").alias("_da"), F.col("_prefix").alias("_pa"), F.col("_split").alias("_sa"))
    b = top.select(F.col("_depth").alias("_db"), F.col("_prefix").alias("_pb"), F.col("_split").alias("_sb"))
    pairs = (a.withColumn("_mask", masks).withColumn("_pb", F.col("_pa").bitwiseXOR(F.col("_mask")))
             .where("_pa <= _pb").withColumn("_used", F.bit_count("_mask")).drop("_mask").join(b, "_pb"))
    done, depth = pairs.where("not _sa and not _sb"), first
    while not nodes.where((F.col("_depth") == depth) & F.col("_split")).isEmpty():
        below = min(64, depth + STEP)
        bits = below - depth
        kids = nodes.where(F.col("_depth") == below)
        open_ = pairs.where("_sa or _sb")
        for side, other in (("a", "b"), ("b", "a")):
            own = kids.select(F.shiftrightunsigned("_prefix", bits).alias(f"_p{side}"), F.col("_prefix").alias("_kid"),
                              F.col("_split").alias("_kid_split"))
            split = open_.where(f"_s{side}").join(own, f"_p{side}").select(
                F.lit(below).alias(f"_d{side}"), F.col("_kid").alias(f"_p{side}"), F.col("_kid_split").alias(f"_s{side}"),
                f"_d{other}", f"_p{other}", f"_s{other}", "_used", F.lit(True).alias(f"_new{side}"),
                *([f"_new{other}"] if f"_new{other}" in open_.columns else []))
            rest = open_.where(f"not _s{side}").withColumn(f"_new{side}", F.lit(False))
            open_ = split.unionByName(rest)
        both = F.col("_newa") & F.col("_newb")
        low = (1 << bits) - 1
        more = F.bit_count(F.col("_pa").bitwiseXOR(F.col("_pb")).bitwiseAND(F.lit(low)))
        # a node beside itself, or a pair of children from one parent, comes up in both orders
        pairs = staged(open_.withColumn("_used", F.col("_used") + F.when(both, more).otherwise(0))  # else no new bit is common
                       .where((F.col("_used") <= budget) & ((F.col("_da") != F.col("_db")) | (F.col("_pa") <= F.col("_pb"))))
                       .drop("_newa", "_newb"), "trie-pairs")
        done, depth = done.unionByName(pairs.where("not _sa and not _sb")), below
    return done.select("_da", "_pa", "_db", "_pb", "_used")


def links(fps: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Distinct fingerprints `_fp` -> links (u, v) that span the components of the fingerprints."""
    placed, nodes, first = trie_nodes(fps, node_rows)
    pairs = node_pairs(nodes, first, budget)
    cell = ["_da", "_pa", "_db", "_pb"]
    at_a = placed.withColumnsRenamed({"_depth": "_da", "_prefix": "_pa"}).join(pairs, ["_da", "_pa"]).withColumn("_side", F.lit(0))
    other = pairs.where("_da != _db or _pa != _pb")
    at_b = placed.withColumnsRenamed({"_depth": "_db", "_prefix": "_pb"}).join(other, ["_db", "_pb"]).withColumn("_side", F.lit(1))
    rows = at_a.unionByName(at_b).select(*cell, "_used", "_side", "_fp")

    def walk(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth_a, _, depth_b, _ = (k.as_py() for k in key)
        held = [(x.column("_side").to_numpy(), x.column("_fp").to_numpy(), x.column("_used")[0].as_py()) for x in batches]
        side, fp = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        fp = fp.view(np.uint64)
        a, b = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        used, depth = held[0][2], min(depth_a, depth_b)
        root = trie_links(a, b if len(b) else None, depth, used, budget)
        both = np.concatenate([a, b]).view(np.int64)
        linked = np.nonzero(root != np.arange(len(root)))[0]
        yield pa.record_batch([both[linked], both[root[linked]]], names=["u", "v"])

    walk.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.groupBy(*cell).applyInArrow(walk, "u long, v long")


def groups(fingerprints: DataFrame, id_col: str = "doc_id", fp_col: str = "_fp", budget: int = BUDGET,
           node_rows: int = NODE_ROWS) -> DataFrame:
    """One row per distinct fingerprint: fp_col, `_group` (a fingerprint that stands for the component) and
    `component_id` (the smallest id in it)."""
    distinct = staged(fingerprints.groupBy(F.col(fp_col).alias("_fp")).agg(F.min(id_col).alias("_least")), "fingerprints")
    label = component_of(links(distinct.select("_fp"), budget, node_rows))
    # only linked fingerprints pass through the group-by
    linked = staged(distinct.join(label.withColumnsRenamed({"node": "_fp", "root": "_group"}), "_fp"), "linked")
    least = linked.groupBy("_group").agg(F.min("_least").alias("component_id"))
    found = linked.join(least, "_group").select("_fp", "_group", "component_id")
    return (distinct.join(found, "_fp", "left")
            .select(F.col("_fp").alias(fp_col), F.coalesce("_group", "_fp").alias("_group"),
                    F.when(F.col("_group").isNull(), F.col("_least")).otherwise(F.col("component_id")).alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET,
                    node_rows: int = NODE_ROWS) -> DataFrame:
    """One row per document: its id, `_fp`, `_group` and `component_id`."""
    marked = staged(with_fingerprint(docs.select(id_col, text_col), text_col).drop(text_col), "marked")
    return marked.join(groups(marked, id_col, "_fp", budget, node_rows), "_fp").select(
        id_col, "_fp", "_group", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET,
             node_rows: int = NODE_ROWS) -> DataFrame:
    """One document of each group, columns unchanged: the one with the smallest id (null last, then by content)."""
    known = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *identity_columns(docs))
    marked = staged(with_fingerprint(known, "_text").drop("_text"), "marked")
    grouped = marked.join(groups(marked, "_id", "_fp", budget, node_rows).select("_fp", "_group"), "_fp")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_row_a", "_row_b")
    first = grouped.groupBy("_group").agg(F.min(order).alias("first")).select("first._row_a", "first._row_b")
    often = marked.groupBy("_row_a", "_row_b").agg(F.count("*").alias("_rows"))
    return apply_copies(docs, first.join(often, ["_row_a", "_row_b"]).withColumn("_copies", F.lit(1)))


# --- groups by similarity of the shingles ------------------------------------------------------------------------

ALIKE_SHINGLE = 5
ALIKE = 0.8
#: The order of hashes: those in OFTEN or more documents of a sample come last, MOST_FREQUENT at most. It bears on cost alone.
SAMPLE_DOCS, SAMPLE_SHARE, OFTEN, MOST_FREQUENT = 4_000, 1 / 32, 4, 1_000_000
#: In hashes of more sets than this, one set is compared with all others before all pairs are formed.
MANY_SETS = 16


def hash_set(found: list[bytes]) -> np.ndarray:
    """The different hashes of shingles, ascending."""
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in found]), ">i8").astype(np.int64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _prefix(hashes: np.ndarray, frequent: np.ndarray, least: float) -> np.ndarray:
    """The hashes of which a set at least that similar has one in its own prefix; those in `frequent` come last."""
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[:len(hashes) - ceil(least * len(hashes) - 1e-9) + 1]


def _frequent(known: DataFrame, size: int) -> np.ndarray:
    """Hashes that are frequent among the shingles of a sample of the rows, ascending."""
    share = max(SAMPLE_SHARE, min(1.0, SAMPLE_DOCS / max(known.count(), 1)))
    some = known.where(F.pmod("_row_a", F.lit(1 << 20)) < int(share * (1 << 20))).select("_text")
    udf = text_udf(lambda texts: [hash_set(shingles(t, size)) for t in texts], "array<long>", pa.list_(pa.int64()))
    often = (some.select(F.explode(udf("_text")).alias("_hash")).groupBy("_hash").count().where(F.col("count") >= OFTEN)
             .orderBy(F.desc("count"), "_hash").limit(MOST_FREQUENT))
    return np.sort(np.array([r["_hash"] for r in often.select("_hash").toLocalIterator()], np.int64))


def _sets(known: DataFrame, size: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Every row with its set's key `_k`, size, fingerprint and prefix; and of each different set one of its rows."""
    sent = known.sparkSession.sparkContext.broadcast(_frequent(known, size))

    def mark(texts: list[bytes]) -> list[dict]:
        out = []
        for text in texts:
            found = shingles(text, size)
            hashes = hash_set(found)
            out.append({"k": int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64)), "n": len(hashes),
                        "fp": int(np.uint64(_vote(found)).astype(np.int64)), "low": _prefix(hashes, sent.value, least)})
        return out

    kind = pa.struct([("k", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("low", pa.list_(pa.int64()))])
    udf = text_udf(mark, "struct<k:long,n:long,fp:long,low:array<long>>", kind)
    marked = staged(known.withColumn("_set", udf("_text")).select(
        "_id", "_row_a", "_row_b", F.col("_set.k").alias("_k"), F.col("_set.n").alias("_n"), F.col("_set.fp").alias("_fp"),
        F.col("_set.low").alias("_low")), "marked")
    sets = staged(marked.groupBy("_k").agg(F.min(F.struct("_row_a", "_row_b")).alias("_row"), F.min("_fp").alias("_fp"),
                                           F.count("*").alias("_rows")), "sets")
    return marked, sets


def alike_links(known: DataFrame, marked: DataFrame, sets: DataFrame, size: int, least: float) -> DataFrame:
    """Links (u, v) between keys of sets that span all components of sets with a similarity of `least` or more."""
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for at in range(len(a)):
            x, y = (hash_set(shingles(t[at].as_py() or b"", size)) for t in (a, b))
            out.append(jaccard(x, y) >= least - 1e-9)
        return pa.array(out, pa.bool_())

    compare.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    alike = F.arrow_udf(compare, "boolean").asNondeterministic()

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs.distinct(), "alike-pairs")
        some = staged(pairs.select(F.explode(F.array("u", "v")).alias("_k")).distinct().join(sets, "_k").select(
            "_k", "_row._row_a", "_row._row_b"), "alike-keys")
        held = staged(known.join(small_or_not(some), ["_row_a", "_row_b"]).dropDuplicates(["_k"]).select(
            "_k", F.col("_text").cast("binary").alias("_text")), "alike-texts")
        return staged(pairs.join(held.withColumnsRenamed({"_k": "u", "_text": "_x"}), "u")
                      .join(held.withColumnsRenamed({"_k": "v", "_text": "_y"}), "v")
                      .select("u", "v", alike("_x", "_y").alias("_ok")).where("_ok").select("u", "v"), "alike-links")

    # near fingerprints: they bind large groups of near copies with one link a set
    near = sets.groupBy("_fp").agg(F.min("_k").alias("_least"))
    same = sets.join(near, "_fp").where("_k != _least").select(F.col("_k").alias("u"), F.col("_least").alias("v"))
    apart = (links(near.select("_fp"), BUDGET).join(near.select(F.col("_fp").alias("u"), F.col("_least").alias("_u")), "u")
             .join(near.select(F.col("_fp").alias("v"), F.col("_least").alias("_v")), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")))

    # one row of each set; size and position share a long
    copied = sets.where("_rows > 1").select("_k", "_row")
    single = (marked.join(small_or_not(copied), "_k", "left").where("_row is null or (_row._row_a = _row_a and _row._row_b = _row_b)"))
    place = F.shiftleft("_n", 32).bitwiseOR(F.col("_at").cast("long"))
    every = single.select("_k", "_n", F.posexplode("_low").alias("_at", "_hash")).select("_hash", "_k", place.alias("_place"))
    shared = every.groupBy("_hash").agg(F.min("_k").alias("_a"), F.max("_k").alias("_b")).where("_a != _b").select("_hash")
    cells = staged(every.join(shared, "_hash").distinct().select(
        "_hash", "_k", F.shiftright("_place", 32).alias("_n"), F.col("_place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("_at")), "alike-cells")
    fits = f"least(_n, _m) >= {least} * greatest(_n, _m) - 1e-9"
    overlap = f"{least / (1 + least)} * (_n + _m) - 1e-6"

    pivot = F.min(F.struct(F.xxhash64("_k").alias("by"), "_k", "_n", "_at")).alias("_p")
    large = cells.groupBy("_hash").agg(F.count("*").alias("_sets"), pivot).where(F.col("_sets") > MANY_SETS)
    star = (cells.join(large.select("_hash", F.col("_p._k").alias("v"), F.col("_p._n").alias("_m"), F.col("_p._at").alias("_to")), "_hash")
            .where("_k != v").where(fits).where(f"least(_n - _at, _m - _to) >= {overlap}").select(F.col("_k").alias("u"), "v"))
    found = confirmed(same.unionByName(apart).unionByName(star))

    # the rest: hashes whose sets are not all linked yet
    label = component_of(found).withColumnsRenamed({"node": "_k"})
    placed = staged(cells.join(label, "_k", "left").withColumn("_c", F.coalesce("root", "_k")).drop("root"), "alike-placed")
    mixed = placed.groupBy("_hash").agg(F.min("_c").alias("_ca"), F.max("_c").alias("_cb")).where("_ca != _cb").select("_hash")
    open_ = staged(placed.join(mixed, "_hash"), "alike-open")
    other = open_.withColumnsRenamed({"_k": "v", "_n": "_m", "_c": "_d", "_at": "_to"})
    # what the prefixes share and what is left behind the last hash they share must hold the overlap
    pairs = (open_.join(other, "_hash").where("_k < v and _c != _d").where(fits)
             .groupBy(F.col("_k").alias("u"), "v", "_n", "_m").agg(F.count("*").alias("_both"), F.max("_at").alias("_at"), F.max("_to").alias("_to"))
             .where(f"_both + least(_n - _at, _m - _to) - 1 >= {overlap}").select("u", "v"))
    return found.unionByName(confirmed(pairs))


def keep_one_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = ALIKE_SHINGLE,
                   least: float = ALIKE) -> DataFrame:
    """One document of each group linked by a shingle similarity of `least` or more, columns unchanged: the one with the
    smallest id (null last, then by content). Texts without words are one group."""
    known = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *identity_columns(docs))
    with small_batches(docs.sparkSession):
        return _keep_one_alike(docs, known, size, least)


def _keep_one_alike(docs: DataFrame, known: DataFrame, size: int, least: float) -> DataFrame:
    marked, sets = _sets(known, size, least)
    label = component_of(alike_links(known, marked, sets, size, least)).withColumnsRenamed({"node": "_k"})
    marked = marked.drop("_low")
    grouped = marked.join(label, "_k", "left").withColumn("_group", F.coalesce("root", "_k"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_row_a", "_row_b")
    first = grouped.groupBy("_group").agg(F.min(order).alias("first")).select("first._row_a", "first._row_b")
    often = marked.groupBy("_row_a", "_row_b").agg(F.count("*").alias("_rows"))
    return apply_copies(docs, first.join(often, ["_row_a", "_row_b"]).withColumn("_copies", F.lit(1)))
