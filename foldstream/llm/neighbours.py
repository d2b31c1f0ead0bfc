"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

Vectors get one more component so that all have the same length; then the largest inner product is the least distance.
Centroids come from halving a bounded sample again and again at the median, so every list holds about equally many. A
vector goes to its nearest list and, if it lies near a boundary, to other lists at nearly the same distance too (Chen et
al., 2021). Lists are found by a search in a graph of the centroids, held in
memory. A query visits the lists whose distance is within a ratio of the nearest one's. (list, part) cells of bounded size
are scored with exact inner products of the original vectors in double precision.

Equal vectors are one entry that stands for its least ids, as many as a result can show; so are queries with equal vectors.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part; neither do rows
without an id, nor vectors whose dimension is not the most frequent one. Rows with one id and one vector count once. Fewer
candidates than asked for give fewer rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstream.llm.common import staged


@dataclass(frozen=True)
class Lists:
    """sample_rows: vectors that centroids are fitted on. list_rows: vectors wanted in a list; there are never more lists than
    sample_rows / 8. replicas, boundary: most lists of a vector, and the distance ratio up to which it is copied.
    probes, ratio, sure: most lists of a query, the distance ratio up to which they are visited, and how many are visited whatever
    their distance (a query amid its copies is very near to one list). degree, beam: neighbours of a centroid in the graph, and
    candidates that a search keeps. part_rows: vectors of a cell; visit_rows: queries of a cell, about; query_rows: queries scored
    at once. fit_queries, wanted: with more lists than `probes`, so many queries are compared with all vectors, and probes is
    raised to what finds this share of their nearest ones.
    """

    sample_rows: int = 32_768
    list_rows: int = 256
    replicas: int = 3
    boundary: float = 1.15
    probes: int = 64
    ratio: float = 1.35
    sure: int = 16
    degree: int = 24
    beam: int = 96
    part_rows: int = 20_000
    visit_rows: int = 20_000
    query_rows: int = 512
    fit_queries: int = 64
    wanted: float = 0.96
    seed: int = 3


# --- centroids and their graph -----------------------------------------------------------------------------------


def balanced_centroids(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Means of `lists` equal shares of the sample, cut again and again across the line between two means."""
    rng = np.random.default_rng(seed)
    done, todo = [], [(np.arange(len(x)), lists)]
    while todo:
        at, n = todo.pop()
        if n <= 1 or len(at) <= 1:
            done.append(x[at].mean(axis=0))
            continue
        part = x[at]
        a, b = part[rng.choice(len(at), 2, replace=False)]
        for _ in range(6):
            nearer = ((part - a) ** 2).sum(axis=1) < ((part - b) ** 2).sum(axis=1)
            if nearer.all() or not nearer.any():
                break
            a, b = part[nearer].mean(axis=0), part[~nearer].mean(axis=0)
        left = n // 2
        order = np.argsort(part @ (a - b), kind="stable")
        cut = round(len(at) * left / n)
        todo += [(at[order[:cut]], left), (at[order[cut:]], n - left)]
    return np.array(done)


class CentroidGraph:
    """Centroids, each linked to its nearest ones; searched by best-first steps for many vectors at once."""

    def __init__(self, centroids: np.ndarray, degree: int, seed: int):
        self.c = np.ascontiguousarray(centroids, np.float32)
        n = len(self.c)
        self.norm = (self.c * self.c).sum(axis=1)
        degree = min(degree, n - 1)
        links = []
        for at in range(0, n, 1024):
            d = self.norm - 2 * self.c[at:at + 1024] @ self.c.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            links.append(np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree else np.empty((len(d), 0), int))
        near = np.concatenate(links)
        # some far links keep the graph in one piece
        far = np.random.default_rng(seed).integers(0, n, (n, 4))
        self.links = np.concatenate([near, far], axis=1)
        self.entries = np.linspace(0, n - 1, min(n, 4 * ceil(n**0.5))).astype(int)

    def search(self, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the `keep` nearest centroids found, and their squared distances, nearest first."""
        n, rows = len(self.c), len(x)
        keep = min(keep, n)
        x = x.astype(np.float32)
        own = (x * x).sum(axis=1)
        d = self.norm[self.entries] - 2 * x @ self.c[self.entries].T
        width = min(keep, len(self.entries))
        first = np.argpartition(d, width - 1, axis=1)[:, :width]
        ids = np.full((rows, keep), -1)
        dist = np.full((rows, keep), np.inf, np.float32)
        ids[:, :width], dist[:, :width] = self.entries[first], np.take_along_axis(d, first, 1)
        seen = np.zeros((rows, n), bool)
        seen[:, self.entries] = True
        opened = np.zeros((rows, keep), bool)
        line = np.arange(rows)
        live = line
        while len(live):
            waiting = np.where(opened[live] | (ids[live] < 0), np.inf, dist[live])
            step = np.argpartition(waiting, min(3, keep - 1), axis=1)[:, :min(4, keep)]  # the nearest unopened few
            some = np.isfinite(np.take_along_axis(waiting, step, 1))
            go = some.any(axis=1)
            live, step, some = live[go], step[go], some[go]
            if not len(live):
                break
            opened[live[:, None], step] |= some
            from_ = np.where(some, ids[live[:, None], step], ids[live, 0][:, None])
            next_ = self.links[from_].reshape(len(live), -1)
            new = ~seen[live[:, None], next_]
            seen[live[:, None], next_] = True
            cand = self.norm[next_] - 2 * np.einsum("rd,rkd->rk", x[live], self.c[next_])
            # a centroid may come up twice in one step: the later place loses
            order = np.argsort(next_, axis=1, kind="stable")
            ordered = np.take_along_axis(next_, order, 1)
            again = np.zeros_like(new)
            np.put_along_axis(again, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            cand = np.where(new & ~again, cand, np.inf)
            all_d = np.concatenate([dist[live], cand], axis=1)
            all_i = np.concatenate([ids[live], next_], axis=1)
            all_o = np.concatenate([opened[live], np.zeros_like(new)], axis=1)
            best = np.argpartition(all_d, keep - 1, axis=1)[:, :keep]
            dist[live], ids[live], opened[live] = (np.take_along_axis(v, best, 1) for v in (all_d, all_i, all_o))
            ids[live] = np.where(np.isfinite(dist[live]), ids[live], -1)
        order = np.argsort(dist, axis=1, kind="stable")
        dist = np.take_along_axis(dist, order, 1) + own[:, None]
        return np.take_along_axis(ids, order, 1), np.maximum(dist, 0)


    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `search`, of all centroids."""
        x = x.astype(np.float32)
        d = np.maximum(self.norm - 2 * x @ self.c.T + (x * x).sum(axis=1)[:, None], 0)
        ids = np.argsort(d, axis=1, kind="stable")
        return ids, np.take_along_axis(d, ids, 1)


def posting(graph: CentroidGraph, x: np.ndarray, how: Lists) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest list, and those at nearly its distance."""
    ids, dist = graph.search(x, min(how.beam, 4 * how.replicas))
    ids, dist = ids[:, :how.replicas], dist[:, :how.replicas]
    row, col = np.nonzero((ids >= 0) & (dist <= dist[:, :1] * how.boundary**2 + 1e-12))
    return row, ids[row, col]


def probing(graph: CentroidGraph, q: np.ndarray, how: Lists) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the lists a query visits."""
    if how.probes * 8 > len(graph.c):  # a large share of all lists: no search
        ids, dist = graph.all(q)
    else:
        ids, dist = graph.search(q, max(how.beam, how.probes))
    ids, dist = ids[:, :how.probes], dist[:, :how.probes]
    near = dist <= dist[:, :1] * how.ratio**2 + 1e-12
    near[:, :how.sure] = True
    row, col = np.nonzero((ids >= 0) & near)
    return row, ids[row, col]


def fitted(graph: CentroidGraph, posted: DataFrame, asked: DataFrame, k: int, longest: float, how: Lists) -> Lists:
    """`how` with the probes, and if need be without the ratio, that find `wanted` of the k nearest of some queries."""
    some = asked.orderBy("_a", "_b").limit(how.fit_queries).collect()
    if len(graph.c) <= how.probes or not some:
        return how
    q = np.array([r["_vec"] for r in some])
    ids, dist = graph.all(_query(q, longest))
    place = np.argsort(ids, axis=1)  # of each list
    inside = dist <= dist[:, :1] * how.ratio**2 + 1e-12
    inside[:, :how.sure] = True
    keys = {(r["_a"], r["_b"]): i for i, r in enumerate(some)}
    sent = asked.sparkSession.sparkContext.broadcast((q, place, keys))
    most = (k + 1) * how.replicas

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, place, keys = sent.value
        best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = q @ _matrix(batch.column("_vec")).T
            a, b, lists = (batch.column(c).to_numpy() for c in ("_a", "_b", "_list"))
            for i in range(len(q)):
                new = (scores[i], a, b.astype(np.int64), place[i, lists])
                near = np.argpartition(-scores[i], most - 1)[:most] if len(a) > most else np.arange(len(a))
                held = [np.concatenate([old, x[near]]) for old, x in zip(best[i], new, strict=True)]
                first = np.argsort(-held[0], kind="stable")[:most]
                best[i] = tuple(x[first] for x in held)
        for i, (score, a, b, at) in enumerate(best):
            other = np.array([keys.get((x, y)) != i for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
            yield pa.record_batch([pa.array(np.full(int(other.sum()), i, np.int32)), pa.array(a[other]), pa.array(b[other]), pa.array(score[other]),
                                   pa.array(at[other].astype(np.int32))], names=["_q", "_a", "_b", "_score", "_at"])

    seen = posted.select("_list", "_a", "_b", "_vec").mapInArrow(scan, "_q int, _a long, _b long, _score double, _at int")
    seen = seen.groupBy("_q", "_a", "_b").agg(F.max("_score").alias("_score"), F.min("_at").alias("_at"))
    first = W.partitionBy("_q").orderBy(F.desc("_score"), "_a", "_b")
    rows = seen.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k).select("_q", "_at").collect()
    if not rows:
        return how
    at = np.array([r["_at"] for r in rows])
    fine = inside[[r["_q"] for r in rows], at]
    ratio = how.ratio if fine.mean() >= how.wanted else float("inf")
    at = np.sort(np.where(fine, at, len(graph.c)) if np.isfinite(ratio) else at)
    return replace(how, ratio=ratio, probes=max(how.probes, int(at[ceil(how.wanted * len(at)) - 1]) + 1))


# --- tables --------------------------------------------------------------------------------------------------------


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(_id, _vec as array<double>, _a, _b) of the vectors that take part; _a, _b stand for the vector."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    some = rows.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.transform(vec, lambda v: v + F.lit(0.0)).alias("_vec")).where(
        F.col("_id").isNotNull() & fine)
    sizes = some.groupBy(F.size("_vec").alias("_dim")).count().orderBy(F.desc("count"), "_dim").first()
    dim = sizes["_dim"] if sizes else 0
    return some.where(F.size("_vec") == dim).select("*", F.xxhash64("_vec").alias("_a"), F.hash("_vec").alias("_b"))


def nearest(rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            how: Lists = Lists()) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row (condition over `_id`) its k nearest other rows, exact scores."""
    spark = rows.sparkSession
    good = usable(rows, id_col, vec_col)
    # an entry per different vector; of its ids the k + 1 least, limited before the shuffle
    least = good.dropDuplicates(["_a", "_b", "_id"]).withColumn(
        "_at", F.row_number().over(W.partitionBy("_a", "_b").orderBy("_id"))).where(F.col("_at") <= k + 1)
    entries = staged(least.groupBy("_a", "_b").agg(F.first("_vec").alias("_vec"), F.array_sort(F.collect_list("_id")).alias("_ids")), "entries")
    queries = staged(good.where(is_query).select("_id", "_a", "_b").distinct(), "queries")
    n, longest = entries.agg(F.count("*"), F.max(F.aggregate("_vec", F.lit(0.0), lambda s, v: s + v * v))).first()
    longest = float(longest or 1.0) ** 0.5

    share = min(1.0, how.sample_rows / max(n, 1))
    picked = entries.where(F.pmod(F.col("_a"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else entries
    sample = np.array([r["_vec"] for r in picked.select("_vec").limit(2 * how.sample_rows).toLocalIterator()]) if n else np.zeros((1, 1))
    lists = max(1, min(ceil(n / how.list_rows), len(sample) // 8))
    graph = CentroidGraph(balanced_centroids(_level(sample, longest), lists, how.seed), how.degree, how.seed)
    sent = spark.sparkContext.broadcast(graph)  # at most sample_rows / 8 centroids

    def spread(choose):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, how.query_rows):
                    batch = whole.slice(at, how.query_rows)
                    x = _matrix(batch.column("_vec"))
                    row, to = choose(sent.value, x)
                    taken = batch.take(pa.array(row))
                    yield pa.record_batch([pa.array(to, pa.int32()), *taken.columns], names=["_list", *taken.schema.names])
        return run

    kinds = "_list int, _a long, _b int, _vec array<double>"
    posted = staged(entries.select("_a", "_b", "_vec", "_ids").mapInArrow(
        spread(lambda g, x: posting(g, _level(x, longest), how)), f"{kinds}, _ids array<long>"), "postings")
    asked = entries.join(queries.select("_a", "_b").distinct(), ["_a", "_b"], "left_semi").select("_a", "_b", "_vec")
    fit = fitted(graph, posted, asked, k, longest, how)
    probes = asked.mapInArrow(spread(lambda g, x: probing(g, _query(x, longest), fit)), kinds)

    # lists that outgrow a cell are cut into parts, their queries into blocks, and each block goes to every part
    parts = posted.groupBy("_list").agg(F.ceil(F.count("*") / how.part_rows).cast("int").alias("_parts"))  # one row per list
    if asked.count() > how.visit_rows:
        often = probes.groupBy("_list").agg(F.ceil(F.count("*") / how.visit_rows).cast("int").alias("_blocks"))
        parts = parts.join(often, "_list")  # a list without queries goes
    else:
        parts = parts.withColumn("_blocks", F.lit(1))
    parts = F.broadcast(parts)
    cells = posted.join(parts, "_list").withColumn("_part", F.pmod("_a", "_parts").cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    visits = probes.join(parts, "_list").withColumn("_block", F.pmod(F.xxhash64("_a", "_b"), "_blocks").cast("int")).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    cell = ["_list", "_part", "_block"]
    found = (visits.select(*cell, "_a", "_b", "_vec").groupBy(*cell)
             .cogroup(cells.select(*cell, "_vec", "_ids").groupBy(*cell))
             .applyInArrow(_score(k + 1, how.query_rows), "_a long, _b int, _found array<struct<score:double,id:long>>"))
    # `probes` times parts, k + 1 each; sorted by id, what several lists found stands side by side
    by_id = F.array_sort(F.transform(F.flatten(F.collect_list("_found")), lambda x: F.struct(x["id"].alias("id"), (-x["score"]).alias("minus"))))
    merged = found.groupBy("_a", "_b").agg(by_id.alias("_by_id"))
    once = F.filter("_by_id", lambda x, i: (i == 0) | (F.get("_by_id", i - 1)["id"] != x["id"]))
    # nearest first, ties to the smaller id; one more than asked for, as the query itself may be among them
    best = merged.select("_a", "_b", F.slice(F.array_sort(
        F.transform(once, lambda x: F.struct(x["minus"].alias("minus"), x["id"].alias("id")))), 1, k + 1).alias("_best"))
    result = queries.join(best, ["_a", "_b"])
    first = F.slice(F.filter("_best", lambda x: x["id"] != F.col("_id")), 1, k)
    return (result.select("_id", F.posexplode(first).alias("_at", "_one"))
            .select(F.col("_id").alias("query_id"), (F.col("_at") + 1).cast("int").alias("rank"), F.col("_one.id").alias("vec_id"),
                    (-F.col("_one.minus")).alias("score")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _level(x: np.ndarray, longest: float) -> np.ndarray:
    """All vectors at the length of the longest, by one more component."""
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _query(x: np.ndarray, longest: float) -> np.ndarray:
    """Queries at the same length, with nothing in the added component: order of inner products stays."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.concatenate([x * (longest / size), np.zeros((len(x), 1))], axis=1)


def _score(k: int, query_rows: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))
        a, b, out = [], [], []
        if left.num_rows and right.num_rows:
            x = _matrix(right["_vec"].combine_chunks())
            ids = right["_ids"].to_pylist()
            least = np.array([i[0] for i in ids])
            for at in range(0, left.num_rows, query_rows):
                part = left.slice(at, query_rows)
                q = _matrix(part["_vec"].combine_chunks())
                rough = q @ x.T
                for row, (scores, ka, kb) in enumerate(zip(rough, part["_a"].to_pylist(), part["_b"].to_pylist(), strict=True)):
                    # a few more than k, so that rounding of the matrix product loses none
                    near = np.nonzero(scores >= np.partition(scores, max(len(scores) - k, 0))[max(len(scores) - k, 0)] - 1e-9 * (
                        1 + abs(scores).max()))[0]
                    exact = (x[near] * q[row]).cumsum(axis=1)[:, -1]  # term by term, as a plain sum gives it
                    order = np.lexsort((least[near], -exact))
                    held = []
                    for place, j in enumerate(order):
                        held += [{"score": float(exact[j]), "id": i} for i in ids[near[j]]]
                        if len(held) >= k and (place + 1 == len(order) or exact[order[place + 1]] < exact[j]):
                            break
                    held.sort(key=lambda h: (-h["score"], h["id"]))
                    a.append(ka)
                    b.append(kb)
                    out.append(held[:k])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(out, kind)], names=["_a", "_b", "_found"])

    run.__annotations__ = {"left": pa.Table, "right": pa.Table, "return": pa.Table}
    return run
