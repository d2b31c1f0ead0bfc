"""Scoring users against items and keeping the best.

Items are cut into parts and users into chunks, both of bounded size. For the best items one task walks the parts of a lane with
a chunk of users and their k best so far (`walk`), so only `k` rows per user and lane leave it, however many parts
there are. Scores are rounded to SCORE_DIGITS and ties go to the lower item id.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldstream.functions.vectors import empty, length_sq
from foldstream.operators.walk import (SCORE_DIGITS, USERS, all_of, by_length, found_in_lane, scored_pairs, sum_up, summaries,
                                       walk)
from foldstream.session import cut_lineage

PART_ITEMS = 65_536
#: The more items a walk puts in boxes at once, the smaller the boxes.
BOXED_ITEMS = 262_144
CHUNK_USERS = 65_536
#: A copy of the items goes to every chunk, so where there are more chunks than cores need, they hold users of so many bytes.
CHUNK_BYTES = 200 << 20
#: Chunks are made smaller, down to this, before the items of a chunk are shared between tasks.
LEAST_CHUNK_USERS = 256
#: Parts that one task walks at most: bounds what is lost with a task.
LANE_PARTS = 64
PART_BLOCKS, BLOCK_ITEMS = 16, 4096
CELLS_PER_CORE = 2
#: Coordinates that bound a score before it is computed.
FOCUS = 5

_PICKED = "user_id bigint, item_id bigint, score double, rank int"
_ENTRIES = "struct<ids: array<bigint>, values: array<double>>"


def _chunk_of(n: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(n)).cast("int")


def _for_chunks(items: DataFrame, by: list[str], chunks: int, part_items: int) -> DataFrame:
    """Items packed first, so that a chunk's copy of them is a few large rows: (by, entries, chunk)."""
    blocks = max(1, min(PART_BLOCKS, ceil(part_items / BLOCK_ITEMS)))
    packed = items.groupBy(*by, F.pmod(F.xxhash64("item_id", F.lit(1)), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct(F.col("item_id").cast("bigint").alias("item_id"), "vec")).alias("l"))
    # the numbers of all items in one array: an array for each takes half as much room again
    entries = F.struct(F.col("l")["item_id"].alias("ids"), F.flatten(F.col("l")["vec"]).alias("values")).alias("entries")
    return packed.select(*by, entries).select(*by, "entries", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _chunks(n_users: int, wanted: int) -> int:
    """Number of chunks of users, `wanted` of them if that leaves them neither large nor tiny."""
    return max(1, ceil(n_users / CHUNK_USERS), min(wanted, ceil(n_users / LEAST_CHUNK_USERS)))


def _lanes(n_parts: int, n_users: int, cores: int) -> int:
    """Number of lanes: one, unless a lane would be too long or the chunks are too few to keep all cores at work."""
    wanted = cores * CELLS_PER_CORE
    return max(1, min(n_parts, max(ceil(n_parts / LANE_PARTS), ceil(wanted / _chunks(n_users, wanted)))))


def _fewer_chunks(items: DataFrame, n_users: int, wanted: int, chunks: int, k: int) -> int:
    """As many chunks as hold users of CHUNK_BYTES with their `k` best, if that is less than `chunks` and still `wanted`."""
    if n_users <= CHUNK_USERS * wanted:
        return chunks
    first = items.select(F.size("vec").alias("dim")).first()
    held = 16 * k + 48 * (first["dim"] if first else 0) + 64
    return min(chunks, max(wanted, ceil(n_users * held / CHUNK_BYTES)))


def _walk_lanes(visits: DataFrame, items: DataFrame, n_users: int, n_lanes: int, kernel: Callable, k: int,
                schema: str = _PICKED, part_items: int = PART_ITEMS) -> DataFrame:
    """Run `kernel` on every cell of a chunk of users and a lane, with the lane's parts in order.

    visits: (user_id, vec, lane, floor), one row per lane a user visits; items: (item_id, vec, lane, part).
    """
    wanted = ceil(_cores(visits) * CELLS_PER_CORE / n_lanes)
    chunks = _fewer_chunks(items, n_users, wanted, _chunks(n_users, wanted), k)
    left = visits.select(_chunk_of(chunks).alias("chunk"), "lane", F.lit(USERS).alias("part"), F.col("user_id").cast("bigint").alias("user_id"),
                         "vec", "floor", F.struct(empty("array<bigint>").alias("ids"), empty("array<double>").alias("values")).alias("entries"))
    right = _for_chunks(items, ["lane", "part"], chunks, part_items).select(
        "chunk", "lane", "part", F.lit(None).cast("bigint").alias("user_id"), empty("array<double>").alias("vec"),
        F.lit(None).cast("double").alias("floor"), "entries")
    # a task for each cell: cells are few but each is much work, and by hash some tasks would get several
    cell = (F.col("chunk") * n_lanes + F.col("lane")).cast("int")
    return (left.unionByName(right).repartitionById(chunks * n_lanes, cell)
            .sortWithinPartitions("chunk", "lane", "part").mapInArrow(kernel, schema))


def _hashed_parts(items: DataFrame, n_items: int, part_items: int) -> tuple[DataFrame, int]:
    n = max(1, ceil(n_items / part_items))
    return items.select("item_id", "vec", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int").alias("part")), n


def ranked(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Rows with rank 1..k per `by`, best score first, ties to the lower item id."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc("item_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _merge(picked: DataFrame, k: int, n_lanes: int) -> DataFrame:
    """Best of the lanes' best: at most n_lanes * k rows per user. One lane has ranked its rows."""
    if n_lanes == 1:
        return picked
    return ranked(picked.drop("rank"), k, ["user_id"])


def _to_lanes(users: DataFrame, n_lanes: int) -> DataFrame:
    return users.select("user_id", "vec", F.explode(F.sequence(F.lit(0), F.lit(n_lanes - 1))).alias("lane"), F.lit(-inf).alias("floor"))


def _dealt(parted: DataFrame, n_lanes: int, first: int = 0) -> DataFrame:
    """Parts from `first` on, dealt over the lanes in turn."""
    return parted.withColumn("lane", F.pmod(F.col("part") - F.lit(first), F.lit(n_lanes)).cast("int"))


def topk(users: DataFrame, items: DataFrame, k: int, part_items: int = BOXED_ITEMS, n_users: int | None = None,
         n_items: int | None = None) -> DataFrame:
    """(user_id, item_id, score, rank): each user's k best of all items. Users must be distinct. Counts that are known
    already need not be taken again."""
    n_users = users.count() if n_users is None else n_users
    parted, n_parts = _hashed_parts(items, items.count() if n_items is None else n_items, part_items)
    lanes = _lanes(n_parts, n_users, _cores(users))
    picked = _walk_lanes(_to_lanes(users, lanes), _dealt(parted, lanes), n_users, lanes, walk(k, all_of), k, part_items=part_items)
    return _merge(picked, k, lanes)


def score_summary(users: DataFrame, items: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """Every user scored against every item: (user_id, n, mean, lo, hi) of the scores."""
    n_users = users.count()
    parted, n_parts = _hashed_parts(items, items.count(), part_items)
    lanes = _lanes(n_parts, n_users, _cores(users))
    cells = _walk_lanes(_to_lanes(users, lanes), _dealt(parted, lanes), n_users, lanes, walk(1, sum_up, summaries), 1,
                        "user_id bigint, n bigint, total double, lo double, hi double", part_items)
    return cells.groupBy("user_id").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def local_topk(users: DataFrame, items: DataFrame, k: int, part_items: int = BOXED_ITEMS) -> DataFrame:
    """(user_id, shard, item_id, score, rank): the k best of each item shard.

    items: (item_id, vec, shard). With a column `shard` on `users` too, a user sees that shard only.
    A shard above `part_items` lies in several parts, which one task walks; only a shard of more than LANE_PARTS
    parts has several lanes that are merged here.
    """
    sizes = items.groupBy("shard").count().collect()  # one row per shard of the model
    layout, shard_of, parts = [], [], 0
    for row in sizes:
        n = ceil(row["count"] / part_items)
        lanes = ceil(n / LANE_PARTS)
        layout.append((row["shard"], parts, n, len(shard_of), lanes))
        shard_of += [(len(shard_of) + i, row["shard"]) for i in range(lanes)]
        parts += n
    spark = items.sparkSession
    known = F.broadcast(spark.createDataFrame(layout, "shard int, first int, n int, lane0 int, lanes int"))
    in_shard = F.pmod(F.xxhash64("item_id"), F.col("n"))
    parted = items.join(known, "shard").select(
        "item_id", "vec", (F.col("first") + in_shard).cast("int").alias("part"),
        (F.col("lane0") + F.pmod(in_shard, F.col("lanes"))).cast("int").alias("lane"))
    n_lanes = max(len(shard_of), 1)
    if "shard" in users.columns:
        visits = users.join(known, "shard").select(
            "user_id", "vec", F.explode(F.sequence(F.col("lane0"), F.col("lane0") + F.col("lanes") - 1)).alias("lane"), F.lit(-inf).alias("floor"))
    else:
        visits = _to_lanes(users, n_lanes)
    # the user's rows say which lane they come from
    picked = _walk_lanes(visits, parted, users.count(), n_lanes, walk(k, all_of, found_in_lane), k, _PICKED + ", lane int", part_items)
    in_shards = picked.join(F.broadcast(spark.createDataFrame(shard_of, "lane int, shard int")), "lane").drop("lane")
    if all(lanes == 1 for *_, lanes in layout):
        return in_shards
    return ranked(in_shards.drop("rank"), k, ["user_id", "shard"])


def pruned_topk(users: DataFrame, items: DataFrame, k: int, bucket_size: int = 75, part_items: int = PART_ITEMS,
                focus: int = FOCUS) -> DataFrame:
    """The result of `topk`, skipping items too short to reach a user's k-th score and, from the products over the `focus`
    greatest coordinates of the user, those that point elsewhere (see `walk.by_length`).

    Parts follow falling vector length, so a task that walks all of them prunes better with each. With several lanes all
    users score the longest part first; its k-th score is the bar a lane's greatest length must clear for the user to
    visit it, and what a lane reports.
    """
    return _pruned(users, items, k, bucket_size, part_items, focus)


def pruned_pairs(users: DataFrame, items: DataFrame, k: int, bucket_size: int = 75, part_items: int = PART_ITEMS,
                 focus: int = FOCUS) -> DataFrame:
    """(user_id, scored): how many items `pruned_topk` scores for each user."""
    return _pruned(users, items, k, bucket_size, part_items, focus, count=True)


def _pruned(users: DataFrame, items: DataFrame, k: int, bucket_size: int, part_items: int, focus: int,
            count: bool = False) -> DataFrame:
    n_users, n_items = users.count(), items.count()
    search = by_length(bucket_size, focus)
    kernel, schema = (walk(k, search, scored_pairs), "user_id bigint, scored bigint") if count else (walk(k, search), _PICKED)
    measured = items.select("item_id", "vec", F.sqrt(length_sq(F.col("vec"))).alias("length"))
    n = max(1, ceil(n_items / part_items))
    if n == 1:
        return _walk_lanes(_to_lanes(users, 1), measured.select("item_id", "vec", F.lit(0).alias("lane"), F.lit(0).alias("part")),
                           n_users, 1, kernel, k, schema, part_items)

    inner = measured.approxQuantile("length", [i / n for i in range(1, n)], 1.0 / (4 * n))
    splits = [-inf, *sorted(set(inner)), inf]
    banded = Bucketizer(splits=splits, inputCol="length", outputCol="band").transform(measured)
    # one row per band; a band of equal lengths may be large and is split further by hash
    bands = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("top")).collect()
    layout, tops = [], []
    for row in sorted(bands, key=lambda r: -r["band"]):
        m = ceil(row["n"] / part_items)
        layout.append((row["band"], len(tops), m))
        tops.extend([row["top"]] * m)
    spark = items.sparkSession
    parted = banded.join(F.broadcast(spark.createDataFrame(layout, "band double, first int, m int")), "band").select(
        "item_id", "vec", (F.col("first") + F.pmod(F.xxhash64("item_id"), F.col("m"))).cast("int").alias("part"))

    # a lane's length counts by its items: many small parts are no more work than a few large ones
    lanes = _lanes(min(len(tops), max(LANE_PARTS, ceil(n_items / PART_ITEMS))), n_users, _cores(users))
    if lanes == 1:
        return _walk_lanes(_to_lanes(users, 1), _dealt(parted, 1), n_users, 1, kernel, k, schema, part_items)
    # k rows per user, read twice below
    longest = _dealt(parted.where(F.col("part") == 0), 1)
    first = cut_lineage(_walk_lanes(_to_lanes(users, 1), longest, n_users, 1, walk(k, search), k, part_items=part_items))
    bars = first.groupBy("user_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-inf)).alias("floor"))
    lanes = min(lanes, len(tops) - 1)
    reach = F.sqrt(length_sq(F.col("vec"))) * (1 + 1e-12)
    # tops fall from part to part, so a lane's first part has its longest item; one row per lane
    later = F.broadcast(spark.createDataFrame([(i, float(tops[i + 1])) for i in range(lanes)], "lane int, top double"))
    bound = F.col("top") * F.col("reach") + 10.0 ** -SCORE_DIGITS
    visits = (users.join(bars, "user_id").withColumn("reach", reach)
              .join(later, F.isnan(bound) | (bound >= F.col("floor"))).select("user_id", "vec", "floor", "lane"))
    more = _walk_lanes(visits, _dealt(parted.where(F.col("part") > 0), lanes, 1), n_users, lanes, kernel, k, schema, part_items)
    if count:
        # the longest part again, for its count alone
        counted = _walk_lanes(_to_lanes(users, 1), longest, n_users, 1, kernel, k, schema, part_items)
        return counted.unionByName(more).groupBy("user_id").agg(F.sum("scored").alias("scored"))
    return _merge(first.unionByName(more), k, lanes + 1)


def collect_lists(ranks: DataFrame, order: str = "descending", by: str = "user_id") -> DataFrame:
    """One row per user with `topk`, an array of item ids of at most k entries.

    "descending" puts the best item first, "ascending" last.
    """
    if order not in ("ascending", "descending"):
        raise ValueError(f"order: {order}")
    position = F.col("rank") if order == "descending" else -F.col("rank")
    packed = ranks.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(position.alias("at"), "item_id"))).alias("l"))
    return packed.select(by, F.transform("l", lambda x: x["item_id"]).alias("topk"))
