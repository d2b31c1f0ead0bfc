import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from table_rows import rows
from pyspark.sql import functions as F

from foldstream.operators import retrieval, walk

VECTORS = "array<double>"


def frame(spark, ids, matrix, name):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix)], f"{name} bigint, vec {VECTORS}")


def exact(user_ids, q, item_ids, v, k):
    scores = np.round(q @ v.T, retrieval.SCORE_DIGITS) + 0.0
    out = []
    for u, row in zip(user_ids, scores):
        order = sorted(range(len(item_ids)), key=lambda i: (-row[i], item_ids[i]))[:k]
        out += [(int(u), int(item_ids[i]), rank) for rank, i in enumerate(order, 1)]
    return sorted(out)


@pytest.fixture(scope="module", params=["spread", "ties", "equal lengths"])
def model(request, spark):
    rng = np.random.default_rng(5)
    q, v = rng.normal(size=(40, 6)), rng.normal(size=(500, 6))
    if request.param == "ties":
        q, v = np.round(q), np.round(v / 2)  # many equal scores, zero vectors included
    elif request.param == "spread":
        v *= 2.0 ** rng.integers(0, 8, size=(500, 1))
    else:
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    user_ids, item_ids = np.arange(100, 140), rng.permutation(1000)[:500]
    return (frame(spark, user_ids, q, "user_id"), frame(spark, item_ids, v, "item_id"), user_ids, q, item_ids, v)


def picked(df):
    return rows(df.select("user_id", "item_id", "rank"))


@pytest.mark.parametrize("part_items", [retrieval.PART_ITEMS, 60])
def test_topk_is_exact(model, part_items):
    users, items, *raw = model
    assert picked(retrieval.topk(users, items, 7, part_items)) == exact(*raw, 7)


@pytest.mark.parametrize("part_items", [retrieval.PART_ITEMS, 60])
def test_pruned_equals_exact(model, part_items):
    users, items, *raw = model
    assert picked(retrieval.pruned_topk(users, items, 7, 10, part_items)) == exact(*raw, 7)


def test_more_asked_than_there_is(model):
    users, items, *raw = model
    for run in (retrieval.topk, retrieval.pruned_topk):
        assert picked(run(users, items, 600, part_items=200)) == exact(*raw, 600)


@pytest.mark.parametrize("part_items", [retrieval.PART_ITEMS, 40])
def test_shards(model, part_items):
    """One shard holds most items; results do not depend on how it is cut."""
    users, items, user_ids, q, item_ids, v = model
    shard_of = np.where(item_ids % 10 == 0, 1, 0)
    sharded = items.withColumn("shard", F.when(F.col("item_id") % 10 == 0, 1).otherwise(0))
    got = rows(retrieval.local_topk(users, sharded, 3, part_items).select("shard", "user_id", "item_id", "rank"))
    expected = [(s, *r) for s in (0, 1) for r in exact(user_ids, q, item_ids[shard_of == s], v[shard_of == s], 3)]
    assert got == sorted(expected)
    one = rows(retrieval.local_topk(users.withColumn("shard", (F.col("user_id") % 2).cast("int")), sharded, 3, part_items)
               .select("shard", "user_id", "item_id", "rank"))
    assert one == sorted(r for r in expected if r[0] == r[1] % 2)


def test_summary(model):
    users, items, user_ids, q, _, v = model
    scores = q @ v.T
    got = rows(retrieval.score_summary(users, items, 90))
    for (u, n, mean, lo, hi), i in zip(got, range(len(user_ids))):
        assert (u, n) == (user_ids[i], 500)
        assert (mean, lo, hi) == pytest.approx((scores[i].mean(), scores[i].min(), scores[i].max()))


def test_no_items(spark, model):
    users = model[0]
    none = spark.createDataFrame([], f"item_id bigint, vec {VECTORS}")
    assert retrieval.topk(users, none, 5).count() == 0
    assert retrieval.pruned_topk(users, none, 5).count() == 0
    assert retrieval.local_topk(users, none.withColumn("shard", F.lit(0)), 5).count() == 0


def test_pruned_visits_few_parts(spark):
    """Two long items decide; parts of short items are visited by nobody."""
    items = spark.createDataFrame([(i, [100.0 if i < 2 else 0.001, 0.0]) for i in range(100)], f"item_id bigint, vec {VECTORS}")
    users = spark.createDataFrame([(u, [1.0, 0.5]) for u in range(5)], f"user_id bigint, vec {VECTORS}")
    got = picked(retrieval.pruned_topk(users, items, 2, 5, part_items=10))
    assert got == sorted((u, i, i + 1) for u in range(5) for i in range(2))


def test_lists(model):
    users, items, *raw = model
    ranks = retrieval.topk(users, items, 4)
    down = dict(rows(retrieval.collect_lists(ranks)))
    up = dict(rows(retrieval.collect_lists(ranks, "ascending")))
    assert all(up[u] == down[u][::-1] for u in down)
    expected = {}
    for u, i, _ in sorted(exact(*raw, 4), key=lambda r: (r[0], r[2])):
        expected.setdefault(u, []).append(i)
    assert down == expected


def test_cells_are_repartitioned_once(model):
    """Users and packed items meet in one shuffle; packing is the other."""
    users, items, *_ = model
    plan = retrieval.topk(users, items, 5)._jdf.queryExecution().executedPlan().toString()
    cells = plan[plan.index("MapInArrow"):]
    assert cells.count("Exchange") == 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_each_cell_has_a_task(spark, monkeypatch):
    """No task walks two cells: by hash some had three of them and others none."""
    monkeypatch.setattr(retrieval, "_chunks", lambda n_users, wanted: 7)
    monkeypatch.setattr(retrieval, "_lanes", lambda n_parts, n_users, cores: 3)
    vec = F.array(*(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 1000.0 for c in range(3)))
    users = spark.range(400).select(F.col("id").alias("user_id"), vec.alias("vec"))
    items = spark.range(300).select(F.col("id").alias("item_id"), vec.alias("vec"))
    n_lanes = []
    monkeypatch.setattr(retrieval, "_merge", lambda picked, k, lanes: n_lanes.append(lanes) or picked)
    picked = retrieval.topk(users, items, 2, part_items=100).withColumn("task", F.spark_partition_id())
    chunk = F.pmod(F.xxhash64("user_id"), F.lit(7))
    found = picked.select("task", chunk.alias("chunk")).distinct().collect()
    assert n_lanes == [3] and len({r["task"] for r in found}) == 21
    assert max(sum(r["task"] == t for r in found) for t in range(21)) == 1


@pytest.mark.parametrize("lanes", [1, 3])
@pytest.mark.parametrize("run", [retrieval.topk, retrieval.pruned_topk])
def test_a_lane_walks_many_parts(model, monkeypatch, lanes, run):
    monkeypatch.setattr(retrieval, "_lanes", lambda n_parts, n_users, cores: lanes)
    users, items, *raw = model
    assert picked(run(users, items, 7, part_items=20)) == exact(*raw, 7)


def test_rows_to_merge_do_not_grow_with_parts(model, monkeypatch):
    users, items, *_ = model
    monkeypatch.setattr(retrieval, "_lanes", lambda n_parts, n_users, cores: 2)
    merged = []
    monkeypatch.setattr(retrieval, "_merge", lambda df, k, lanes: merged.append(df.count()) or df)
    for part_items in (100, 10):
        retrieval.topk(users, items, 7, part_items)
    assert merged == [40 * 7 * 2] * 2


def test_a_large_shard_has_lanes(model, monkeypatch):
    monkeypatch.setattr(retrieval, "LANE_PARTS", 2)
    users, items, user_ids, q, item_ids, v = model
    sharded = items.withColumn("shard", F.when(F.col("item_id") % 10 == 0, 1).otherwise(0))
    got = rows(retrieval.local_topk(users, sharded, 3, 40).select("shard", "user_id", "item_id", "rank"))
    expected = [(s, *r) for s, at in ((0, item_ids % 10 != 0), (1, item_ids % 10 == 0)) for r in exact(user_ids, q, item_ids[at], v[at], 3)]
    assert got == sorted(expected)


@pytest.mark.parametrize("part_items", [retrieval.PART_ITEMS, 60])
@pytest.mark.parametrize("focus", [0, 1, 3])
def test_increments_do_not_change_the_result(model, focus, part_items):
    users, items, *raw = model
    assert picked(retrieval.pruned_topk(users, items, 7, 10, part_items, focus)) == exact(*raw, 7)


def test_increments_score_fewer_pairs(spark):
    """Vectors with few great coordinates: lengths alone cannot tell them apart."""
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(50, 10)) ** 3, rng.normal(size=(2000, 10)) ** 3
    users, items = frame(spark, range(50), q, "user_id"), frame(spark, range(2000), v, "item_id")
    scored = {focus: sum(n for _, n in rows(retrieval.pruned_pairs(users, items, 10, focus=focus))) for focus in (0, 3, 5)}
    assert scored[3] < scored[0] / 2 and scored[5] <= scored[3] and scored[0] < 50 * 2000
    assert picked(retrieval.pruned_topk(users, items, 10)) == exact(range(50), q, range(2000), v, 10)
    many = sum(n for _, n in rows(retrieval.pruned_pairs(users, items, 10, part_items=300)))
    assert 50 * 10 <= many < scored[0]


@pytest.mark.parametrize("part_items", [30, 1000])
def test_infinite_and_undefined_scores(spark, part_items):
    users = spark.createDataFrame([(1, [1.0, 0.0])], "user_id bigint, vec array<double>")
    finite = [(i, [float(i), 0.0]) for i in range(100)]
    low = [(200, [float("-inf"), 1.0]), (201, [float("inf"), 1.0])]
    ends = [(u, [1.0, 1.0]) for u in (1,)]
    asked = spark.createDataFrame(ends, "user_id bigint, vec array<double>")
    schema = "item_id bigint, vec array<double>"
    few = spark.createDataFrame(low + finite[:2], schema)
    for fn in (retrieval.topk, retrieval.pruned_topk):
        got = [r["item_id"] for r in fn(asked, spark.createDataFrame(low + finite, schema), 3, part_items=part_items).sort("rank").collect()]
        assert got == [201, 99, 98]
        assert [r["item_id"] for r in fn(asked, few, 4, part_items=part_items).sort("rank").collect()] == [201, 1, 0, 200]
        undefined = spark.createDataFrame([(0, [0.0, float("inf")])] + finite[1:], schema)
        with pytest.raises(Exception, match="not a number"):
            fn(users, undefined, 3, part_items=part_items).collect()


@pytest.mark.parametrize("k", [3, 40])
def test_boxes_rule_out_items_and_change_nothing(k):
    rng = np.random.default_rng(11)
    q, found = rng.uniform(-1, 1, (300, 3)), []
    parts = [(rng.permutation(4000) + 4000 * i, np.round(rng.uniform(-1, 1, (4000, 3)), 1 + i)) for i in range(3)]
    for search in (walk.all_of, lambda best, ids, v: walk._all_pairs(best, np.arange(len(best.ids)), ids, v)):
        best = walk.Best(np.arange(300), q, np.full(300, -np.inf), k)
        for ids, v in parts:
            search(best, ids, v)
        found.append(best)
    boxes, pairs = found
    assert (boxes.top_ids == pairs.top_ids).all() and (boxes.top == pairs.top).all()
    assert pairs.scored.sum() == 300 * 12_000 and boxes.scored.sum() < pairs.scored.sum() / 2


@pytest.mark.parametrize("value", [np.inf, 1e200])
def test_boxes_leave_endless_scores_to_scoring(value):
    rng = np.random.default_rng(12)
    q, v = rng.uniform(0.1, 1, (20, 4)), rng.uniform(0, 1, (2000, 4))
    v[7, 2] = value
    q[3] *= 1e200
    best = walk.Best(np.arange(20), q, np.full(20, -np.inf), 2)
    walk.all_of(best, np.arange(2000), v)
    assert (best.top_ids[:, 0] == 7).all() and np.isinf(best.top[3, 0])


def test_candidates_are_scored_in_slices():
    rng = np.random.default_rng(13)
    best = walk.Best(np.arange(5000), rng.normal(size=(5000, 64)), np.full(5000, -np.inf), 10)
    v = rng.normal(size=(600, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    walk.by_length(75, 5)(best, np.arange(600), v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # one copy of both vectors for each pair of a bucket: 384e6


def test_rows_for_python_have_no_null_arrays(model):
    """Spark 4.1 passes null arrays again for each row it writes to Python."""
    users, items, *_ = model

    def nulls(batches):
        for b in batches:
            yield pa.record_batch({"nulls": pa.array([b["vec"].null_count + b["entries"].null_count + b["entries"].field("ids").null_count])})

    lanes = retrieval._walk_lanes(retrieval._to_lanes(users, 1), items.withColumns({"lane": F.lit(0), "part": F.lit(0)}), users.count(), 1, nulls, 7, "nulls long")
    assert lanes.agg(F.sum("nulls")).collect() == [(0,)]


def test_summary_moves_a_user_once(model, monkeypatch):
    """However many parts there are, a user goes to a lane once; before, once to every part."""
    users, items, *_ = model
    n_items = items.count()
    moved = users.sparkSession.sparkContext.accumulator(0)
    inner = retrieval.walk

    def counting(*args):
        kernel = inner(*args)

        def run(batches):
            def seen():
                for b in batches:
                    moved.add(sum(p == retrieval.USERS for p in b["part"].to_pylist()))
                    yield b
            return kernel(seen())
        return run

    monkeypatch.setattr(retrieval, "walk", counting)
    monkeypatch.setattr(retrieval, "_lanes", lambda n_parts, n_users, cores: 1)
    got = retrieval.score_summary(users, items, 20).collect()
    assert {r["n"] for r in got} == {n_items} and moved.value == len(got) == users.count()


def test_small_parts_share_a_lane(model, monkeypatch):
    """Lanes are counted by items: of many small parts there are no more than of some large ones."""
    users, items, *raw = model
    asked = []
    monkeypatch.setattr(retrieval, "_lanes", lambda n_parts, n_users, cores: asked.append(n_parts) or 1)
    monkeypatch.setattr(retrieval, "LANE_PARTS", 4)
    assert picked(retrieval.pruned_topk(users, items, 7, 10, 5)) == exact(*raw, 7)
    assert asked and max(asked) <= 4


def test_many_users_make_few_chunks(spark):
    items = spark.createDataFrame([(1, [0.0] * 10)], "item_id long, vec array<double>")
    chunks = retrieval._chunks(5_400_000, 16)
    few = retrieval._fewer_chunks(items, 5_400_000, 16, chunks, 10)
    assert 16 <= few <= chunks / 4 and few < retrieval._fewer_chunks(items, 5_400_000, 16, chunks, 100) <= chunks
    assert retrieval._fewer_chunks(items, 900_000, 16, 16, 10) == 16
