import random
from dataclasses import replace

import numpy as np
import pytest
from table_rows import rows
from pyspark.sql import functions as F

from foldstream.functions.vectors import init_vector
from foldstream.operators import training
from foldstream.operators.params import vector_sum
from foldstream.plans.loop import ParameterLoop, over_slots
from foldstream.plans.store import ParamTable, read_batches, store_options
from foldstream.plans.train_eval import FactorConfig, TrainEval, evaluate_fixed, online_train_eval, prequential, run_job
from foldstream.session import folders_in, scratch_path
from foldstream.sources.sinks import read_report
from foldstream.streaming.run import each_batch, run_available

REQUEST = "eval_id bigint, user_id bigint, item_id bigint, rating double, ts bigint"
CONFIG = FactorConfig(dim=4, k=5, lo=-0.5, hi=0.5, learning_rate=0.05, negatives=3, slot_seconds=10)


def make_requests(n=120):
    rng = random.Random(2)
    return [(i, rng.choice([0, 0, 0, 1, 2, 3]), rng.randint(0, 14), 1.0, i // 4) for i in range(n)]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(make_requests(), REQUEST)


def starts(spark, n, dim, lo, hi, seed):
    df = spark.range(n).select("id", init_vector(F.col("id"), dim, lo, hi, seed).alias("v"))
    return {r["id"]: np.array(r["v"]) for r in df.collect()}


def train(batch, users, items, c, order=None):
    """One batch by hand: squared error, vectors of the batch start, deltas added up."""
    ids = order or sorted(items)
    du, di = {}, {}
    for e, u, i, r, _ in batch:
        pairs = [(i, r)]
        for j in range(1, c.negatives + 1):
            k = (((e * 31 + j * 17) % len(ids)) * 48271) % len(ids)
            if ids[k] != i:
                pairs.append((ids[k], 0.0))
        for item, rating in pairs:
            err = c.learning_rate * (rating - users[u] @ items[item])
            du[u] = du.get(u, 0) + err * items[item]
            di[item] = di.get(item, 0) + err * users[u]
    return ({u: x + du.get(u, 0) for u, x in users.items()}, {i: x + di.get(i, 0) for i, x in items.items()})


def gain(batch, users, items, k):
    out = {}
    ids = sorted(items)
    for e, u, i, _, _ in batch:
        order = sorted(ids, key=lambda x: (-round(float(users[u] @ items[x]), 9), x))[:k]
        out[e] = 1 / (np.log2(order.index(i) + 1) + 1) if i in order else 0.0
    return out


def tables(spark, users, items):
    make = lambda t: spark.createDataFrame([(k, v.tolist()) for k, v in t.items()], "id bigint, vec array<double>")
    return make(users), make(items)


def same(df, expected):
    got = {r["id"]: r["vec"] for r in df.collect()}
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k] == pytest.approx(list(expected[k]))


@pytest.mark.parametrize("broadcast", [True, False])
def test_sgd_step(spark, requests, broadcast, monkeypatch):
    users, items = starts(spark, 4, 4, -0.5, 0.5, 1), starts(spark, 15, 4, -0.5, 0.5, 2)
    expected_users, expected_items = train(make_requests(), users, items, CONFIG)
    if not broadcast:  # shuffle both sides
        monkeypatch.setattr("foldstream.operators.lookup.BROADCAST_BYTES", 0)
    u, i = training.sgd_step(requests, *tables(spark, users, items), 4, 0.05, 3)
    same(u, expected_users)
    same(i, expected_items)


def test_negatives_never_equal_the_positive(spark, requests):
    items = requests.select(F.col("item_id").alias("id")).distinct()
    drawn = training.negative_samples(requests, items, 5)
    joined = drawn.join(requests.select("eval_id", F.col("item_id").alias("own")), "eval_id")
    assert joined.where("item_id = own").count() == 0
    assert drawn.count() > 4 * requests.count() and drawn.agg(F.max("rating")).first()[0] == 0.0


def test_prequential_evaluates_before_training(spark, requests):
    users, items = starts(spark, 4, 4, -0.5, 0.5, 1), starts(spark, 15, 4, -0.5, 0.5, 2)
    expected = {}
    for slot in range(3):
        batch = [r for r in make_requests() if r[4] // 10 == slot]
        expected |= gain(batch, users, items, 5)
        users, items = train(batch, users, items, CONFIG)
    catalog = spark.range(15).select("id", CONFIG.item_init(F.col("id")).alias("vec"))
    got = {e: x for e, x in rows(prequential(requests, catalog, CONFIG, 10).select("eval_id", "ndcg"))}
    assert got == pytest.approx(expected)
    pruned = {e: x for e, x in rows(prequential(requests, catalog, replace(CONFIG, pruned=True), 10).select("eval_id", "ndcg"))}
    assert pruned == pytest.approx(expected)
    report = rows(online_train_eval(requests, catalog, CONFIG, 10))
    for slot, ndcg, n in report:
        part = [expected[r[0]] for r in make_requests() if r[4] // 10 == slot]
        assert (ndcg, n) == (pytest.approx(np.mean(part)), len(part))


def test_items_appear_when_first_requested(spark, requests):
    root = scratch_path(spark, "grow")
    run = TrainEval(spark, root, CONFIG).create()
    n = over_slots(run.process, requests, 10)
    assert run.items.read(n).count() == requests.select("item_id").distinct().count()
    first = run.results(n).where("ts < 10")
    assert first.agg(F.sum("ndcg")).first()[0] == 0.0  # nothing known yet


@pytest.mark.parametrize("variant", ["kafka", "kafkaredis", "redis"])
def test_store_variants(spark, requests, variant):
    catalog = spark.range(15).select("id", CONFIG.item_init(F.col("id")).alias("vec"))
    report = online_train_eval(requests, catalog, replace(CONFIG, store=variant), 15)
    assert report.agg(F.sum("n")).first()[0] == 120
    with pytest.raises(ValueError, match="not supported"):
        store_options("other")


def test_increments_of_users_in_single_precision(spark, requests):
    users, items = starts(spark, 4, 4, -0.5, 0.5, 1), starts(spark, 15, 4, -0.5, 0.5, 2)
    indexed, n = training.item_index(tables(spark, users, items)[1])
    pairs = training.training_pairs(requests, indexed.select("id", "idx"), n, 3)
    deltas, exact = {}, {}
    for precision, out in (("float", deltas), ("double", exact)):
        both = training.sgd_deltas(pairs, tables(spark, users, items)[0], indexed, 4, 0.05, 4, n, precision)
        out.update({side: {r["id"]: np.array(r["vec"]) for r in df.collect()} for side, df in zip(("user", "item"), both)})
    expected = {}
    for one in make_requests():  # a request's increment is rounded, then added
        u, _ = train([one], users, items, CONFIG)
        step = np.float32(u[one[1]] - users[one[1]]).astype(float)
        expected[one[1]] = expected.get(one[1], 0) + step
    for u, d in expected.items():
        assert deltas["user"][u] == pytest.approx(d, abs=1e-9)
    assert any((deltas["user"][u] != exact["user"][u]).any() for u in expected)
    assert all(deltas["item"][i] == pytest.approx(exact["item"][i], abs=1e-12) for i in exact["item"])


def test_initial_vectors_keep_double_precision(spark):
    run = TrainEval(spark, scratch_path(spark, "precise"), replace(CONFIG, store="kafkaredis", dim=1)).create(
        users=spark.createDataFrame([(1, [0.1])], "id bigint, vec array<double>"))
    assert run.users.read(0).first()["vec"] == [0.1]


def test_reading_keys_moves_no_other_rows(spark):
    held = ParamTable(spark, scratch_path(spark, "keys"), 1, 100).create(
        spark.range(1000).select("id", F.array(F.lit(1.0)).alias("vec")))
    for b in range(3):
        held.append(spark.createDataFrame([(5, [1.0]), (2000 + b, [1.0])], "id bigint, vec array<double>"), b)
    wanted = spark.createDataFrame([(5,), (7,), (2001,), (9999,)], "id bigint")
    got = held.read(3, wanted)
    assert dict(rows(got)) == {5: [4.0], 7: [1.0], 2001: [1.0]}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")


def test_slots_are_written_by_few_tasks(spark, requests):
    seen = []
    over_slots(lambda df, b: seen.append(df.inputFiles()), requests.repartition(40), 5)
    files = {f for fs in seen for f in fs}
    assert len(files) <= len(seen) + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_job_from_file_to_file(spark, requests, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "report")
    requests.select(F.concat_ws(",", "ts", "user_id", "item_id").alias("value")).write.text(src)
    report = rows(run_job(spark, src, dst, CONFIG, 15))
    assert sum(n for *_, n in report) == 120
    assert sorted(tuple(r) for r in read_report(spark, dst).collect()) == report


def test_shards_offer_their_best(spark):
    users = spark.createDataFrame([(1, [1.0])], "id bigint, vec array<double>")
    items = spark.createDataFrame([(i, [float(i)]) for i in range(12)], "id bigint, vec array<double>")
    for worker_k, best in ((5, [11, 10, 9, 8, 7]), (1, [11, 10, 9])):
        run = TrainEval(spark, scratch_path(spark, "shards"), replace(CONFIG, dim=1, shards=3, worker_k=worker_k))
        assert [r["item_id"] for r in run.rank(users, items).sort("rank").collect()] == best


def test_report_of_fixed_vectors(spark, requests):
    users, items = starts(spark, 4, 4, -0.5, 0.5, 1), starts(spark, 15, 4, -0.5, 0.5, 2)
    items = {i: items[i] for i in {r[2] for r in make_requests()}}
    expected = gain(make_requests(), users, items, 5)
    for pruned in (False, True):
        report = rows(evaluate_fixed(requests, replace(CONFIG, pruned=pruned)))
        assert [n for *_, n in report] == [40, 40, 40]
        assert sum(x * n for _, x, n in report) == pytest.approx(sum(expected.values()))


def test_streamed_training_equals_slots(spark, requests, tmp_path):
    catalog = spark.range(15).select("id", CONFIG.item_init(F.col("id")).alias("vec"))
    by_slot = rows(prequential(requests, catalog, CONFIG, 10).select("eval_id", "ndcg"))
    run = TrainEval(spark, scratch_path(spark, "streamed"), CONFIG).create(items=catalog)
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    for slot in range(3):
        requests.where((F.col("ts") / 10).cast("int") == slot).write.mode("append").parquet(path)
        stream = spark.readStream.schema(REQUEST).parquet(path)
        run_available(each_batch(stream, run.process_micro_batch, state))
    got = rows(run.results(3).select("eval_id", "ndcg"))
    assert [e for e, _ in got] == [e for e, _ in by_slot]
    assert [x for _, x in got] == pytest.approx([x for _, x in by_slot])


# --- table and loop -------------------------------------------------------------------------


@pytest.mark.parametrize("every", [1, 2, 3, 100])
def test_table_reads_any_version(spark, every):
    held = ParamTable(spark, scratch_path(spark, "table"), 1, every, keep=10).create(
        spark.createDataFrame([(1, [10.0])], "id bigint, vec array<double>"))
    for b in range(5):
        held.append(spark.createDataFrame([(1, [1.0]), (b, [0.5])], "id bigint, vec array<double>"), b)
    for b in range(5):  # a batch that runs again changes nothing
        held.append(spark.createDataFrame([(1, [1.0]), (b, [0.5])], "id bigint, vec array<double>"), b)
        assert dict(rows(held.read(b)))[1] == [10.0 + b + (0.5 if b > 1 else 0.0)]
    assert dict(rows(held.read(5))) == {0: [0.5], 1: [15.5], 2: [0.5], 3: [0.5], 4: [0.5]}


def test_loop_with_custom_step_and_merge(spark):
    asked = spark.createDataFrame([(i, i % 3, i) for i in range(12)], "eval_id bigint, user_id bigint, ts bigint")
    init = lambda key: F.array(key.cast("double"))

    def step(answered):
        pushes = answered.select(F.col("user_id").alias("id"), F.array(F.lit(1.0)).alias("vec"))
        return vector_sum(pushes, "id", 1), answered.select("eval_id", F.get("vec", F.lit(0)).alias("seen"))

    def keep_greatest(table, pushes):
        return table.unionByName(pushes).groupBy("id").agg(F.array(F.max(F.get("vec", F.lit(0)))).alias("vec"))

    root = scratch_path(spark, "loop")
    added = ParameterLoop(ParamTable(spark, f"{root}/a", 1, 2).create(), init, step, f"{root}/ao")
    n = over_slots(added.process, asked, 6)
    assert rows(read_batches(spark, added.out, n)) == [(i, float(i % 3 + (2 if i >= 6 else 0))) for i in range(12)]
    merged = ParameterLoop(ParamTable(spark, f"{root}/m", 1, 1).create(), init, step, f"{root}/mo", server_merge=keep_greatest)
    n = over_slots(merged.process, asked, 6)
    assert rows(read_batches(spark, merged.out, n)) == [(i, float(max(i % 3, 2) if i >= 6 else i % 3)) for i in range(12)]


def test_a_batch_reads_the_buckets_of_its_keys_only(spark):
    held = ParamTable(spark, scratch_path(spark, "buckets"), 1, compact_every=4, n_buckets=64).create(
        spark.range(4_000).select("id", F.array(F.lit(1.0)).alias("vec")))
    everyone = spark.range(4_000).select("id", F.array(F.lit(0.5)).alias("vec"))
    for b in range(3):
        held.append(everyone, b)
    assert len(held.read(3).inputFiles()) == 4 * 64
    wanted = spark.createDataFrame([(i,) for i in range(0, 1_000, 100)], "id bigint")
    got = held.read(3, wanted)
    buckets = {f.split("_bucket=")[1].split("/")[0] for f in got.inputFiles()}
    assert len(buckets) <= 10 and len(got.inputFiles()) <= 4 * 10
    assert dict(rows(got)) == {i: [2.5] for i in range(0, 1_000, 100)}


def test_buckets_are_summed_up_one_by_one_and_old_folders_go(spark):
    held = ParamTable(spark, scratch_path(spark, "compact"), 1, compact_every=2, n_buckets=8).create(
        spark.range(64).select("id", F.array(F.lit(0.0)).alias("vec")))
    hot = held.spark.createDataFrame([(1, [1.0])], "id bigint, vec array<double>")
    cold = held.spark.createDataFrame([(i, [1.0]) for i in range(64)], "id bigint, vec array<double>")
    for b, deltas in enumerate([hot, hot, cold, hot, hot]):
        held.append(deltas, b)
    now = held.manifest(5)["buckets"]
    own = spark.createDataFrame([(1,)], "id bigint").select(held.bucket_of("id")).first()[0]
    # the hot bucket was summed up after its second and its fourth delta; the others still have their first one
    assert now[str(own)] == ["base-3", "delta-4"]
    assert all(parts == ["base-start", "delta-2"] for k, parts in now.items() if k != str(own))
    parts = set(folders_in(spark, held.rows))
    assert parts == {"part=base-start", "part=delta-2", "part=base-3", "part=delta-4"}
    assert f"_bucket={own}" not in folders_in(spark, f"{held.rows}/part=base-start")
    assert dict(rows(held.read(5)))[1] == [5.0]
    # another driver finds the table by its folder alone
    again = ParamTable(spark, held.root, 1)
    assert dict(rows(again.read(5))) == dict(rows(held.read(5)))


def test_new_items_get_the_next_places(spark, requests):
    """No item changes its place, and negatives are drawn by place."""
    users, items = starts(spark, 4, 4, -0.5, 0.5, 1), starts(spark, 15, 4, -0.5, 0.5, 2)
    run = TrainEval(spark, scratch_path(spark, "places"), CONFIG).create()
    n = over_slots(run.process, requests, 10)
    order, seen = [], set()
    held_users, held_items = {}, {}
    for slot in range(3):
        batch = [r for r in make_requests() if r[4] // 10 == slot]
        new = sorted({r[2] for r in batch} - seen)
        order, seen = order + new, seen | set(new)
        held_items |= {i: items[i] for i in new}
        held_users |= {r[1]: held_users.get(r[1], users[r[1]]) for r in batch}
        held_users, held_items = train(batch, held_users, held_items, CONFIG, order)
    got = {r["id"]: (r["vec"], r["idx"]) for r in run.items.read(n).collect()}
    assert {i: x[1] for i, x in got.items()} == {i: at for at, i in enumerate(order)}
    assert run.items.count(n) == len(order)
    assert {i: x[0] for i, x in got.items()} == {i: pytest.approx(list(v)) for i, v in held_items.items()}


def test_one_shard_alone(spark):
    users = spark.createDataFrame([(1, [1.0])], "id bigint, vec array<double>")
    items = spark.createDataFrame([(i, [float(i)]) for i in range(12)], "id bigint, vec array<double>")
    run = TrainEval(spark, scratch_path(spark, "shard"), replace(CONFIG, dim=1, shards=3, only_shard=1))
    assert [r["item_id"] for r in run.rank(users, items).sort("rank").collect()] == [10, 7, 4, 1]
