import random

import numpy as np
import pytest
from table_rows import rows
from pyspark.sql import functions as F

from foldstream.functions.vectors import init_vector
from foldstream.operators import evaluation, lookup, params, routing, segments
from foldstream.operators.ids import dense_ids
from foldstream.sources.text import decode_messages

MESSAGE = "kind string, src bigint, dest bigint, vec array<double>, seq bigint"


def init(key):
    return init_vector(key, 2, -1.0, 1.0, 1)


def start(spark, key):
    return spark.range(1).select(init(F.lit(key)).alias("v")).first()["v"]


def make_messages(n=600, seed=1):
    """A third and more of the messages go to key 0."""
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        dest = 0 if rng.random() < 0.4 else rng.randint(1, 12)
        push = rng.random() < 0.5
        out.append(("Push" if push else "Pull", seq, dest, [float(rng.randint(-9, 9)), 0.5] if push else None, seq))
    return out


def replay(spark, messages):
    """Asynchronous server, one message at a time: (answers, final state)."""
    state, answers = {}, []
    for kind, src, dest, vec, _ in messages:
        if kind == "Push":
            state[dest] = [a + b for a, b in zip(state[dest], vec)] if dest in state else vec
        else:
            if dest not in state:
                state[dest] = start(spark, dest)
            answers.append((dest, src, state[dest]))
    return answers, state


def close(got, expected):
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:-1] == e[:-1]
        assert g[-1] == pytest.approx(e[-1])


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(make_messages(), MESSAGE).repartition(5).cache()


# --- segments, ids, lookups -----------------------------------------------------------------


@pytest.mark.parametrize("per_segment", [10_000, 50, 7])
def test_running_values_split_hot_keys(spark, messages, per_segment):
    got = segments.running_by_key(messages, ["dest"], "seq", {
        "s": ("sum", F.col("src")), "lo": ("min", -F.col("src")), "hi": ("max", F.col("src") % 50)}, per_segment)
    seen, expected = {}, []
    for _, src, dest, _, seq in make_messages():
        part = seen.setdefault(dest, [])
        part.append(src)
        expected.append((dest, seq, sum(part), -max(part), max(x % 50 for x in part)))
    assert rows(got.select("dest", "seq", "s", "lo", "hi")) == sorted(expected)


def test_segments_bound_a_hot_key(spark, messages):
    cut, n = segments.with_segment(messages, "seq", 50)
    assert n >= 10
    assert cut.groupBy("dest", segments.SEGMENT).count().agg(F.max("count")).first()[0] <= 100


@pytest.mark.parametrize("n", [1, 8])
def test_dense_ids(spark, n):
    # one value of the leading column holds most rows
    df = spark.createDataFrame([(0 if i % 10 else i, i) for i in range(1000)], "a int, b int").repartition(6)
    got = dense_ids(df, ["a", "b"], "id", n_partitions=n).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1000))
    assert [(r["a"], r["b"]) for r in got] == sorted((0 if i % 10 else i, i) for i in range(1000))


def test_dense_ids_of_nothing(spark):
    assert dense_ids(spark.createDataFrame([], "a int"), ["a"]).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_salts_hot_keys(spark, how):
    facts = spark.createDataFrame([(i, 7 if i % 3 == 0 else i % 50) for i in range(900)], "x int, k int")
    facts = facts.unionByName(spark.createDataFrame([(-1, None), (-2, None)], "x int, k int"))
    table = spark.range(0, 40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("y"))
    plain = facts.join(table, "k", how).select("x", "k", "y")
    for options in ({"hot": [7]}, {"hot": [7, 49, -5]}, {}, {"table_bytes": 100}):
        got = lookup.lookup_join(facts, table, "k", how, **options).select("x", "k", "y")
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


# --- routing --------------------------------------------------------------------------------


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "kind string, x int")
    left, right = routing.split_tagged(df, "a")
    assert rows(left.select("x")) == [(1,)] and rows(right.select("x")) == [(2,), (3,)]
    assert routing.union_outputs(left, right).count() == 3


@pytest.mark.parametrize("per_segment", [5, 1000])
def test_null_keys_are_one_group(spark, per_segment):
    df = spark.createDataFrame([(None if i % 2 else 1, i, 1) for i in range(40)], "k int, seq bigint, x int")
    got = segments.running_by_key(df, ["k"], "seq", {"run": ("sum", F.col("x"))}, per_segment).collect()
    for k in (None, 1):
        assert [r["run"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["seq"])] == list(range(1, 21))


def test_guards_stay_when_the_kind_is_not_selected(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "kind string, x int")
    with pytest.raises(Exception, match="kind not supported: b"):
        routing.guard_kinds(df, ["a"]).select("x").collect()
    lines = spark.createDataFrame([("Poke:1:2",)], "value string")
    with pytest.raises(Exception, match="message kind not supported: Poke"):
        decode_messages(lines).select("src").collect()


def test_guard(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "kind string, x int")
    assert routing.guard_kinds(df, ["a", "b"]).count() == 2
    with pytest.raises(Exception, match="kind not supported: b"):
        routing.guard_kinds(df, ["a"]).collect()


def test_outputs_and_messages_part(spark):
    sent = make_messages(60)
    emitted = spark.createDataFrame(sent, MESSAGE).select("src", "dest", "kind")
    outputs, rest = routing.split_tagged(emitted, "Push")
    assert outputs.count() == sum(m[0] == "Push" for m in sent) and rest.count() == sum(m[0] == "Pull" for m in sent)


# --- parameters -----------------------------------------------------------------------------


def test_pull_answers(spark):
    """Every pull is answered with its key's vector, to the one who asked."""
    pulls = spark.createDataFrame([(s, d) for s, d in zip(range(10, 18), [3, 3, 5, 8, 8, 8, 1, 5])], "src bigint, dest bigint")
    held = spark.createDataFrame([(k, [k * 2.0, k - 0.5]) for k in (1, 3, 5, 8)], "id bigint, vec array<double>")
    got = rows(params.pull_or_init(pulls, held, init))
    assert got == sorted((d, s, [d * 2.0, d - 0.5]) for s, d in zip(range(10, 18), [3, 3, 5, 8, 8, 8, 1, 5]))


def test_pull_or_init(spark):
    pulls = spark.createDataFrame([(10, 1), (11, 2), (12, 1)], "src bigint, dest bigint")
    held = spark.createDataFrame([(1, [5.0, 6.0])], "id bigint, vec array<double>")
    for hot in ([], [1]):
        got = [(s, d, v) for s, d, v in rows(params.pull_or_init(pulls, held, init, hot))]
        assert got == [(1, 10, [5.0, 6.0]), (1, 12, [5.0, 6.0]), (2, 11, start(spark, 2))]
    assert rows(params.append_initialised(held, pulls, init)) == [(1, [5.0, 6.0]), (2, start(spark, 2))]


@pytest.mark.parametrize("per_segment", [10_000, 40])
def test_asof_and_state_match_replay(spark, messages, per_segment):
    answers, state = replay(spark, make_messages())
    got = params.pull_asof(messages, 2, init, rows_per_segment=per_segment).select("src", "dest", "vec")
    close(rows(got), sorted(answers))
    empty = spark.createDataFrame([], "id bigint, vec array<double>")
    close(rows(params.push_merge(empty, messages, 2, init)), sorted(state.items()))


def test_asof_continues_from_a_table(spark):
    first, second = make_messages()[:300], make_messages()[300:]
    answers, state = replay(spark, make_messages())
    empty = spark.createDataFrame([], "id bigint, vec array<double>")
    held = params.push_merge(empty, spark.createDataFrame(first, MESSAGE), 2, init)
    later = spark.createDataFrame(second, MESSAGE)
    got = params.pull_asof(later, 2, init, held).select("src", "dest", "vec")
    close(rows(got), sorted(a for a in answers if a[1] >= 300))
    merged = params.push_merge(held, later, 2, init)
    close(rows(merged), sorted(state.items()))
    added = params.vector_sum(held.unionByName(params.push_delta(held, later, 2, init)), "id", 2)
    close(rows(added), sorted(state.items()))


def test_push_before_any_pull_is_not_initialised(spark):
    sent = spark.createDataFrame([("Push", 0, 1, [1.0, 2.0], 0), ("Pull", 1, 1, None, 1)], MESSAGE)
    assert rows(params.pull_asof(sent, 2, init).select("vec")) == [([1.0, 2.0],)]


def test_float_deltas(spark):
    sent = spark.createDataFrame([("Push", 0, 1, [0.1, 0.2], 0)], MESSAGE)
    empty = spark.createDataFrame([], "id bigint, vec array<double>")
    got = params.push_merge(empty, sent, 2, delta_precision="float").first()["vec"]
    assert got == [float(np.float32(0.1)), float(np.float32(0.2))]


def test_sums_agree_and_check_lengths(spark, messages):
    pushes = messages.where("kind = 'Push'")
    assert rows(params.vector_sum(pushes, "dest", 2)) == rows(params.vector_sum_any(pushes, "dest"))
    uneven = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "id bigint, vec array<double>")
    for run in (lambda: params.vector_sum(uneven, "id", 2), lambda: params.vector_sum_any(uneven, "id")):
        with pytest.raises(Exception, match="length"):
            run().collect()
    inf = spark.createDataFrame([(1, [float("inf")]), (1, [float("-inf")])], "id bigint, vec array<double>")
    with pytest.raises(Exception, match="not a number"):
        params.vector_sum(inf, "id", 1).collect()


def test_random_pushes_accumulate(spark):
    rng = np.random.default_rng(3)
    data = [(int(rng.integers(20)), rng.random(5).tolist()) for _ in range(20)]
    df = spark.createDataFrame(data, "dest bigint, vec array<double>")
    expected = {}
    for d, x in data:
        expected[d] = np.add(expected.get(d, np.zeros(5)), x)
    got = dict(rows(params.vector_sum(df, "dest", 5)))
    assert got.keys() == expected.keys()
    assert all(np.allclose(got[d], expected[d]) for d in expected)


def test_item_set_last_write_wins(spark):
    held = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id bigint, vec array<double>")
    updates = spark.createDataFrame([(1, [9.0], 5), (1, [8.0], 7), (3, [3.0], 1)], "id bigint, vec array<double>, seq bigint")
    assert rows(params.item_set(held, updates)) == [(1, [8.0]), (2, [2.0]), (3, [3.0])]


@pytest.mark.parametrize("per_segment", [10_000, 30])
def test_fold_with_a_custom_update(spark, messages, per_segment):
    """Associative but not commutative: the order of a key's pushes must hold across segments."""
    def after(a, b):  # 2x2 affine maps x -> a0 * x + a1, composed in order
        return np.array([a[0] * b[0], b[0] * a[1] + b[1]])

    pushes = messages.where("kind = 'Push'").withColumn(
        "vec", F.array(F.when(F.get("vec", F.lit(0)) > 0, -1.0).otherwise(1.0), F.get("vec", F.lit(0))))
    expected = {}
    for kind, _, dest, vec, _ in make_messages():
        if kind == "Push":
            x = np.array([-1.0 if vec[0] > 0 else 1.0, vec[0]])
            expected[dest] = after(expected[dest], x) if dest in expected else x
    got = rows(params.param_fold(pushes, after, rows_per_segment=per_segment))
    close(got, sorted((d, list(x)) for d, x in expected.items()))
    seeded = dict(rows(params.param_fold(pushes, np.maximum, init, per_segment)))
    assert all(x[0] >= start(spark, d)[0] for d, x in seeded.items())


def replay_sync(spark, messages):
    state, locked, waiting, answers = {}, set(), {}, {}
    for kind, src, dest, vec, seq in messages:
        queue = waiting.setdefault(dest, [])

        def answer(who, dest=dest, seq=seq):
            state.setdefault(dest, start(spark, dest))
            locked.add(dest)
            answers[who] = (dest, who, seq, state[dest])

        if kind == "Push":
            state[dest] = [a + b for a, b in zip(state[dest], vec)] if dest in state else vec
            locked.discard(dest)
            if queue:
                answer(queue.pop(0))
        elif dest in locked:
            queue.append(src)
        else:
            answer(src)
    return sorted(answers.values()), sum(len(q) for q in waiting.values())


@pytest.mark.parametrize("per_segment", [10_000, 45])
@pytest.mark.parametrize("seed", [1, 2])
def test_synchronous_answers_match_replay(spark, per_segment, seed):
    sent = make_messages(400, seed)
    expected, still_waiting = replay_sync(spark, sent)
    got = params.sync_answers(spark.createDataFrame(sent, MESSAGE), 2, init, per_segment)
    answered = got.where("answered_at is not null")
    close(rows(answered.select("src", "dest", "answered_at", "vec")), expected)
    assert got.where("answered_at is null").count() == still_waiting


# --- evaluation -----------------------------------------------------------------------------


def test_unmatched_answers_get_dummies(spark):
    answers = spark.createDataFrame([(1,), (2,)], "eval_id bigint")
    asked = spark.createDataFrame([(1, 50, 99)], "eval_id bigint, item_id bigint, ts bigint")
    assert rows(evaluation.correlate_requests(answers, asked)) == [(1, 50, 99), (2, -1, -1)]


def test_co_process_sees_both_inputs_in_order(spark):
    a = spark.createDataFrame([(1, 10, "x"), (2, 5, "y")], "k bigint, seq bigint, name string")
    b = spark.createDataFrame([(1, 9, 1.0), (1, 11, 2.0), (2, 6, 3.0)], "k bigint, seq bigint, val double")

    def left(state, row):
        state["name"] = row["name"]
        return []

    def right(state, row):
        return [(row["k"], row["val"], state.get("name", "?"))]

    for n in (1, 8):
        got = evaluation.co_process(a, b, "k", "seq", left, right, "k bigint, val double, name string", n)
        assert rows(got) == [(1, 1.0, "?"), (1, 2.0, "x"), (2, 3.0, "y")]


EVALS = "eval_id bigint, item_id bigint, ts bigint, topk array<struct<item_id: bigint, score: double>>"


def test_merge_and_lists(spark):
    parts = spark.createDataFrame([
        (1, 7, 100, [(7, 0.5), (3, 0.9)]), (1, -1, -1, [(4, 0.9), (5, 0.1)]), (2, -1, -1, [])], EVALS)
    merged = evaluation.merge_evaluations(parts, 3)
    down = {r["eval_id"]: r for r in evaluation.recommendations(merged).collect()}
    assert (down[1]["target_id"], down[1]["ts"], down[1]["topk"]) == (7, 100, [3, 4, 7])
    assert (down[2]["target_id"], down[2]["topk"]) == (-1, [])
    up = {r["eval_id"]: r["topk"] for r in evaluation.recommendations(merged, "ascending").collect()}
    assert up[1] == [7, 4, 3]
    twice = parts.unionByName(parts)
    assert rows(evaluation.merge_evaluations(twice, 3, distinct=True)) == rows(merged)


def test_target_gain_orders(spark):
    ranks = spark.createDataFrame([(1, 10 + r, 1.0 - r / 10, r) for r in range(1, 5)], "user_id bigint, item_id bigint, score double, rank int")
    asked = spark.createDataFrame([(0, 1, 11, 5), (1, 1, 14, 6), (2, 1, 99, 7), (3, 2, 11, 8)], "eval_id bigint, user_id bigint, item_id bigint, ts bigint")
    down = [x for _, _, x in rows(evaluation.target_gain(asked, ranks).select("eval_id", "ts", "ndcg"))]
    assert down == pytest.approx([1.0, 1 / 3, 0.0, 0.0])
    up = [x for _, _, x in rows(evaluation.target_gain(asked, ranks, "ascending").select("eval_id", "ts", "ndcg"))]
    assert up == pytest.approx([1 / 3, 1.0, 0.0, 0.0])


def test_slots_truncate_toward_zero(spark):
    df = spark.createDataFrame([(-7,), (-1,), (0,), (7,)], "ts bigint")
    assert [r[0] for r in df.select(evaluation.time_slot(F.col("ts"), 2)).collect()] == [-3, 0, 0, 3]


def test_report(spark):
    df = spark.createDataFrame([(0.5, 10), (1.0, 20), (0.0, 86400)], "ndcg double, ts bigint")
    assert rows(evaluation.slot_report(df)) == [(0, 0.75, 2), (1, 0.0, 1)]


@pytest.mark.parametrize("per_segment", [10_000, 60])
def test_count_window(spark, messages, per_segment):
    by_key = {}
    for _, src, dest, _, _ in make_messages():
        by_key.setdefault(dest, []).append(src)
    expected = sorted((d, w, sum(x[w * 7:w * 7 + 7])) for d, x in by_key.items() for w in range(len(x) // 7))
    got = evaluation.count_window(messages, ["dest"], "seq", 7, [F.sum("src").alias("s")], per_segment)
    assert rows(got) == expected


@pytest.mark.parametrize("per_segment", [10_000, 20, 5])
def test_sessions_across_segments(spark, per_segment):
    rng = random.Random(4)
    events = [(0 if rng.random() < 0.5 else rng.randint(1, 4), rng.randint(0, 3000) * 1_000_000, 1.0) for _ in range(300)]
    # a session longer than any segment
    events += [(9, i * 1_000_000, 1.0) for i in range(0, 3000, 5)]
    expected = []
    for key in {e[0] for e in events}:
        times = sorted(t for k, t, _ in events if k == key)
        cur = [times[0]]
        for t in times[1:]:
            if t - cur[-1] <= 10_000_000:
                cur.append(t)
            else:
                expected.append((key, cur[0], cur[-1], len(cur), float(len(cur))))
                cur = [t]
        expected.append((key, cur[0], cur[-1], len(cur), float(len(cur))))
    df = spark.createDataFrame(events, "k bigint, at bigint, x double")
    assert rows(evaluation.session_by_key(df, "k", "at", 10, "x", per_segment)) == sorted(expected)


def test_latency(spark):
    entered = spark.createDataFrame([(i, "g", 0) for i in range(100)], "eval_id bigint, g string, ts_in bigint")
    left = spark.createDataFrame([(i, i + 1) for i in range(100)], "eval_id bigint, ts_out bigint")
    assert rows(evaluation.latency_stats(entered, left, "g")) == [("g", 100, 50.5, 1, 100, 50, 95, 99)]
