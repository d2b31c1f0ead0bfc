"""One query per operator over the test tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstream.functions import metrics, vectors
from foldstream.operators import evaluation, params, retrieval, routing, training
from foldstream.operators.segments import SEGMENT, with_segment
from foldstream.plans.loop import ParameterLoop, over_slots
from foldstream.plans.store import ParamTable, read_batches, store_options
from foldstream.plans import train_eval
from foldstream.plans.train_eval import FactorConfig, evaluate_fixed
from foldstream.session import scratch_path, staged
from foldstream.sources import sinks, text, topics
from foldstream.sources import tables as t
from foldstream.streaming import counters, keyed
from foldstream.streaming import params as stream_params
from foldstream.streaming import windows as stream_windows
from foldstream.streaming.run import each_batch, run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Vectors of the retrieval and message queries; wide enough that scores differ.
CONFIG = FactorConfig(lo=-1.0, hi=1.0, k=10)
# The training queries have the job's own settings, and start from its small vectors.
TRAIN = FactorConfig()
YEAR = 365 * 86_400
WEEK = 7 * 86_400
DIM = 3
N_SHARDS = 4
SHARD_K = 5


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def init3(key):
    return vectors.init_vector(key, DIM, -1.0, 1.0, 1)


def _round(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def _fields(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return _round(params.components(df, keys), digits, "val")


# --- sources and sinks ----------------------------------------------------------------------


@query
def interactions_scan(spark, sf):
    rows = t.interactions(spark, sf)
    return rows.select(F.concat_ws(",", "ts", "user_id", "item_id").alias("value")).transform(text.decode_interactions)


@query
def interactions_offset(spark, sf):
    rows = t._lines_with_orders(spark, sf)
    lines = rows.select(F.concat_ws(",", "l_orderkey", "ts", "user_id", "item_id").alias("value"))
    return text.decode_interactions(lines, eval_id=0, ts=1, user=2, item=3, ts_offset=1000000007)


@query
def interactions_file(spark, sf):
    path = scratch_path(spark, "interactions")
    rows = t.interactions(spark, sf)
    rows.select(F.concat_ws(",", "ts", "user_id", "item_id").alias("value")).write.text(path)
    return text.read_interactions(spark, path)


@query
def dense_ids(spark, sf):
    return t.requests(spark, sf)


def _model_lines(spark, sf):
    return text.encode_model(t.query_vectors(spark, sf).withColumnRenamed("user_id", "id"), sep=",")


@query
def model_scan(spark, sf):
    path = scratch_path(spark, "model")
    _model_lines(spark, sf).write.text(path)
    return _fields(text.read_model(spark, path), "id", digits=9)


@query
def model_decode(spark, sf):
    return _fields(text.decode_model(_model_lines(spark, sf)), "id", digits=9)


@query
def model_encode(spark, sf):
    pushes = t.messages(spark, sf, whole=True).where(F.col("kind") == text.PUSH)
    return text.encode_model(pushes.select(F.col("src").alias("id"), "vec"))


def _message_columns(df: DataFrame) -> DataFrame:
    return df.select("kind", "src", "dest", *(F.get("vec", F.lit(i)).alias(f"v{i}") for i in range(DIM)))


@query
def message_decode(spark, sf):
    lines = text.encode_messages(t.messages(spark, sf, whole=True))
    return _message_columns(text.decode_messages(lines))


@query
def answer_decode(spark, sf):
    pulls = t.messages(spark, sf).where(F.col("kind") == text.PULL)
    line = F.concat_ws(":", "dest", "src", F.concat_ws(",", (F.col("src") % 7).cast("double"), F.col("dest").cast("double")))
    return text.decode_answers(pulls.select(line.alias("value"))).select(
        "src", "dest", F.get("vec", F.lit(0)).alias("v0"), F.get("vec", F.lit(1)).alias("v1"))


@query
def message_encode(spark, sf):
    sent = t.messages(spark, sf, whole=True)
    answered = sent.where(F.col("kind") == text.PULL).select(
        F.lit(text.ANSWER).alias("kind"), F.col("dest").alias("src"), F.col("src").alias("dest"),
        F.array(F.col("src").cast("double"), F.lit(1.0)).alias("vec"))
    return text.encode_messages(sent.drop("seq").unionByName(answered))


@query
def topic_roundtrip(spark, sf):
    """Messages go through a topic as text and are read back by a stream."""
    topic, out, state = (scratch_path(spark, n) for n in ("topic", "decoded", "state"))
    text.encode_messages(t.messages(spark, sf, whole=True)).write.text(topic)
    decoded = _message_columns(text.decode_messages(topics.read_topic(spark, topic, per_batch=4)))
    run_available(decoded.writeStream.format("parquet").option("path", out).option("checkpointLocation", state))
    return spark.read.parquet(out)


@query
def result_lines(spark, sf):
    path = scratch_path(spark, "report")
    sinks.save_report(evaluate_fixed(t.interactions(spark, sf), CONFIG), path)
    return _round(sinks.read_report(spark, path), 6, "ndcg")


# --- routing --------------------------------------------------------------------------------


@query
def split_tagged(spark, sf):
    events = t.table(spark, sf, "events").select(F.col("event_type").alias("kind"), "value")
    left, right = routing.split_tagged(events, "view")
    side = lambda df, name: df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("side", F.lit(name))
    return side(left, "left").unionByName(side(right, "right"))


@query
def message_counts(spark, sf):
    return routing.message_counts(t.messages(spark, sf))


@query
def union_outputs(spark, sf):
    server = t.table(spark, sf, "events").select(F.lit("server").alias("side"), F.col("event_id").alias("id"), F.col("value").alias("val"))
    worker = t.table(spark, sf, "orders").select(F.lit("worker").alias("side"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("val"))
    return routing.union_outputs(server, worker)


@query
def warm_start(spark, sf):
    """User vectors are pushed, item vectors set, requests passed on."""
    customers = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    parts = t.table(spark, sf, "part").select(F.col("p_partkey").alias("key"))
    orders = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"))

    def rows(df, kind, vec, seq):
        return df.select(F.lit(kind).alias("kind"), "key", vec.alias("vec"), F.lit(seq).cast("bigint").alias("seq"))

    none = F.lit(None).cast("array<double>")
    inputs = (rows(customers, "user", vectors.init_vector(F.col("key"), DIM, -1.0, 1.0, 3), 0)
              .unionByName(rows(parts, "item", vectors.init_vector(F.col("key"), DIM, -1.0, 1.0, 2), 1))
              .unionByName(rows(parts, "item", vectors.init_vector(F.col("key"), DIM, -1.0, 1.0, 4), 2))
              .unionByName(rows(orders, "request", none, 3)))
    asked, pushes, items = routing.dispatch_inputs(inputs)
    held = params.vector_sum(t.messages(spark, sf).where(F.col("kind") == text.PUSH), "dest", DIM)
    users = params.push_merge(held, pushes, DIM)
    empty = spark.createDataFrame([], "id bigint, vec array<double>")
    passed = asked.groupBy(F.col("key").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("val"))
    return (_fields(users, "id").withColumn("side", F.lit("user"))
            .unionByName(_fields(params.item_set(empty, items), "id").withColumn("side", F.lit("item")))
            .unionByName(passed.select("id", F.lit(0).alias("pos"), "val", F.lit("request").alias("side"))))


# --- parameters -----------------------------------------------------------------------------


def _pushed(spark, sf):
    return params.vector_sum(t.messages(spark, sf).where(F.col("kind") == text.PUSH), "dest", DIM)


def _order_pulls(spark, sf):
    return t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dest"))


def _supplier_params(spark, sf):
    return t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), vectors.init_vector(F.col("s_suppkey"), DIM, -1.0, 1.0, 2).alias("vec"))


@query
def pull_or_init(spark, sf):
    return _fields(params.pull_or_init(_order_pulls(spark, sf), _pushed(spark, sf), init3), "src", "dest")


@query
def append_initialised(spark, sf):
    return _fields(params.append_initialised(_pushed(spark, sf), _order_pulls(spark, sf), init3), "id")


@query
def pull_asof(spark, sf):
    return _fields(params.pull_asof(t.messages(spark, sf), DIM, init3), "src", "dest")


@query
def pull_asof_held(spark, sf):
    """The same with a table of vectors held before the first message."""
    return _fields(params.pull_asof(t.messages(spark, sf), DIM, init3, _supplier_params(spark, sf)), "src", "dest")


@query
def vector_sum(spark, sf):
    return _fields(_pushed(spark, sf), "id")


@query
def vector_sum_any(spark, sf):
    rows = t.item_vectors(spark, sf).join(
        t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").cast("bigint").alias("label")), "item_id")
    return _fields(params.vector_sum_any(rows, "label"), "id")


@query
def push_merge(spark, sf):
    return _fields(params.push_merge(_supplier_params(spark, sf), t.messages(spark, sf), DIM, init3), "id")


@query
def push_float32(spark, sf):
    return _fields(params.push_merge(_supplier_params(spark, sf), t.messages(spark, sf), DIM, init3, "float"), "id")


@query
def item_set(spark, sf):
    pushes = t.messages(spark, sf).where(F.col("kind") == text.PUSH).select(F.col("dest").alias("id"), "vec", "seq")
    return _fields(params.item_set(_supplier_params(spark, sf), pushes), "id")


@query
def param_fold_custom(spark, sf):
    pushes = t.messages(spark, sf).where(F.col("kind") == text.PUSH)
    return _fields(params.param_fold(pushes, np.maximum, init3), "id")


@query
def sync_param(spark, sf):
    answers = params.sync_answers(t.messages(spark, sf), DIM, init3)
    return _round(answers.select("src", "dest", "answered_at", *(F.get("vec", F.lit(i)).alias(f"v{i}") for i in range(DIM))),
                  6, "v0", "v1", "v2")


# --- vectors --------------------------------------------------------------------------------


@query
def init_vectors(spark, sf):
    ids = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return _fields(ids.select("id", vectors.init_vector(F.col("id"), 10).alias("vec")), "id", digits=12)


def _user_fields(spark, sf):
    events = t.table(spark, sf, "events")
    return events.groupBy(F.col("user_id").alias("id"), (F.col("event_id") % 5).cast("int").alias("pos")).agg(F.max("value").alias("val"))


@query
def init_missing(spark, sf):
    keys = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return _round(vectors.fill_missing(_user_fields(spark, sf), keys, 8, -1.0, 1.0, 1), 9, "val")


@query
def vector_from_fields(spark, sf):
    packed = vectors.from_fields(_user_fields(spark, sf))
    return packed.select("id", F.size("vec").alias("size"), *(F.get("vec", F.lit(i)).alias(f"v{i}") for i in range(5)))


@query
def vector_to_fields(spark, sf):
    return vectors.to_fields(t.item_vectors(spark, sf), "item_id")


def _vector_pairs(spark, sf):
    return t.item_vectors(spark, sf).join(t.query_vectors(spark, sf).select(F.col("user_id").alias("item_id"), F.col("vec").alias("other")), "item_id")


@query
def dot_product(spark, sf):
    return _vector_pairs(spark, sf).select("item_id", F.round(vectors.dot_product(F.col("vec"), F.col("other")), 6).alias("dot"))


@query
def length_sq(spark, sf):
    return t.item_vectors(spark, sf).select("item_id", F.round(vectors.length_sq(F.col("vec")), 6).alias("length_sq"))


@query
def vector_add(spark, sf):
    both = _vector_pairs(spark, sf)
    return _fields(both.select("item_id", vectors.vector_add(F.col("vec"), F.col("other")).alias("vec")), "item_id")


# --- retrieval ------------------------------------------------------------------------------


def _customers(spark, sf):
    return t.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), CONFIG.user_init(F.col("c_custkey")).alias("vec"))


def _parts(spark, sf):
    return t.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), CONFIG.item_init(F.col("p_partkey")).alias("vec"))


def _sharded_parts(spark, sf):
    return _parts(spark, sf).withColumn("shard", (F.col("item_id") % N_SHARDS).cast("int"))


@query
def score_pairs(spark, sf):
    return _round(retrieval.score_summary(_customers(spark, sf), _parts(spark, sf)), 6, "mean", "lo", "hi")


@query
def local_topk(spark, sf):
    return retrieval.local_topk(_customers(spark, sf), _sharded_parts(spark, sf), SHARD_K)


@query
def global_topk(spark, sf):
    return retrieval.topk(_customers(spark, sf), _parts(spark, sf), CONFIG.k)


@query
def pruned_topk(spark, sf):
    return retrieval.pruned_topk(t.query_vectors(spark, sf), t.item_vectors(spark, sf), CONFIG.k)


@query
def pruned_topk_parts(spark, sf):
    """The same over many parts by falling length, of which a user visits the first few."""
    return retrieval.pruned_topk(t.query_vectors(spark, sf), t.item_vectors(spark, sf), CONFIG.k, part_items=40)


@query
def pruned_topk_lengths(spark, sf):
    """Lengths alone decide what is scored."""
    return retrieval.pruned_topk(t.query_vectors(spark, sf), t.item_vectors(spark, sf), CONFIG.k, focus=0)


@query
def shard_topk(spark, sf):
    users = _customers(spark, sf).withColumn("shard", (F.col("user_id") % N_SHARDS).cast("int"))
    return retrieval.local_topk(users, _sharded_parts(spark, sf), SHARD_K)


# --- evaluation -----------------------------------------------------------------------------


def _targets(spark, sf):
    return t.interactions(spark, sf).select("user_id", "item_id").distinct()


@query
def ndcg_single(spark, sf):
    pair = F.struct("user_id", "item_id")
    gains = evaluation.target_gain(_targets(spark, sf).withColumn("eval_id", pair), global_topk(spark, sf))
    return _round(gains.select("eval_id.user_id", "eval_id.item_id", "ndcg"), 9, "ndcg")


@query
def dcg(spark, sf):
    gains = evaluation.list_gain(global_topk(spark, sf), _targets(spark, sf))
    return gains.select("user_id", F.round("dcg", 9).alias("dcg"))


@query
def idcg(spark, sf):
    wanted = _targets(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("wanted"))
    return wanted.select("user_id", F.round(metrics.ideal_dcg(F.col("wanted"), F.lit(CONFIG.k)), 9).alias("idcg"))


@query
def ndcg_list(spark, sf):
    gains = evaluation.list_gain(global_topk(spark, sf), _targets(spark, sf))
    return gains.where(F.col("idcg") > 0).select("user_id", F.round("ndcg", 9).alias("ndcg"))


@query
def correlate_requests(spark, sf):
    answers = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("eval_id"), F.col("o_custkey").alias("src"))
    asked = t.table(spark, sf, "events").select(F.col("event_id").alias("eval_id"), F.col("user_id").alias("item_id"), t.epoch("ts").alias("ts"))
    return evaluation.correlate_requests(answers, asked)


def _remember(state, row):
    state["ts"] = row["seq"]
    return []


def _answer(state, row):
    return [(row["key"], row["seq"], state.get("ts", evaluation.NO_TS))]


@query
def cogroup_inputs(spark, sf):
    """Orders are requests, first shipments answers; an answer knows its request if that came first."""
    asked = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), t.epoch("o_orderdate").alias("seq"))
    shipped = t.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_shipdate").alias("s"))
    # an answer at the same second comes after its request
    answers = shipped.select("key", (t.epoch("s") * 2 + 1).alias("seq"))
    return evaluation.co_process(asked.withColumn("seq", F.col("seq") * 2), answers, "key", "seq", _remember, _answer,
                                 "eval_id bigint, answered bigint, asked bigint")


def _evaluations(spark, sf):
    local = retrieval.local_topk(_customers(spark, sf), _sharded_parts(spark, sf), SHARD_K)
    asked = t.interactions(spark, sf).groupBy("user_id").agg(F.min("item_id").alias("target"), F.max("ts").alias("at"))
    lists = local.groupBy("user_id", "shard").agg(F.collect_list(F.struct("item_id", "score")).alias("topk"))
    owner = F.col("shard") == F.col("target") % N_SHARDS
    parts = lists.join(asked, "user_id").select(
        F.col("user_id").alias("eval_id"), F.when(owner, F.col("target")).otherwise(evaluation.NO_ITEM).alias("item_id"),
        F.when(owner, F.col("at")).otherwise(evaluation.NO_TS).alias("ts"), "topk")
    return staged(parts, "parts")  # read more than once, and dear to find


@query
def merge_evaluations(spark, sf):
    return evaluation.merge_evaluations(_evaluations(spark, sf), CONFIG.k)


@query
def merge_distinct(spark, sf):
    """Every shard reports twice; the merge removes the repeats."""
    once = _evaluations(spark, sf)
    return evaluation.merge_evaluations(once.unionByName(once), CONFIG.k, distinct=True)


@query
def time_slots(spark, sf):
    slot = evaluation.time_slot(F.col("ts") - 900_000_000, 86400)
    return t.interactions(spark, sf).groupBy(slot.alias("time_slot")).agg(F.count(F.lit(1)).alias("n"))


@query
def ndcg_by_slot(spark, sf):
    return _round(evaluate_fixed(t.interactions(spark, sf), CONFIG), 6, "ndcg")


@query
def ndcg_by_slot_ascending(spark, sf):
    return _round(evaluate_fixed(t.interactions(spark, sf), replace(CONFIG, order="ascending")), 6, "ndcg")


@query
def count_window(spark, sf):
    return evaluation.count_window(
        t.table(spark, sf, "events"), ["user_id"], "event_id", 8,
        [F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.round(F.sum("value"), 4).alias("total")])


@query
def session_by_key(spark, sf):
    events = t.table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    return _round(evaluation.session_by_key(events, "user_id", "at", 21_600, "value"), 4, "total")


@query
def latency_stats(spark, sf):
    entered = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("eval_id"), "o_orderpriority", t.epoch("o_orderdate").alias("ts_in"))
    left = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("eval_id"), t.epoch("l_shipdate").alias("ts_out"))
    return _round(evaluation.latency_stats(entered, left, "o_orderpriority"), 4, "mean")


# --- training -------------------------------------------------------------------------------


def _catalog(df: DataFrame, config: FactorConfig) -> DataFrame:
    return df.select(F.col("item_id").alias("id")).distinct().select("id", config.item_init(F.col("id")).alias("vec"))


@query
def negative_samples(spark, sf):
    asked = t.requests(spark, sf)
    return training.negative_samples(asked, asked.select(F.col("item_id").alias("id")).distinct(), 4)


@query
def sgd_step(spark, sf):
    asked = t.requests(spark, sf)
    users = asked.select(F.col("user_id").alias("id")).distinct().select("id", TRAIN.user_init(F.col("id")).alias("vec"))
    new_users, new_items = training.sgd_step(asked, users, _catalog(asked, TRAIN), TRAIN.dim, TRAIN.learning_rate, TRAIN.negatives)
    return (_fields(new_users, "id").withColumn("side", F.lit("user"))
            .unionByName(_fields(new_items, "id").withColumn("side", F.lit("item"))))


@query
def sgd_step_float(spark, sf):
    """The step of the store that rounds what a request adds to its user; vectors wide enough to show it."""
    asked = t.requests(spark, sf)
    users = asked.select(F.col("user_id").alias("id")).distinct().select("id", CONFIG.user_init(F.col("id")).alias("vec"))
    precision = store_options("kafkaredis")["user_precision"]
    new_users, new_items = training.sgd_step(asked, users, _catalog(asked, CONFIG), CONFIG.dim, CONFIG.learning_rate, CONFIG.negatives,
                                             user_precision=precision)
    return (_fields(new_users, "id", digits=7).withColumn("side", F.lit("user"))
            .unionByName(_fields(new_items, "id", digits=7).withColumn("side", F.lit("item"))))


@query
def sgd_strata(spark, sf):
    """One pass over all requests, each step after the one before it."""
    asked = t.requests(spark, sf)
    users = asked.select(F.col("user_id").alias("id")).distinct().select("id", TRAIN.user_init(F.col("id")).alias("vec"))
    new_users, new_items = training.sgd_pass(asked, users, _catalog(asked, TRAIN), TRAIN.learning_rate, TRAIN.negatives)
    return (_fields(new_users, "id").withColumn("side", F.lit("user"))
            .unionByName(_fields(new_items, "id").withColumn("side", F.lit("item"))))


@query
def prequential(spark, sf):
    asked = t.requests(spark, sf)
    return _round(train_eval.prequential(asked, _catalog(asked, TRAIN), TRAIN, YEAR), 6, "ndcg")


@query
def prequential_growing(spark, sf):
    """Items are not known before they are asked for; batches of a year."""
    return _round(train_eval.prequential(t.requests(spark, sf), None, TRAIN, YEAR), 6, "ndcg")


@query
def online_train_eval(spark, sf):
    asked = t.requests(spark, sf)
    return _round(train_eval.online_train_eval(asked, _catalog(asked, TRAIN), TRAIN, YEAR), 6, "ndcg")


@query
def job_report(spark, sf):
    """The whole job from text to text, with four shards that offer their best; the report as it was written."""
    source, report = scratch_path(spark, "job-in"), scratch_path(spark, "job-out")
    t.interactions(spark, sf).select(F.concat_ws(",", "ts", "user_id", "item_id").alias("value")).write.text(source)
    train_eval.run_job(spark, source, report, replace(TRAIN, shards=N_SHARDS), YEAR)
    return _round(sinks.read_report(spark, report), 6, "ndcg")


@query
def param_loop(spark, sf):
    """Users gather [value, 1, 0]; every event reports the vector its week started with."""
    events = t.table(spark, sf, "events").select("event_id", "user_id", "value", t.epoch("ts").alias("ts"))

    def step(answered):
        pushes = answered.select(F.col("user_id").alias("id"), F.array("value", F.lit(1.0), F.lit(0.0)).alias("vec"))
        return params.vector_sum(pushes, "id", DIM), answered.select("event_id", "vec")

    root = scratch_path(spark, "param-loop")
    loop = ParameterLoop(ParamTable(spark, f"{root}/users", DIM, compact_every=2).create(), init3, step, f"{root}/out")
    n = over_slots(loop.process, events, WEEK)
    return _fields(read_batches(spark, loop.out, n), "event_id")


@query
def worker_only_loop(spark, sf):
    """Workers alone: an event goes to every shard; its owner adds [value, 0, 0], each shard [0, 1, 0]."""
    events = t.table(spark, sf, "events").select("event_id", "user_id", "value", t.epoch("ts").alias("ts"))

    def step(answered):
        own = F.when(F.pmod("event_id", F.lit(N_SHARDS)) == F.col("shard"), F.col("value")).otherwise(0.0)
        pushes = answered.select(F.col("user_id").alias("id"), F.array(own, F.lit(1.0), F.lit(0.0)).alias("vec"))
        return params.vector_sum(pushes, "id", DIM), answered.select("event_id", "shard", "vec")

    root = scratch_path(spark, "worker-loop")
    table = ParamTable(spark, f"{root}/users", DIM, compact_every=2).create()
    loop = ParameterLoop(table, init3, step, f"{root}/out", shards=N_SHARDS)
    n = over_slots(loop.process, events, WEEK)
    return _fields(read_batches(spark, loop.out, n), "event_id", "shard")


# --- streams --------------------------------------------------------------------------------


def _pieces(df: DataFrame, order: str, pieces: int = 4) -> list[DataFrame]:
    """The rows in `pieces` steps by `order`, a numeric column."""
    cut, n = with_segment(df, order, max(1, ceil(df.count() / pieces)))
    return [cut.where(F.col(SEGMENT) == i).drop(SEGMENT) for i in range(n)]


def _arrive(spark, pieces: list[DataFrame], writer) -> int:
    """Let rows arrive a piece at a time; `writer(stream)` makes the stream writer, which resumes from its checkpoint at
    every step. The number of micro-batches that had rows."""
    path = scratch_path(spark, "arrivals")
    for piece in pieces:
        piece.write.mode("append").parquet(path)
        run_available(writer(spark.readStream.schema(piece.schema).parquet(path)))
    return len(pieces)


def _feed(spark, sf, writer, pieces: int = 4) -> int:
    """Let the messages arrive in `pieces` steps in `seq` order."""
    return _arrive(spark, _pieces(t.messages(spark, sf), "seq", pieces), writer)


def _append_to(spark, out: str, state: str):
    return lambda df: df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)


def _timed_events(spark, sf) -> DataFrame:
    return t.table(spark, sf, "events").select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("at"))


def _and_a_last_row(pieces: list[DataFrame], time: str) -> list[DataFrame]:
    """A row without a key, 1000 days later, lets the watermark pass all others."""
    schema = pieces[-1].schema
    end = pieces[-1].agg(F.expr(f"max({time}) + interval 1000 days").alias(time))
    return [*pieces, end.select(*((F.col(f.name) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))]


@query
def count_window_stream(spark, sf):
    """Windows of eight events of a user, in order, whatever the micro-batches."""
    out, state = scratch_path(spark, "windows"), scratch_path(spark, "state")
    # every piece holds events of all times, so many arrive long before and after their turn; the watermark waits for them
    events = _timed_events(spark, sf)
    pieces = _and_a_last_row([events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) for i in range(3)], "at")

    def fold(rows):
        return int(rows["event_id"].iloc[0]), int(rows["event_id"].iloc[-1]), float(rows["value"].sum())

    def writer(stream):
        found = keyed.ordered_count_windows(stream, "user_id", "event_id", "at", 8, fold,
                                            "first_id bigint, last_id bigint, total double", "400 days")
        return _append_to(spark, out, state)(found)

    with keyed.state_store(spark):
        _arrive(spark, pieces, writer)
    return _round(spark.read.parquet(out), 4, "total")


@query
def merge_evaluations_stream(spark, sf):
    """Partial lists of four shards arrive apart from each other; a list is merged when its fourth part is there."""
    out, state = scratch_path(spark, "merged"), scratch_path(spark, "state")
    parts = _evaluations(spark, sf)
    by = F.pmod(F.xxhash64("eval_id", F.col("topk")[0]["item_id"]), F.lit(4))
    pieces = [parts.where(by == i) for i in range(4)]
    with keyed.state_store(spark):
        _arrive(spark, pieces, lambda stream: _append_to(spark, out, state)(keyed.merge_evaluations_stream(stream, N_SHARDS, CONFIG.k)))
    return spark.read.parquet(out)


@query
def model_callbacks(spark, sf):
    """Suppliers' vectors are the model; pulls read it and pushes change it, key by key."""
    out, state = scratch_path(spark, "answers"), scratch_path(spark, "state")

    def writer(messages):
        found = keyed.model_callbacks(messages, "dest", "seq", keyed.answer_or_add, "src bigint, dest bigint, vec array<double>",
                                      _supplier_params(spark, sf))
        return _append_to(spark, out, state)(found)

    with keyed.state_store(spark):
        _feed(spark, sf, writer)
    return _fields(spark.read.parquet(out), "src", "dest")


@query
def session_stream(spark, sf):
    """Sessions of a user, each reported once the stream has passed it; a user that comes back has another."""
    out, state = scratch_path(spark, "sessions"), scratch_path(spark, "state")
    events = _timed_events(spark, sf).withColumn("second", F.unix_micros("at"))
    pieces = _and_a_last_row([p.drop("second") for p in _pieces(events, "second")], "at")
    _arrive(spark, pieces, lambda s: _append_to(spark, out, state)(stream_windows.sessions_stream(s, "user_id", "at", 21_600, "value")))
    return _round(spark.read.parquet(out).where("user_id is not null"), 4, "total")


@query
def dense_ids_stream(spark, sf):
    """Requests arrive in time order and get numbers without gaps over all micro-batches."""
    out, state = scratch_path(spark, "numbered"), scratch_path(spark, "state")
    # joined once: the pieces are counted, cut and read one by one
    rows = staged(t._lines_with_orders(spark, sf, "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"), "lines")
    n = _arrive(spark, _pieces(rows, "ts"), lambda s: counters.dense_ids_stream(s, t.ARRIVAL_ORDER, out, state))
    return read_batches(spark, out, n).select("eval_id", "user_id", "item_id", F.lit(1.0).alias("rating"), "ts")


@query
def latency_stream(spark, sf):
    """Orders enter and lines leave, both in time order; latencies up to 200 days, counted in each micro-batch."""
    out, state = scratch_path(spark, "latency"), scratch_path(spark, "state")
    entered = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("eval_id"), "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("entered"))
    left = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("eval_id"), F.col("l_shipdate").cast("timestamp").alias("left"))
    paths = [scratch_path(spark, "entered"), scratch_path(spark, "left")]
    cuts = entered.select(F.unix_seconds("entered").alias("s")).approxQuantile("s", [0.0, 0.34, 0.67], 0.01)
    for i, low in enumerate(cuts):
        high = cuts[i + 1] if i + 1 < len(cuts) else float("inf")
        for df, time, path in zip((entered, left), ("entered", "left"), paths, strict=True):
            second = F.unix_seconds(time)
            df.where((second < high) if i == 0 else ((second >= low) & (second < high))).write.mode("append").parquet(path)
        run_available(counters.latency_counts(spark.readStream.schema(entered.schema).parquet(paths[0]),
                                              spark.readStream.schema(left.schema).parquet(paths[1]), "o_orderpriority", out, state, "200 days"))
    return _round(counters.latency_so_far(spark, out, "o_orderpriority"), 4, "mean")


@query
def topic_latest(spark, sf):
    """A reader that starts at a topic's latest message, and goes on from there after a restart; the sink writes the topic."""
    topic, out = scratch_path(spark, "topic"), scratch_path(spark, "decoded")
    states = [scratch_path(spark, "state") for _ in range(2)]
    sent = t.messages(spark, sf, whole=True)
    pieces = [text.encode_messages(sent.where(F.col("seq") % 4 == i).drop("seq")) for i in range(4)]
    arrived = scratch_path(spark, "lines")

    def publish(piece):
        piece.write.mode("append").text(arrived)
        run_available(topics.write_folder_topic(spark.readStream.text(arrived), topic, states[0]))

    def listen():
        decoded = _message_columns(text.decode_messages(topics.read_folder_topic(spark, topic)))
        run_available(_append_to(spark, out, states[1])(decoded))

    publish(pieces[0])
    listen()  # nothing new yet: what is there was there before
    for piece in pieces[1:]:
        publish(piece)
        listen()
    return spark.read.schema("kind string, src bigint, dest bigint, v0 double, v1 double, v2 double").parquet(out)


@query
def param_stream(spark, sf):
    """State of every key after the stream, from a streaming aggregate that reports changed keys only."""
    out, state = scratch_path(spark, "params"), scratch_path(spark, "state")

    def writer(messages):
        current = stream_params.param_state(messages, DIM, init3)
        save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        return each_batch(current, save, state).outputMode("update")

    _feed(spark, sf, writer)
    reported = spark.read.schema("id bigint, vec array<double>, batch bigint").parquet(out)
    return _fields(reported.groupBy("id").agg(F.max_by("vec", "batch").alias("vec")), "id")


@query
def pull_stream(spark, sf):
    """Answers of the stream, with the vectors in a table between micro-batches."""
    root = scratch_path(spark, "serve")
    held = ParamTable(spark, f"{root}/params", DIM, compact_every=3).create()
    n = _feed(spark, sf, lambda messages: stream_params.serve_from_table(
        messages, held, f"{root}/out", init3, f"{root}/state"))
    return _fields(read_batches(spark, f"{root}/out", n), "src", "dest")
