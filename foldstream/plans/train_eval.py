"""Online recommendation: evaluate each batch with the vectors held so far, then train on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstream.functions.vectors import init_vector
from foldstream.operators.evaluation import slot_report, target_gain
from foldstream.operators.ids import dense_ids
from foldstream.operators.params import vector_sum
from foldstream.operators.retrieval import local_topk, pruned_topk, ranked, topk
from foldstream.operators.training import drawn_requests, item_index, sgd_deltas
from foldstream.plans.loop import over_slots
from foldstream.plans.store import ParamTable, read_batches, store_options
from foldstream.session import cut_lineage, scratch_path, staged
from foldstream.sources.sinks import save_report
from foldstream.sources.text import read_interactions

USER_SEED = 1
ITEM_SEED = 2

# Defaults of the factorisation job.
DEFAULTS = {
    "learning_rate": 0.4,
    "negatives": 9,
    "dim": 10,
    "lo": -0.001,
    "hi": 0.001,
    "k": 100,
    "worker_k": 100,
    "bucket_size": 75,
    "slot_seconds": 86400,
}


@dataclass(frozen=True)
class FactorConfig:
    """Settings of the job. With `shards` over 1 every shard of the items offers its `worker_k` best, and the k best of
    those are the list; a `worker_k` below k may then leave out items that are among the k best of all. With `only_shard`
    that shard's best are the list, as a worker sees it.
    """

    learning_rate: float = DEFAULTS["learning_rate"]
    negatives: int = DEFAULTS["negatives"]
    dim: int = DEFAULTS["dim"]
    lo: float = DEFAULTS["lo"]
    hi: float = DEFAULTS["hi"]
    k: int = DEFAULTS["k"]
    worker_k: int = DEFAULTS["worker_k"]
    shards: int = 1
    only_shard: int | None = None
    bucket_size: int = DEFAULTS["bucket_size"]
    slot_seconds: int = DEFAULTS["slot_seconds"]
    order: str = "descending"
    pruned: bool = False
    store: str = "kafka"
    seed: int = 0

    def user_init(self, key):
        return init_vector(key, self.dim, self.lo, self.hi, USER_SEED)

    def item_init(self, key):
        return init_vector(key, self.dim, self.lo, self.hi, ITEM_SEED)


class TrainEval:
    """Users, items and per-request results of a run, all below `root`."""

    def __init__(self, spark: SparkSession, root: str, config: FactorConfig):
        self.user_precision = store_options(config.store)["user_precision"]
        self.spark, self.config = spark, config
        self.users = ParamTable(spark, f"{root}/users", config.dim)
        # an item's place in the index is stored with it
        self.items = ParamTable(spark, f"{root}/items", config.dim, carry="idx")
        self.out = f"{root}/results"

    def create(self, users: DataFrame | None = None, items: DataFrame | None = None) -> TrainEval:
        """Start from the given vectors (id, vec). Items get their places in the index by id."""
        self.users.create(users)
        if items is None:
            self.items.create()
        else:
            indexed, n = item_index(items)
            self.items.create(indexed, n)
        return self

    def process(self, requests: DataFrame, batch_id: int) -> None:
        """requests: (eval_id, user_id, item_id, rating, ts). Results hold (eval_id, ndcg, ts).

        The index of items is only ever added to: items of this batch that are new get the next places, by id. Without new
        items nothing of the catalogue is sorted or numbered.
        """
        c = self.config
        wanted = requests.select(F.col("user_id").alias("id")).distinct()
        held = wanted.join(self.users.read(batch_id, wanted).withColumn("old", F.lit(True)), "id", "left")
        users = staged(held.select("id", F.coalesce("vec", c.user_init(F.col("id"))).alias("vec"),
                                   F.col("old").isNull().alias("new")), "users")
        n_users = users.count()
        known, n_known = self.items.read(batch_id), self.items.count(batch_id)
        ranks = self.rank(users, known, n_users, n_known)
        target_gain(requests, ranks, c.order).write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")

        asked = requests.select(F.col("item_id").alias("id")).distinct()
        fresh, n_fresh = self._numbered(asked.join(known.select("id"), "id", "left_anti"), n_known)
        items, n = known.unionByName(fresh) if n_fresh else known, n_known + n_fresh
        pairs = drawn_requests(requests, items.select("id", "idx"), n, c.negatives, c.seed)
        user_deltas, item_deltas = sgd_deltas(pairs, users, items, c.dim, c.learning_rate, n_users, n, self.user_precision)
        self.users.append(users.where("new").select("id", "vec").unionByName(user_deltas), batch_id)
        # every batch reads the whole catalogue to rank it, so its rows are added up once, here
        after = vector_sum(items.unionByName(item_deltas, allowMissingColumns=True), "id", c.dim, carry="idx")
        self.items.replace(after, batch_id, n)

    def _numbered(self, ids: DataFrame, first: int) -> tuple[DataFrame, int]:
        """New items (id, vec, idx) with places from `first` on, and how many there are."""
        if ids.isEmpty():
            return ids, 0
        indexed, n = item_index(staged(ids, "fresh"))
        return indexed.select("id", self.config.item_init(F.col("id")).alias("vec"), (F.col("idx") + first).alias("idx")), n

    def process_micro_batch(self, requests: DataFrame, batch_id: int) -> None:
        """`process` for a stream: the source is read once."""
        self.process(cut_lineage(requests), batch_id)

    def rank(self, users: DataFrame, items: DataFrame, n_users: int | None = None, n_items: int | None = None) -> DataFrame:
        """Each user's list. Row counts that are known already need not be taken again."""
        c = self.config
        queries = users.select(F.col("id").alias("user_id"), "vec")
        catalog = items.select(F.col("id").alias("item_id"), "vec")
        if c.only_shard is not None:
            # one shard offers its items alone
            own = catalog.where(F.pmod("item_id", F.lit(c.shards)) == c.only_shard)
            return topk(queries, own, min(c.k, c.worker_k), n_users=n_users)
        if c.shards > 1:
            sharded = catalog.withColumn("shard", F.pmod("item_id", F.lit(c.shards)).cast("int"))
            offered = local_topk(queries, sharded, c.worker_k).drop("rank", "shard")
            return ranked(offered, c.k, ["user_id"])
        if c.pruned:
            return pruned_topk(queries, catalog, c.k, c.bucket_size)
        return topk(queries, catalog, c.k, n_users=n_users, n_items=n_items)

    def results(self, n_batches: int) -> DataFrame:
        return read_batches(self.spark, self.out, n_batches)


def prequential(requests: DataFrame, items: DataFrame | None, config: FactorConfig, batch_seconds: int,
                root: str | None = None) -> DataFrame:
    """Results (eval_id, ndcg, ts) of evaluating, then training on, each time slot in turn."""
    spark = requests.sparkSession
    run = TrainEval(spark, root or scratch_path(spark, "train-eval"), config).create(items=items)
    return run.results(over_slots(run.process, requests, batch_seconds))


def online_train_eval(requests: DataFrame, items: DataFrame | None, config: FactorConfig, batch_seconds: int,
                      root: str | None = None) -> DataFrame:
    """The whole job: (time_slot, ndcg, n), average metric and count per reporting slot."""
    return slot_report(prequential(requests, items, config, batch_seconds, root), config.slot_seconds)


def run_job(spark: SparkSession, interactions: str, report: str, config: FactorConfig, batch_seconds: int,
            items: DataFrame | None = None, algorithm: str = "factorisation") -> DataFrame:
    """The job from files to a file: `ts,user,item` lines in, `slot,ndcg,n` lines out; also gives the report.

    `algorithm` names one of ALGORITHMS: `factorisation` evaluates and trains, `untrained` evaluates the initial vectors.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm not supported: {algorithm}")
    requests = dense_ids(read_interactions(spark, interactions), ["ts", "user_id", "item_id"])
    result = staged(ALGORITHMS[algorithm](requests, items, config, batch_seconds), "report")
    save_report(result, report)
    return result


def evaluate_fixed(requests: DataFrame, config: FactorConfig) -> DataFrame:
    """Report of untrained vectors over all requests: initial vectors, top-K, metric, slots."""
    requests = staged(requests.select("user_id", "item_id", "ts"), "requests")
    users = requests.select(F.col("user_id").alias("id")).distinct().select("id", config.user_init(F.col("id")).alias("vec"))
    items = requests.select(F.col("item_id").alias("id")).distinct().select("id", config.item_init(F.col("id")).alias("vec"))
    queries = users.select(F.col("id").alias("user_id"), "vec")
    catalog = items.select(F.col("id").alias("item_id"), "vec")
    ranks = pruned_topk(queries, catalog, config.k, config.bucket_size) if config.pruned else topk(queries, catalog, config.k)
    return slot_report(target_gain(requests, ranks, config.order), config.slot_seconds)


#: (requests, items, config, batch_seconds) to (time_slot, ndcg, n).
ALGORITHMS = {
    "factorisation": online_train_eval,
    "untrained": lambda requests, items, config, batch_seconds: evaluate_fixed(requests, config),
}
