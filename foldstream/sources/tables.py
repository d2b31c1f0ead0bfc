"""The test tables as interactions, messages and vectors. Times are read in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstream.operators.ids import dense_ids
from foldstream.sources.text import PULL, PUSH

PUSH_EVENTS = ("purchase", "click", "signup")
ARRIVAL_ORDER = ["ts", "l_orderkey", "l_linenumber", "item_id", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str | Column) -> Column:
    """Seconds since 1970 of a time without zone."""
    return F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def _lines_with_orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), epoch("o_orderdate").alias("ts"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id"), *columns)
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, rating, ts), one row per order line."""
    return _lines_with_orders(spark, sf_dir).select("user_id", "item_id", F.lit(1.0).alias("rating"), "ts")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions with `eval_id`, dense in arrival order."""
    rows = _lines_with_orders(spark, sf_dir, "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    numbered = dense_ids(rows, ARRIVAL_ORDER)
    return numbered.select("eval_id", "user_id", "item_id", F.lit(1.0).alias("rating"), "ts")


def messages(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Events as (kind, src, dest, vec, seq); with `whole`, vectors hold whole numbers only."""
    value = F.floor("value").cast("double") if whole else F.col("value")
    push = F.col("event_type").isin(*PUSH_EVENTS)
    vec = F.array(value, (F.col("event_id") % 7).cast("double"), (F.col("event_id") % 3).cast("double"))
    return table(spark, sf_dir, "events").select(
        F.when(push, PUSH).otherwise(PULL).alias("kind"), F.col("event_id").alias("src"),
        F.col("user_id").alias("dest"), F.when(push, vec).alias("vec"), F.col("event_id").alias("seq"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings scaled to differ in length: (item_id, vec)."""
    scale = F.pow(F.lit(2.0), F.col("vec_id") % 8)
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("vec"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as they are: (user_id, vec)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("user_id"), F.col("embedding").cast("array<double>").alias("vec"))
