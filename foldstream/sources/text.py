"""Comma and colon separated records: interactions, model lines, messages, answers.

Every decoder maps a DataFrame with a string column `value` to typed columns, so it serves
`spark.read.text`, a file stream and a Kafka topic alike (`DataFrame.transform`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the message format.
PULL = "Pull"
PUSH = "Push"
ANSWER = "PullAnswer"


def _strict(text: Column, dtype: str) -> Column:
    """Cast that ends the job on bad input, whatever the ANSI setting."""
    message = F.concat(F.lit(f"not a {dtype}: "), F.coalesce(text, F.lit("(missing)")))
    return F.coalesce(text.try_cast(dtype), F.raise_error(message).cast(dtype))


def _strict_vector(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), ",")
    return F.transform(parts, lambda x: _strict(x, "double"))


def _printed(vec: Column) -> Column:
    return F.concat_ws(",", F.transform(vec, lambda x: x.cast("string")))


# --- interactions ---------------------------------------------------------------------------


def decode_interactions(lines: DataFrame, user: int = 1, item: int = 2, ts: int = 0,
                        eval_id: int | None = None, ts_offset: int = 0) -> DataFrame:
    """Pick fields by 0-based position; further fields are ignored; the rating is 1.0."""
    parts = F.split("value", ",")

    def field(i: int) -> Column:
        return _strict(F.get(parts, F.lit(i)), "bigint")

    columns = [field(user).alias("user_id"), field(item).alias("item_id"),
               F.lit(1.0).alias("rating"), (field(ts) - F.lit(ts_offset)).alias("ts")]
    if eval_id is not None:
        columns.insert(0, field(eval_id).alias("eval_id"))
    return lines.select(*columns)


def read_interactions(spark: SparkSession, path: str, **layout) -> DataFrame:
    return decode_interactions(spark.read.text(path), **layout)


def stream_interactions(spark: SparkSession, path: str, files_per_batch: int = 1, **layout) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return decode_interactions(lines, **layout)


# --- model lines ----------------------------------------------------------------------------


def decode_model(lines: DataFrame) -> DataFrame:
    """`id,v0,v1,...` to (id, vec)."""
    parts = F.split("value", ",", 2)
    return lines.select(_strict(F.get(parts, F.lit(0)), "bigint").alias("id"),
                        _strict_vector(F.get(parts, F.lit(1))).alias("vec"))


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return decode_model(spark.read.text(path))


def encode_model(params: DataFrame, sep: str = ":") -> DataFrame:
    """(id, vec) to `id:v0,v1,...`; `sep=","` gives the form `decode_model` reads."""
    return params.select(F.concat(F.col("id").cast("string"), F.lit(sep), _printed(F.col("vec"))).alias("value"))


# --- messages -------------------------------------------------------------------------------


def _message_fields(lines: DataFrame) -> tuple[Column, Column, Column, Column]:
    parts = F.split("value", ":")
    return tuple(F.get(parts, F.lit(i)) for i in range(4))


def require(condition: Column, message: Column) -> Column:
    """A condition for a filter: true, or the job fails with the message."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def decode_messages(lines: DataFrame) -> DataFrame:
    """`Pull:src:dest` and `Push:src:dest:v0,...` to (kind, src, dest, vec); others end the job."""
    kind, src, dest, payload = _message_fields(lines)
    # a filter, so that the check stays when the kind is not selected
    known = require(kind.isin(PULL, PUSH), F.concat(F.lit("message kind not supported: "), F.coalesce(kind, F.lit("(missing)"))))
    return lines.where(known).select(kind.alias("kind"), _strict(src, "bigint").alias("src"),
                        _strict(dest, "bigint").alias("dest"),
                        F.when(kind == PUSH, _strict_vector(payload)).alias("vec"))


def split_rejects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines `decode_messages` accepts, lines it would fail on)."""
    kind, src, dest, payload = _message_fields(lines)
    numbers = F.transform(F.split(payload, ","), lambda x: x.try_cast("double"))
    keyed = src.try_cast("bigint").isNotNull() & dest.try_cast("bigint").isNotNull()
    ok = F.coalesce(keyed & ((kind == PULL) | ((kind == PUSH) & F.forall(numbers, lambda x: x.isNotNull()))),
                    F.lit(False))
    return lines.where(ok), lines.where(~ok)


def decode_answers(lines: DataFrame) -> DataFrame:
    """`src:dest:v0,...` to (src, dest, vec); src is the parameter key."""
    parts = F.split("value", ":")
    return lines.select(_strict(F.get(parts, F.lit(0)), "bigint").alias("src"),
                        _strict(F.get(parts, F.lit(1)), "bigint").alias("dest"),
                        _strict_vector(F.get(parts, F.lit(2))).alias("vec"))


def encode_messages(messages: DataFrame) -> DataFrame:
    """(kind, src, dest, vec) to text; answers are printed without their kind."""
    src, dest = F.col("src").cast("string"), F.col("dest").cast("string")
    head = F.when(F.col("kind") != ANSWER, F.col("kind"))
    body = F.when(F.col("kind") != PULL, _printed(F.col("vec")))
    return messages.select(F.concat_ws(":", head, src, dest, body).alias("value"))
