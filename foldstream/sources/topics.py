"""Topics of text messages: Kafka on a cluster, a shared folder elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from foldstream.sources import folder_topic


def read_topic(spark: SparkSession, topic: str, servers: str | None = None,
               starting: str = "latest", per_batch: int | None = None) -> DataFrame:
    """A streaming DataFrame with one string column `value`.

    With `servers`, `topic` is a Kafka topic, by default from its latest offset; messages already
    there are skipped. Without, it is a folder that files are added to.
    """
    if servers is None:
        reader = spark.readStream
        if per_batch:
            reader = reader.option("maxFilesPerTrigger", per_batch)
        return reader.text(topic)
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", starting))
    if per_batch:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load().selectExpr("cast(value as string) as value")


def read_folder_topic(spark: SparkSession, path: str, starting: str = "latest") -> DataFrame:
    """Messages (value) of a topic that `write_folder_topic` writes, from its first or after its latest commit."""
    folder_topic.register(spark)
    return spark.readStream.format(folder_topic.FORMAT).option("path", path).option("starting", starting).load()


def write_folder_topic(lines: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer, not yet started; a micro-batch that runs again replaces its commit."""
    folder_topic.register(lines.sparkSession)
    return (lines.select("value").writeStream.format(folder_topic.FORMAT).outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint))


def write_topic(lines: DataFrame, topic: str, checkpoint: str, servers: str | None = None) -> DataStreamWriter:
    """A writer, not yet started, for a streaming DataFrame with a string column `value`."""
    writer = lines.select("value").writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if servers is None:
        return writer.format("text").option("path", topic)
    return writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
