"""Topics as folders: what is published is appended, and each subscriber reads what comes after it has begun or all there is."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def _folder(root: str, topic: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", topic):
        raise ValueError(f"no topic name: {topic!r}")
    return f"{root.rstrip('/')}/topic={topic}"


def publish(messages: DataFrame, root: str, topic: str) -> None:
    messages.write.mode("append").parquet(_folder(root, topic))


def publish_stream(messages: DataFrame, root: str, topic: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = messages.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(_folder(root, topic))


def subscribe(spark: SparkSession, root: str, topic: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Messages of a topic as a stream; unlike a queue in memory it loses none to a slow subscriber."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_folder(root, topic))
