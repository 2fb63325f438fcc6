"""The event log as a stream: exactly-once appends, a live view of runs, triggers, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dagframe.operators.eventlog import EVENT
from dagframe.sources.files import append_events


def log_stream(spark: SparkSession, path: str, form: str = "json", files_per_batch: int = 100) -> DataFrame:
    """Events from a folder as they come."""
    reader = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path) if form == "json" else reader.parquet(path)


def once(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each run and seq once; with a delay, which bounds the state, only repeats within it are known."""
    if delay is None:
        return events.dropDuplicates(["run_id", "seq"])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "seq"])


def append_stream(events: DataFrame, path: str, checkpoint: str, every: str = "100 milliseconds", available_now: bool = False) -> StreamingQuery:
    """Append events to a Parquet log in small batches; a batch that is played again adds nothing."""
    writer = events.writeStream.foreachBatch(lambda batch, _: append_events(batch.sparkSession, batch, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def live_runs(events: DataFrame) -> DataFrame:
    """Status of each run as far as it is known, for update or complete mode."""
    start, end = F.col("event_type") == "run_started", F.col("event_type") == "run_completed"
    folded = events.groupBy("run_id").agg(F.max(F.when(start, F.struct("seq", "flow_id"))).alias("s"), F.max(F.when(end, F.struct("seq", "status", "duration_ms"))).alias("e"), F.count(F.lit(1)).alias("n_events"))
    status = F.when(F.col("s").isNull() & F.col("e").isNull(), "pending").when(F.col("e").isNotNull() & (F.col("s").isNull() | (F.col("e.seq") > F.col("s.seq"))), F.col("e.status")).otherwise("running")
    return folded.select("run_id", "s.flow_id", status.alias("status"), "e.duration_ms", "n_events")


def trigger_stream(triggers: DataFrame, delay: str | None = None) -> DataFrame:
    """Triggers without repeats of their keys; those without a key all pass and leave no state. With a delay, which bounds the state, only repeats within it are known."""
    keyed = triggers.where("idempotency_key is not null")
    kept = keyed.dropDuplicates(["idempotency_key"]) if delay is None else keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["idempotency_key"])
    return kept.unionByName(triggers.where("idempotency_key is null"))


def chain_stream(events: DataFrame, source_flow: str, target_flow: str, statuses: tuple[str, ...] = ("completed",)) -> DataFrame:
    from dagframe.operators.triggers import chained

    return chained(events, source_flow, target_flow, statuses)


def cron_stream(spark: SparkSession, flow_id: str, every_seconds: int) -> DataFrame:
    """Triggers at a fixed interval, with the tick's second as idempotency key; cron lines belong to an outer scheduler."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    due = ticks.where(F.unix_timestamp("timestamp") % every_seconds == 0)
    return due.select(F.lit(flow_id).alias("flow_id"), F.lit("{}").alias("inputs"), F.concat_ws(":", F.lit("cron"), F.lit(flow_id), F.unix_timestamp("timestamp").cast("string")).alias("idempotency_key"), F.col("timestamp").alias("ts"))


def awaited(requests: DataFrame, answers: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Human answers joined to the nodes that wait for them, by run and node, within a delay: stream to stream."""
    left = requests.withWatermark("ts", delay).select("run_id", "node_id", F.col("ts").alias("asked_at"))
    right = answers.withWatermark("ts", delay).select(F.col("run_id").alias("_run"), F.col("node_id").alias("_node"), F.col("ts").alias("answered_at"), "value")
    on = (F.col("run_id") == F.col("_run")) & (F.col("node_id") == F.col("_node")) & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {delay}"))
    return left.join(right, on).drop("_run", "_node")
