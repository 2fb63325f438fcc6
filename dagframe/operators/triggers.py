"""What starts runs: trigger events, without repeats and with a version; runs that start others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("flow_id", "version_id", "inputs", "source", "idempotency_key")


def once(triggers: DataFrame, order: str = "ts") -> DataFrame:
    """The first trigger of each idempotency key; those without one all pass."""
    keyed = triggers.where("idempotency_key is not null")
    rest = [c for c in triggers.columns if c != "idempotency_key"]
    first = keyed.groupBy("idempotency_key").agg(F.min_by(F.struct(*rest), order).alias("_t")).select(*[F.col(f"_t.{c}").alias(c) for c in rest], "idempotency_key")
    return first.select(*triggers.columns).unionByName(triggers.where("idempotency_key is null"))


def resolved(triggers: DataFrame, heads: DataFrame, versions: DataFrame) -> DataFrame:
    """Triggers with the version that they name or else their flow's head; those with neither go."""
    known = versions.select(F.col("version_id").alias("_known")).distinct()
    head = heads.select("flow_id", F.col("current_version_id").alias("_head"))
    out = triggers.join(head, "flow_id", "left").join(known, F.col("version_id") == F.col("_known"), "left")
    return out.withColumn("version_id", F.when(F.col("version_id").isNull(), F.col("_head")).otherwise(F.col("_known"))).where("version_id is not null").select(*triggers.columns)


def chained(log: DataFrame, source_flow: str, target_flow: str, statuses: tuple[str, ...] = ("completed",)) -> DataFrame:
    """Triggers of a flow for the completed runs of another."""
    done = log.where((F.col("event_type") == "run_completed") & (F.col("flow_id") == source_flow) & F.col("status").isin(*statuses))
    return done.select(F.lit(target_flow).alias("flow_id"), F.lit(None).cast("string").alias("version_id"), F.lit("{}").alias("inputs"), F.concat(F.lit("flow:"), "run_id").alias("source"), F.concat_ws(":", F.lit("flow"), F.lit(target_flow), "run_id").alias("idempotency_key"), "ts")


def http_route(path: str, method: str = "post") -> tuple[str, str]:
    """(path, METHOD) of a route; the path starts with a slash."""
    if not path.startswith("/"):
        raise ValueError("a route's path starts with /")
    return path, method.upper()
