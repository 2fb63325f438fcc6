"""Keyed tables: rows that are kept once, and heads and tags whose last write counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_rows(stored: DataFrame, batch: DataFrame, keys: list[str], within: bool = True) -> DataFrame:
    """Rows of a batch whose key isn't stored; with ``within`` also once each inside the batch."""
    fresh = batch.join(stored.select(*keys), keys, "left_anti")
    return fresh.dropDuplicates(keys) if within else fresh


def insert_ignore(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return stored.unionByName(new_rows(stored, batch, keys), allowMissingColumns=True)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Version tables: the first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Head tables: the last row of each key; the order columns tell rows apart."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def tags(changes: DataFrame, keys: tuple[str, ...] = ("flow_id", "tag"), order: tuple[str, ...] = ("updated_at",), deleted: str = "deleted") -> DataFrame:
    """Tags in force after sets and deletions in order."""
    return keep_last(changes, list(keys), list(order)).where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def tag_deletions(changes: DataFrame, keys: tuple[str, ...] = ("flow_id", "tag"), order: str = "updated_at", deleted: str = "deleted") -> DataFrame:
    """For each deletion whether the tag existed just before."""
    before = F.lag(F.col(deleted)).over(Window.partitionBy(*keys).orderBy(order))
    return changes.withColumn("existed", F.coalesce(~before, F.lit(False))).where(F.col(deleted))


def current_versions(heads: DataFrame, versions: DataFrame) -> DataFrame:
    """Each flow's head with its version."""
    return heads.join(versions.drop("flow_id"), heads["current_version_id"] == versions["version_id"], "inner")


def version_history(versions: DataFrame, flow_id: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    page = versions.where(F.col("flow_id") == flow_id).orderBy(F.desc("created_at"), F.desc("version_id")).offset(offset)
    return page if limit is None else page.limit(limit)


def version_pair(versions: DataFrame, first: str, second: str) -> DataFrame:
    """One row with both graphs; reading it fails where a version is missing."""
    side = lambda v: F.coalesce(F.any_value(F.when(F.col("version_id") == v, F.col("graph")), True), F.raise_error(f"version not found: {v}").cast("string"))
    return versions.where(F.col("version_id").isin(first, second)).agg(side(first).alias("first_graph"), side(second).alias("second_graph"))


def saved_versions(heads: DataFrame, versions: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, versions) after a batch (flow_id, name, graph, created_at): a graph is stored once by its hash, and only a new one moves its flow's head."""
    hashed = batch.withColumn("version_id", F.sha2(F.col("graph").cast("binary"), 256))
    first = keep_first(hashed, ["version_id"], ["created_at", "flow_id"])
    fresh = first.join(versions.select("version_id"), "version_id", "left_anti")
    moved = fresh.select("flow_id", "name", F.col("version_id").alias("current_version_id"), F.col("created_at").alias("updated_at"))
    all_heads = keep_last(heads.unionByName(moved), ["flow_id"], ["updated_at", "current_version_id"])
    return all_heads, versions.unionByName(fresh.select(*versions.columns))
