"""Runs of a flow in bulk: every node is one DataFrame over all runs.

Nodes are functions from (run_id, value) to (run_id, value) with JSON texts as values, registered
by type. Along each edge go the runs whose output meets its condition; a node gets the merged
input of the runs that are ready for it; entry nodes get the runs' inputs. Arrays that a
fan-out edge carries spread over rows and are gathered by index behind the node. A cycle, which
is a back edge, takes the runs whose condition holds through its nodes again; a run goes along
each back edge at most ``max_traversals`` times. What several edges take from a node is written
once, so that plans grow with the graph.

Deviations, as all runs move together: nodes run in the order in which they are declared where
the graph leaves it open; of several edges to one port the last declared wins; a node that
fails does so for all runs, so failures of single runs are values with an ``error`` field, and
edges behind them are asked their conditions as any (``dataflow.ready_nodes`` has the step
after a failure that asks none).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagframe.functions import variants
from dagframe.operators import dataflow
from dagframe.sources.rounds import round_writer
from dagframe.plans.graph import Graph, back_edges, problems

NodeFunction = Callable[[DataFrame, object], DataFrame]
MAX_TRAVERSALS = 50


def conditional(df: DataFrame, config: object) -> DataFrame:
    """Branches hang on edges; the node itself changes nothing."""
    return df


def tool_router(df: DataFrame, config: object) -> DataFrame:
    return df.withColumn("value", F.to_json(dataflow.tool_calls(F.parse_json("value"))))


def scalar(f: Callable) -> NodeFunction:
    """A node type from a Column function of the value."""
    return lambda df, config: df.withColumn("value", f(F.col("value"), config))


BUILT_IN: dict[str, NodeFunction] = {"conditional": conditional, "tool_router": tool_router}


class Flow:
    """A sound graph with the node functions it needs."""

    def __init__(self, graph: Graph, functions: Mapping[str, NodeFunction] | None = None, max_traversals: int = MAX_TRAVERSALS):
        self.graph, self.functions, self.max_traversals = graph, {**BUILT_IN, **(functions or {})}, max_traversals
        if found := problems(graph):
            raise ValueError("; ".join(found))
        if unknown := {n.node_type for n in graph.nodes} - set(self.functions):
            raise ValueError(f"unknown node types: {sorted(unknown)}")
        self.back = back_edges(graph)
        self.nodes = {n.instance_id: n for n in graph.nodes}

    def order(self) -> list[str]:
        """Nodes, each behind those that lead to it."""
        left, out = [n.instance_id for n in self.graph.nodes], []
        while left:
            ready = next(n for n in left if all(e.from_node in out for e in self.graph.edges if e.to_node == n and e.id not in self.back))
            out.append(ready)
            left.remove(ready)
        return out

    def _along(self, edge, outputs: DataFrame, ordinal: int) -> DataFrame:
        v = F.parse_json("value")
        rows = dataflow.passing(outputs.withColumn("_v", v), edge.condition, "_v")
        return rows.select("run_id", F.lit(edge.to_port).alias("to_port"), F.lit(ordinal).alias("edge_ordinal"), F.to_json(dataflow.port_value(F.col("_v"), edge.from_port)).alias("value"))

    def _apply(self, node: str, inputs: DataFrame) -> DataFrame:
        config = self.nodes[node].config
        f = self.functions[self.nodes[node].node_type]
        if isinstance(config, dict) and config.get("fan_out"):
            spread = dataflow.fan_out(inputs.select("run_id", variants.as_array(F.parse_json("value")).alias("_items"), "value"), "_items")
            each = spread.withColumn("value", F.when(F.col("fan_out_index").isNull(), F.col("value")).otherwise(F.to_json("item"))).withColumn("run_id", F.struct("run_id", "fan_out_index"))
            done = f(each.select("run_id", "value"), config).select("run_id.run_id", "run_id.fan_out_index", "value")
            gathered = dataflow.fan_in(done.where("fan_out_index is not null"), ["run_id"], item="value")
            whole = done.where("fan_out_index is null").select("run_id", "value")
            return gathered.select("run_id", F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")).alias("value")).unionByName(whole)
        return f(inputs.select("run_id", "value"), config)

    def run(self, inputs: DataFrame, checkpoint: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
        """(outputs of each node, status of each run) for inputs (run_id, value).

        checkpoint(df, name) writes and rereads what a round of a cycle gives, and what more than
        one edge takes from a node, as plans would grow with every use; by default in the shared folder.
        """
        if checkpoint is None:
            checkpoint = round_writer(inputs.sparkSession)
        outputs: dict[str, DataFrame] = {}
        for node in self.order():
            rows = self._first(node, inputs, outputs)
            shared = self.back or sum(e.from_node == node for e in self.graph.edges) > 1
            outputs[node] = checkpoint(rows, f"first-{node}") if shared else rows
        again = [(e, i) for i, e in enumerate(self.graph.edges) if e.id in self.back]
        gone: list[DataFrame] = []  # (run_id, edge_ordinal) of each round
        k, fresh = -1, outputs
        while self.back:
            k += 1
            moving = [self._along(e, fresh[e.from_node], i).withColumn("to_node", F.lit(e.to_node)) for e, i in again if e.from_node in fresh]
            if not moving:
                break
            moved = moving[0]
            for more in moving[1:]:
                moved = moved.unionByName(more)
            if k >= self.max_traversals:  # no run can have gone along an edge so often before
                often = reduce(DataFrame.unionByName, gone).groupBy("run_id", "edge_ordinal").count().where(F.col("count") >= self.max_traversals)
                moved = moved.join(often, ["run_id", "edge_ordinal"], "left_anti")
            moved = checkpoint(moved, f"round-{k}")
            if moved.isEmpty():
                break
            gone.append(moved.select("run_id", "edge_ordinal"))
            fresh = {}
            for node in self.order():
                parts = [moved.where(F.col("to_node") == node).drop("to_node")] if any(e.to_node == node for e, _ in again) else []
                parts += [self._along(e, fresh[e.from_node], i) for i, e in enumerate(self.graph.edges) if e.to_node == node and e.id not in self.back and e.from_node in fresh]
                if parts:
                    rows = fresh[node] = checkpoint(self._apply(node, self._merged(parts)), f"round-{k}-{node}")
                    kept = outputs[node].join(rows.select("run_id"), "run_id", "left_anti")
                    outputs[node] = checkpoint(rows.unionByName(kept), f"after-{k}-{node}")
        return outputs, self._status(inputs, outputs)

    def _merged(self, parts: list[DataFrame]) -> DataFrame:
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        merged = dataflow.merge_ports(rows, ["run_id"])
        return merged.select("run_id", dataflow.merged_input(F.col("ports")).alias("value"))

    def _first(self, node: str, inputs: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
        leading = [(e, i) for i, e in enumerate(self.graph.edges) if e.to_node == node and e.id not in self.back]
        if not leading:
            return self._apply(node, inputs)
        merged = self._merged([self._along(e, outputs[e.from_node], i) for e, i in leading])
        return self._apply(node, merged)

    def _status(self, inputs: DataFrame, outputs: dict[str, DataFrame]) -> DataFrame:
        states = None
        for node, rows in outputs.items():
            failed = variants.field(F.try_parse_json("value"), "error").isNotNull()
            one = rows.select("run_id", F.lit(node).alias("node_id"), F.when(failed, "failed").otherwise("completed").alias("state"))
            states = one if states is None else states.unionByName(one)
        known = dataflow.run_status(states, len(self.graph.nodes))
        return inputs.select("run_id").join(known, "run_id", "left").select("run_id", F.coalesce("status", F.lit("failed")).alias("status"))
