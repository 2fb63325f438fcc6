"""Flow graphs: what they hold, whether they are sound, which edges go back, and their hashes. All of it is as small as the graph."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "[SECRET_PLACEHOLDER]"
#: Parts of names whose values are secrets.
SECRET_NAMES = ("SECRET", "KEY", "PASSWORD")


@dataclass(frozen=True)
class Node:
    instance_id: str
    node_type: str
    config: Any = None


@dataclass(frozen=True)
class Edge:
    id: str
    from_node: str
    to_node: str
    from_port: str = "output"
    to_port: str = "input"
    condition: str | None = None


@dataclass(frozen=True)
class Graph:
    id: str
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...] = ()
    name: str = ""
    version: str = "1"
    schema_version: int = 1
    metadata: dict = field(default_factory=dict)
    tool_definitions: dict = field(default_factory=dict)

    @staticmethod
    def from_json(text: str) -> Graph:
        raw = json.loads(text)
        nodes = tuple(Node(n["instance_id"], n["node_type"], n.get("config")) for n in raw["nodes"])
        edges = tuple(Edge(e["id"], e["from_node"], e["to_node"], e.get("from_port", "output"), e.get("to_port", "input"), (e.get("condition") or {}).get("expression")) for e in raw.get("edges", ()))
        return Graph(raw["id"], nodes, edges, raw.get("name", ""), raw.get("version", "1"), raw.get("schema_version", 1), raw.get("metadata", {}), raw.get("tool_definitions", {}))

    def to_json(self) -> str:
        edges = [{"id": e.id, "from_node": e.from_node, "from_port": e.from_port, "to_node": e.to_node, "to_port": e.to_port, "condition": None if e.condition is None else {"expression": e.condition}} for e in self.edges]
        nodes = [{"instance_id": n.instance_id, "node_type": n.node_type, "config": n.config} for n in self.nodes]
        raw = {"schema_version": self.schema_version, "id": self.id, "name": self.name, "version": self.version, "nodes": nodes, "edges": edges, "metadata": self.metadata, "tool_definitions": self.tool_definitions}
        return json.dumps(raw, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problems(graph: Graph) -> list[str]:
    """All that is wrong with a graph."""
    ids = [n.instance_id for n in graph.nodes]
    found = [f"duplicate node {k}" for k, n in Counter(ids).items() if n > 1]
    found += [f"edge {e.id}: unknown node {end}" for e in graph.edges for end in (e.from_node, e.to_node) if end not in ids]
    found += [f"duplicate edge {k}" for k, n in Counter(e.id for e in graph.edges).items() if n > 1]
    if not graph.nodes:
        found.append("graph has no nodes")
    elif not entry_nodes(graph):
        found.append("graph has no entry node")
    return found


def back_edges(graph: Graph) -> set[str]:
    """Ids of edges that lead back to a node on the way to them, looking from the nodes nothing leads to, or else from all in order."""
    out: dict[str, list[Edge]] = {n.instance_id: [] for n in graph.nodes}
    for e in graph.edges:
        out.setdefault(e.from_node, []).append(e)
    reached = {e.to_node for e in graph.edges}
    starts = [n.instance_id for n in graph.nodes if n.instance_id not in reached] or list(out)
    state: dict[str, int] = {}
    back = set()
    for start in starts + [n for n in out if n not in starts]:
        if state.get(start):
            continue
        path = [(start, iter(out[start]))]
        state[start] = 1
        while path:
            node, rest = path[-1]
            e = next(rest, None)
            if e is None:
                state[node] = 2
                path.pop()
            elif state.get(e.to_node) == 1:
                back.add(e.id)
            elif not state.get(e.to_node):
                state[e.to_node] = 1
                path.append((e.to_node, iter(out.get(e.to_node, []))))
    return back


def entry_nodes(graph: Graph) -> list[str]:
    back = back_edges(graph)
    reached = {e.to_node for e in graph.edges if e.id not in back}
    return [n.instance_id for n in graph.nodes if n.instance_id not in reached]


def version_id(graph: Graph) -> str:
    """Content hash of the graph; the order of its nodes and edges counts."""
    return hashlib.sha256(graph.to_json().encode()).hexdigest()


def without_secrets(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: PLACEHOLDER if any(s in k.upper() for s in SECRET_NAMES) else without_secrets(v) for k, v in value.items()}
    return [without_secrets(v) for v in value] if isinstance(value, list) else value


def config_hash(graph: Graph) -> str:
    """Hash of the nodes' configurations without their secrets, in whatever order the nodes stand."""
    text = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(("[" + ",".join(sorted(text(without_secrets(n.config)) for n in graph.nodes)) + "]").encode()).hexdigest()


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, problem, item) over many graphs at once: nodes (graph_id, node_id), edges (graph_id, edge_id, from_node, to_node)."""
    twice = lambda df, key, name: df.groupBy("graph_id", key).count().where("count > 1").select("graph_id", F.lit(name).alias("problem"), F.col(key).cast("string").alias("item"))
    ends = edges.select("graph_id", "edge_id", F.explode(F.array("from_node", "to_node")).alias("node_id"))
    unknown = ends.join(nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti").select("graph_id", F.lit("unknown node").alias("problem"), F.col("node_id").cast("string").alias("item"))
    return twice(nodes, "node_id", "duplicate node").unionByName(twice(edges, "edge_id", "duplicate edge")).unionByName(unknown)


def graph_entries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id) of nodes that nothing leads to, over many graphs without cycles."""
    return nodes.join(edges.select("graph_id", F.col("to_node").alias("node_id")), ["graph_id", "node_id"], "left_anti")
