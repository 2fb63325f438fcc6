"""How values move through a flow, for many runs at once.

A flow's data is a table with run_id and value (VARIANT or any type) for each port; operators
here route it along edges, spread arrays over rows and gather them again, and merge inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dagframe.functions import variants
from dagframe.functions.predicates import edge_condition, row_condition


#: Edges of a flow, which are broadcast.
MOST_EDGES = 10_000


def port_value(output: Column, port: str) -> Column:
    """The output's field of the port's name if it has one, else the whole output."""
    at = variants.field(output, port)
    return F.when((variants.kind(output) == "object") & at.isNotNull(), at).otherwise(output)


def passing(outputs: DataFrame, expression: str | None, value: str = "value") -> DataFrame:
    """Rows whose whole output meets an edge's condition."""
    return outputs if expression is None else outputs.where(edge_condition(expression, F.col(value)))


def passing_rows(df: DataFrame, expression: str | None) -> DataFrame:
    """The same for outputs that are typed columns rather than one value."""
    if expression is None:
        return df
    try:
        return df.where(row_condition(expression, df))
    except ValueError:
        return df.where("false")


def fan_out(df: DataFrame, values: str, index: str = "fan_out_index", item: str = "item") -> DataFrame:
    """One row for each element of an array; rows with an empty or null array stay one row, without an index."""
    return df.select("*", F.posexplode_outer(values).alias(index, item)).drop(values)


def fan_in(df: DataFrame, keys: Sequence[str], index: str = "fan_out_index", item: str = "item", out: str = "items") -> DataFrame:
    """The elements of each key as an array by index."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(item).alias("v"))))
    return df.groupBy(*keys).agg(F.transform(gathered, lambda x: x["v"]).alias(out))


def fan_in_results(df: DataFrame, keys: Sequence[str], index: str = "fan_out_index", result: str = "result", error: str = "error", out: str = "results") -> DataFrame:
    """As fan_in for JSON texts: a failed element leaves ``{"error":..,"fan_out_index":..}``, one without result null."""
    text = F.when(F.col(error).isNotNull(), F.to_json(F.struct(F.col(error).alias("error"), F.col(index).alias("fan_out_index")))).otherwise(F.coalesce(F.col(result), F.lit("null")))
    return fan_in(df.withColumn("_text", text), keys, index, "_text", out)


def merge_ports(inputs: DataFrame, keys: Sequence[str], port: str = "to_port", value: str = "value", ordinal: str = "edge_ordinal", out: str = "ports") -> DataFrame:
    """Inputs of a node as a map from port to value; of several edges to one port the last declared wins."""
    last = inputs.groupBy(*keys, port).agg(F.max_by(value, ordinal).alias("_value"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(port).alias("k"), F.col("_value").alias("v"))))).alias(out))


def merged_input(ports: Column) -> Column:
    """A node's input from map<string,string> of JSON texts: one port's value as it is, several as an object, none ``{}``."""
    entries = F.array_sort(F.map_entries(ports))
    named = F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    return F.when(F.coalesce(F.size(ports), F.lit(0)) < 1, "{}").when(F.size(ports) == 1, entries[0]["value"]).otherwise(F.concat(F.lit("{"), F.array_join(named, ","), F.lit("}")))


def ready_nodes(edges: DataFrame, status: DataFrame, passed: DataFrame | None) -> DataFrame:
    """(run_id, node_id) of nodes that can start: all sources done, one of them completed over an edge that passed.

    edges (edge_id, from_node, to_node) without back edges; status (run_id, node_id, state);
    passed (run_id, edge_id), or None for the step after a failure, which asks no condition. Nodes
    that have a state are left out.
    """
    if edges.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise ValueError(f"a flow has at most {MOST_EDGES} edges")
    runs = status.select("run_id").distinct()
    wanted = runs.join(F.broadcast(edges), how="cross")  # every run has the flow's edges, which were counted
    if passed is None:
        passed = wanted.select("run_id", "edge_id")
    done = wanted.join(status.withColumnRenamed("node_id", "from_node"), ["run_id", "from_node"], "left").join(passed.select("run_id", "edge_id", F.lit(True).alias("_passed")), ["run_id", "edge_id"], "left")
    per_node = done.groupBy("run_id", F.col("to_node").alias("node_id")).agg(F.bool_and(F.coalesce(F.col("state").isin("completed", "failed"), F.lit(False))).alias("_all"), F.bool_or(F.coalesce((F.col("state") == "completed") & F.col("_passed"), F.lit(False))).alias("_one"))
    return per_node.where("_all and _one").join(status.select("run_id", "node_id"), ["run_id", "node_id"], "left_anti").select("run_id", "node_id")


def run_status(states: DataFrame, n_nodes: int, cancelled: Column | None = None) -> DataFrame:
    """Status of each run from (run_id, node_id, state): a node that neither completed nor failed makes it failed, as does any failure."""
    counts = states.groupBy("run_id").agg(F.count_if(F.col("state").isin("completed", "failed")).alias("_done"), F.count_if(F.col("state") == "failed").alias("_failed"), F.bool_or(cancelled if cancelled is not None else F.lit(False)).alias("_cancelled"))
    status = F.when(F.col("_cancelled"), "cancelled").when(F.col("_done") < n_nodes, "failed").when(F.col("_failed") == 0, "completed").otherwise("failed")
    return counts.select("run_id", status.alias("status"))


def tool_calls(output: Column) -> Column:
    """The calls of a model's answer: its tool_calls, itself if it is an array, else none."""
    return F.coalesce(variants.as_array(variants.field(output, "tool_calls")), variants.as_array(output), F.array().cast("array<variant>"))


def append_turns(history: DataFrame, turns: DataFrame, keys: Sequence[str], messages: str = "messages") -> DataFrame:
    """Stored conversations with new turns (keys, pos, role, content) behind them, in order; new keys start one."""
    new = fan_in(turns.withColumn("_m", F.struct("role", "content")), keys, "pos", "_m", "_new")
    empty = F.array().cast(new.schema["_new"].dataType)
    return history.join(new, list(keys), "full").select(*keys, F.concat(F.coalesce(messages, empty), F.coalesce("_new", empty)).alias(messages))


def history(turns: DataFrame, keys: Sequence[str], order: str = "turn", system: str | None = None) -> DataFrame:
    """Ordered conversations of (keys, order, role, content) as arrays of struct<role,content>, after a system turn if given."""
    out = fan_in(turns.withColumn("_m", F.struct("role", "content")), keys, order, "_m", "messages")
    if system is None:
        return out
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return out.withColumn("messages", F.concat(first, "messages"))
