"""Named queries over the test tables, each with SQL that gives the same rows.

The log queries read events as a log: a user is a run, the event's id its seq; signups start
runs, views start nodes, clicks complete them, errors fail them (for good if the value is under
50), purchases are model calls; the node is the id modulo 5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.functions import pricing, scalars, transforms, variants
from dagframe.functions.predicates import condition
from dagframe.operators import adapters, dataflow, eventlog, lookup, stores, tabular, triggers
from dagframe.plans import graph as graphs
from dagframe.plans.flow import Flow, scalar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# tabular -----------------------------------------------------------------------------------


@query("SELECT c AS column_name, (SELECT count(*) FROM nation) AS row_count FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) v(c)")
def csv_list_columns(spark, d):
    report = tabular.list_columns(tabular.as_texts(t(spark, d, "nation")), "n_nationkey")
    return report.select(F.explode("columns").alias("column_name"), "row_count")


def _filter_query(name, table, column, operator, value, columns, sql_test):
    @query(f"SELECT {', '.join(columns)} FROM {table} WHERE {sql_test}", name)
    def run(spark, d):
        rows = t(spark, d, table)
        return tabular.query(rows.select(*dict.fromkeys([*columns, column])), column, value, operator, limit=None).select(*columns)


_filter_query("csv_query_eq", "customer", "c_mktsegment", "eq", "BUILDING", ["c_custkey", "c_name", "c_mktsegment"], "c_mktsegment = 'BUILDING'")
_filter_query("csv_query_contains", "part", "p_name", "contains", "RING", ["p_partkey", "p_name"], "contains(lower(p_name), 'ring')")
_filter_query("csv_query_gt", "part", "p_size", "gt", 40, ["p_partkey", "p_size"], "p_size > 40")
_filter_query("csv_query_lt", "lineitem", "l_quantity", "lt", "3", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity < 3")
_filter_query("csv_query_gte", "customer", "c_acctbal", "gte", 9000, ["c_custkey", "c_acctbal"], "c_acctbal >= 9000")
_filter_query("csv_query_lte", "customer", "c_acctbal", "lte", "-500.5", ["c_custkey", "c_acctbal"], "c_acctbal <= -500.5")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' ORDER BY p_partkey LIMIT 20")
def csv_query_limit(spark, d):
    rows = t(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return tabular.query(rows, "p_brand", "Brand#2", order="p_partkey").select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 1")
def csv_query_limit_zero(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.lit("x").alias("k"))
    return tabular.query(rows, "k", "x", limit=0, order="p_partkey").select("p_partkey")


def _aggregate_query(name, table, column, operation, sql_value, group=None):
    sql = f"SELECT {f'{group}, ' if group else ''}{sql_value} AS result FROM {table}" + (f" GROUP BY {group}" if group else "")

    @query(sql, name)
    def run(spark, d):
        rows = t(spark, d, table).select(*dict.fromkeys([column, *([group] if group else [])]))
        out = tabular.aggregate(rows, column, operation, group)
        return out.withColumn("result", F.round("result", 2)) if operation in ("sum", "avg") else out


_aggregate_query("csv_agg_sum", "lineitem", "l_quantity", "sum", "round(sum(l_quantity), 2)")
_aggregate_query("csv_agg_avg", "lineitem", "l_quantity", "avg", "round(avg(l_quantity), 2)")
_aggregate_query("csv_agg_min", "lineitem", "l_extendedprice", "min", "min(l_extendedprice)")
_aggregate_query("csv_agg_max", "lineitem", "l_extendedprice", "max", "max(l_extendedprice)")
_aggregate_query("csv_agg_count", "lineitem", "l_quantity", "count", "CAST(count(*) AS DOUBLE)")
_aggregate_query("csv_agg_grouped_sum", "lineitem", "l_quantity", "sum", "round(sum(l_quantity), 2)", "l_returnflag")
_aggregate_query("csv_agg_grouped_avg", "lineitem", "l_discount", "avg", "round(avg(l_discount), 2)", "l_returnflag")
_aggregate_query("csv_agg_grouped_min", "orders", "o_totalprice", "min", "min(o_totalprice)", "o_orderpriority")
_aggregate_query("csv_agg_grouped_max", "orders", "o_totalprice", "max", "max(o_totalprice)", "o_orderpriority")
_aggregate_query("csv_agg_grouped_count", "orders", "o_totalprice", "count", "CAST(count(*) AS DOUBLE)", "o_orderpriority")


@query("SELECT CAST(NULL AS DOUBLE) AS result")
def csv_agg_empty(spark, d):
    return tabular.aggregate(tabular.as_texts(t(spark, d, "region").where("false")), "r_regionkey", "count")


# catalog -----------------------------------------------------------------------------------


def _parts(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("long").alias("stock"), F.concat(F.lit("SKU-"), (F.col("p_partkey") % 500).cast("string")).alias("sku"))


@query("SELECT p_partkey AS place, p_name AS name FROM part WHERE contains(lower(p_name), 'blue') OR contains(lower(p_type), 'blue')")
def catalog_search_text(spark, d):
    return lookup.search(_parts(spark, d), text="BLUE", limit=None).select("place", "name")


@query("SELECT p_partkey AS place, p_brand AS category FROM part WHERE lower(p_brand) = 'brand#7'")
def catalog_search_category(spark, d):
    return lookup.search(_parts(spark, d), category="bRAND#7", limit=None).select("place", "category")


@query("SELECT p_partkey AS place, p_retailprice AS price FROM part WHERE p_retailprice BETWEEN 910 AND 920.5")
def catalog_search_price(spark, d):
    return lookup.search(_parts(spark, d), min_price=910, max_price=920.5, limit=None).select("place", "price")


@query("SELECT p_partkey AS place, p_name AS name, p_retailprice AS price FROM part WHERE contains(lower(p_name), 'ring') AND p_retailprice <= 1000 ORDER BY p_partkey LIMIT 10")
def catalog_search_combined(spark, d):
    return lookup.search(_parts(spark, d), text="ring", max_price=1000, order="place").select("place", "name", "price")


_ASKED = ["SKU-3", "SKU-499", "SKU-3", "SKU-x", "SKU-17", "SKU-42"]
_ASKED_SQL = "r(pos, sku) AS (VALUES (0, 'SKU-3'), (1, 'SKU-499'), (2, 'SKU-3'), (3, 'SKU-x'), (4, 'SKU-17'), (5, 'SKU-42')), f AS (SELECT 'SKU-' || (p_partkey % 500) AS sku, p_partkey, p_name, p_size, p_retailprice, row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_partkey) AS k FROM part)"


@query(f"WITH {_ASKED_SQL} SELECT pos, r.sku, p_name AS name, CAST(CASE WHEN p_size > 0 THEN p_size WHEN p_partkey IS NOT NULL THEN 0 END AS DOUBLE) AS stock, CAST(p_size > 0 AS VARCHAR) AS in_stock, CASE WHEN p_partkey IS NULL THEN 'SKU not found' END AS error FROM r LEFT JOIN f ON r.sku = f.sku AND k = 1")
def catalog_check_stock(spark, d):
    return lookup.check_stock(lookup.request_rows(spark, [*_ASKED[:3], 7, *_ASKED[3:]]), _parts(spark, d)).select("pos", "sku", "name", F.col("stock").cast("double").alias("stock"), F.col("in_stock").cast("string").alias("in_stock"), "error")


@query(f"WITH {_ASKED_SQL} SELECT pos, r.sku, p_name AS name, p_retailprice AS price, CASE WHEN p_partkey IS NULL THEN 'SKU not found' END AS error FROM r LEFT JOIN f ON r.sku = f.sku AND k = 1")
def catalog_compare_prices(spark, d):
    return lookup.compare_prices(lookup.request_rows(spark, _ASKED), _parts(spark, d)).select("pos", "sku", "name", "price", "error")


@query(f"WITH {_ASKED_SQL}, p AS (SELECT pos, r.sku, p_retailprice AS price FROM r JOIN f ON r.sku = f.sku AND k = 1) SELECT (SELECT sku FROM p ORDER BY price, pos LIMIT 1) AS cheapest, (SELECT min(price) FROM p) AS cheapest_price, (SELECT sku FROM p ORDER BY price DESC, pos DESC LIMIT 1) AS most_expensive, (SELECT max(price) FROM p) AS most_expensive_price")
def catalog_compare_extremes(spark, d):
    return lookup.price_extremes(lookup.compare_prices(lookup.request_rows(spark, _ASKED), _parts(spark, d)))


# conditions --------------------------------------------------------------------------------

_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"


def _condition_query(name, text, sql_test):
    @query(f"SELECT event_id FROM events WHERE {sql_test}", name)
    def run(spark, d):
        rows = t(spark, d, "events").select("event_id", F.parse_json("props").alias("v"))
        return rows.where(condition(text, F.col("v"))).select("event_id")


_condition_query("expr_eq", "k == 42", f"{_K} = 42")
_condition_query("expr_ne_missing", "missing != 'x' && k != 7", f"{_K} <> 7")
_condition_query("expr_order", "k >= 10 && k < 12.5", f"{_K} >= 10 AND {_K} < 12.5")
_condition_query("expr_and_or_not", "!k > 5 || k == 90 && missing == null", f"NOT {_K} > 5 OR {_K} = 90")
_condition_query("expr_mismatch", "k != 'text' || k == true || k < 3", f"{_K} < 3")
_condition_query("expr_truthy", "k && !gone.away", f"{_K} <> 0")


# dataflow ----------------------------------------------------------------------------------


@query("SELECT o_orderkey, 'large' AS branch FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, 'done' FROM orders WHERE o_orderstatus = 'F'")
def edge_branch_route(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    large = dataflow.passing_rows(rows, "price > 300000").select("o_orderkey", F.lit("large").alias("branch"))
    return large.unionByName(dataflow.passing_rows(rows, "status == 'F'").select("o_orderkey", F.lit("done").alias("branch")))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value >= 20 OR event_type <> 'view' AND event_id < 100")
def expr_typed_rows(spark, d):
    return dataflow.passing_rows(t(spark, d, "events"), "event_type == 'click' && value >= 20 || event_type != 'view' && event_id < 100 && missing == null").select("event_id")


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS fan_out_index, ws[i] AS item FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))")
def fanout_posexplode(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.split("text", " ").alias("ws"))
    return dataflow.fan_out(rows, "ws").select("doc_id", "fan_out_index", "item")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys FROM orders GROUP BY o_custkey")
def fanin_collect(spark, d):
    rows = t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("i"), F.col("o_orderkey").cast("string").alias("v"))
    return dataflow.fan_in(rows, ["o_custkey"], "i", "v", "keys").select("o_custkey", F.array_join("keys", ",").alias("order_keys"))


@query("SELECT vec_id, round(sum(CAST(x AS DOUBLE) * x), 6) AS norm2 FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def fanout_embeddings(spark, d):
    rows = dataflow.fan_out(t(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    x = F.col("item").cast("double")
    return rows.groupBy("vec_id").agg(F.round(F.sum(x * x), 6).alias("norm2"))


@query("WITH l AS (SELECT o_custkey, o_orderstatus, arg_max(o_orderkey, o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o_custkey AS run_id, string_agg(o_orderstatus || '=' || k, ',' ORDER BY o_orderstatus) AS ports FROM l GROUP BY o_custkey")
def merge_ports_last_wins(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("to_port"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("edge_ordinal"))
    merged = dataflow.merge_ports(rows, ["run_id"])
    return merged.select("run_id", F.array_join(F.transform(F.array_sort(F.map_entries("ports")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("ports"))


_COUNTER = graphs.Graph("counter", (graphs.Node("start", "conditional"), graphs.Node("step", "increment"), graphs.Node("end", "conditional")), (graphs.Edge("a", "start", "step"), graphs.Edge("b", "step", "step", condition="n < 6"), graphs.Edge("c", "step", "end", condition="n >= 6")))


def _increment(value, config):
    v = F.parse_json(value)
    return F.to_json(F.struct((variants.as_double(variants.field(v, "n")) + 1).cast("long").alias("n")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS run_id, CAST(greatest(n_nationkey + 1, least(6, n_nationkey + 1 + 4)) AS BIGINT) AS n FROM nation")
def cycle_bounded(spark, d):
    inputs = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("run_id"), F.to_json(F.struct(F.col("n_nationkey").alias("n"))).alias("value"))
    outputs, _ = Flow(_COUNTER, {"increment": scalar(_increment)}, max_traversals=4).run(inputs)
    return outputs["step"].select("run_id", F.get_json_object("value", "$.n").cast("long").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS run_id, 'failed' AS status FROM orders")
def flow_untaken_branch_fails(spark, d):
    """A run that leaves a branch aside has a node without an end, and so fails."""
    branch = graphs.Graph("branch", (graphs.Node("in", "conditional"), graphs.Node("yes", "conditional"), graphs.Node("no", "conditional")), (graphs.Edge("y", "in", "yes", condition="p > 200000"), graphs.Edge("n", "in", "no", condition="p <= 200000")))
    inputs = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.to_json(F.struct(F.col("o_totalprice").alias("p"))).alias("value"))
    return Flow(branch).run(inputs)[1]


@query("SELECT r_name AS node_id FROM region")
def graph_entry_nodes(spark, d):
    nation, region = t(spark, d, "nation"), t(spark, d, "region")
    nodes = region.select(F.lit("g").alias("graph_id"), F.col("r_name").alias("node_id")).unionByName(nation.select(F.lit("g").alias("graph_id"), F.col("n_name").alias("node_id")))
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("g").alias("graph_id"), F.col("r_name").alias("from_node"), F.col("n_name").alias("to_node"))
    return graphs.graph_entries(nodes, edges).select("node_id")


@query("SELECT 'unknown node' AS problem, CAST(n_regionkey AS VARCHAR) AS item FROM nation WHERE n_regionkey > 2 UNION ALL SELECT 'duplicate edge', CAST(n_regionkey AS VARCHAR) FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def graph_validate(spark, d):
    nation = t(spark, d, "nation")
    nodes = nation.select(F.lit("g").alias("graph_id"), (F.col("n_nationkey") + 100).cast("string").alias("node_id")).unionByName(t(spark, d, "region").where("r_regionkey <= 2").select(F.lit("g").alias("graph_id"), F.col("r_regionkey").cast("string").alias("node_id")))
    edges = nation.select(F.lit("g").alias("graph_id"), F.col("n_regionkey").alias("edge_id"), F.col("n_regionkey").cast("string").alias("from_node"), (F.col("n_nationkey") + 100).cast("string").alias("to_node"))
    return graphs.graph_problems(nodes, edges).select("problem", "item")


# event log ---------------------------------------------------------------------------------


def log(spark: SparkSession, d: str) -> DataFrame:
    """events as a log."""
    e = t(spark, d, "events")
    kind = F.col("event_type")
    types = {"signup": "run_started", "view": "node_started", "click": "node_completed", "error": "node_failed", "purchase": "llm_invocation"}
    return e.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[kind].alias("event_type"),
        "ts",
        F.when(kind != "signup", F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string"))).alias("node_id"),
        (F.col("event_id") % 3).cast("int").alias("attempt"),
        F.lit(None).cast("int").alias("fan_out_index"),
        F.floor("value").cast("long").alias("duration_ms"),
        F.lit(None).cast("string").alias("status"),
        F.when(kind == "signup", F.concat(F.lit("flow"), (F.col("user_id") % 4).cast("string"))).alias("flow_id"),
        F.when(kind == "signup", F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string"))).alias("version_id"),
        F.lit(None).cast("string").alias("parent_run_id"),
        F.col("props").alias("inputs"),
        F.when(kind == "click", F.col("props")).alias("outputs"),
        F.when(kind == "error", F.col("props")).alias("error"),
        (F.col("value") >= 50).alias("will_retry"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"),
        (F.col("event_id") % 100).alias("input_tokens"),
        (F.col("event_id") % 50).alias("output_tokens"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("cost"),
        F.array(F.concat(F.lit("t"), (F.col("event_id") % 4).cast("string"))).alias("tool_names"),
    )


_LOG = "e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, event_type AS kind, 'n' || (event_id % 5) AS node_id, CAST(event_id % 3 AS INTEGER) AS attempt, value, props, user_id FROM events)"
_RUNS = f"{_LOG}, s AS (SELECT run_id, max(seq) AS seq, count(*) AS n FROM e WHERE kind = 'signup' GROUP BY run_id), runs AS (SELECT g.run_id, CASE WHEN s.seq IS NOT NULL THEN 'flow' || (CAST(g.run_id AS BIGINT) % 4) END AS flow_id, CASE WHEN s.seq IS NOT NULL THEN 'v' || (s.seq % 7) END AS version_id, CASE WHEN s.seq IS NULL THEN 'pending' ELSE 'running' END AS status, g.n AS n_events FROM (SELECT run_id, count(*) AS n FROM e GROUP BY run_id) g LEFT JOIN s USING (run_id))"


@query(f"WITH {_RUNS} SELECT run_id, flow_id, version_id, status, n_events FROM runs")
def run_fold(spark, d):
    return eventlog.runs(log(spark, d)).select("run_id", "flow_id", "version_id", "status", "n_events")


@query(f"WITH {_RUNS} SELECT run_id, version_id FROM runs WHERE flow_id = 'flow1' AND status = 'running' ORDER BY run_id LIMIT 10 OFFSET 5")
def run_list_filtered_page(spark, d):
    return eventlog.filtered_runs(log(spark, d), flow_id="flow1", status="running", offset=5, limit=10)[0].select("run_id", "version_id")


@query(f"WITH {_RUNS} SELECT count(*) AS total FROM runs WHERE flow_id = 'flow1' AND status = 'running'")
def run_list_total(spark, d):
    return eventlog.filtered_runs(log(spark, d), flow_id="flow1", status="running", offset=5, limit=10)[1]


@query(f"WITH {_RUNS} SELECT version_id, count(*) AS n_runs FROM runs WHERE flow_id = 'flow2' GROUP BY version_id")
def runs_by_version(spark, d):
    return eventlog.runs_by_version(log(spark, d), "flow2")


@query(f"WITH {_LOG} SELECT DISTINCT run_id FROM e")
def run_ids(spark, d):
    return eventlog.run_ids(log(spark, d))


_NODES = f"""WITH {_LOG}, n AS (SELECT * FROM e WHERE kind IN ('view', 'click', 'error')),
f AS (SELECT run_id, node_id, min(seq) AS first, max(seq) AS last, max(attempt) AS attempts FROM n WHERE kind = 'view' GROUP BY ALL),
x AS (SELECT n.* FROM n JOIN f USING (run_id, node_id) WHERE seq > first AND (kind = 'click' OR kind = 'error' AND value < 50)),
g AS (SELECT run_id, node_id, arg_max(kind, seq) AS kind, arg_max(props, seq) FILTER (kind = 'click') AS outputs, arg_max(CAST(floor(value) AS BIGINT), seq) FILTER (kind = 'click') AS duration_ms, arg_max(props, seq) FILTER (kind = 'error') AS error FROM x GROUP BY ALL)
SELECT f.run_id, f.node_id, CASE g.kind WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, i.props AS inputs, outputs, error, CAST(duration_ms AS DOUBLE) AS duration_ms, attempts
FROM f JOIN e i ON i.run_id = f.run_id AND i.seq = f.last LEFT JOIN g ON g.run_id = f.run_id AND g.node_id = f.node_id"""


@query(_NODES)
def node_results(spark, d):
    return eventlog.node_results(log(spark, d)).withColumn("duration_ms", F.col("duration_ms").cast("double"))


# without fan-out indexes an end closes the latest open start: brackets, matched by depth
_DETAILS = f"""WITH {_LOG}, n AS (SELECT *, CASE WHEN kind = 'view' THEN 1 ELSE -1 END AS step FROM e WHERE kind IN ('view', 'click', 'error')),
a AS (SELECT *, sum(step) OVER (PARTITION BY run_id, node_id ORDER BY seq) AS s FROM n),
b AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY run_id, node_id ORDER BY seq)) AS depth FROM a),
c AS (SELECT *, CASE WHEN kind = 'view' THEN depth ELSE coalesce(lag(depth) OVER (PARTITION BY run_id, node_id ORDER BY seq), 0) END AS level FROM b),
p AS (SELECT *, lead(kind) OVER v AS next_kind, lead(props) OVER v AS next_props, lead(value) OVER v AS next_value FROM c WHERE level > 0 WINDOW v AS (PARTITION BY run_id, node_id, level ORDER BY seq))
SELECT run_id, node_id, CAST(row_number() OVER (PARTITION BY run_id, node_id ORDER BY seq) - 1 AS INTEGER) AS ordinal, attempt, CAST(NULL AS DOUBLE) AS fan_out_index, props AS inputs,
CASE WHEN next_kind = 'click' THEN next_props END AS outputs, CASE WHEN next_kind = 'error' THEN next_props END AS error, CASE WHEN next_kind = 'click' THEN CAST(floor(next_value) AS DOUBLE) END AS duration_ms
FROM p WHERE kind = 'view'"""


@query(_DETAILS)
def node_details(spark, d):
    return eventlog.node_details(log(spark, d)).withColumns({c: F.col(c).cast("double") for c in ("fan_out_index", "duration_ms")})


@query("SELECT 'r' || (event_id % 100) AS run_id, event_id AS seq, event_type AS edge_id, value > 20 AS result FROM events WHERE event_type = 'view'")
def edge_results(spark, d):
    e = t(spark, d, "events")
    rows = e.select(F.concat(F.lit("r"), (F.col("event_id") % 100).cast("string")).alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "edge_evaluated").otherwise("custom").alias("event_type"), F.col("event_type").alias("edge_id"), F.lit(None).cast("string").alias("condition"), (F.col("value") > 20).alias("result"), F.col("props").alias("data"))
    return eventlog.edge_results(rows).select("run_id", "seq", "edge_id", "result")


@query(f"WITH {_LOG} SELECT run_id, seq, node_id, 'm' || (seq % 3) AS model, seq % 100 AS input_tokens FROM e WHERE kind = 'purchase' AND node_id = 'n2'")
def llm_invocations(spark, d):
    return eventlog.llm_invocations(log(spark, d), "n2").select("run_id", "seq", "node_id", "model", "input_tokens")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, props AS data FROM events WHERE event_type = 'click'")
def custom_events(spark, d):
    rows = log(spark, d).withColumn("name", F.when(F.col("event_type") == "node_completed", "click").otherwise("other")).withColumn("event_type", F.lit("custom")).withColumn("data", F.col("inputs"))
    return eventlog.custom_events(rows, "click").select("run_id", "seq", "data")


@query(f"WITH {_LOG} SELECT run_id, count(*) AS n_calls, CAST(sum(seq % 100) AS BIGINT) AS input_tokens, CAST(sum(seq % 50) AS BIGINT) AS output_tokens, round(sum(CASE WHEN seq % 2 = 0 THEN value END), 2) AS cost, string_agg(DISTINCT 'm' || (seq % 3), ',' ORDER BY 'm' || (seq % 3)) AS models, string_agg(DISTINCT 't' || (seq % 4), ',' ORDER BY 't' || (seq % 4)) AS tools FROM e WHERE kind = 'purchase' GROUP BY run_id")
def llm_run_summary(spark, d):
    s = eventlog.llm_summary(log(spark, d))
    return s.select("run_id", "n_calls", "input_tokens", "output_tokens", F.round("cost", 2).alias("cost"), F.array_join("models", ",").alias("models"), F.array_join("tools", ",").alias("tools"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq FROM events")
def log_dedup(spark, d):
    rows = log(spark, d).select("run_id", "seq")
    return eventlog.deduplicated(rows.unionByName(rows.where("seq % 3 = 0")))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq FROM events WHERE event_id % 4 <> 0")
def log_append_new(spark, d):
    rows = log(spark, d).select("run_id", "seq")
    return stores.new_rows(rows.where("seq % 4 = 0"), rows, ["run_id", "seq"])


@query(f"WITH {_RUNS} SELECT run_id, 9223372036854775807 AS seq, 'interrupted' AS status FROM runs WHERE status = 'running'")
def crash_mark(spark, d):
    return eventlog.interrupted(log(spark, d)).select("run_id", "seq", "status")


@query("WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events WHERE event_id >= 500), l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_id < 500 GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, CAST(k + coalesce(last + 1, 0) AS BIGINT) AS seq FROM e LEFT JOIN l USING (user_id)")
def log_numbered(spark, d):
    rows = log(spark, d).select("run_id", "seq")
    fresh = rows.where("seq >= 500").select("run_id", F.col("seq").alias("event_id"), F.col("seq").alias("arrival"))
    return eventlog.numbered(fresh, rows.where("seq < 500")).select("run_id", "event_id", "seq")


@query(f"WITH {_RUNS}, q AS (SELECT CAST(user_id AS VARCHAR) AS run_id, max(ts) AS ts, max(event_id) AS seq FROM events GROUP BY user_id) SELECT run_id, q.seq + 1 AS seq, 'failed' AS status FROM runs JOIN q USING (run_id) WHERE status = 'running' AND q.ts < (SELECT max(ts) - INTERVAL 8 HOUR FROM events)")
def sessions_abandoned(spark, d):
    rows = log(spark, d)
    last = t(spark, d, "events").agg(F.max("ts")).first()[0]
    return eventlog.abandoned(rows, F.lit(last) - F.expr("INTERVAL 8 HOURS")).select("run_id", "seq", "status")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'retryable' WHEN turn % 3 = 1 THEN 'ok' ELSE 'fatal' END AS kind, CASE WHEN turn % 3 = 1 THEN role END AS answer FROM conversations")
def http_outcomes(spark, d):
    from dagframe.operators import models

    status = F.element_at(F.array(F.lit(503), F.lit(200), F.lit(404)), (F.col("turn") % 3 + 1).cast("int"))
    made = models.http_outcome(status, F.to_json(F.struct("role")))
    return t(spark, d, "conversations").select("conv_id", "turn", made["kind"].alias("kind"), F.get_json_object(made["value"], "$.role").alias("answer"))


@query(f"WITH {_LOG}, n AS (SELECT DISTINCT run_id, node_id FROM e WHERE kind <> 'signup'), c AS (SELECT run_id, node_id AS from_node, lead(node_id) OVER (PARTITION BY run_id ORDER BY node_id) AS to_node FROM n) SELECT * FROM c WHERE to_node IS NOT NULL")
def topology_chain(spark, d):
    return eventlog.topology_chain(log(spark, d))


@query(f"WITH {_LOG}, v AS (SELECT run_id, seq, node_id, lag(node_id) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM e WHERE kind <> 'signup'), c AS (SELECT * FROM v WHERE before <> node_id) SELECT run_id, string_agg(before || '>' || node_id, ',' ORDER BY seq) AS edges FROM c GROUP BY run_id")
def topology_edges(spark, d):
    visits = log(spark, d).where("node_id is not null").select("run_id", F.col("seq").alias("ord"), F.col("node_id").alias("node"))
    found = eventlog.topology_from_transitions(adapters.node_changes(visits))
    return found.select("run_id", F.array_join(F.transform("edges", lambda e: F.concat_ws(">", e["from"], e["to"])), ",").alias("edges"))


@query(f"WITH {_LOG}, p AS (SELECT run_id, node_id, seq, kind, props, lag(kind) OVER w AS bk, lag(props) OVER w AS bp FROM e WHERE kind IN ('view', 'click') WINDOW w AS (PARTITION BY run_id, node_id ORDER BY seq)) SELECT run_id, node_id, seq AS ord, CASE WHEN bk = 'view' THEN bp ELSE '{{}}' END AS request, props AS response FROM p WHERE kind = 'click'")
def pair_start_end(spark, d):
    rows = log(spark, d).where("event_type in ('node_started', 'node_completed')")
    events = rows.select("run_id", "node_id", F.lit("llm").alias("kind"), F.col("seq").alias("ord"), F.when(F.col("event_type") == "node_started", "start").otherwise("end").alias("phase"), F.col("inputs").alias("payload"))
    return eventlog.paired(events).select("run_id", "node_id", "ord", "request", "response")


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM (SELECT min(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id, event_type UNION ALL SELECT event_id FROM events WHERE event_type = 'error')")
def trigger_dedup(spark, d):
    e = t(spark, d, "events")
    rows = e.select(F.concat(F.lit("flow"), F.col("user_id").cast("string")).alias("flow_id"), F.col("event_id"), F.when(F.col("event_type") != "error", F.concat_ws(":", "event_type", "user_id")).alias("idempotency_key"))
    return triggers.once(rows, "event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


@query("SELECT 'target' AS flow_id, 'flow:' || user_id AS source, 'flow:target:' || user_id AS idempotency_key FROM events WHERE event_type = 'purchase' AND event_id % 4 = 1 AND value > 10")
def flow_chain(spark, d):
    e = t(spark, d, "events").where("event_type = 'purchase'")
    rows = e.select(F.lit("run_completed").alias("event_type"), F.concat(F.lit("flow"), (F.col("event_id") % 4).cast("string")).alias("flow_id"), F.col("user_id").cast("string").alias("run_id"), F.when(F.col("value") > 10, "completed").otherwise("failed").alias("status"), "ts")
    return triggers.chained(rows, "flow1", "target").select("flow_id", "source", "idempotency_key")


@query("SELECT c_custkey AS trigger_id, CASE WHEN c_custkey % 3 = 0 THEN 'v' || c_nationkey ELSE 'head' || (c_custkey % 10) END AS version_id FROM customer WHERE CASE WHEN c_custkey % 3 = 0 THEN c_nationkey < 20 ELSE c_custkey % 10 < 8 END")
def trigger_resolve(spark, d):
    c = t(spark, d, "customer")
    asked = c.select(F.col("c_custkey").alias("trigger_id"), F.concat(F.lit("f"), (F.col("c_custkey") % 10).cast("string")).alias("flow_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("v"), F.col("c_nationkey").cast("string"))).alias("version_id"))
    heads = spark.range(8).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("flow_id"), F.concat(F.lit("head"), F.col("id").cast("string")).alias("current_version_id"))
    versions = spark.range(20).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("version_id"))
    return triggers.resolved(asked, heads, versions).select("trigger_id", "version_id")


# functions ---------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS version_id FROM documents")
def version_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", scalars.content_hash(F.col("text")).alias("version_id"))


@query("SELECT event_id, left(sha256(user_id || ':'), 32) AS trace_id, left(sha256(user_id || ':' || event_type || ':' || (event_id % 3) || ':'), 16) AS span_id FROM events")
def trace_span_ids(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", scalars.trace_id(F.col("user_id")).alias("trace_id"), scalars.span_id(F.col("user_id"), F.col("event_type"), F.col("event_id") % 3).alias("span_id"))


@query("SELECT c_custkey, c_name AS as_none, '[REDACTED]' AS as_secret, '****' || right(c_name, 4) AS as_masked, '[PII_REDACTED]' AS as_pii, '[CUSTOM_REDACTED]' AS as_custom FROM customer")
def redact_policies(spark, d):
    return t(spark, d, "customer").select("c_custkey", *[scalars.redact(F.col("c_name"), s).alias(f"as_{s}") for s in ("none", "secret", "masked", "pii", "custom")])


@query("SELECT conv_id, turn, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens, greatest(CAST(floor(strlen(text) / 4.0) AS BIGINT), 1) AS mock_tokens FROM conversations")
def token_estimate(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", scalars.token_estimate(F.col("text")).alias("tokens"), scalars.mock_prompt_tokens(F.col("text")).alias("mock_tokens"))


_PRICES = [("alpha", 0.5, 1.5), ("beta-2", 0.25, 0.75), ("beta-2-mini", 0.125, 0.25)]
_CALLS = "calls AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'alpha-0613' WHEN 2 THEN 'beta-2' WHEN 3 THEN 'beta-2-mini-x' ELSE 'gamma-1' END AS model, event_id % 100 AS prompt_tokens, event_id % 50 AS completion_tokens FROM events), n AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta-2' WHEN 3 THEN 'beta-2-mini' ELSE 'gamma-1' END AS priced_model FROM calls), p(model, prompt, completion) AS (VALUES ('alpha', 0.5, 1.5), ('beta-2', 0.25, 0.75), ('beta-2-mini', 0.125, 0.25))"


def _calls(spark, d):
    k = F.col("event_id") % 5
    model = F.when(k == 0, "alpha").when(k == 1, "alpha-0613").when(k == 2, "beta-2").when(k == 3, "beta-2-mini-x").otherwise("gamma-1")
    return t(spark, d, "events").select("event_id", model.alias("model"), (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"))


def _prices(spark):
    return spark.createDataFrame(_PRICES, "model string, prompt double, completion double")


@query(f"WITH {_CALLS} SELECT event_id, priced_model FROM n")
def model_normalize(spark, d):
    return pricing.normalized_models(_calls(spark, d), _prices(spark)).select("event_id", "priced_model")


@query(f"WITH {_CALLS} SELECT n.priced_model, count(*) AS n_calls, CAST(round(sum(prompt_tokens * prompt + completion_tokens * completion), 3) AS DOUBLE) AS cost FROM n LEFT JOIN p ON p.model = n.priced_model GROUP BY n.priced_model")
def cost_per_model(spark, d):
    return pricing.with_cost(_calls(spark, d), _prices(spark)).groupBy("priced_model").agg(F.count(F.lit(1)).alias("n_calls"), F.round(F.sum("cost"), 3).alias("cost"))


@query("SELECT conv_id, len(string_agg(text, '')) AS n_chars, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def conversation_history(spark, d):
    found = dataflow.history(t(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content")), ["conv_id"])
    return found.select("conv_id", F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["content"])).alias("n_chars"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'system' ELSE 'custom' END AS role FROM conversations")
def role_map(spark, d):
    k = F.col("turn") % 4
    role = F.when(k == 0, "human").when(k == 1, "AIMessage").when(k == 2, "SystemMessageChunk").otherwise("custom")
    return t(spark, d, "conversations").select("conv_id", "turn", scalars.map_role(role).alias("role"))


# JSON transforms ---------------------------------------------------------------------------


def _baskets(spark, d):
    item = F.struct(F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), (F.col("l_discount") > 0.05).alias("active"), F.col("l_linenumber").alias("n"))
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("items"))).alias("j"))
    return rows.select("l_orderkey", transforms.items(F.parse_json("j"), "items").alias("items"))


@query("SELECT l_orderkey, count(*) AS n, round(max(l_extendedprice * l_quantity), 2) AS largest FROM lineitem GROUP BY l_orderkey")
def jq_map(spark, d):
    products = transforms.map_product(F.col("items"), "price", "qty")
    return _baskets(spark, d).select("l_orderkey", F.size("items").cast("long").alias("n"), F.round(F.array_max(products), 2).alias("largest"))


@query("SELECT l_orderkey, CAST(sum(CAST(l_discount > 0.05 AS INTEGER)) AS BIGINT) AS n_active FROM lineitem GROUP BY l_orderkey")
def jq_select(spark, d):
    return _baskets(spark, d).select("l_orderkey", F.size(transforms.select(F.col("items"), "active")).cast("long").alias("n_active"))


@query("SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def jq_totals(spark, d):
    prices = F.transform("items", lambda x: variants.as_double(variants.field(x, "price")))
    made = transforms.totals(prices)
    return _baskets(spark, d).select("l_orderkey", F.round(made["total"], 2).alias("total"), made["count"].cast("long").alias("n"))


@query(f"SELECT event_id, CASE WHEN {_K} = 42 OR {_K} = 7 THEN 'hit' ELSE 'miss' END AS outcome, CAST(CAST({_K} AS BIGINT) AS VARCHAR) AS k_text FROM events")
def jq_if(spark, d):
    v = F.parse_json("props")
    k = variants.as_double(transforms.path(v, "k"))
    return t(spark, d, "events").select("event_id", transforms.if_else((k == 42) | (k == 7), F.lit("hit"), F.lit("miss")).alias("outcome"), transforms.to_string(transforms.path(v, "k")).alias("k_text"))


# stores ------------------------------------------------------------------------------------


@query("SELECT o_custkey AS flow_id, arg_max(o_orderkey, o_orderkey) AS version_id FROM orders GROUP BY o_custkey")
def heads_upsert(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("flow_id"), F.col("o_orderkey").alias("version_id"))
    return stores.keep_last(rows.withColumn("at", F.col("version_id")), ["flow_id"], ["at"]).select("flow_id", "version_id")


@query("SELECT o_custkey AS flow_id, o_orderpriority AS tag, k AS version_id FROM (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS k FROM orders GROUP BY ALL) WHERE k % 5 <> 0")
def tags_upsert(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("flow_id"), F.col("o_orderpriority").alias("tag"), F.col("o_orderkey").alias("version_id"), F.col("o_orderkey").alias("updated_at"), (F.col("o_orderkey") % 5 == 0).alias("deleted"))
    return stores.tags(rows).select("flow_id", "tag", "version_id")


@query("SELECT o_custkey AS flow_id, min(o_orderkey) AS version_id FROM orders GROUP BY o_custkey")
def versions_insert_ignore(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("flow_id"), F.col("o_orderkey").alias("version_id"))
    return stores.keep_first(rows, ["flow_id"], ["version_id"])


@query("SELECT event_id, kind, name FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'llm_start' WHEN 'click' THEN 'tool_end' WHEN 'signup' THEN 'step_start' END AS kind, CASE event_type WHEN 'click' THEN 'tool' || (event_id % 3) WHEN 'signup' THEN 'Chain' END AS name FROM events) WHERE kind IS NOT NULL")
def adapter_langchain(spark, d):
    cb = F.create_map(*[F.lit(x) for kv in {"view": "on_llm_start", "click": "on_tool_end", "signup": "on_chain_start", "error": "on_retry", "purchase": None}.items() for x in kv])
    raw = F.to_json(F.struct(cb[F.col("event_type")].alias("callback"), F.concat(F.lit("tool"), (F.col("event_id") % 3).cast("string")).alias("tool_name"), F.struct(F.array(F.lit("langchain_x"), F.lit("Chain")).alias("id")).alias("serialized")))
    rows = t(spark, d, "events").select("event_id", raw.alias("raw"))
    return adapters.translated(rows, "langchain").select("event_id", F.col("type").alias("kind"), "name")


from dagframe import catalog_more  # noqa: E402, F401 - registers further queries
