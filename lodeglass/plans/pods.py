"""Queries that pick pods and containers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.operators import compact, picks
from lodeglass.operators.entries import parse_as
from lodeglass.operators.logs import requested_lines
from lodeglass.plans.inputs import containers, open_workloads, pod_lines, pods, workloads
from lodeglass.plans.registry import Tables, query

# Orders a customer's workload selects, by segment.
_SELECTED = """CASE c_mktsegment WHEN 'BUILDING' THEN o_orderpriority IN ('1-URGENT', '2-HIGH')
                    WHEN 'MACHINERY' THEN o_orderpriority <> '5-LOW' WHEN 'FURNITURE' THEN o_orderstatus = 'O'
                    WHEN 'AUTOMOBILE' THEN o_orderstatus <> 'O' ELSE TRUE END"""
_PAIRS = f"SELECT c_custkey, c_name, c_mktsegment, o_orderkey, o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey WHERE {_SELECTED}"
_PICKED = f"""SELECT c_custkey, arg_min(o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) * 1000000000000 + o_orderkey) AS o_orderkey,
                     count(*) AS pods, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS running FROM ({_PAIRS}) GROUP BY c_custkey"""


@query(f"SELECT c_name AS name, 'pod-' || o_orderkey AS pod FROM ({_PAIRS})")
def workload_pods(t: Tables):
    return picks.workload_pods(workloads(t.customer), pods(t.orders)).select("name", "pod")


@query(
    f"""SELECT c.c_name AS name, 'pod-' || p.o_orderkey AS pod, coalesce(p.pods, 0) AS pods,
               CASE p.running WHEN 1 THEN 'Running' WHEN 0 THEN 'Pending' END AS phase
        FROM customer c LEFT JOIN ({_PICKED}) p USING (c_custkey)"""
)
def pod_pick(t: Tables):
    return picks.pick_pods(workloads(t.customer), pods(t.orders)).select("name", "pod", "pods", "phase")


@query(
    f"""SELECT c.c_name AS name, 'pod-' || p.o_orderkey AS pod FROM customer c LEFT JOIN ({_PICKED}) p USING (c_custkey)
        WHERE c_mktsegment = 'HOUSEHOLD'"""
)
def job_selector(t: Tables):
    jobs = workloads(t.customer).where(F.col("kind") == "Job")
    return picks.pick_pods(jobs, pods(t.orders)).select("name", "pod")


@query(
    f"""SELECT c.c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'web-1' WHEN 'BUILDING' THEN NULL
                                 ELSE 'pod-' || p.o_orderkey END AS pod,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'unsupported resource type' WHEN c_mktsegment = 'MACHINERY' THEN NULL
                    WHEN p.o_orderkey IS NULL THEN 'no pods found' END AS problem
        FROM customer c LEFT JOIN ({_PICKED}) p USING (c_custkey)"""
)
def log_target(t: Tables):
    segment = F.col("c_mktsegment")
    reference = (
        F.when(segment == "MACHINERY", "web-1")
        .when(segment == "BUILDING", F.concat(F.lit("cronjob/"), F.col("c_name")))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("job/"), F.col("c_name")))
        .otherwise(F.concat(F.lit("DEPLOY/"), F.col("c_name")))
    )
    owned = workloads(t.customer)
    requests = t.customer.select(
        "c_custkey", F.concat(F.lit("ns-"), F.pmod("c_custkey", F.lit(7))).alias("namespace"), reference.alias("reference")
    )
    return picks.resolve_pods(requests, owned, pods(t.orders)).select("c_custkey", "pod", "problem")


@query(
    """SELECT n_name AS name, 'pod-' || min(o_orderkey) AS pod, count(o_orderkey) AS pods FROM nation
       LEFT JOIN orders ON o_custkey % 7 = n_nationkey % 7
        AND CASE n_nationkey % 3 WHEN 0 THEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') WHEN 1 THEN o_orderstatus <> 'O' ELSE TRUE END
       GROUP BY n_name"""
)
def pod_pick_negative(t: Tables):
    """Workloads that only say what their pods do not have, and jobs that take every pod of a namespace."""
    waiting = pods(t.orders).withColumn("phase", F.lit(None).cast("string"))
    return picks.pick_pods(open_workloads(t.nation), waiting).select("name", "pod", "pods")


@query(
    f"""SELECT c.c_custkey, event_id AS line_no, 'ERROR' AS level, 'user ' || user_id || ' did error' AS message
        FROM customer c JOIN ({_PICKED}) p USING (c_custkey)
        JOIN (SELECT *, event_id % (SELECT max(o_orderkey) + 1 FROM orders) AS pod FROM events) e ON e.pod = p.o_orderkey
        WHERE event_type = 'error' AND c_mktsegment NOT IN ('MACHINERY', 'BUILDING')
          AND CASE WHEN c_mktsegment = 'FURNITURE' THEN event_id % 2 = 1 ELSE event_id % 2 = 0 END"""
)
def log_request(t: Tables):
    """From a workload's name to the errors in its log: pod, container, lines, entries. Lines are spread over the pods of
    all orders, so pods with lines grow with the tables."""
    keys = (t.orders.agg(F.max("o_orderkey")).first()[0] or 0) + 1
    return _requested_errors(t, pod_lines(t.events, t.orders, keys))


def _requested_errors(t: Tables, lines: DataFrame) -> DataFrame:
    segment = F.col("c_mktsegment")
    kind = F.when(segment == "MACHINERY", "pod").when(segment == "BUILDING", "cronjob").when(segment == "HOUSEHOLD", "job").otherwise("deployment")
    requests = t.customer.select(
        "c_custkey",
        F.concat(F.lit("ns-"), F.pmod("c_custkey", F.lit(7))).alias("namespace"),
        F.concat(kind, F.lit("/"), "c_name").alias("reference"),
        F.when(segment == "FURNITURE", "side").alias("container"),
    )
    own = pods(t.orders).withColumn("containers", F.array(F.lit("istio-proxy"), F.lit("main"), F.lit("side")))
    entries = parse_as(requested_lines(requests, workloads(t.customer), own, lines), "json")
    return entries.where("level = 'ERROR'").select("c_custkey", "line_no", "level", "message")


_FORWARD = "['istio-proxy', 'vector', 'app-a', 'fluent-bit', 'app-b', 'envoy', 'app-c']"
_LISTED = f"list_slice(CASE WHEN l_returnflag = 'R' THEN {_FORWARD} ELSE list_reverse({_FORWARD}) END, 1, l_linenumber)"


@query(
    f"""SELECT l_orderkey, l_linenumber,
               CASE WHEN l_linenumber = 1 THEN '' WHEN l_returnflag <> 'R' THEN 'app-c'
                    WHEN l_linenumber = 2 THEN 'istio-proxy' ELSE 'app-a' END AS container,
               CASE WHEN l_linenumber > 1 THEN array_to_string({_LISTED}, ', ') END AS names,
               CASE WHEN l_linenumber > 1 THEN '# auto-selected container: '
                    || CASE WHEN l_returnflag <> 'R' THEN 'app-c' WHEN l_linenumber = 2 THEN 'istio-proxy' ELSE 'app-a' END
                    || ' (pod has ' || l_linenumber || ' containers: ' || array_to_string({_LISTED}, ', ') || ')' END AS note
        FROM lineitem"""
)
def container_pick(t: Tables):
    listed = t.lineitem.withColumn("names", containers())
    chosen = picks.choose_container(F.col("names"))
    return listed.select(
        "l_orderkey",
        "l_linenumber",
        chosen.alias("container"),
        F.array_join(picks.reported_containers(F.col("names")), ", ").alias("names"),
        compact.selection_note(chosen, F.col("names")).alias("note"),
    )
