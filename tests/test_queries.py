"""Every registered query against its independent SQL on the smallest tables, and the plans that matter."""

import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodeglass.operators.detect import detect_format
from lodeglass.operators.entries import parse_logs
from lodeglass.plans import QUERIES, Tables
from lodeglass.plans import inputs as I
from lodeglass.plans.registry import TABLES
from lodeglass.sources.staging import release, stage

FOLDER = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, str(FOLDER))


def ordered(rows):
    return sorted((tuple(map(repr, r)) for r in rows))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query(tables, duck, name):
    query = QUERIES[name]
    df = query.build(tables)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()]
    cursor = duck.execute(query.sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert ordered(got) == ordered(want)


def test_event_ts_of_every_format(tables):
    """All events have a row, and conversion lines that carry a date have it."""
    out = QUERIES["log_event_ts"].build(tables)
    assert out.count() == tables.events.count()
    dated = out.where("format = 'virtv2v' and event_ts is not null").count()
    assert dated == tables.events.where("user_id % 6 = 4 and event_type = 'error'").count() > 0


def test_pods_with_lines_grow_with_the_orders(tables):
    """Events far beyond the first 4000 orders still have a pod of their own."""
    events = tables.spark.range(20_000).selectExpr("id AS event_id", "id AS user_id", "'error' AS event_type", "'{}' AS props", "timestamp '2026-01-01' AS ts")
    orders = tables.spark.range(10_000).selectExpr("id AS o_orderkey", "id AS o_custkey")
    assert I.pod_lines(events, orders, 10_000).select("pod").distinct().count() == 10_000


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(tables):
    plan = plan_of(QUERIES["list_where_order_limit"].build(tables))
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(event_type,error), GreaterThan(value,100.0)" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan


def test_each_line_is_parsed_once_and_not_shuffled(tables):
    """A filter on a parsed column must not parse again below, and raw-line filters must sink to the scan."""
    lines = I.lines(tables.events, I.zap_line())
    formats = stage(detect_format(lines))
    assert release(stage(formats)) is None
    errors = parse_logs(lines, formats).where("level = 'ERROR' and raw_line like '%error%'")
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate inline", 1)
    assert "from_json" not in above
    assert "Contains(" in below or "contains(" in below.lower()
    assert "Exchange hashpartitioning" not in plan_of(errors)


@pytest.mark.parametrize("name", ["log_entries_mixed", "log_compact", "log_stage", "log_stage_blocks", "log_progress"])
def test_lines_are_scanned_once(tables, name):
    """Formats and marks are written before; then one scan serves all formats, and only blocks exchange lines."""
    plan = plan_of(QUERIES[name].build(tables))
    assert plan.count("events.parquet]") == 1
    assert ("Exchange hashpartitioning(source_id" in plan) == (name == "log_stage_blocks")


@pytest.mark.parametrize("name", ["log_flatten", "log_flatten_repeated", "log_json", "log_json_logrus", "log_newest_first"])
def test_json_lines_of_one_file_part_are_parsed_by_all_tasks(tables, name):
    """Columns of a few MB are one task's part or row group, but as lines they are work for all."""
    below_the_parse = plan_of(QUERIES[name].build(tables)).rsplit("Generate inline", 1)[1]
    assert "Exchange hashpartitioning(event_id" in below_the_parse


@pytest.mark.parametrize("name", ["log_detect", "log_tail"])
def test_lines_are_not_sorted_before_they_are_picked(tables, name):
    """Blocks are counted by hashing; only lines of the blocks that are wanted are exchanged and sorted."""
    plan = plan_of(QUERIES[name].build(tables))
    scans = plan.split("FileScan")[:-1]
    for above in scans:
        below_last_exchange = above.rsplit("Exchange", 1)[1]
        assert "Sort " not in below_last_exchange
    assert plan.count("FileScan") == 2
    assert "BroadcastHashJoin" in plan.split("Exchange hashpartitioning(source_id", 2)[1 if name == "log_tail" else 2]


def test_no_query_pairs_rows_without_a_key(tables):
    for name in ("log_request", "pod_pick_negative", "workload_pods", "log_target"):
        plan = plan_of(QUERIES[name].build(tables))
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
