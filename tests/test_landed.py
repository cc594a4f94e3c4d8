"""Landed lines: searches give the rows of a whole scan and read few parts."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lodeglass.operators import logs
from lodeglass.operators.entries import event_time
from lodeglass.sources import landed

AS_OF = dt.datetime(2026, 3, 3, 12, 0, 0, tzinfo=dt.timezone.utc)


def log_lines():
    rnd = random.Random(11)
    rows = []
    for s in range(12):
        minute = rnd.randrange(0, 9000)
        for k in range(rnd.choice([1, 30, 700])):
            minute += rnd.randrange(3)
            stamp = (AS_OF - dt.timedelta(minutes=11_000 - minute)).strftime("%Y-%m-%dT%H:%M:%SZ ")
            dated = s != 3 and rnd.random() < (0.02 if s % 4 == 1 else 0.5)
            rows.append((f"s{s}", k, (stamp if dated else "") + " ".join(rnd.choices(["Alpha", "beta-gamma", "x=1", "É"], k=4))))
    rows.append(("s2", 5000, "a Needle, found"))
    rows.append(("s3", 5000, ""))
    return rows


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(log_lines(), "source_id string, line_no long, value string").repartition(3)


@pytest.fixture(scope="module")
def path(lines, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("landed") / "x")
    landed.land(lines, folder, part_rows=100)
    return folder


def files_read(df):
    """Files that the scan of the lines has read, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    leaves = df._jdf.queryExecution().executedPlan().executedPlan().collectLeaves()
    counts = []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        inner = leaf.plan() if "QueryStage" in leaf.getClass().getSimpleName() else leaf
        for scan in [inner.collectLeaves().apply(j) for j in range(inner.collectLeaves().size())]:
            if "/lines" in scan.toString():
                counts.append(scan.metrics().apply("numFiles").value())
    return max(counts)


@pytest.mark.parametrize("wanted", [["needle"], ["GAMMA", "alpha"], ["É", "1"], ["none"], ["found", "alpha"], ["needle", "found", "a"]])
def test_search(spark, path, wanted):
    want = {(s, k) for s, k, v in log_lines() if {w.lower() for w in wanted} <= {w.lower() for w in re.split(r"[\W_]+", v)}}
    assert {(r.source_id, r.line_no) for r in landed.search(spark, path, wanted).collect()} == want
    with pytest.raises(ValueError):
        landed.search(spark, path, [])


def test_search_reads_few_parts(spark, path):
    parts = spark.read.parquet(f"{path}/lines").select("part").distinct().count()
    assert parts > 20
    assert files_read(landed.search(spark, path, ["needle"])) <= parts / 10


@pytest.mark.parametrize("duration", ["1m", "20h", "100h", "9000h"])
def test_recent(spark, lines, path, duration):
    want = {(r.source_id, r.line_no) for r in logs.recent(lines, event_time(F.col("value")), duration, AS_OF).collect()}
    found = landed.recent(spark, path, duration, AS_OF)
    assert {(r.source_id, r.line_no) for r in found.collect()} == want
    assert want


def test_no_lines(spark, lines, tmp_path):
    landed.land(lines.where("false"), str(tmp_path / "none"))
    assert landed.search(spark, str(tmp_path / "none"), ["x"]).count() == 0
    assert landed.recent(spark, str(tmp_path / "none"), "1h", AS_OF).count() == 0
