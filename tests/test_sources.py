"""Reading snapshots and text files, staging, writing results, and the stream form of parsing."""

import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodeglass.functions.paths import path
from lodeglass.functions.predicates import need
from lodeglass.operators.blocks import number_lines
from lodeglass.operators.compact import compact_line
from lodeglass.operators.detect import detect_files, detect_format
from lodeglass.operators.entries import parse_logs
from lodeglass.operators.logs import tail
from lodeglass.sources import sinks, snapshots, staging
from lodeglass.sources.edges import last_lines
from lodeglass.sources.lines import container_logs, read_lines
from lodeglass.sources.staging import stage
from lodeglass.streaming.entries import stream_entries, stream_logs

POD = {"kind": "Pod", "metadata": {"name": "a", "namespace": "n"}, "spec": {"containers": [{"name": "c"}]}}


def test_lines_keep_order_across_splits(spark, tmp_path):
    """Files of several splits, with lines of every length, empty lines and carriage returns."""
    texts = {"a.log": [f"{i} " + "x" * (i * 37 % 200) for i in range(30000)], "b.log": ["one\r", "", "  ", "two"]}
    for name, values in texts.items():
        (tmp_path / name).write_text("\n".join(values) + "\n", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        source = F.substring_index("_metadata.file_path", "/", -1)
        lines = read_lines(spark, str(tmp_path), source)
        assert lines.rdd.getNumPartitions() > 2
        rows = number_lines(lines).orderBy("source_id", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, values in texts.items():
        got = [(r.line_no, r.value) for r in rows if r.source_id == name]
        assert got == list(enumerate(values, 1))


def test_container_logs(spark, tmp_path):
    for pod in ("a", "b"):
        folder = tmp_path / "n" / pod / "app"
        folder.mkdir(parents=True)
        (folder / "current.log").write_text(f"{pod} now\n")
        (folder / "previous.log").write_text(f"{pod} before\n")
    now = container_logs(spark, str(tmp_path)).collect()
    assert sorted((r.source_id, r.value) for r in now) == [("n/a/app", "a now"), ("n/b/app", "b now")]
    before = container_logs(spark, str(tmp_path), pod="b", previous=True).collect()
    assert [(r.source_id, r.value) for r in before] == [("n/b/app", "b before")]


def test_tiny_splits_are_refused(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        with pytest.raises(ValueError):
            read_lines(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_snapshot_round_trip(spark, tmp_path):
    rows = [("Pod", "n1", "a", {"app": "x"}), ("Pod", "n2", "b", {}), ("Job", "n1", "a", {"app": "x"})]
    df = spark.createDataFrame(rows, "kind string, namespace string, name string, labels map<string,string>")
    snapshots.write_snapshot(df, str(tmp_path / "s"))
    back = snapshots.read_snapshot(spark, str(tmp_path / "s"))

    def names(found):
        return sorted((r.kind, r.namespace, r.name) for r in found.collect())

    assert names(snapshots.list_objects(back, "Pod", "n1")) == [("Pod", "n1", "a")]
    assert names(snapshots.list_objects(back, "Pod", all_namespaces=True)) == [("Pod", "n1", "a"), ("Pod", "n2", "b")]
    assert names(snapshots.list_objects(back, "Pod", all_namespaces=True, labels=[need("app", "=", "x")])) == [("Pod", "n1", "a")]
    assert names(snapshots.get_object(back, "Job", "n1", "a")) == [("Job", "n1", "a")]
    with pytest.raises(ValueError):
        snapshots.list_objects(back, "Pod")
    with pytest.raises(ValueError):
        snapshots.get_object(back, "Pod", "n1", "")
    plan = snapshots.get_object(back, "Job", "n1", "a")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "EqualTo(name,a)" in plan


def test_mixed_snapshot(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(POD) + "\nnot json\n")
    df = snapshots.read_mixed(spark, str(tmp_path / "s.json"))
    assert [(r.kind, r.namespace, r.name) for r in df.where("kind is not null").collect()] == [("Pod", "n", "a")]
    found = df.where("kind = 'Pod'").select(F.to_json(F.struct(path(df, "object.spec.containers.name").alias("v"))).alias("j"))
    assert found.first().j == '{"v":["c"]}'


def test_events(spark):
    rows = [("n", ("Pod", "a")), ("n", ("Pod", "b")), ("m", ("Job", "a"))]
    df = spark.createDataFrame(rows, "namespace string, involvedObject struct<kind:string,name:string>")
    assert snapshots.list_events(df, "n", kind="Pod", name="a").count() == 1
    assert snapshots.list_events(df, "n", kind="pod").count() == 0
    assert snapshots.list_events(df, all_namespaces=True, name="a").count() == 2
    with pytest.raises(ValueError):
        snapshots.list_events(df)


def test_sinks(spark, tmp_path):
    rows = [("a", i, f'{{"msg":"m{i}"}}') for i in range(1, 50)] + [("b", 1, "text")]
    lines = spark.createDataFrame(rows, "source_id string, line_no long, value string").repartition(3)
    entries = parse_logs(lines)

    def read(name):
        return [line for f in sorted((tmp_path / name).glob("part-*")) for line in f.read_text().splitlines()]

    sinks.write_raw(entries, str(tmp_path / "raw"))
    assert read("raw") == [r[2] for r in rows]
    sinks.write_compact(entries, str(tmp_path / "compact"))
    assert read("compact") == [f"[INFO ] m{i}" for i in range(1, 50)] + ["text"]
    sinks.write_json(entries.select("message", "fields").where("message = 'm7'"), str(tmp_path / "json"))
    assert read("json") == ['{"message":"m7"}']
    sinks.write_json(entries.where("level = 'FATAL'"), str(tmp_path / "none"))
    assert read("none") == []


def test_stage(spark):
    df = spark.range(5).withColumn("x", F.lit("y"))
    staged = stage(df)
    assert staged.schema.names == ["id", "x"] and staged.count() == 5
    assert spark.conf.get("spark.checkpoint.dir") in staged.inputFiles()[0]


def test_stream(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text('{"msg":"m","level":"err"}\n\nodd\n')
    (logs / "b.log").write_text("plain\n")
    formats = stage(detect_format(read_lines(spark, str(logs))))
    entries = stream_entries(spark, str(logs), formats)
    query = (
        entries.select(compact_line().alias("line"), "format")
        .writeStream.format("memory").queryName("entries").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r.format, r.line) for r in spark.table("entries").collect())
    assert got == [("json", "[     ] odd"), ("json", "[ERROR] m"), ("plain", "plain")]


def write_sparse(path, head, tail, size=1 << 40):
    """A file of a terabyte that takes a few blocks of disk."""
    with open(path, "wb") as file:
        file.write(head)
        file.seek(size - len(tail))
        file.write(tail)


def test_edges_of_files(spark, tmp_path):
    """The lines that detection and tails need, whatever lies between them."""
    import gzip
    import random

    rnd = random.Random(2)
    kinds = ['{"a":1}', "I0303 11:14:07.3 1 a.go:1] x", "", "  ", "\u2003", "text", "a=1 b=2 c=3", "x" * 70_000]
    for k in range(25):
        lines = [rnd.choice(kinds[: 3 + k % 6]) for _ in range(rnd.randrange(0, 60))]
        (tmp_path / f"{k}.log").write_text("\n".join(lines) + rnd.choice(["", "\n"]), newline="")
    (tmp_path / "silent.log").write_text("\n" * 200_000 + '{"late":1}\n')
    with gzip.open(tmp_path / "packed.log.gz", "wt") as file:
        file.write('{"a":1}\n' * 5000)
    lines = read_lines(spark, str(tmp_path))
    assert sorted(map(tuple, detect_files(spark, str(tmp_path)).collect())) == sorted(
        tuple(r) for r in detect_format(lines).collect()
    )
    for n in (1, 3, 40, 5000):
        want = sorted((r.source_id, r.value) for r in tail(lines, n).collect())
        got = last_lines(spark, str(tmp_path), n).collect()
        assert sorted((r.source_id, r.value) for r in got) == want
        by_source = {}
        for r in got:
            by_source.setdefault(r.source_id, []).append(r.line_no)
        assert all(len(set(at)) == len(at) for at in by_source.values())


def test_edges_do_not_depend_on_length(spark, tmp_path):
    write_sparse(tmp_path / "long.log", b'{"level":"info"}\n' * 30, b"\n" + b'{"level":"error"}\n' * 3)
    assert [r.format for r in detect_files(spark, str(tmp_path)).collect()] == ["json"]
    found = last_lines(spark, str(tmp_path), 3).orderBy("line_no").collect()
    assert [r.value for r in found] == ['{"level":"error"}'] * 3 and found[0].line_no > 1 << 39


@pytest.mark.parametrize("order", ["sorted", "shuffled"])
def test_stream_with_state_equals_batch(spark, tmp_path, order):
    """Votes, stages and progress of a stream, lines in order or not, are those of the batch job on the same lines."""
    import random

    import pandas as pd

    rnd = random.Random(order)
    conversion = ["Building command: virt-v2v", "[   3.5] Opening the source", "virt-v2v monitoring: Progress update, completed 7 %",
                  "odd", "[  21.9] Copying disk 2/5", "[   1.1] Setting up the source: -i ova", "nbdkit: debug: x"]
    kinds = {
        "pod": lambda k: conversion[k % 7], "json": lambda k: f'{{"msg":"m{k}","level":"warn"}}', "text": lambda k: f"free {k}",
        "late": lambda k: "" if k < 25 else '{"a":1}', "mixed": lambda k: rnd.choice(['{"a":1}', "I0303 x", "", "text"]),
    }
    lengths = {"pod": 60, "json": 40, "text": 30, "late": 40, "mixed": 50, "short": 3}
    kinds["short"] = kinds["json"]
    rows = [(s, k, kinds[s](k), 1_770_000_000 + 10 * k) for s, n in lengths.items() for k in range(n)]
    batch = parse_logs(spark.createDataFrame([r[:3] for r in rows], "source_id string, line_no long, value string"))
    # arrival: by time, disturbed by less than the watermark's delay
    rows.sort(key=lambda r: (r[3] + (rnd.uniform(0, 55) if order == "shuffled" else 0), r[0], r[1]))
    rows.append(("end", 0, "x", 1_770_100_000))
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(0, len(rows), 40):
        frame = pd.DataFrame(rows[k : k + 40], columns=["source_id", "line_no", "value", "at"])
        frame["at"] = pd.to_datetime(frame["at"], unit="s", utc=True).astype("datetime64[us, UTC]")
        frame.to_parquet(folder / f"{k:05d}.parquet")
        os.utime(folder / f"{k:05d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    schema = "source_id string, line_no long, value string, at timestamp"
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = (
        stream_logs(lines, idle_seconds=3000).writeStream.format("memory").queryName(f"logs_{order}")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    columns = ["source_id", "line_no", "format", "level", "message", "parsed", "fields"]
    shown = lambda df: sorted((*map(repr, r[:-1]), sorted((r[-1] or {}).items())) for r in df.select(columns).collect())
    got = shown(spark.table(f"logs_{order}").where("source_id != 'end'"))
    assert got == shown(batch)


def test_staged_tables_are_deleted_together(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "shared_folder", lambda _: str(tmp_path / "app"))
    first, second = stage(spark.range(3)), stage(spark.range(4))
    staging.release(first)
    assert second.count() == 4 and len(list((tmp_path / "app").iterdir())) == 1
    staging.release_all(spark)
    assert not (tmp_path / "app").exists()


@pytest.mark.parametrize("master, warehouse, fine", [("spark://far:7077", "file:/tmp/x", False), ("yarn", "s3a://b/x", True), ("local[2]", "file:/x", True)])
def test_own_disks_of_a_cluster_are_refused(master, warehouse, fine):
    settings = {"spark.checkpoint.dir": None, "spark.sql.warehouse.dir": warehouse}
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: settings[name] or default),
        sparkContext=SimpleNamespace(master=master, applicationId="app"),
    )
    if fine:
        assert staging.shared_folder(session) == f"{warehouse}/lodeglass-app"
    else:
        with pytest.raises(ValueError):
            staging.shared_folder(session)
