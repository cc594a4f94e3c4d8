"""Picks over log lines: those of a request, tail, age, newest first."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.predicates import since
from lodeglass.operators.blocks import BLOCK_ROWS, PICK_ROWS, carry_last, last_rows
from lodeglass.operators.picks import choose_container, reported_containers, resolve_pods


def resolve_requests(requests: DataFrame, workloads: DataFrame, pods: DataFrame) -> DataFrame:
    """Where each request's lines are: its columns, ``pod``, ``container``, ``containers`` and ``problem``.

    Requests have ``namespace``, ``reference`` (a pod's name or ``type/name`` of a workload) and ``container``, NULL or
    empty where it is to be chosen. Pods have ``containers``, their containers' names, besides the columns of
    :mod:`lodeglass.operators.picks`. ``containers`` is set where one of several was chosen.
    """
    found = resolve_pods(requests, workloads, pods)
    listed = pods.select("namespace", F.col("name").alias("pod"), F.col("containers").alias("_names"))
    placed = found.join(listed, ["namespace", "pod"], "left")
    asked = F.nullif("container", F.lit(""))
    chosen = F.nullif(choose_container(F.col("_names")), F.lit(""))
    only = F.get("_names", F.lit(0))
    problem = F.coalesce("problem", F.when(F.col("_names").isNull(), "pod not found"))
    columns = [c for c in requests.columns if c != "container"]
    return placed.select(
        *columns,
        "pod",
        F.coalesce(asked, chosen, only).alias("container"),
        F.when(asked.isNull(), reported_containers(F.col("_names"))).alias("containers"),
        problem.alias("problem"),
    )


def requested_lines(requests: DataFrame, workloads: DataFrame, pods: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines that requests ask for: ``lines`` (namespace, pod, container, line_no, value) with ``source_id`` and
    the requests' other columns, ready for ``parse_logs``.

    Only the workloads that some request names are resolved. Lines are joined by namespace, pod and container. Requests
    for the same container each get its lines.
    """
    where = resolve_requests(requests, workloads, pods).where("problem is null").drop("problem", "containers")
    found = lines.join(where, ["namespace", "pod", "container"])
    return found.withColumn("source_id", F.concat_ws("/", "namespace", "pod", "container"))


def tail(lines: DataFrame, n: int, block_rows: int = PICK_ROWS) -> DataFrame:
    """The last ``n`` lines of every source; 0 keeps all. Applies before detection and parsing."""
    return last_rows(lines, n, block_rows=block_rows) if n > 0 else lines


def recent(
    lines: DataFrame, event_time: Column, duration: str, as_of: Column | dt.datetime, block_rows: int = BLOCK_ROWS,
    modified: str | None = None,
) -> DataFrame:
    """Lines not older than ``duration`` at ``as_of``.

    A line without a time has that of the last line before it that has one, and at the start of a source that of the
    first one after it. A source without any time stays whole, unless ``modified`` names a column that says when it was last
    written: none of its lines is younger than that.
    """
    timed = carry_last(lines, {"_time": event_time}, block_rows=block_rows, first={"_first": "_time"})
    young = since(F.coalesce("_time", "_first"), duration, as_of)
    undated = F.col("_first").isNull()
    if modified:
        undated = undated & (F.col(modified).isNull() | since(F.col(modified), duration, as_of))
    return timed.where(young | undated).select(*lines.columns)


def newest_order() -> list[Column]:
    """Sort columns of entries by source, last line first."""
    return [F.col("source_id").asc(), F.col("line_no").desc()]


def newest_first(entries: DataFrame) -> DataFrame:
    """Entries by source, last line first. Sorting comes after parsing, so carried stages follow file order."""
    return entries.orderBy(*newest_order())
