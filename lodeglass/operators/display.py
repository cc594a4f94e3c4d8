"""Snapshot rows as query items, and their display columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.functions.ordering import display_key
from lodeglass.functions.text import last_wins_map, let

CELLS = "_columns"
HOISTED = ("name", "namespace")


def shape_rows(table: DataFrame, headers: Sequence[str], object_col: str = "object", cells_col: str = "cells") -> DataFrame:
    """Object members as columns, ``name`` and ``namespace`` from its metadata, display cells as a map.

    A row with fewer cells than headers lacks the last keys.
    """
    kind = table.schema[object_col].dataType
    metadata = kind["metadata"].dataType if "metadata" in kind.names else T.StructType()
    hoisted = [n for n in HOISTED if n in metadata.names]
    obj = F.col(object_col)
    cells = F.col(cells_col)
    shown = F.least(F.size(cells), F.lit(len(headers)))
    names = F.slice(F.array(*[F.lit(h) for h in headers]), F.lit(1), shown)

    values = F.slice(cells, F.lit(1), shown)
    if len(set(headers)) == len(headers):
        named = F.map_from_arrays(names, values)
    else:
        pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        named = let(pairs, last_wins_map)

    def hoist(name: str) -> Column:
        value = obj["metadata"][name]
        return F.coalesce(value, obj[name]) if name in kind.names else value

    return table.select(
        *[obj[n].alias(n) for n in kind.names if n not in hoisted],
        *[hoist(n).alias(n) for n in hoisted],
        F.when(cells.isNotNull(), named).alias(CELLS),
    )


def strip_internal(items: DataFrame) -> DataFrame:
    """Drop what row shaping has added."""
    return items.drop(CELLS, *HOISTED)


def inject_namespace(headers: Sequence[str], items: DataFrame) -> tuple[list[str], DataFrame]:
    """Put a ``Namespace`` display column after ``Name`` (else first), unless there is one."""
    lowered = [h.lower() for h in headers]
    if "namespace" in lowered:
        return list(headers), items
    at = lowered.index("name") + 1 if "name" in lowered else 0
    namespace = F.coalesce(F.col("namespace"), F.lit("")) if "namespace" in items.columns else F.lit("")
    kept = F.map_filter(CELLS, lambda k, _: k != "Namespace")
    cells = F.map_concat(kept, F.create_map(F.lit("Namespace"), namespace))
    return [*headers[:at], "Namespace", *headers[at:]], items.withColumn(CELLS, cells)


def display(
    items: DataFrame,
    headers: Sequence[str],
    sort_by: str | None = None,
    row_limit: int = 0,
    tie: Sequence[str] = (),
    all_namespaces: bool = False,
) -> DataFrame:
    """Display columns as text, sorted by one of them if it exists, then limited."""
    if all_namespaces:
        headers, items = inject_namespace(headers, items)
    named = {h.lower(): h for h in reversed(headers)}
    if sort_by and sort_by.lower() in named:
        items = items.orderBy(display_key(F.col(CELLS)[named[sort_by.lower()]]), *tie)
    if row_limit > 0:
        items = items.limit(row_limit)
    return items.select(
        *[F.coalesce(F.col(CELLS)[h].cast("string"), F.lit("")).alias(h) for h in headers]
    )
