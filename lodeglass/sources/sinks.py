"""Results as JSON rows, compact log lines or the original lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.operators.compact import compact_line
from lodeglass.operators.display import CELLS


def json_rows(df: DataFrame, drop: Sequence[str] = (CELLS,)) -> DataFrame:
    """One JSON object per row in a ``json`` column: keys in order, null members left out."""
    names = sorted(c for c in df.columns if c not in drop)
    ordered = F.struct(*[_sorted_members(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in names])
    return df.select(F.to_json(ordered).alias("json"))


def _sorted_members(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        members = [_sorted_members(value.getField(n), kind[n].dataType).alias(n) for n in sorted(kind.names)]
        return F.when(value.isNotNull(), F.struct(*members))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
        return F.transform(value, lambda x: _sorted_members(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: value[k]))
    return value


def write_json(df: DataFrame, path: str) -> None:
    """JSON Lines; an empty result writes no rows."""
    json_rows(df).write.text(path)


def _in_order(entries: DataFrame, text: Column) -> DataFrame:
    order = ["source_id", "line_no"]
    ranged = entries.select(*order, text.alias("value")).repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).select("value")


def write_compact(entries: DataFrame, path: str) -> None:
    """One compact line per entry, in source and line order across the part files."""
    _in_order(entries, compact_line()).write.option("lineSep", "\n").text(path)


def write_raw(entries: DataFrame, path: str, column: str = "raw_line") -> None:
    """The original lines, in source and line order across the part files."""
    _in_order(entries, F.col(column)).write.option("lineSep", "\n").text(path)
