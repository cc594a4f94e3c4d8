"""Sort keys: NULL lowest, numbers and numeric texts by value and before other texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.functions.paths import Ref

# Texts that count as numbers.
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE = r"^[+-]?\d{1,18}$"


def sort_keys(ref: Ref, descending: bool = False) -> list[Column]:
    """Sort expressions for one key. Spark's defaults already put NULL first ascending and last descending."""
    keys = _parts(ref)
    return [k.desc() if descending else k.asc() for k in keys]


def _parts(ref: Ref) -> list[Column]:
    kind = ref.type
    if isinstance(kind, T.StringType):
        return _text_parts(ref.column)
    if isinstance(kind, T.VariantType):
        return _text_parts(F.try_variant_get(ref.column, "$", "string"))
    if isinstance(kind, (T.MapType, T.StructType, T.ArrayType)):
        return [F.to_json(ref.column)]
    return [ref.column]


def _text_parts(text: Column) -> list[Column]:
    # Four keys: numbers before texts, the number, the exact number where a double cannot hold it, the text.
    is_number = text.rlike(NUMERIC)
    return [
        ~is_number,
        F.when(is_number, text.try_cast("double")),
        F.when(text.rlike(WHOLE), text.try_cast("bigint")),
        F.when(~is_number, text),
    ]


def display_key(cell: Column) -> Column:
    """Sort key of a display cell: its text in lower case, missing cells as empty text."""
    return F.lower(F.coalesce(cell.cast("string"), F.lit("")))
