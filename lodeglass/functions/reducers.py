"""Reducers over the elements of one row's array: ``sum``, ``len``, ``any``, ``all``.

Anything that is not an array passes through unchanged. Only numbers count for ``sum`` and only ``true`` counts as true.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.functions.paths import Ref

# Names of the reducers.
NAMES = ("sum", "len", "any", "all")

_NUMBER_KINDS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def reduce_value(ref: Ref, name: str) -> Ref:
    if name not in NAMES:
        raise ValueError(f"unknown reducer {name!r}")
    if isinstance(ref.type, T.VariantType):
        items = Ref(
            F.try_variant_get(ref.column, "$", "array<variant>"), T.ArrayType(T.VariantType())
        )
        reduced = _reduce_array(items, name)
        is_array = F.schema_of_variant(ref.column).startswith("ARRAY")
        return Ref(F.when(is_array, reduced.column.cast("variant")).otherwise(ref.column), ref.type)
    if not isinstance(ref.type, T.ArrayType):
        return ref
    return _reduce_array(ref, name)


def _reduce_array(ref: Ref, name: str) -> Ref:
    items, kind = ref.column, ref.type.elementType
    if name == "len":
        return Ref(F.when(items.isNotNull(), F.size(items).cast("long")), T.LongType())
    if name == "sum":
        return Ref(F.aggregate(_numbers(items, kind), F.lit(0.0), lambda a, x: a + x), T.DoubleType())
    flags = _flags(items, kind)
    if name == "any":
        return Ref(F.exists(flags, lambda x: x), T.BooleanType())
    return Ref((F.size(flags) > 0) & F.forall(flags, lambda x: x), T.BooleanType())


def _numbers(items: Column, kind: T.DataType) -> Column:
    """Elements as doubles, 0 for what is not a number."""
    if isinstance(kind, T.NumericType):
        return F.transform(items, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    if isinstance(kind, T.VariantType):

        def value(x: Column) -> Column:
            is_number = F.schema_of_variant(x).rlike(_NUMBER_KINDS)
            return F.coalesce(F.when(is_number, F.try_variant_get(x, "$", "double")), F.lit(0.0))

        return F.transform(items, value)
    return F.transform(items, lambda _: F.lit(0.0))


def _flags(items: Column, kind: T.DataType) -> Column:
    """Elements as booleans, false for what is not true."""
    if isinstance(kind, T.BooleanType):
        return F.transform(items, lambda x: F.coalesce(x, F.lit(False)))
    if isinstance(kind, T.VariantType):
        return F.transform(
            items,
            lambda x: F.coalesce(
                F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean")),
                F.lit(False),
            ),
        )
    return F.transform(items, lambda _: F.lit(False))


def any_element(items: Column, condition: Callable[[Column], Column]) -> Column:
    """Some element meets the condition; false for an empty array."""
    return F.coalesce(F.exists(items, lambda x: F.coalesce(condition(x), F.lit(False))), F.lit(False))


def all_elements(items: Column, condition: Callable[[Column], Column]) -> Column:
    """There are elements and each meets the condition."""
    met = F.forall(items, lambda x: F.coalesce(condition(x), F.lit(False)))
    return F.coalesce((F.size(items) > 0) & met, F.lit(False))


def length(ref: Ref) -> Column:
    """Number of elements of an array or map, or of characters of a text."""
    if isinstance(ref.type, (T.ArrayType, T.MapType)):
        return F.when(ref.column.isNotNull(), F.size(ref.column).cast("long"))
    if isinstance(ref.type, T.VariantType):
        items = F.try_variant_get(ref.column, "$", "array<variant>")
        text = F.try_variant_get(ref.column, "$", "string")
        return F.when(items.isNotNull(), F.size(items)).otherwise(F.length(text)).cast("long")
    return F.length(ref.column.cast("string")).cast("long")
