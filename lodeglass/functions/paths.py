"""Nested access by path: ``a.b``, ``a[0]``, ``a[key]``, ``a[*].b`` and the implicit fan-out over arrays.

A path is resolved once against the DataFrame's schema and becomes one Catalyst expression. What has no value (an index
out of range, a step below a scalar) is NULL. Columns of type VARIANT are resolved at run time, with the same rules.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeglass.functions.text import let

_PART = re.compile(r"(?:[^.\[]|\[[^\]]*\])+")
_BRACKET = re.compile(r"^(.*)\[([^\]]+)\]$")


class Ref(NamedTuple):
    """A resolved value: its column and its type."""

    column: Column
    type: T.DataType


def _nothing() -> Ref:
    return Ref(F.lit(None), T.NullType())


def _empty_list() -> Ref:
    return Ref(F.array().cast("array<string>"), T.ArrayType(T.StringType()))


def path(df: DataFrame, text: str) -> Column:
    return resolve(df, text).column


def resolve(df: DataFrame, text: str) -> Ref:
    parts = _PART.findall(text.strip().removeprefix("{{").removesuffix("}}").strip().removeprefix("."))
    return _walk(Ref(None, df.schema), parts)


def match_name(names: list[str], wanted: str) -> str | None:
    """Exact name, else ignoring case, else with underscores for blanks; of several the first in schema order."""
    if wanted in names:
        return wanted
    for form in (wanted.lower(), wanted.replace("_", " ").lower()):
        for name in names:
            if name.lower() == form:
                return name
    return None


def _walk(ref: Ref, parts: list[str]) -> Ref:
    if not parts:
        return ref
    if not isinstance(ref.type, (T.StructType, T.MapType, T.VariantType)):
        return _nothing()
    part, rest = parts[0], parts[1:]
    bracket = _BRACKET.match(part)
    name, inside = bracket.groups() if bracket else (part, None)
    value = _member(ref, name)

    if inside == "*":
        return _each(value, rest)
    if inside is not None and inside.isdigit():
        value = _element(value, int(inside))
    elif inside is not None:
        value = _key(value, inside.strip("\"'"))
    if rest and isinstance(value.type, T.ArrayType):
        return _each(value, rest)
    if rest and isinstance(value.type, T.VariantType):
        return _variant_rest(value, rest)
    return _walk(value, rest)


def _member(ref: Ref, name: str) -> Ref:
    if isinstance(ref.type, T.StructType):
        found = match_name(ref.type.names, name)
        if found is None:
            return _nothing()
        column = F.col(f"`{found}`") if ref.column is None else _field(ref, found)
        return Ref(column, ref.type[found].dataType)
    if isinstance(ref.type, T.MapType):
        return Ref(_map_member(ref.column, name), ref.type.valueType)

    def find(obj: Column) -> Column:
        exact = F.try_variant_get(obj, f"$[{_quoted(name)}]", "variant")
        members = F.try_variant_get(obj, "$", "map<string,variant>")
        return F.coalesce(exact, let(members, lambda m: _map_member(m, name)))

    return Ref(_not_json_null(let(ref.column, find)), T.VariantType())


def _field(ref: Ref, name: str) -> Column:
    """Member of a struct; where others differ from it by case alone, by its place."""
    names = ref.type.names
    if sum(n.lower() == name.lower() for n in names) == 1:
        return ref.column.getField(name)
    placed = T.StructType([T.StructField(f"_{k}", f.dataType, True) for k, f in enumerate(ref.type.fields)])
    return ref.column.cast(placed).getField(f"_{names.index(name)}")


def _quoted(key: str) -> str:
    return f"'{key}'" if "'" not in key else f'"{key}"'


def _not_json_null(value: Column) -> Column:
    return let(value, lambda v: F.when(~F.is_variant_null(v), v))


def _map_member(members: Column, name: str) -> Column:
    """Value of a key found by the rules of :func:`match_name`."""

    def first(form: str) -> Column:
        return F.map_filter(members, lambda k, _: F.lower(k) == form)

    any_case, spaced = first(name.lower()), first(name.replace("_", " ").lower())
    return (
        F.when(F.map_contains_key(members, name), members[name])
        .when(F.size(any_case) > 0, F.get(F.map_values(any_case), F.lit(0)))
        .otherwise(F.get(F.map_values(spaced), F.lit(0)))
    )


def _element(ref: Ref, index: int) -> Ref:
    if isinstance(ref.type, T.ArrayType):
        return Ref(F.get(ref.column, F.lit(index)), ref.type.elementType)
    if isinstance(ref.type, T.VariantType):
        return Ref(_not_json_null(F.try_variant_get(ref.column, f"$[{index}]", "variant")), ref.type)
    return _nothing()


def _key(ref: Ref, key: str) -> Ref:
    if isinstance(ref.type, T.MapType):
        return Ref(ref.column[key], ref.type.valueType)
    if isinstance(ref.type, T.StructType) and key in ref.type.names:
        return Ref(_field(ref, key), ref.type[key].dataType)
    if isinstance(ref.type, T.VariantType):
        found = F.try_variant_get(ref.column, f"$[{_quoted(key)}]", "variant")
        return Ref(_not_json_null(found), ref.type)
    return _nothing()


def _each(ref: Ref, rest: list[str]) -> Ref:
    """The rest of the path for every element: hits only, array hits flattened by one level."""
    if isinstance(ref.type, T.VariantType):
        items = Ref(F.try_variant_get(ref.column, "$", "array<variant>"), T.ArrayType(ref.type))
        return _each(items, rest)
    if not isinstance(ref.type, T.ArrayType):
        return _nothing()

    found: list[T.DataType] = []

    def hit(item: Column) -> Column:
        got = _walk(Ref(item, ref.type.elementType), rest)
        found[:] = [got.type]
        return _variant_hits(got.column) if isinstance(got.type, T.VariantType) else got.column

    hits = F.filter(F.transform(ref.column, hit), lambda v: v.isNotNull())
    (kind,) = found
    if isinstance(kind, T.NullType):
        return Ref(F.when(ref.column.isNotNull(), _empty_list().column), _empty_list().type)
    if isinstance(kind, T.VariantType):
        return Ref(F.flatten(hits), T.ArrayType(kind))
    if isinstance(kind, T.ArrayType):
        return Ref(F.flatten(hits), kind)
    return Ref(hits, T.ArrayType(kind))


def _variant_hits(value: Column) -> Column:
    """Elements of an array value, the value itself otherwise; NULL when there is none."""

    def hits(one: Column) -> Column:
        members = F.try_variant_get(one, "$", "array<variant>")
        return F.when(one.isNotNull() & ~F.is_variant_null(one), F.coalesce(members, F.array(one)))

    return let(value, hits)


def _variant_rest(ref: Ref, rest: list[str]) -> Ref:
    """Below a VARIANT an array fans out and an object is entered, whichever it turns out to be."""
    found: list[T.DataType] = []

    def enter(value: Column) -> Column:
        inner = Ref(value, T.VariantType())
        direct = _walk(inner, rest)
        found[:] = [direct.type]
        if isinstance(direct.type, T.ArrayType):
            return direct.column
        listed = F.to_variant_object(_each(inner, rest).column)
        return F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(direct.column)

    column = let(ref.column, enter)
    return Ref(column, found[0])
