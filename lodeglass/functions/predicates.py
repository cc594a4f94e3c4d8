"""Predicates that need more than a Column operator: byte sizes, label and field selectors, age, safe arithmetic."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary size suffixes.
SIZE_UNITS = {"Ki": 1024, "Mi": 1024**2, "Gi": 1024**3, "Ti": 1024**4, "Pi": 1024**5}

# Units of a duration, in seconds.
DURATION_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def size(text: str) -> Column:
    """Literal such as ``512Mi`` as a number of bytes."""
    number, unit = re.fullmatch(r"(\d+(?:\.\d+)?)(Ki|Mi|Gi|Ti|Pi)?", text).groups()
    bytes_ = float(number) * SIZE_UNITS.get(unit, 1)
    return F.lit(int(bytes_) if bytes_.is_integer() else bytes_)


def size_of(text: Column) -> Column:
    """Text such as ``512Mi`` in a column as a number of bytes; NULL for other texts."""
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)?)(?:Ki|Mi|Gi|Ti|Pi)?$", 1)
    unit = F.regexp_extract(text, r"(Ki|Mi|Gi|Ti|Pi)$", 1)
    factors = F.create_map(F.lit(""), F.lit(1), *[F.lit(x) for kv in SIZE_UNITS.items() for x in kv])
    return number.try_cast("double") * factors[unit]


def divide(left: Column, right: Column) -> Column:
    """Quotient, NULL when dividing by zero."""
    return F.try_divide(left, right)


def modulo(left: Column, right: Column) -> Column:
    """Remainder, NULL when dividing by zero."""
    return F.try_mod(left, right)


class Need(NamedTuple):
    """One condition of a label selector: ``op`` is one of ``=  !=  in  notin  exists  !exists``."""

    key: str
    op: str
    values: tuple[str, ...] = ()


def need(key: str, op: str = "exists", values: str | Iterable[str] = ()) -> Need:
    return Need(key, op, (values,) if isinstance(values, str) else tuple(values))


def matches_labels(labels: Column, needs: Sequence[Need]) -> Column:
    """All conditions hold on a label map; an absent key satisfies the negative ones."""
    return reduce(and_, [_meets(labels, n) for n in needs], F.lit(True))


def _meets(labels: Column, wanted: Need) -> Column:
    value = F.coalesce(labels, F.create_map().cast("map<string,string>"))[wanted.key]
    if wanted.op in ("=", "in"):
        return F.coalesce(value.isin(*wanted.values), F.lit(False))
    if wanted.op in ("!=", "notin"):
        return F.coalesce(~value.isin(*wanted.values), F.lit(True))
    if wanted.op == "exists":
        return value.isNotNull()
    if wanted.op == "!exists":
        return value.isNull()
    raise ValueError(f"unknown label condition {wanted.op!r}")


def matches_fields(**fields: tuple[Column, str | None]) -> Column:
    """Equality on every field whose wanted value is given."""
    return reduce(and_, [c == v for c, v in fields.values() if v], F.lit(True))


def duration_seconds(text: str) -> int:
    """Whole seconds of a duration such as ``1h30m``."""
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(h|ms|us|µs|ns|m|s)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"invalid duration {text!r}")
    return int(sum(float(n) * DURATION_UNITS[u] for n, u in parts))


def since(event_time: Column, duration: str, as_of: Column | dt.datetime) -> Column:
    """Not older than ``duration`` at the time ``as_of``."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return event_time >= now - F.make_dt_interval(secs=F.lit(duration_seconds(duration)))
