"""One query: filter, sort, limit, project - in that order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from lodeglass.functions.ordering import sort_keys
from lodeglass.functions.paths import Ref, resolve
from lodeglass.functions.reducers import length, reduce_value


class Item(NamedTuple):
    """A selected path, its alias (the path itself by default) and its reducer."""

    path: str
    alias: str | None = None
    reducer: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.path


class Names:
    """Columns by alias or path; an alias stands for its path with the reducer applied."""

    def __init__(self, df: DataFrame, items: Sequence[Item] = ()):
        self._df = df
        self._items = {}
        for item in items:
            self._items.setdefault(item.name, item)

    def ref(self, name: str) -> Ref:
        item = self._items.get(name, Item(name))
        found = resolve(self._df, item.path)
        return reduce_value(found, item.reducer) if item.reducer else found

    def __call__(self, name: str) -> Column:
        return self.ref(name).column

    def length(self, name: str) -> Column:
        return length(self.ref(name))

    def reduced(self, name: str, reducer: str) -> Column:
        return reduce_value(self.ref(name), reducer).column


Condition = Column | Callable[[Names], Column]


def run(
    df: DataFrame,
    select: Sequence[Item | str] = (),
    where: Condition | None = None,
    order_by: Sequence[str | tuple[str, bool]] = (),
    limit: int | None = None,
    tie: Sequence[str] = (),
    row_limit: int = 0,
) -> DataFrame:
    """Run one query.

    ``where`` is a Column or a function of :class:`Names`; ``order_by`` lists aliases or paths, each optionally with
    ``True`` for descending; ``tie`` names columns that make the order total; ``limit`` 0 gives no rows; ``row_limit``
    0 means no limit and applies after ``limit``.
    """
    items = [Item(s) if isinstance(s, str) else s for s in select]
    names = Names(df, items)
    out = df
    if where is not None:
        out = out.where(where(names) if callable(where) else where)
    if order_by:
        keys = []
        for entry in order_by:
            name, descending = (entry, False) if isinstance(entry, str) else entry
            keys += sort_keys(names.ref(name), descending)
        out = out.orderBy(*keys, *tie)
    if limit is not None:
        out = out.limit(limit)
    if row_limit > 0:
        out = out.limit(row_limit)
    if items:
        out = out.select(*[names(item.name).alias(item.name) for item in items])
    return out
