"""Ordered work within a source, split so that no source has to fit in one task.

A source may hold a large part of all lines. Its positions are cut into *blocks*; rows meet only within their block, and
what has to travel between blocks is one small row per block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions per block; one block of one source is the most that ever meets in one task.
BLOCK_ROWS = 1 << 20

# Positions per block where first or last rows are picked: all that is ranked beyond the pick itself.
PICK_ROWS = 1 << 13

# Marks that are looked through for a line, at most.
STATES = 64

_BLOCK = "_block"


def _with_block(lines: DataFrame, pos: str, block_rows: int) -> DataFrame:
    # Whole division: positions may need all 64 bits.
    return lines.withColumn(_BLOCK, F.expr(f"`{pos}` div {int(block_rows)}"))


def block_marks(
    lines: DataFrame,
    events: Mapping[str, Column],
    keys: Sequence[str] = ("source_id",),
    pos: str = "line_no",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per block of each key with its last non-NULL value of every event, and its first one: all that a block has
    to know of others. It is made while lines are read, without exchanging them."""
    at = {n: F.when(e.isNotNull(), F.col(pos)) for n, e in events.items()}
    last = [F.max_by(e, at[n]).alias(n) for n, e in events.items()]
    first = [F.min_by(e, at[n]).alias(f"_first_{n}") for n, e in events.items()]
    return _with_block(lines, pos, block_rows).groupBy(*keys, _BLOCK).agg(*last, *first)


def carry_last(
    lines: DataFrame,
    events: Mapping[str, Column],
    keys: Sequence[str] = ("source_id",),
    pos: str = "line_no",
    block_rows: int = BLOCK_ROWS,
    marks: DataFrame | None = None,
    first: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add, per named event column, its last non-NULL value at or before each row of the same key.

    ``marks`` is a written result of :func:`block_marks` for the same lines and blocks; without it lines are read twice.
    ``first`` names further columns that get the first value of an event within the whole key.
    """
    keys, first = list(keys), first or {}
    found = {name: f"_event_{name}" for name in events}
    before = {name: f"_before_{name}" for name in events}
    known = block_marks(lines, events, keys, pos, block_rows) if marks is None else marks
    by_key = Window.partitionBy(*keys).orderBy(_BLOCK)
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    incoming = known.select(
        *keys, _BLOCK, *[F.last(n, True).over(earlier).alias(before[n]) for n in events],
        *[F.first(f"_first_{n}", True).over(whole).alias(c) for c, n in first.items()],
    )

    blocked = _with_block(lines.withColumns({found[n]: e for n, e in events.items()}), pos, block_rows)
    so_far = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = blocked.withColumns({found[n]: F.last(found[n], True).over(so_far) for n in events})
    joined = local.join(incoming, [*keys, _BLOCK], "left")
    return joined.select(
        *[c for c in lines.columns if c not in events and c not in first],
        *[F.coalesce(found[n], before[n]).alias(n) for n in events],
        *first,
    )


def states(marks: DataFrame, names: Sequence[str], keys: Sequence[str] = ("source_id",), pos: str = "line_no") -> DataFrame:
    """``marks`` (few rows with the values they set) as intervals: per key rows of at most ``STATES`` marks with the values
    that hold from each on, and the positions between which such a row counts."""
    so_far = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    part = F.ceil(number / F.lit(STATES)).cast("int").alias("_part")
    held = marks.select(*keys, pos, part, *[F.last(n, True).over(so_far).alias(n) for n in names])
    parts = held.groupBy(*keys, "_part").agg(
        F.min(pos).alias("_from"), F.array_sort(F.collect_list(F.struct(pos, *names))).alias("_states")
    )
    return parts.withColumn("_to", F.lead("_from").over(Window.partitionBy(*keys).orderBy("_part"))).drop("_part")


def as_of(
    lines: DataFrame, held: DataFrame, names: Sequence[str], keys: Sequence[str] = ("source_id",), pos: str = "line_no"
) -> DataFrame:
    """Add the values of :func:`states` that hold at each row, NULL before the first. Made for intervals that are few
    enough to be broadcast: then lines are neither read twice nor exchanged."""
    line, part = lines.alias("line"), held.alias("part")
    same = reduce(and_, [F.col(f"line.{k}").eqNullSafe(F.col(f"part.{k}")) for k in keys])
    at = F.col(f"line.{pos}")
    inside = (at >= F.col("_from")) & (F.col("_to").isNull() | (at < F.col("_to")))
    last = F.try_element_at(F.filter("_states", lambda s: s[pos] <= at), F.lit(-1))
    return line.join(part, same & inside, "left").select("line.*", *[last[n].alias(n) for n in names])


def number_lines(
    lines: DataFrame,
    keys: Sequence[str] = ("source_id",),
    pos: str = "line_no",
    name: str = "line_no",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Dense 1-based numbers in position order."""
    keys = list(keys)
    blocked = _with_block(lines, pos, block_rows)
    counts = _rows_before(blocked, keys, descending=False).drop("_count")
    within = Window.partitionBy(*keys, _BLOCK).orderBy(pos)
    numbered = (
        blocked.withColumn("_rank", F.row_number().over(within))
        .join(counts, [*keys, _BLOCK])
        .withColumn("_number", F.col("_before") + F.col("_rank"))
        .drop("_rank", "_before", _BLOCK)
    )
    kept = [c for c in lines.columns if c != name]
    return numbered.select(*kept, F.col("_number").alias(name))


def _rows_before(blocked: DataFrame, keys: list[str], descending: bool) -> DataFrame:
    """One row per block: its size and how many rows lie in the blocks before it (after it when descending)."""
    order = F.col(_BLOCK).desc() if descending else F.col(_BLOCK).asc()
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counts = blocked.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("_count"))
    return counts.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))


def first_rows(
    lines: DataFrame,
    n: int,
    keys: Sequence[str] = ("source_id",),
    pos: str = "line_no",
    rank: str | None = None,
    block_rows: int = PICK_ROWS,
) -> DataFrame:
    """The first ``n`` rows of every key in position order; ``rank`` names a column for their 1-based rank."""
    return _pick(lines, n, list(keys), pos, rank, block_rows, descending=False)


def last_rows(
    lines: DataFrame,
    n: int,
    keys: Sequence[str] = ("source_id",),
    pos: str = "line_no",
    rank: str | None = None,
    block_rows: int = PICK_ROWS,
) -> DataFrame:
    """The last ``n`` rows of every key; ``rank`` 1 is the last one."""
    return _pick(lines, n, list(keys), pos, rank, block_rows, descending=True)


def _pick(
    lines: DataFrame, n: int, keys: list[str], pos: str, rank: str | None, block_rows: int, descending: bool
) -> DataFrame:
    # Blocks are counted first, from the positions alone; then only the blocks that reach into the pick are read and ranked.
    order = F.col(pos).desc() if descending else F.col(pos).asc()
    blocked = _with_block(lines, pos, block_rows)
    reach = _rows_before(blocked, keys, descending).where(F.col("_before") < n).drop("_count")
    in_block = F.row_number().over(Window.partitionBy(*keys, _BLOCK).orderBy(order))
    picked = (
        blocked.join(reach, [*keys, _BLOCK])
        .withColumn("_rank", in_block + F.col("_before"))
        .where(F.col("_rank") <= n)
    )
    columns = [F.col(c) for c in lines.columns]
    return picked.select(*columns, *([F.col("_rank").alias(rank)] if rank else []))
