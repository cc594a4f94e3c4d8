"""Stage and progress of VM conversions, carried from the lines that set them to the lines after them.

Lines that set something are found first and written: they are few in most logs. Each line then takes what holds at its
place from a broadcast table of intervals, and lines are read once and never exchanged. Where there are too many such
lines, lines are carried in blocks instead.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.formats import conversion
from lodeglass.operators.blocks import BLOCK_ROWS, as_of, block_marks, carry_last, states
from lodeglass.sources.lines import bytes_of
from lodeglass.sources.staging import release, stage

STAGE, PROGRESS = "stage", "progress_pct"
_STARTED, _SEEN = "_started", "_seen"
# Marks of one source that are still looked up by interval, and bytes of a mark in memory.
MOST_MARKS, MARK_BYTES = 1 << 12, 64


class Marks(NamedTuple):
    """What :func:`find_marks` wrote: intervals, or the last marks of every block where there are too many of them."""

    intervals: DataFrame | None
    blocks: DataFrame | None

    def release(self) -> None:
        for table in self:
            if table is not None:
                release(table)


def _seen(started: Column, progress: Column) -> dict[str, Column]:
    # The first stage of a run clears the progress: an empty value, so that both are simply the last value seen.
    return {STAGE: started, PROGRESS: F.coalesce(progress, F.when(started == conversion.RESTART_STAGE, ""))}


def _started(line: Column) -> Column:
    """The stage that a conversion line starts, else NULL."""
    # The tool's messages hold a keyword if their lines do; only those few lines are classed.
    keyword = conversion.stage_of(line)
    return F.when(keyword.isNotNull() & conversion.tokens(line).isin(*conversion.TOOL_CLASSES), keyword)


def line_marks(line: Column) -> dict[str, Column]:
    """Stage and progress that a conversion line sets, NULL where it sets none."""
    return _seen(_started(line), conversion.progress(line))


def _of_lines(lines: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Conversion lines with what they set, found once per line, and the events from it."""
    line = F.col("value")
    set_here = F.struct(_started(line).alias(_STARTED), conversion.progress(line).alias(_SEEN))
    found = lines.select("*", F.inline(F.array(set_here)))
    return found, _seen(F.col(_STARTED), F.col(_SEEN))


def _shown(carried: DataFrame) -> DataFrame:
    first = F.coalesce(STAGE, F.lit(conversion.FIRST_STAGE))
    return carried.withColumns({STAGE: first, PROGRESS: F.nullif(PROGRESS, F.lit(""))})


def carry_marks(rows: DataFrame, message: Column, by_tool: Column, progress: Column, **options) -> DataFrame:
    """Add ``stage`` and ``progress_pct`` columns to rows in ``(source_id, line_no)`` order.

    ``message`` of rows where ``by_tool`` holds may start a stage.
    """
    return _shown(carry_last(rows, _seen(F.when(by_tool, conversion.stage_of(message)), progress), **options))


def find_marks(lines: DataFrame, block_rows: int = BLOCK_ROWS, most: int = MOST_MARKS) -> Marks:
    """The lines of conversion logs that start a stage or report progress, written for :func:`carry_stage`."""
    found, events = _of_lines(lines)
    marks = stage(
        found.select("source_id", "line_no", *[e.alias(n) for n, e in events.items()]).where(
            F.col(STAGE).isNotNull() | F.col(PROGRESS).isNotNull()
        )
    )
    size = marks.groupBy("source_id").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    room = bytes_of(lines.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    if (size["most"] or 0) <= most and (size["all"] or 0) * MARK_BYTES <= room:
        written = Marks(stage(states(marks, [*events])), None)
    else:
        places = lines.select("source_id", "line_no", *[F.lit(None).cast("string").alias(n) for n in events])
        named = {n: F.col(n) for n in events}
        written = Marks(None, stage(block_marks(marks.unionByName(places), named, block_rows=block_rows)))
    release(marks)
    return written


def carry_stage(lines: DataFrame, block_rows: int = BLOCK_ROWS, marks: Marks | None = None) -> DataFrame:
    """Add ``stage`` and ``progress_pct`` to conversion-log lines, before parsing so that only raw lines are shuffled, if any.

    With ``marks`` of the same lines and blocks they are read once, else twice.
    """
    if marks and marks.intervals:
        return _shown(as_of(lines, marks.intervals, [STAGE, PROGRESS]))
    found, events = _of_lines(lines)
    carried = carry_last(found, events, block_rows=block_rows, marks=marks.blocks if marks else None)
    return _shown(carried).drop(_STARTED, _SEEN)


def add_carried(entries: DataFrame, where: Column | None = None) -> DataFrame:
    """Move the carried columns into ``fields`` of all entries, or of those ``where`` a condition holds."""
    own = F.map_filter(
        F.coalesce("fields", F.create_map().cast("map<string,string>")),
        lambda k, _: ~k.isin(STAGE, PROGRESS),
    )
    carried = F.map_filter(
        F.create_map(F.lit(STAGE), F.col(STAGE), F.lit(PROGRESS), F.col(PROGRESS)),
        lambda _, v: v.isNotNull(),
    )
    fields = F.map_concat(own, carried)
    fields = fields if where is None else F.when(where, fields).otherwise(F.col("fields"))
    return entries.withColumn("fields", fields).drop(STAGE, PROGRESS)
