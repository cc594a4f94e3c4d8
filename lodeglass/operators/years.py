"""Years of log lines that carry month and day only.

The last line of a log is from the time its file was last written. Going back from there, each step from January to
December is one year. Such steps are found without bringing a log's lines together: a block of lines is summed up by
the places of its months, and only blocks in which months are mixed are looked at line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeglass.functions.formats.klog import month_and_day
from lodeglass.operators.blocks import BLOCK_ROWS

#: Columns: the year of a source's last line, and the steps over a new year on the way to it.
YEAR, STEPS = "_year", "_steps"
_BLOCK = "_block"


def with_years(formats: DataFrame, lines: DataFrame, modified: str = "modified", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``formats`` with the years of its klog sources, for :func:`lodeglass.operators.entries.parse_logs`.

    ``modified`` is the column of ``lines`` that says when a source was last written, in UTC. A step is a change of month
    by more than half a year between neighbours; one back undoes one forward, so lines that arrive in the wrong order
    around a new year keep their years. A list of steps goes with each source: it has an entry per new year.
    """
    klog = formats.where("format = 'klog'").select("source_id")
    day = month_and_day(F.col("value"))
    rows = lines.join(klog, "source_id", "left_semi").select("source_id", "line_no", F.col(modified).alias("_written"), day.alias("_day"))
    block = F.expr(f"`line_no` div {int(block_rows)}")
    rows = rows.where("_day is not null").select("*", F.expr("_day div 100").alias("_month"), block.alias(_BLOCK))
    months = rows.groupBy("source_id", _BLOCK, "_month").agg(
        F.min("line_no").alias("_first"), F.max("line_no").alias("_last"),
        F.max_by("_day", "line_no").alias("_day"), F.max("_written").alias("_written"),
    )
    earlier = Window.partitionBy("source_id", _BLOCK).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_mixed", F.coalesce(F.max("_last").over(earlier) > F.col("_first"), F.lit(False)))
    mixed = months.groupBy("source_id", _BLOCK).agg(F.bool_or("_mixed").alias("_mixed"))
    clean = months.drop("_mixed").join(mixed.where("not _mixed"), ["source_id", _BLOCK])
    inside = Window.partitionBy("source_id", _BLOCK).orderBy("line_no")
    one_by_one = rows.join(mixed.where("_mixed"), ["source_id", _BLOCK]).withColumn("_before", F.lag("_month").over(inside))
    changes = clean.select("source_id", F.col("_first").alias("line_no"), "_month").unionByName(
        one_by_one.where("_before is null or _before <> _month").select("source_id", "line_no", "_month")
    )
    change = F.lag("_month").over(Window.partitionBy("source_id").orderBy("line_no")) - F.col("_month")
    step = F.when(change > 6, 1).when(change < -6, -1)
    steps = changes.select("source_id", "line_no", step.alias("by")).where("by is not null")
    listed = steps.groupBy("source_id").agg(F.collect_list(F.struct("line_no", "by")).alias(STEPS))
    ends = months.groupBy("source_id").agg(F.max_by("_day", "_last").alias("_day"), F.max("_written").alias("_written"))
    # a line may be a little later than the time of writing, by its zone; one that is much later is from the year before
    after = F.date_add("_written", 1)
    ahead = (F.col("_day") > F.month(after) * 100 + F.dayofmonth(after)) & (F.year(after) == F.year("_written"))
    year = F.year("_written") - F.when(ahead, 1).otherwise(0)
    known = ends.select("source_id", year.alias(YEAR)).join(listed, "source_id", "left")
    return formats.join(known, "source_id", "left")


def year_of() -> Column:
    """The year of a line of a source that has ``YEAR`` and ``STEPS``."""
    later = F.filter(STEPS, lambda s: s["line_no"] > F.col("line_no"))
    return F.col(YEAR) - F.coalesce(F.aggregate(later, F.lit(0), lambda a, s: a + s["by"]), F.lit(0))
