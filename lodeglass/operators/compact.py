"""Entries as short text lines, and one summary line per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.formats import PLAIN

NO_MATCH = "(no matching log entries)"


def compact_line() -> Column:
    """``[LEVEL] HH:MM:SS source: message key=value``; plain sources keep their lines."""
    level = F.when(F.col("level") == "", "INFO").otherwise(F.col("level"))
    origin = F.when(F.col("logger") != "", F.col("logger")).otherwise(F.col("source"))
    # "plan|v6z6r" is shown as "plan".
    origin = F.when(F.locate("|", origin) > 1, F.substring_index(origin, "|", 1)).otherwise(origin)
    shown = F.map_filter("fields", lambda _, v: v != "")

    def pair(key: Column) -> Column:
        value = F.col("fields")[key]
        quoted = F.when(value.contains(" "), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
        return F.concat(F.lit(" "), key, F.lit("="), quoted)

    extra = F.array_join(F.transform(F.array_sort(F.map_keys(shown)), pair), "")
    parsed = F.concat(
        F.lit("["),
        F.when(F.length(level) < 5, F.rpad(level, 5, " ")).otherwise(level),
        F.lit("] "),
        F.when(F.col("timestamp") != "", F.concat("timestamp", F.lit(" "))).otherwise(""),
        F.when(origin != "", F.concat(origin, F.lit(": "))).otherwise(""),
        F.col("message"),
        F.coalesce(extra, F.lit("")),
    )
    return (
        F.when(F.col("format") == PLAIN, F.col("raw_line"))
        .when(F.col("parsed"), parsed)
        .otherwise(F.concat(F.lit("[     ] "), "raw_line"))
    )


def log_header(kept: DataFrame, formats: DataFrame) -> DataFrame:
    """``source_id, format, lines, header`` for every source in ``formats``: how many of its entries were kept.

    Plain sources are shown as they are and have no header.
    """
    counts = kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("lines"))
    lines = F.coalesce("lines", F.lit(0))
    header = F.when(lines == 0, NO_MATCH).otherwise(
        F.concat(F.lit("# format: "), "format", F.lit(", lines: "), lines.cast("string"))
    )
    return formats.join(counts, "source_id", "left").select(
        "source_id", "format", lines.alias("lines"), F.when(F.col("format") != PLAIN, header).alias("header")
    )


def selection_note(chosen: Column, names: Column) -> Column:
    """Note that a container was chosen among several; NULL when there was no choice."""
    return F.when(
        F.size(names) > 1,
        F.concat(
            F.lit("# auto-selected container: "), chosen, F.lit(" (pod has "), F.size(names).cast("string"),
            F.lit(" containers: "), F.array_join(names, ", "), F.lit(")"),
        ),
    )
