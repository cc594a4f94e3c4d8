"""Which format a source's log is in, by a vote of its first lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass.functions.formats import PLAIN, TIE_ORDER, line_class
from lodeglass.functions.text import is_blank
from lodeglass.operators.blocks import PICK_ROWS
from lodeglass.sources.edges import first_lines

# Lines that vote, lines among which all of them are looked for, and the share of votes a format needs.
VOTERS = 10
LOOKED_AT = 2 * VOTERS - 1
THRESHOLD = 0.40


def sample_lines(lines: DataFrame, block_rows: int = PICK_ROWS) -> DataFrame:
    """The voters of every source: its first ten lines that are not blank, as far as they are among its first nineteen
    lines, and the first one after those. A source of blank lines has one row, without a line."""
    block = F.expr(f"`line_no` div {int(block_rows)}")
    rows = lines.select("source_id", "line_no", "value", block.alias("_block"), (~is_blank(F.col("value"))).alias("_said"))
    sizes = rows.groupBy("source_id", "_block").agg(F.count(F.lit(1)).alias("_all"), F.count_if("_said").alias("_voters"))
    earlier = Window.partitionBy("source_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "source_id",
        "_block",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in ("_all", "_voters")],
        F.sum("_voters").over(Window.partitionBy("source_id")).alias("_total"),
        F.row_number().over(Window.partitionBy("source_id").orderBy("_block")).alias("_nth"),
    )
    # Blocks that hold one of the first voters are read; of a silent source its first one, for its row.
    reach = sizes.where((F.col("_voters_before") < VOTERS) & ((F.col("_total") > 0) | (F.col("_nth") == 1)))
    within = Window.partitionBy("source_id", "_block").orderBy("line_no")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.join(reach, ["source_id", "_block"]).select(
        "source_id",
        "line_no",
        "value",
        "_said",
        "_total",
        (F.row_number().over(within) + F.col("_all_before")).alias("_rank"),
        (F.count_if("_said").over(so_far) + F.col("_voters_before")).alias("_voter"),
    )
    silent = (F.col("_total") == 0) & (F.col("_rank") == 1)
    heard = ranked.where(silent | (F.col("_said") & (F.col("_voter") <= VOTERS)))
    before = F.lag("_rank", 1, 0).over(Window.partitionBy("source_id").orderBy("line_no"))
    voters = heard.withColumn("_earlier", before).where(F.col("_earlier") <= LOOKED_AT)
    return voters.select("source_id", "line_no", F.when(F.col("_said"), F.col("value")).alias("value"))


def detect_files(spark: SparkSession, path: str, source: Column | None = None) -> DataFrame:
    """:func:`detect_format` of text files, of which only the lines are read that it looks at."""
    return detect_format(first_lines(spark, path, LOOKED_AT, source))


def detect_format(lines: DataFrame, block_rows: int = PICK_ROWS) -> DataFrame:
    """One row per source: ``source_id, format, confidence``; a source without voters is plain."""
    said = F.col("value").isNotNull()
    votes = sample_lines(lines, block_rows).select("source_id", said.alias("said"), line_class(F.col("value")).alias("cls"))
    counted = votes.groupBy("source_id").agg(
        F.count_if("said").alias("voters"),
        *[F.count_if(F.col("cls") == name).alias(name) for name in TIE_ORDER],
    )
    best = F.greatest(*TIE_ORDER)
    winner = F.coalesce(*[F.when(F.col(name) == best, name) for name in TIE_ORDER])
    share = F.when(F.col("voters") > 0, best / F.col("voters")).otherwise(0.0)
    return counted.select(
        "source_id",
        F.when(share >= THRESHOLD, winner).otherwise(PLAIN).alias("format"),
        share.alias("confidence"),
    )
