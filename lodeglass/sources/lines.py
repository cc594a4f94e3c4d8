"""Log text as lines in order: ``source_id, line_no, value``.

``line_no`` of text files orders the lines of a file but is not dense; :func:`lodeglass.operators.blocks.number_lines`
makes it so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Splits start on different units, and a task reads fewer rows than fit below the unit.
_UNIT_BITS, _ROW_BITS = 20, 33


def read_lines(spark: SparkSession, path: str, source: Column | None = None, modified: bool = False) -> DataFrame:
    """Lines of all files under ``path``. A source is a file unless ``source`` computes it from ``_metadata.file_path``.

    Only ``\\n`` ends a line; a ``\\r`` stays. Empty lines are kept, as detection counts them. ``modified`` adds a column of
    that name, when the file was last written.
    """
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        if bytes_of(spark.conf.get(name)) < 1 << _UNIT_BITS:
            raise ValueError(f"{name} has to be at least 1 MiB for lines to keep their order")
    text = spark.read.option("lineSep", "\n").text(path)
    source = F.col("_metadata.file_path") if source is None else source
    return _ordered(text, source, modified)


def container_logs(
    spark: SparkSession,
    root: str,
    namespace: str = "*",
    pod: str = "*",
    container: str = "*",
    previous: bool = False,
    modified: bool = False,
) -> DataFrame:
    """Lines of containers' current or previous instances, kept as ``root/namespace/pod/container/current.log``.

    A source is ``namespace/pod/container``, and an instance is one file. Given names read only their folders.
    """
    instance = "previous" if previous else "current"
    folders = F.split(F.col("_metadata.file_path"), "/")
    source = F.array_join(F.slice(folders, -4, 3), "/")
    return read_lines(spark, f"{root}/{namespace}/{pod}/{container}/{instance}.log", source, modified)


def _ordered(text: DataFrame, source: Column, modified: bool) -> DataFrame:
    unit = F.shiftright(F.col("_metadata.file_block_start"), _UNIT_BITS)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return text.select(
        source.alias("source_id"),
        F.shiftleft(unit, _ROW_BITS).bitwiseOR(row).alias("line_no"),
        "value",
        *([F.col("_metadata.file_modification_time").alias("modified")] if modified else []),
    )


def bytes_of(setting: str) -> int:
    """A size as settings write it, such as ``10MB``."""
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    text = setting.lower().removesuffix("b")
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def split_text(df: DataFrame, source: str, text: str) -> DataFrame:
    """Lines of texts held in a column, one source per row, numbered from 1; newlines at the end of a text do not count."""
    trimmed = F.rtrim(F.col(text), F.lit("\n"))
    return df.select(
        F.col(source).alias("source_id"), F.posexplode(F.split(trimmed, "\n")).alias("line_no", "value")
    ).withColumn("line_no", (F.col("line_no") + 1).cast("long"))
