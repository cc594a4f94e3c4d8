"""What the operators of this subpackage share: text expressions, written tables and the shape of a query."""

from __future__ import annotations

import string
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.sources import staging

#: White space between words: space, and tab to carriage return.
BREAKS = " \t\n\x0b\x0c\r"


class Query(NamedTuple):
    """A registered query and the SQL that answers it independently, if there is one."""

    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is; ``lower`` alone would also fold É."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """The words of ``text`` between white space; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` computed once.

    Spark merges a projection into the one above it; inside a lambda such an expression would be computed again for
    each element. It does not merge across a generator.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def others(df: DataFrame, *names: str) -> Column:
    """All columns of ``df`` but ``names`` in one struct, ``row``, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in names]).alias("row")


def carried(df: DataFrame, *names: str) -> tuple[list[Column], list[Column]]:
    """All columns of ``df`` but ``names`` as ``in0``, ``in1``, .., and those under their own names again.

    For plans with generators, where Spark cannot prune the fields of a struct.
    """
    kept = [c for c in df.columns if c not in names]
    return (
        [F.col(f"`{c}`").alias(f"in{k}") for k, c in enumerate(kept)],
        [F.col(f"in{k}").alias(c) for k, c in enumerate(kept)],
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder for what is written for other tasks; ``release_all`` of :mod:`lodeglass.sources.staging` deletes them all."""
    return staging.new_folder(spark)


def stage(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder: computed once, and safe from lost executors."""
    return staging.stage(df)
