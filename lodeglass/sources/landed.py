"""Lines written as Parquet with small tables that say what each part holds, so that searches read few parts.

Lines are sorted by source and number and cut into parts of about equal size, one folder each. Beside them stand, per part,
a bit map of the words that occur and, per source in it, the times its lines begin and end with. A search reads these
first and joins the lines with the parts that are left; Spark prunes the folders by that join when it runs
(dynamic partition pruning), so nothing about parts passes through the driver.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeglass.functions.predicates import since
from lodeglass.operators.entries import event_time

#: Lines of a part.
PART_ROWS = 1 << 20
#: Bit maps per part, each of the size that Spark's bit map functions have.
MAPS, MAP_BITS = 8, 1 << 15
_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words of a text: letters and digits, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), _WORD)), lambda w: w != "")


def _place(word: Column) -> tuple[Column, Column]:
    """The map that a word is in, and its bit there."""
    place = F.pmod(F.xxhash64(word), F.lit(MAPS * MAP_BITS))
    return F.floor(place / F.lit(MAP_BITS)).cast("int"), F.pmod(place, F.lit(MAP_BITS))


def land(lines: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """Write ``lines`` (``source_id, line_no, value``) and what is known of their parts to ``path``.

    Their own times are written with them. No part holds more than about ``part_rows`` lines, whatever their sources.
    """
    spark = lines.sparkSession
    parts = max(1, -(-lines.count() // part_rows))
    timed = lines.select("source_id", F.col("line_no").cast("long").alias("line_no"), "value", event_time(F.col("value")).alias("event_ts"))
    ranged = timed.repartitionByRange(parts, "source_id", "line_no").withColumn("part", F.spark_partition_id())
    ranged.sortWithinPartitions("source_id", "line_no").write.partitionBy("part").parquet(f"{path}/lines")

    written = _written(spark, path, timed.schema["source_id"].dataType.simpleString())
    found = written.select("part", F.explode(words(F.col("value"))).alias("word")).select(
        "part", _place(F.col("word"))[0].alias("map"), _place(F.col("word"))[1].alias("bit")
    )
    found.groupBy("part", "map").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(f"{path}/words")
    at = F.when(F.col("event_ts").isNotNull(), F.col("line_no"))
    written.groupBy("part", "source_id").agg(
        F.min_by("event_ts", at).alias("first"), F.max_by("event_ts", at).alias("last"), F.max("event_ts").alias("latest")
    ).write.parquet(f"{path}/times")


def _written(spark: SparkSession, path: str, source: str) -> DataFrame:
    schema = f"source_id {source}, line_no long, value string, event_ts timestamp, part int"
    return spark.read.schema(schema).parquet(f"{path}/lines")


def _lines_of(spark: SparkSession, path: str, chosen: DataFrame, on: list[str]) -> DataFrame:
    source = spark.read.parquet(f"{path}/times").schema["source_id"].dataType.simpleString()
    return _written(spark, path, source).join(chosen, on)


def search(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """``source_id, line_no, value`` of the landed lines that hold all ``wanted`` words, in any case and order.

    Only parts are read whose bit maps have all words.
    """
    wanted = sorted({w.lower() for w in wanted})
    if not wanted:
        raise ValueError("a search needs words")
    known = spark.read.parquet(f"{path}/words")
    needed = [F.struct(*[c.alias(n) for c, n in zip(_place(F.lit(w)), ("map", "bit"), strict=True)]) for w in wanted]
    asked = F.filter(F.array(*needed), lambda n: n["map"] == F.col("map"))
    byte = lambda bit: F.conv(F.hex(F.substring("bits", F.floor(bit / F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = lambda n: F.getbit(byte(n["bit"]), F.pmod(n["bit"], F.lit(8)).cast("int")) == 1
    hits = known.where(F.size(asked) > 0).groupBy("part").agg(F.sum(F.size(F.filter(asked, has))).alias("hits"))
    chosen = hits.where(F.col("hits") == len(wanted)).select("part")
    own = words(F.col("value"))
    found = _lines_of(spark, path, chosen, ["part"])
    return found.where(F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(own, w))).select("source_id", "line_no", "value")


def recent(spark: SparkSession, path: str, duration: str, as_of: Column | dt.datetime) -> DataFrame:
    """``source_id, line_no, value`` of the landed lines not older than ``duration`` at ``as_of``: those that
    :func:`lodeglass.operators.logs.recent` keeps.

    Only parts are read that can hold such lines, by the times of their sources and what earlier parts left.
    """
    of_source = Window.partitionBy("source_id").orderBy("part")
    before = of_source.rowsBetween(Window.unboundedPreceding, -1)
    whole = of_source.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    times = spark.read.parquet(f"{path}/times").select(
        "part", "source_id", "latest",
        F.coalesce(F.last("last", True).over(before), F.first("first", True).over(whole)).alias("_incoming"),
    )
    young = lambda t: since(t, duration, as_of)
    may = F.col("_incoming").isNull() | young(F.greatest("latest", "_incoming"))
    chosen = times.where(may).select("part", "source_id", "_incoming")
    so_far = Window.partitionBy("part", "source_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    timed = _lines_of(spark, path, chosen, ["part", "source_id"]).withColumn(
        "_time", F.coalesce(F.last("event_ts", True).over(so_far), F.col("_incoming"))
    )
    return timed.where(F.col("_time").isNull() | young(F.col("_time"))).select("source_id", "line_no", "value")
