"""From lines to entries.

Lines are ``source_id, line_no, value`` (other columns pass through); entries add
``timestamp, level, message, source, logger, fields, raw_line, event_ts, format, parsed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeglass.functions.formats import ENTRY_COLUMNS, FORMATS, PLAIN, line_class, plain_entry
from lodeglass.functions.formats.conversion import FORMAT as CONVERSION
from lodeglass.functions.text import leading_time, let
from lodeglass.operators.blocks import BLOCK_ROWS
from lodeglass.operators.carry import add_carried, carry_stage, find_marks
from lodeglass.operators.detect import detect_format
from lodeglass.operators.years import STEPS, YEAR, year_of


def without_empty(lines: DataFrame) -> DataFrame:
    """Drop empty lines; lines of blanks stay."""
    return lines.where(F.col("value") != "")


def parse_as(lines: DataFrame, name: str) -> DataFrame:
    """Entries of lines that are all in one format."""
    return _shape(lines.withColumn("format", F.lit(name)), [name], one=True)


def parse_by_format(lines: DataFrame) -> DataFrame:
    """Entries of lines that carry their format in a ``format`` column."""
    return _shape(lines, list(FORMATS))


def _shape(lines: DataFrame, names: list[str], one: bool = False) -> DataFrame:
    line, fmt = F.col("value"), F.col("format")
    token = {name: f"_token_{name}" for name in names if name != PLAIN}

    def only_for(name: str, column: Column) -> Column:
        return column if one else F.when(fmt == name, column)

    # One match or parse per line. The generator passes the tokens on as they are, but filters on entry columns are not
    # pushed below it, where each use of a token would match the line anew; filters on the raw line are.
    tokenised = lines.withColumns({token[name]: only_for(name, FORMATS[name].tokens(line)) for name in token})
    if token:
        tokenised = tokenised.select(*lines.columns, F.inline(F.array(F.struct(*token.values()))))
    shaped = {name: FORMATS[name].entry_columns(line, F.col(token[name])) for name in token}
    columns = {}
    for column in ENTRY_COLUMNS:
        if one:
            columns[column] = shaped.get(names[0], plain_entry())[column]
            continue
        chain = F.when(F.lit(False), plain_entry()[column])
        for name in token:
            chain = chain.when(fmt == name, shaped[name][column])
        columns[column] = chain.otherwise(plain_entry()[column])
    year = year_of() if YEAR in lines.columns else F.lit(None).cast("int")
    times = {name: FORMATS[name].event_time(line, F.col(token[name]), year) for name in token}
    own_time = F.lit(None).cast("timestamp")
    for name, time in times.items():
        own_time = time if one else F.when(fmt == name, time).otherwise(own_time)
    kept = [F.col(c) for c in lines.columns if c not in ("value", "format", YEAR, STEPS)]
    return tokenised.select(
        *kept,
        *[columns[c].alias(c) for c in ENTRY_COLUMNS if c != "parsed"],
        line.alias("raw_line"),
        F.coalesce(own_time, leading_time(line)).alias("event_ts"),
        "format",
        columns["parsed"].alias("parsed"),
    )


def with_format(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Give each line its source's format, and what ``formats`` knows of its years; sources without a detected format are plain.

    Only sources that need a parser are joined. How the join runs is left to their number at run time.
    """
    needed = formats.where(F.col("format") != PLAIN)
    needed = needed.select("source_id", "format", *[c for c in (YEAR, STEPS) if c in formats.columns])
    return lines.join(needed, "source_id", "left").withColumn(
        "format", F.coalesce("format", F.lit(PLAIN))
    )


def parse_logs(lines: DataFrame, formats: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Detect the format of every source, parse its lines, and carry stage and progress through conversion logs.

    ``formats`` is a written result of :func:`detect_format` when there is one (``sources.staging.stage`` writes it).
    Then its size is known, so joining it to the lines broadcasts it only while it is small, and only the parsers and the
    carrying that some source needs become part of the plan; the marks of conversion logs are found and written, and unless
    there are very many of them lines are read once more, by one scan for all formats, and not exchanged. Without
    ``formats`` nothing runs here: the plan detects formats itself and has all parsers.

    klog lines have no year. They get an ``event_ts`` if ``formats`` comes from :func:`lodeglass.operators.years.with_years`.
    """
    written = formats is not None
    if not written:
        formats, present = detect_format(lines), {*FORMATS}
    else:
        present = {row["format"] for row in formats.select("format").distinct().collect()}
    typed = with_format(without_empty(lines), formats)
    if CONVERSION not in present:
        return _shape(typed, [n for n in FORMATS if n in present])
    is_conversion = F.col("format") == CONVERSION
    conversions = typed.where(is_conversion).drop(YEAR, STEPS)
    marks = find_marks(conversions, block_rows) if written else None
    if marks and marks.intervals:
        return add_carried(_shape(carry_stage(typed, marks=marks), [n for n in FORMATS if n in present]), is_conversion)
    direct = _shape(typed.where(~is_conversion), [n for n in FORMATS if n in present and n != CONVERSION])
    return direct.unionByName(add_carried(parse_as(carry_stage(conversions, block_rows, marks), CONVERSION)))


def event_time(line: Column) -> Column:
    """The time that a raw line says, by the format that the line itself looks like; NULL when it has no date and year."""
    no_year = F.lit(None).cast("int")

    def time_in(name: str) -> Column:
        if hasattr(FORMATS[name], "line_time"):
            return FORMATS[name].line_time(line)
        return let(FORMATS[name].tokens(line), lambda token: FORMATS[name].event_time(line, token, no_year))

    def own(cls: Column) -> Column:
        chain = F.lit(None).cast("timestamp")
        for name in FORMATS:
            chain = F.when(cls == name, time_in(name)).otherwise(chain)
        return chain

    return F.coalesce(let(line_class(line), own), leading_time(line))
