"""Web server access-log lines (common and combined layout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions import text
from lodeglass.functions.formats.common import capture, entry, group
from lodeglass.functions.text import NON_WS, WS

# The line pattern and the two stamp layouts.
_START = (
    rf'({NON_WS}+){WS}+{NON_WS}+{WS}+({NON_WS}+){WS}+\[([^\]]+)\]{WS}+"([^"]+)"{WS}+(\d+){WS}+({NON_WS}+)'
)
LINE = rf"(?s)^{_START}.*$"
LOOKS = rf"^{_START}"
_CLOCK = r"([01]?\d|2[0-3])(:[0-5]\d:[0-5]\d)(?:[.,]\d+)?"
STAMP = (
    r"(?i)^(\d{2}/(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)/\d{4})"
    rf"(?: {_CLOCK}|:{_CLOCK} [+-](?:[01]\d|2[0-4])[0-5]\d)$"
)


def looks_like(line: Column) -> Column:
    return line.contains("[") & text.trim_space(line).rlike(LOOKS)


def tokens(line: Column) -> Column:
    return F.when(line.contains("["), capture(line, LINE, 6))


def clock(stamp: Column) -> Column:
    """Local time of day of the stamp; in other stamps the first eight characters with ``:`` third and sixth."""

    def read(parts: Column) -> Column:
        date = group(parts, 1)
        day = F.left(date, F.lit(2))
        # Only the days after the 28th depend on month and year.
        valid = day.between("01", "28") | F.try_to_date(F.initcap(date), "dd/MMM/yyyy").isNotNull()
        hour = F.concat(group(parts, 2), group(parts, 4))
        rest = F.concat(group(parts, 3), group(parts, 5))
        return F.when(valid, F.concat(F.lpad(hour, 2, "0"), rest)).otherwise(
            F.regexp_extract(stamp, r"(?s)..:..:..", 0)
        )

    return text.let(capture(stamp, STAMP, 5), read)


def event_time(_line: Column, token: Column, _year: Column) -> Column:
    return text.instant(group(token, 3))


def entry_columns(_line: Column, token: Column) -> dict[str, Column]:
    status = group(token, 5)
    user = group(token, 2)
    level = (
        F.when(status.startswith("5"), "ERROR").when(status.startswith("4"), "WARN").otherwise("INFO")
    )
    always = F.create_map(
        F.lit("client"), group(token, 1), F.lit("status"), status, F.lit("size"), group(token, 6)
    )
    fields = F.when(user == "-", always).otherwise(F.map_concat(always, F.create_map(F.lit("user"), user)))
    return entry(
        token.isNotNull(),
        fields=fields,
        timestamp=clock(group(token, 3)),
        level=level,
        message=group(token, 4),
    )
