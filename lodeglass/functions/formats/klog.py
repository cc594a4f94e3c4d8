"""klog lines: ``I0303 11:14:07.353271       1 metrics.go:637] text``, plain or as ``"key"="value"`` pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions import text
from lodeglass.functions.formats.common import capture, entry, group
from lodeglass.functions.text import NON_WS, WS

# The line pattern, the pair pattern and the level letters.
LINE = rf"(?d)^([IWEF])(\d{{4}}){WS}+(\d{{2}}:\d{{2}}:\d{{2}})(\.\d+){WS}+\d+{WS}+({NON_WS}+:\d+)\]{WS}+(.*)$"
PAIR = r'"[^"]+"="[^"]*"'
LETTERS = {"I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}


def looks_like(line: Column) -> Column:
    return line.rlike(r"^[IWEF][0-9]{4}")


def tokens(line: Column) -> Column:
    def with_pairs(head: Column) -> Column:
        message = group(head, 6)
        found = F.regexp_extract_all(message, F.lit(PAIR), F.lit(0))

        def pair(item: Column) -> Column:
            inner = item.substr(F.lit(2), F.length(item) - 2)
            return F.struct(
                F.substring_index(inner, '"="', 1).alias("key"),
                F.substring_index(inner, '"="', -1).alias("value"),
            )

        pairs = F.when(message.startswith('"'), F.transform(found, pair))
        return F.when(head.isNotNull(), F.struct(head.alias("head"), pairs.alias("pairs")))

    return F.when(looks_like(line), text.let(capture(line, LINE, 6), with_pairs))


def month_and_day(line: Column) -> Column:
    """Month and day as one number of a line that begins like klog's, else NULL."""
    return F.nullif(F.regexp_extract(line, rf"^[IWEF]((?:0[1-9]|1[0-2])[0-3]\d){WS}", 1), F.lit("")).cast("int")


def event_time(_line: Column, token: Column, year: Column) -> Column:
    head = token["head"]
    month, day = F.left(group(head, 2), F.lit(2)), F.right(group(head, 2), F.lit(2))
    date = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month, day)
    return text.instant(F.when(year.isNotNull(), F.concat(date, F.lit("T"), group(head, 3), group(head, 4))))


def entry_columns(_line: Column, token: Column) -> dict[str, Column]:
    head, pairs = token["head"], token["pairs"]
    letters = F.create_map(*[F.lit(part) for pair in LETTERS.items() for part in pair])
    structured = pairs.isNotNull()
    whole = group(head, 6)
    extra = F.filter(pairs, lambda p: ~p["key"].isin("msg", "logger"))
    return entry(
        token.isNotNull(),
        fields=text.last_wins_map(extra),
        timestamp=group(head, 3),
        level=letters[group(head, 1)],
        message=F.when(
            structured, F.coalesce(F.nullif(text.last_value(pairs, "msg"), F.lit("")), whole)
        ).otherwise(whole),
        source=group(head, 5),
        logger=F.when(structured, text.last_value(pairs, "logger")).otherwise(""),
    )
