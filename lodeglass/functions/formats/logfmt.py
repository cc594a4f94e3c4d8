"""``key=value key="quoted value"`` lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions import text
from lodeglass.functions.formats.common import entry

# A pair starts after a blank or where the last pair ended; quotes have no escapes and may stay open.
PAIR = r'(?:\G|(?<= ))[^ =]*+=(?:"[^"]*"?|[^ ]*)'
# Two spellings of one entry column each; of both in a line the later one counts.
SPELLINGS = {"ts": "time", "caller": "source"}
KNOWN = ("time", "level", "source", "msg", "logger")


def _pairs(line: Column) -> Column:
    """``key=value`` texts with a key."""
    found = F.regexp_extract_all(text.trim_space(line), F.lit(PAIR), F.lit(0))
    return F.filter(found, lambda pair: ~pair.startswith("="))


def looks_like(line: Column) -> Column:
    return line.contains("=") & (F.size(_pairs(line)) >= 3)


def tokens(line: Column) -> Column:
    """Values by key; NULL with fewer than two pairs."""

    def entry_of(pair: Column) -> Column:
        key = F.substring_index(pair, "=", 1)
        value = pair.substr(F.length(key) + 2, F.length(pair))
        spelled = F.when(key == "ts", SPELLINGS["ts"]).when(key == "caller", SPELLINGS["caller"]).otherwise(key)
        return F.struct(
            spelled.alias("key"),
            F.when(pair.contains('="') & value.startswith('"'), F.replace(value, F.lit('"'), F.lit("")))
            .otherwise(value)
            .alias("value"),
        )

    return text.let(
        _pairs(line),
        lambda pairs: F.when(
            F.size(pairs) >= 2, text.let(F.transform(pairs, entry_of), text.last_wins_map)
        ),
    )


def event_time(_line: Column, token: Column, _year: Column) -> Column:
    return text.instant(token["time"])


def entry_columns(_line: Column, token: Column) -> dict[str, Column]:
    def value(key: str) -> Column:
        return F.coalesce(token[key], F.lit(""))

    return entry(
        token.isNotNull(),
        fields=text.without_keys(token, *KNOWN),
        timestamp=text.time_of_day(value("time")),
        level=text.normal_level(value("level")),
        message=value("msg"),
        source=value("source"),
        logger=value("logger"),
    )
