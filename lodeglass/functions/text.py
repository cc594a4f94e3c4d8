"""Small text expressions shared by the line formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode white-space trim removes.
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# White space as log patterns mean it: no vertical tab, unlike Java's \s.
ASCII_SPACE = "\t\n\x0c\r "
WS = r"[\t\n\f\r ]"
NON_WS = r"[^\t\n\f\r ]"

# Level spellings and the level they stand for.
LEVELS = {
    "info": "INFO",
    "information": "INFO",
    "warn": "WARN",
    "warning": "WARN",
    "error": "ERROR",
    "err": "ERROR",
    "debug": "DEBUG",
    "dbg": "DEBUG",
    "trace": "DEBUG",
    "fatal": "FATAL",
    "panic": "FATAL",
    "critical": "FATAL",
    "dpanic": "FATAL",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(UNICODE_SPACE))


def is_blank(text: Column) -> Column:
    return trim_space(text) == ""


def after_prefix(text: Column, prefix: str) -> Column:
    return text.substr(F.lit(len(prefix) + 1), F.length(text))


def time_of_day(stamp: Column) -> Column:
    """``HH:MM:SS`` of a date-and-time text; a text without ``T`` or blank stays as it is."""

    def clock(text: Column) -> Column:
        after = F.when(text.contains("T"), F.locate("T", text)).otherwise(F.locate(" ", text)) + 1
        found = F.left(F.substring_index(text.substr(after, F.length(text)), ".", 1), F.lit(8))
        return F.when(text.contains("T") | text.contains(" "), found).otherwise(text)

    return let(stamp, lambda s: let(F.when(s.endswith("Z"), s.substr(F.lit(1), F.length(s) - 1)).otherwise(s), clock))


# Date and time in ISO form, and the two other forms that lines begin with.
ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
_SLASHED = r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}"
_ACCESS = r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}"
_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def instant(stamp: Column) -> Column:
    """The time that a whole stamp says: ISO or slashed (UTC where no zone is given), an access log's, or a number of seconds,
    milliseconds, microseconds or nanoseconds since 1970, told apart by size; else NULL."""

    def of_iso(text: Column) -> Column:
        plain = F.replace(text, F.lit(","), F.lit("."))
        zoned = F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), plain).otherwise(F.concat(plain, F.lit("Z")))
        return F.try_to_timestamp(zoned)

    def of_number(text: Column) -> Column:
        def scaled(x: Column) -> Column:
            size = F.abs(x)
            micros = F.when(size < 10**11, x * 1_000_000).when(size < 10**14, x * 1000).when(size < 10**17, x)
            return F.timestamp_micros(F.floor(micros.otherwise(x / 1000)).cast("long"))

        return let(text.try_cast("decimal(30,9)"), scaled)

    return let(
        stamp,
        lambda s: F.when(s.rlike(f"^{ISO}$"), of_iso(s))
        .when(s.rlike(f"^{_NUMBER}$"), of_number(s))
        .when(s.rlike(f"^{_SLASHED}$"), F.try_to_timestamp(F.concat(s, F.lit(" +0000")), F.lit("yyyy/MM/dd HH:mm:ss Z")))
        .when(s.rlike(f"^{_ACCESS}$"), F.try_to_timestamp(s, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))),
    )


def leading_time(line: Column) -> Column:
    """The time that a line begins with, after blanks and an opening bracket at most."""
    return instant(F.regexp_extract(line, rf"^[ \t]*\[?({ISO}|{_SLASHED}|{_ACCESS})", 1))


def normal_level(level: Column) -> Column:
    known = F.create_map(*[F.lit(part) for pair in LEVELS.items() for part in pair])
    return let(level, lambda text: F.coalesce(known[F.lower(text)], F.upper(text)))


def last_wins_map(entries: Column) -> Column:
    """Map from ``array<struct<key, value>>``; of a repeated key the last value is kept."""

    def rebuilt(newest_first: Column) -> Column:
        names = F.transform(newest_first, lambda e: e["key"])
        return let(
            names,
            lambda all_names: let(
                F.array_distinct(all_names),
                lambda keys: F.map_from_arrays(
                    keys,
                    F.transform(
                        keys,
                        lambda k: F.get(
                            newest_first, (F.array_position(all_names, k) - 1).cast("int")
                        )["value"],
                    ),
                ),
            ),
        )

    names = F.transform(entries, lambda e: e["key"])
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return F.when(unique, F.map_from_entries(entries)).otherwise(let(F.reverse(entries), rebuilt))


def last_value(entries: Column, key: str) -> Column:
    """Value of the last entry with this key, or the empty string."""
    hits = F.filter(entries, lambda e: e["key"] == key)
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


def without_keys(fields: Column, *keys: str) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*keys))
