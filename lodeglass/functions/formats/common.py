"""What every line format provides.

A format turns a line into *tokens* first (one pattern match or one JSON parse) and builds the entry columns from the
tokens. Keeping the two apart lets a job materialise the tokens once per line and still prune entry columns that a
query does not read. ``event_time`` gives the instant that a line's own stamp says, from the tokens too: dates elsewhere
in a line are not its time. Stamps without a year take it from a column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions.text import let

ENTRY_TEXT = ("timestamp", "level", "message", "source", "logger")
ENTRY_COLUMNS = (*ENTRY_TEXT, "fields", "parsed")

# Separates captured groups; lines that carry it themselves take the slower way.
_GROUP_END = "\x01"


def capture(line: Column, pattern: str, groups: int) -> Column:
    """Captured groups of a whole-line pattern as ``array<string>`` from a single match; NULL when it does not match."""
    numbers = range(1, groups + 1)
    marked = F.regexp_replace(line, pattern, "".join(f"{_GROUP_END}${g}" for g in numbers))
    once = F.when(
        marked.startswith(_GROUP_END), F.slice(F.split(marked, _GROUP_END, groups + 1), 2, groups)
    )
    each = F.when(line.rlike(pattern), F.array(*[F.regexp_extract(line, pattern, g) for g in numbers]))
    return F.when(line.contains(_GROUP_END), each).otherwise(once)


def group(captured: Column, number: int) -> Column:
    return F.get(captured, F.lit(number - 1))


def entry(parsed: Column, fields: Column | None = None, **texts: Column) -> dict[str, Column]:
    """Entry columns: texts that are not set are empty, not NULL; ``fields`` is NULL when there are none."""
    empty = F.lit("")
    out = {name: F.when(parsed, texts[name]).otherwise(empty) if name in texts else empty for name in ENTRY_TEXT}
    out["fields"] = F.lit(None).cast("map<string,string>") if fields is None else F.when(
        parsed, let(fields, lambda m: F.when(F.size(m) > 0, m))
    )
    out["parsed"] = parsed
    return out
