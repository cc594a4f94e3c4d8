"""Log line formats and the order in which a line is tested for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions.formats import access, conversion, json_lines, klog, logfmt
from lodeglass.functions.formats.common import ENTRY_COLUMNS, ENTRY_TEXT, entry

PLAIN = "plain"

# Format names.
FORMATS = {
    "json": json_lines,
    "klog": klog,
    "logfmt": logfmt,
    "clf": access,
    "virtv2v": conversion,
}
# A line counts for the first of these whose test it passes.
TEST_ORDER = ("virtv2v", "json", "klog", "clf", "logfmt")
# Of formats with equally many votes the first of these wins.
TIE_ORDER = ("virtv2v", "json", "klog", "logfmt", "clf")


def line_class(line: Column) -> Column:
    """Format a single line looks like, else NULL."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in TEST_ORDER:
        chain = chain.when(FORMATS[name].looks_like(line), name)
    return chain


def plain_entry() -> dict[str, Column]:
    return entry(F.lit(False))
