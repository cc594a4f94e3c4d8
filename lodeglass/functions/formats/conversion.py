"""Lines of a VM conversion pod: the tool's own phases, its monitor, and the programs it runs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions.formats.common import entry
from lodeglass.functions.text import ASCII_SPACE, WS, after_prefix, instant

FORMAT = "virtv2v"
TOOL = "v2v"


class LineClass(NamedTuple):
    """A line class known by its first words.

    ``cut``/``put`` rewrite the text after the prefix; with ``needs`` that text has to match or the line is unparsed.
    """

    prefix: str
    logger: str
    level: str
    lead: str = ""
    needs: str | None = None
    cut: str | None = None
    put: str = ""


# Line classes in the order they are tried.
PREFIXED = (
    LineClass("Building command:", TOOL, "INFO", lead="Building command: "),
    LineClass("virt-v2v monitoring:", "v2v-monitor", "INFO"),
    LineClass("libguestfs:", "libguestfs", "INFO", cut=rf"^trace:{WS}+(?:\w+:{WS}+)?"),
    LineClass("nbdkit:", "nbdkit", "DEBUG", cut=rf"^(?:vddk\[\d+\]:{WS}+)?(?:debug:{WS}+)?"),
    LineClass(
        "libnbd:", "libnbd", "DEBUG",
        needs=rf"^debug:{WS}+\w+:{WS}+", cut=rf"^debug:{WS}+(\w+):{WS}+", put="$1: ",
    ),
    LineClass("guestfsd:", "guestfsd", "DEBUG"),
    LineClass("info:", "v2v-info", "INFO"),
    LineClass("supermin:", "supermin", "INFO"),
    LineClass("dracut:", "dracut", "INFO"),
    LineClass("augeas ", "augeas", "WARN", needs=rf"^failed{WS}+", cut=rf"^failed{WS}+", put="failed "),
    LineClass("check_host_free_space:", TOOL, "INFO", lead="check_host_free_space: "),
    LineClass("rm -rf ", TOOL, "INFO", lead="cleanup: rm -rf ", needs=rf"^--{WS}+", cut=rf"^--{WS}+"),
)
# Classes whose message is the line itself.
WHOLE = (
    LineClass("libvirt xml is", TOOL, "INFO"),
    LineClass("running nbdkit:", TOOL, "INFO"),
    LineClass("Starting server", "server", "INFO"),
    LineClass("Shutdown", "server", "INFO"),
)
# Classes whose logger is the tool itself.
TOOL_CLASSES = (*(k.prefix for k in (*PREFIXED, *WHOLE) if k.logger == TOOL), "phase")
BARE = "libguestfs"
MONITOR = "virt-v2v monitoring:"
WEB = rf"^\d{{4}}/\d{{2}}/\d{{2}}{WS}+(\d{{2}}:\d{{2}}:\d{{2}}){WS}+"
PHASE = rf"^\[{WS}*(\d+\.\d{{1,2}})\]{WS}+"
KERNEL = rf"^\[{WS}+(\d+\.\d{{3,}})\]{WS}+"
XML = rf"^{WS}*<[?/]?\w+"
TRACE = rf"^trace:{WS}+"
EMBEDDED_STAMP = r"\d{4}-\d{2}-\d{2}T(\d{2}:\d{2}:\d{2})\.\d+Z"
WEB_STAMP = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2})"
PROGRESS = rf"(?s)^{MONITOR}{WS}.*?completed{WS}+(\d+){WS}*%"
DISK_OF = rf"[Cc]opying disk (\d+){WS}+out of{WS}+(\d+)"
DISK_SLASH = r"[Cc]opying disk (\d+)/(\d+)"

# First words that count as a vote for this format.
VOTES = (
    "Building command:", "virt-v2v monitoring:", "libguestfs:", "nbdkit:", "libnbd:", "guestfsd:",
    "supermin:", "dracut:", "augeas ", "check_host_free_space:", "libvirt xml is", "running nbdkit:",
)

# Phase keywords, first match wins, and the stage each one starts.
STAGES = (
    ("Setting up the source", "source-setup"),
    ("Opening the source", "source-open"),
    ("Inspecting the source", "inspect"),
    ("Mapping filesystem", "map-fs"),
    ("Creating an overlay", "overlay"),
    ("Setting up the destination", "dest-setup"),
    ("Copying disk", "disk-copy"),
    ("Creating output metadata", "metadata"),
    ("Finishing off", "finish"),
)
FIRST_STAGE = "init"
RESTART_STAGE = "source-setup"


def looks_like(line: Column) -> Column:
    vote = F.lit(False)
    for words in VOTES:
        vote = vote | line.startswith(words)
    inspector = line.startswith("info: ") & line.contains("virt-v2v")
    return vote | inspector | (line.startswith("[") & line.rlike(PHASE))


def tokens(line: Column) -> Column:
    """Name of a parsed line's class: a prefix, or one of ``http phase kernel xml``; NULL for unparsed lines.

    One class names its logger even when the rest of the line is missing; such lines get ``BARE``.
    """
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for known in PREFIXED:
        misfit = F.lit(BARE if known.prefix.startswith(BARE) else None)
        chain = chain.when(line.startswith(known.prefix), F.when(_fits(line, known), known.prefix).otherwise(misfit))
    for known in WHOLE:
        chain = chain.when(line.startswith(known.prefix), known.prefix)
    return (
        chain.when(line.rlike(WEB), "http")
        .when(line.startswith("[") & line.rlike(PHASE), "phase")
        .when(line.startswith("[") & line.rlike(KERNEL), "kernel")
        .when(line.rlike(XML), "xml")
    )


def _fits(line: Column, known: LineClass) -> Column:
    fits = F.lit(True) if known.needs is None else _rest(line, known).rlike(known.needs)
    # At least one blank has to follow a prefix that does not end in one.
    return fits & after_prefix(line, known.prefix).rlike(rf"^{WS}") if known.prefix.endswith(":") else fits


def _rest(line: Column, known: LineClass) -> Column:
    return F.ltrim(after_prefix(line, known.prefix), F.lit(ASCII_SPACE))


def _by_class(token: Column, per_class: dict[str, Column], default: Column) -> Column:
    chain = F.when(F.lit(False), default)
    for name, column in per_class.items():
        chain = chain.when(token == name, column)
    return chain.otherwise(default)


def entry_columns(line: Column, token: Column) -> dict[str, Column]:
    messages = {}
    for known in PREFIXED:
        rest = _rest(line, known)
        body = rest if known.cut is None else F.regexp_replace(rest, known.cut, known.put)
        messages[known.prefix] = F.concat(F.lit(known.lead), body) if known.lead else body
    for name, pattern in (("http", WEB), ("phase", PHASE), ("kernel", KERNEL)):
        messages[name] = F.regexp_replace(line, pattern, "")

    names = {k.prefix: F.lit(k.logger) for k in (*PREFIXED, *WHOLE)}
    names |= {"http": F.lit("http"), "phase": F.lit(TOOL), "kernel": F.lit("kernel"), "xml": F.lit("xml")}
    levels = {k.prefix: F.lit(k.level) for k in (*PREFIXED, *WHOLE)}
    levels |= {"http": F.lit("WARN"), "kernel": F.lit("DEBUG")}
    levels["libguestfs:"] = F.when(_rest(line, PREFIXED[2]).rlike(TRACE), "DEBUG").otherwise("INFO")

    def seconds(pattern: str) -> Column:
        return F.concat(F.regexp_extract(line, pattern, 1), F.lit("s"))

    stamps = {
        "nbdkit:": F.regexp_extract(messages["nbdkit:"], EMBEDDED_STAMP, 1),
        "http": F.regexp_extract(line, WEB, 1),
        "phase": seconds(PHASE),
        "kernel": seconds(KERNEL),
    }
    out = entry(
        token.isNotNull() & (token != BARE),
        fields=_own_fields(line, token),
        timestamp=_by_class(token, stamps, F.lit("")),
        level=_by_class(token, levels, F.lit("INFO")),
        message=_by_class(token, messages, line),
        logger=_by_class(token, names, F.lit("")),
    )
    out["logger"] = F.when(token == BARE, BARE).otherwise(out["logger"])
    return out


def event_time(line: Column, token: Column, _year: Column) -> Column:
    """Of the lines that show a clock time; where that is part of a date, the date counts as well."""
    stamp = F.when(token == "nbdkit:", F.regexp_extract(line, EMBEDDED_STAMP, 0)).when(
        token == "http", F.regexp_extract(line, WEB_STAMP, 1)
    )
    return instant(stamp)


def line_time(line: Column) -> Column:
    """:func:`event_time` of a raw line."""
    of_nbdkit = F.when(line.rlike(rf"^nbdkit:{WS}"), F.regexp_extract(line, EMBEDDED_STAMP, 0))
    return instant(F.coalesce(F.nullif(of_nbdkit, F.lit("")), F.nullif(F.regexp_extract(line, WEB_STAMP, 1), F.lit(""))))


def _own_fields(line: Column, token: Column) -> Column:
    monitor, phase = token == MONITOR, token == "phase"

    def disk(number: int) -> Column:
        found = F.when(monitor, F.regexp_extract(line, DISK_OF, number)).when(
            phase, F.regexp_extract(line, DISK_SLASH, number)
        )
        return F.nullif(found, F.lit(""))

    named = F.create_map(
        F.lit("disk_num"), disk(1),
        F.lit("disk_total"), disk(2),
        F.lit("progress_pct"), progress(line),
    )
    return F.when(monitor | phase, F.map_filter(named, lambda _, v: v.isNotNull()))


def progress(line: Column) -> Column:
    """Percentage a monitor line reports, else NULL."""
    return F.when(line.startswith(MONITOR), F.nullif(F.regexp_extract(line, PROGRESS, 1), F.lit("")))


def stage_of(message: Column) -> Column:
    """Stage that a phase message starts, else NULL."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for keyword, stage in STAGES:
        chain = chain.when(message.contains(keyword), stage)
    return chain
