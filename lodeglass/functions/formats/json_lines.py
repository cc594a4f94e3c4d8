"""JSON log lines in the zap and logrus layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions import text, values
from lodeglass.functions.formats.common import entry

# Keys that have an entry column of their own (or are dropped) in each layout, place by place.
ZAP_KEYS = ("level", "ts", "msg", "logger", "caller", "stacktrace")
LOGRUS_KEYS = ("level", "timestamp", "msg", "component", "pos", "time")

# How containers start, and numbers whose text here is not their JSON text.
_TYPED = r"(?:[\[{]|-?(?:\d{7}|\d+[.eE]))"
# Where a line has a string that looks like one, or might, once its escape is read.
_HAS_LOOKALIKE = rf':[ \t\r\n]*"(?:{_TYPED}|[-\d.]*\\u)'

# Strict JSON: no single quotes, no NaN.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def strip_stamp(line: Column) -> Column:
    """The line without an ``...T...Z`` stamp in front of its JSON object."""
    at = F.locate(" {", line)
    prefix = F.left(line, at - 1)
    stamped = (
        (F.octet_length(line) >= 32)
        & at.between(2, 40)
        & prefix.contains("T")
        & prefix.endswith("Z")
    )
    return F.when(stamped, line.substr(at + 1, F.length(line))).otherwise(line)


def looks_like(line: Column) -> Column:
    return text.trim_space(strip_stamp(line)).startswith("{")


def tokens(line: Column) -> Column:
    """The top-level members of the line's JSON object as their texts, and those with an entry column as shown there;
    NULL when it is not exactly one object.

    Reading members as strings gives their texts already, except for containers and for numbers that print with a
    fraction or an exponent. These are told by how they look, when they are shown; only a line that also has strings
    looking like them is read again, with types.
    """
    body = text.let(text.trim_space(line), strip_stamp)

    def read(b: Column) -> Column:
        typed = F.when(b.rlike(_HAS_LOOKALIKE), _unique(_members(b, "variant"))).alias("variants")
        token = text.let(
            _unique(_members(b, "string")), lambda m: F.when(m.isNotNull(), F.struct(m.alias("members"), typed))
        )
        return F.when(b.startswith("{"), text.let(token, with_known))

    def with_known(token: Column) -> Column:
        zap, logrus = (F.array(*map(F.lit, keys)) for keys in (ZAP_KEYS, LOGRUS_KEYS))
        keys = F.when(_is_logrus(token["members"]), logrus).otherwise(zap)
        slowly = F.transform(keys, lambda k: F.coalesce(_shown(token, k, token["members"][k], values.PRINTED), F.lit("")))
        # texts need no second look, and most lines have nothing else under these keys
        as_read = F.transform(keys, lambda k: F.coalesce(token["members"][k], F.lit("")))
        shown = text.let(as_read, lambda found: F.when(F.exists(found, lambda v: v.rlike(f"^{_TYPED}")), slowly).otherwise(found))
        return F.when(token.isNotNull(), F.struct(token["members"].alias("members"), token["variants"].alias("variants"), shown.alias("known")))

    return text.let(body, read)


def _members(body: Column, value_type: str) -> Column:
    # Inside brackets anything after the object is an error or a second element.
    wrapped = F.concat(F.lit("["), body, F.lit("]"))
    objects = F.from_json(wrapped, f"array<map<string,{value_type}>>", _STRICT)
    return text.let(objects, lambda o: F.when(F.size(o) == 1, F.get(o, F.lit(0))))


def _unique(members: Column) -> Column:
    """A repeated key keeps its last value."""
    return text.let(
        members,
        lambda m: F.when(F.size(F.array_distinct(F.map_keys(m))) == F.size(m), m).otherwise(
            text.last_wins_map(F.map_entries(m))
        ),
    )


def _is_logrus(members: Column) -> Column:
    return F.map_contains_key(members, "component") & (
        F.map_contains_key(members, "pos") | F.map_contains_key(members, "timestamp")
    )


def _is_known(key: Column, logrus: Column) -> Column:
    return F.when(logrus, key.isin(*LOGRUS_KEYS)).otherwise(key.isin(*ZAP_KEYS))


def _shown(token: Column, key: Column, value: Column, style: values.Marks) -> Column:
    """Text of a member that is not null."""

    def exact(json: Column) -> Column:
        is_text = token["variants"].isNotNull() & (F.schema_of_variant(token["variants"][key]) == "STRING")
        return (
            F.when(is_text, json).when(json.rlike(r"^[\[{]"), values.container_text(json, style))
            .otherwise(values.number_text(json))
        )

    return text.let(value, lambda v: F.coalesce(F.when(v.rlike(f"^{_TYPED}"), exact(v)), v))


def event_time(_line: Column, token: Column, _year: Column) -> Column:
    """From the members that hold the time in either layout, the line's own layout first."""
    members = token["members"]
    zap, logrus = ("ts", "timestamp", "time"), ("timestamp", "time", "ts")
    in_order = lambda names: F.coalesce(*[text.instant(members[name]) for name in names])
    return F.when(_is_logrus(members), in_order(logrus)).otherwise(in_order(zap))


def line_time(line: Column) -> Column:
    """:func:`event_time` of a raw line, from the few members that it takes."""
    names = ("ts", "timestamp", "time", "component", "pos")
    body = text.trim_space(strip_stamp(line))
    found = F.from_json(body, ", ".join(f"{n} string" for n in names), _STRICT)

    def time(m: Column) -> Column:
        ts, stamp, clock = (text.instant(m[n]) for n in names[:3])
        logrus = m["component"].isNotNull() & (m["pos"].isNotNull() | m["timestamp"].isNotNull())
        return F.when(logrus, F.coalesce(stamp, clock, ts)).otherwise(F.coalesce(ts, stamp, clock))

    return text.let(found, time)


def entry_columns(_line: Column, token: Column) -> dict[str, Column]:
    members = token["members"]
    logrus = _is_logrus(members)
    level, stamp, message, logger, source, time = (F.get(token["known"], F.lit(k)) for k in range(len(ZAP_KEYS)))

    def others(is_logrus: Column) -> Column:
        own = F.map_filter(members, lambda k, _: ~_is_known(k, is_logrus))
        return F.transform_values(own, lambda k, v: F.coalesce(_shown(token, k, v, values.FLAT), F.lit("<nil>")))

    stamp = F.when((stamp == "") & logrus, time).otherwise(stamp)
    return entry(
        token.isNotNull(),
        fields=text.let(logrus, others),
        timestamp=text.time_of_day(stamp),
        level=text.normal_level(level),
        message=message,
        source=source,
        logger=logger,
    )
