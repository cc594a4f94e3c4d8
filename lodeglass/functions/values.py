"""Text forms of JSON values.

Every JSON number is a double to the log reader, printed with the fewest digits that identify it and with an exponent
once it is below 1e-4 or at least 1e6. Nested values print in one of two styles: *flat* for extra fields
(``a=1 b=2``, ``1,2``) and *printed* where a text was expected but something else was found (``map[a:1 b:2]``, ``[1 2]``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass.functions.text import let


class Marks(NamedTuple):
    """What a style puts around and between the members of a container."""

    key_end: str
    object_open: str
    object_sep: str
    object_close: str
    array_open: str
    array_sep: str
    array_close: str


FLAT = Marks("=", "", " ", "", "", ",", "")
PRINTED = Marks(":", "map[", " ", "]", "[", " ", "]")


def float_text(number: Column) -> Column:
    """Shortest text of a finite double, with an exponent outside [1e-4, 1e6)."""

    def shaped(parts: Column) -> Column:
        digits, exp = parts["digits"], parts["exp"]
        count = F.length(digits)
        science = F.concat(
            F.left(digits, F.lit(1)),
            F.when(count > 1, F.concat(F.lit("."), digits.substr(F.lit(2), count))).otherwise(""),
            F.lit("e"),
            F.when(exp < 0, "-").otherwise("+"),
            F.when(F.abs(exp) < 10, "0").otherwise(""),
            F.abs(exp).cast("string"),
        )
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
        whole = F.concat(digits, F.repeat(F.lit("0"), exp + 1 - count))
        mixed = F.concat(
            F.left(digits, exp + 1), F.lit("."), digits.substr(exp + F.lit(2), count)
        )
        return (
            F.when(digits == "", "0")
            .when((exp < -4) | (exp >= 6), science)
            .when(exp < 0, small)
            .when(count <= exp + 1, whole)
            .otherwise(mixed)
        )

    def split(text: Column) -> Column:
        mantissa = F.substring_index(text, "E", 1)
        shift = F.when(text.contains("E"), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
        before = F.substring_index(mantissa, ".", 1)
        raw = F.replace(mantissa, F.lit("."), F.lit(""))
        lead = F.length(raw) - F.length(F.ltrim(raw, F.lit("0")))
        return F.struct(
            F.btrim(raw, F.lit("0")).alias("digits"),
            (shift + F.length(before) - lead - 1).alias("exp"),
        )

    plain = let(F.abs(number).cast("string"), lambda text: let(split(text), shaped))
    return F.concat(F.when(number < 0, "-").otherwise(""), plain)


def number_text(json: Column) -> Column:
    """:func:`float_text` of a JSON number from its text; most are written that way already."""
    return F.when(json.rlike(f"^(?:{_SHORTEST})$"), json).otherwise(float_text(json.try_cast("double")))


# Structure of a container's text while it is written: control characters, which JSON texts do not have as they are.
_OPEN, _CLOSE, _COMMA, _COLON, _STRING, _HOLE, _ESCAPE = map(chr, range(1, 8))
#: After ``_OPEN``, what is opened.
_OBJECT, _ARRAY = "{", "["
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_SIMPLE = r'^(?:[^"\s]*+"[^"\\{}\[\],:]*+")*+[^"\s]*+$'
#: Numbers of few digits that print as they are.
_SHORTEST = r"0|-?[1-9]\d{0,5}(?:\.\d{0,7}[1-9])?|-?0\.(?!0000)\d{0,7}[1-9]"
#: A value that is no string, and one that does not print as it is.
_BARE = f"(?<=[{_COMMA}{_COLON}]|{_OPEN}\\{_ARRAY})[^{_OPEN}{_CLOSE}{_COMMA}{_COLON}{_STRING}]++(?=[{_CLOSE}{_COMMA}])"
_REWRITTEN = f"(?:[{_COMMA}{_COLON}]|{_OPEN}\\{_ARRAY})(?!(?:{_SHORTEST}|true|false)[{_CLOSE}{_COMMA}])[^{_OPEN}{_CLOSE}{_COMMA}{_COLON}{_STRING}]++[{_CLOSE}{_COMMA}]"
#: In members that are in order, a key that comes again.
_REPEATED = f"(?:^|{_COMMA})([^{_COLON}{_COMMA}]*+){_COLON}[^{_COMMA}]*+{_COMMA}\\1{_COLON}"
#: Up to so many containers are not looked at for how deep they are.
_FEW = 16


def container_text(json: Column, style: Marks) -> Column:
    """Text of a JSON object or array from its JSON text, keys in order; of a key that an object repeats the last value counts.

    Brackets, commas and colons outside strings become control characters, which strings then do not have. Every pass
    writes all containers that have no containers in them and leaves their texts in their places; there are as many passes
    as brackets are nested.
    """

    def write(structure: Column) -> Column:
        count = F.length(structure) - F.length(F.replace(structure, F.lit(_OPEN), F.lit("")))
        passes = F.sequence(F.lit(1), F.when(count <= _FEW, count).otherwise(depth(json)))
        return F.aggregate(passes, structure, lambda now, _: F.when(now.startswith(_OPEN), _closed(now, style)).otherwise(now))

    def shown(text: Column) -> Column:
        return F.when(text.contains(_ESCAPE), _unescaped(text)).otherwise(text)

    return let(let(let(_structure(json), _bare_texts), write), shown)


def _structure(json: Column) -> Column:
    """The JSON text with control characters for its structure, and one in front of each string."""

    def marked(text: Column) -> Column:
        # an opening bracket stays behind its mark
        for found, mark in (("{", _OPEN + _OBJECT), ("[", _OPEN + _ARRAY), ("}", _CLOSE), ("]", _CLOSE), (",", _COMMA), (":", _COLON)):
            text = F.replace(text, F.lit(found), F.lit(mark))
        return text

    def string(inside: Column) -> Column:
        plain = F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), inside, F.lit('"'))), "$", "string")
        return F.when(inside.contains("\\"), let(F.coalesce(plain, inside), _escaped)).otherwise(inside)

    def joined(strings: Column) -> Column:
        around = F.split(marked(F.regexp_replace(F.regexp_replace(json, _QUOTED, _HOLE), r"[ \t\r\n]++", "")), _HOLE)
        filled = F.transform(around, lambda text, i: F.when(i == 0, text).otherwise(
            F.concat(F.lit(_STRING), let(F.get(strings, i - 1), string), text)
        ))
        return F.array_join(filled, "")

    # where strings have neither structure nor escapes in them, the text is marked as a whole
    simple = marked(F.regexp_replace(json, _QUOTED, _STRING + "$1"))
    return F.when(json.rlike(_SIMPLE), simple).otherwise(let(F.regexp_extract_all(json, F.lit(_QUOTED), F.lit(1)), joined))


def _escaped(text: Column) -> Column:
    """Without the characters that mean structure; texts stay in order."""
    found = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "H"))
    for code in range(7):
        found = F.replace(found, F.lit(chr(code)), F.lit(_ESCAPE + chr(65 + code)))
    return F.when(text.rlike(rf"[\x00-{_ESCAPE}]"), found).otherwise(text)


def _unescaped(text: Column) -> Column:
    for code in range(8):
        text = F.replace(text, F.lit(_ESCAPE + chr(65 + code)), F.lit(chr(code)))
    return text


def _bare_texts(structure: Column) -> Column:
    """The structure with texts for null and for numbers that print in another way; strings are not told any more."""

    def bare(value: Column) -> Column:
        return F.when(value == "null", "<nil>").when(value.isin("true", "false"), value).otherwise(number_text(value))

    def joined(values: Column) -> Column:
        filled = F.transform(around, lambda text, i: F.when(i == 0, text).otherwise(F.concat(let(F.get(values, i - 1), bare), text)))
        return F.array_join(filled, "")

    around = F.split(F.regexp_replace(structure, _BARE, _HOLE), _HOLE)
    found = let(F.regexp_extract_all(structure, F.lit(_BARE), F.lit(0)), joined)
    return F.replace(F.when(structure.rlike(_REWRITTEN), found).otherwise(structure), F.lit(_STRING), F.lit(""))


def _closed(structure: Column, style: Marks) -> Column:
    """The structure with texts in place of its innermost containers: what lies between a bracket that opens and the next
    bracket, if that closes."""

    def part(text: Column, rest: Column) -> Column:
        before = F.left(text, F.length(text) - F.length(rest) - 1)
        return F.when(rest == text, F.concat(text, F.lit(_CLOSE))).otherwise(F.concat(before, _innermost_text(rest, style)))

    def joined(parts: Column) -> Column:
        last = F.size(parts) - 1
        shown = F.transform(parts, lambda text, i: F.when(i == last, text).otherwise(
            let(F.substring_index(text, _OPEN, -1), lambda rest: part(text, rest))
        ))
        return F.array_join(shown, "")

    return let(F.split(structure, _CLOSE), joined)


def _innermost_text(container: Column, style: Marks) -> Column:
    """Text of a container from its bracket and its members' texts."""

    def of_object(members: Column) -> Column:
        ordered = F.when(members.rlike(_REPEATED), F.array_join(_last_of_keys(inside), _COMMA)).otherwise(members)
        pairs = F.replace(F.replace(ordered, F.lit(_COMMA), F.lit(style.object_sep)), F.lit(_COLON), F.lit(style.key_end))
        return F.concat(F.lit(style.object_open), pairs, F.lit(style.object_close))

    inside = container.substr(F.lit(2), F.length(container))
    elements = F.replace(inside, F.lit(_COMMA), F.lit(style.array_sep))
    in_order = F.array_join(F.sort_array(F.split(inside, _COMMA)), _COMMA)
    return F.when(container.startswith(_OBJECT), let(in_order, of_object)).otherwise(
        F.concat(F.lit(style.array_open), elements, F.lit(style.array_close))
    )


def _last_of_keys(members: Column) -> Column:
    """The last member of each key, in the order of keys."""

    def last(numbered: Column) -> Column:
        is_last = lambda m, i: F.coalesce(F.get(numbered, i + 1)["key"] != m["key"], F.lit(True))
        return F.transform(F.filter(numbered, is_last), lambda m: m["member"])

    def numbered(found: Column) -> Column:
        key = lambda m: F.substring_index(m, _COLON, 1).alias("key")
        return F.transform(found, lambda m, i: F.struct(key(m), i.alias("place"), m.alias("member")))

    return let(F.sort_array(numbered(F.split(members, _COMMA))), last)


def brackets(json: Column) -> Column:
    """How many opening brackets there are, in strings too."""
    return F.length(json) - F.length(F.translate(json, "{[", ""))


def depth(json: Column) -> Column:
    """How deep brackets outside strings are nested; where there is one opening bracket, it may be in a string."""
    opening = brackets(json)
    return F.when(opening < 2, opening).otherwise(_folded_depth(json))


def _folded_depth(json: Column) -> Column:
    unquoted = F.regexp_replace(json, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    brackets = F.split(F.regexp_replace(unquoted, r"[^\[\]{}]++", ""), "")

    def step(so_far: Column, bracket: Column) -> Column:
        now = so_far["now"] + F.when(bracket.isin("[", "{"), 1).when(bracket.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(so_far["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(brackets, start, step, lambda so_far: so_far["most"])
