"""Numbers on a line, read outwards: what leads up to a number, right to left, and what follows it.

A line's numbers are marked once. A second mark then walks from each number to the left, one step for all of a line's numbers at
once: over blanks, a hedge, a verb, a remark. Where it comes to stand behind a name of the vocabulary, the number is
that name's value; all other marks are taken off again. Every step is one built-in expression on the whole line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import EXCEPTION_SUFFIXES, HEDGES, MAX_REMARK, METRIC, METRIC_PREFIXES, NUMBER, PLUS_MINUS, SPLITS, TRACEBACK, VERBS, any_of
from .text import let, marked_places, matches, strip

BLANKS = " \t"
#: Characters before a sign in which its key, or the name of a range, must begin.
REACH = 240
_NAME = rf"(?iU)(?<![\w.\x04])((?:{any_of(METRIC_PREFIXES)}[ _-]){{0,2}}{METRIC}(?:[_-]{any_of([*SPLITS, 'valid'])})?)"
_LONE_NUMBER = rf"(?U)^{NUMBER}$"
#: Digits that belong to a name (recall@10, map@.5:.95, top-1, f1) are no numbers of their own.
_NUMBERS = rf"(?iU)(?<!@[\d.:]{{0,12}})(?<!(?:top|rouge)[-_ ]?)(?:(?=[-+])|(?<![\w^])){NUMBER}"
#: The marks: a number's begin and end, the one that walks, and a name's begin and end.
_BEGIN, _END, _WALK, _NAMED, _FOR = "\x03", "\x04", "\x05", "\x06", "\x07"
_STEPS = [
    rf"(?iU)[ \t]*(?:{any_of(HEDGES)}[ \t]*)?",
    rf"(?iU)(?:{any_of([v for v in VERBS if not v.isalpha()])}|\b{any_of([v for v in VERBS if v.isalpha()])}(?!{_WALK}{_BEGIN}?\w))",
    rf"[ \t]*(?:\([^){_BEGIN}{_END}]{{0,{MAX_REMARK}}}\)[ \t]*)?",
]


def _before(line: Column, start: Column, reach: int = REACH) -> Column:
    return F.substring(line, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))


def _after(line: Column, end: Column) -> Column:
    return F.substring(line, end + 1, F.length(line))


def metric_values(line: Column) -> Column:
    """Numbers with a name of the vocabulary: start, end, raw, name, value, den, pct, and rest: the two characters behind the
    value, and den_rest: those behind the denominator of a fraction."""
    s = F.translate(line, "\x01\x02\x03\x04\x05\x06\x07", "\x08" * 7)
    s = F.regexp_replace(s, _NUMBERS, f"{_WALK}{_BEGIN}$0{_END}")
    for step in _STEPS:
        s = F.regexp_replace(s, f"({step}){_WALK}", f"{_WALK}$1")
    s = F.regexp_replace(s, rf"{_NAME}(?:(\.){_WALK}|{_WALK}(?!{_BEGIN}?[a-zA-Z0-9]))", f"{_NAMED}$1{_FOR}$2")
    s = F.regexp_replace(s, f"{_WALK}([^{_BEGIN}]*){_BEGIN}([^{_END}]*){_END}", "$1$2")
    taken = f"{_NAMED}([^{_FOR}]*){_FOR}([^{_BEGIN}]*){_BEGIN}([^{_END}]*){_END}" + r"(?U)([ \t]*/[ \t]*(\d+))?([ \t]*%?)"
    s = F.regexp_replace(s, taken, "\x01$1$2$3$4$6\x02$1\x02$3\x02$5\x02$6\x02$4\x01")

    def read(x: Column) -> Column:
        value_end = x["end"] - F.length(x["pct"]) - F.length(x["over"])
        two = lambda at: F.substring(line, at + 1, F.lit(2))
        den_rest = F.when(x["den"] != "", two(value_end + F.length(x["over"]))).otherwise("")
        fields = {"rest": two(value_end), "den_rest": den_rest, "pct": F.when(F.contains(x["pct"], F.lit("%")), "%").otherwise("")}
        return F.struct(*[x[k].alias(k) for k in ("start", "end", "raw", "name", "value", "den")], *[c.alias(k) for k, c in fields.items()])

    return F.transform(marked_places(s, ["name", "value", "den", "pct", "over"]), read)


_KEY = r"[A-Za-z][\w@]*"
_DOTTED_AT_END = rf"(?U)(?<![\w.@]){_KEY}(?:\.{_KEY})*$"


def _left_trimmed(s: Column) -> Column:
    return F.ltrim(s, F.lit(BLANKS))


def equations(line: Column) -> Column:
    """key=value at every equals sign, the value in square brackets or not: start, end, raw, name, value."""

    def left(x: Column) -> Column:
        before = _before(line, x["start"])
        key = let(F.rtrim(before, F.lit(BLANKS)), lambda b: F.struct(F.regexp_extract(b, _DOTTED_AT_END, 0).alias("key"), (F.length(before) - F.length(b)).alias("gap")))
        return let(key, lambda k: F.struct(k["key"].alias("key"), (x["start"] - k["gap"] - F.length(k["key"])).alias("start"), x["end"].alias("sign")))

    def right(k: Column) -> Column:
        def behind(after: Column) -> Column:
            opened = _left_trimmed(after)
            inner = F.when(opened.startswith("["), _left_trimmed(F.substring(opened, F.lit(2), F.length(opened)))).otherwise(opened)
            return let(inner, lambda i: let(F.regexp_extract(i, f"(?U)^{NUMBER}", 0), lambda v: let(F.substring(i, F.length(v) + 1, F.length(i)), lambda rest: result(after, v, rest))))

        def result(after: Column, value: Column, rest: Column) -> Column:
            # a value ends where no word or dot follows: at a closing bracket, after a dot of its own, or at once
            own = F.when(rest.startswith("."), F.lit(1)).otherwise(F.lit(0))
            closed = F.length(F.regexp_extract(rest, r"^\.?[ \t]*\]?", 0))
            ends = lambda n: ~F.substring(rest, n + 1, F.lit(1)).rlike(r"(?U)^[\w.]")
            more = F.when(value == "", None).when(ends(closed), closed).when(ends(own), own)
            return F.struct(value.alias("value"), (k["sign"] + F.length(after) - F.length(rest) + more).alias("end"))

        found = lambda r: F.struct(k["start"].alias("start"), r["end"].alias("end"), F.substring(line, k["start"] + 1, r["end"] - k["start"]).alias("raw"), k["key"].alias("name"), r["value"].alias("value"))
        return let(let(_after(line, k["sign"]), behind), found)

    keyed = F.filter(F.transform(matches(line, "=", []), left), lambda k: k["key"] != "")
    return F.filter(F.transform(keyed, right), lambda x: x["end"].isNotNull())


def tabbed(line: Column) -> Column:
    """A line that is a key, tabs and a number: start, end, raw, name, value; none for other lines."""
    parts = F.split(F.trim(line, F.lit(BLANKS)), "\t+")
    key, value = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    good = (F.size(parts) == 2) & (key != "") & key.rlike(rf"(?U)^{_KEY}$") & value.rlike(_LONE_NUMBER)
    hit = F.struct(F.lit(0).alias("start"), F.length(line).alias("end"), line.alias("raw"), key.alias("name"), value.alias("value"))
    return F.filter(F.array(hit), lambda x: good)


def is_exception(line: Column) -> Column:
    """A traceback's first line, or one that begins with the name of an error, an exception or a warning, and a colon."""
    text = F.regexp_replace(line, r"(?U)^\s+", "")
    head = F.substring_index(text, ":", 1)
    kind = head.rlike(r"(?U)^[\w.]+$") & F.exists(F.array(*[F.lit(s) for s in EXCEPTION_SUFFIXES]), lambda s: head.endswith(s))
    return text.startswith(TRACEBACK) | (F.contains(text, F.lit(":")) & kind)


def _named_before(line: Column, found: Column, gap: int, fields: Callable[[Column], dict[str, Column]]) -> Column:
    """``found`` with the first name that ends at most ``gap`` characters, none of them a digit, before it."""

    def read(x: Column) -> Column:
        # with the first character of what follows, as no name ends inside a word
        before = F.concat(_before(line, x["start"]), F.substring(line, x["start"] + 1, F.lit(1)))
        near = rf"{_NAME}(?![a-zA-Z0-9])\.?[^0-9\n]{{0,{gap}}}(?=[\s\S]$)"
        name, all_ = F.regexp_extract(before, near, 1), F.length(F.regexp_extract(before, near, 0))
        start, end = x["start"] - all_, x["end"]
        return F.struct(start.alias("start"), end.alias("end"), F.substring(line, start + 1, end - start).alias("raw"), name.alias("name"), *[c.alias(k) for k, c in fields(x).items()])

    return F.filter(F.transform(found, read), lambda x: x["name"] != "")


def ranges(line: Column, gap: int) -> Column:
    """Names with a range, between one number and (to) another: start, end, raw, name, lo, hi, pct."""
    found = matches(line, rf"(?iU)\bbetween\s+({NUMBER})\s*%?\s*(?:and|to)\s+({NUMBER})\s*(%)?", ["lo", "hi", "pct"])
    return _named_before(line, found, gap, lambda x: {"lo": x["lo"], "hi": x["hi"], "pct": x["pct"]})


def spreads(line: Column, gap: int) -> Column:
    """Names with a value and its plus-minus: start, end, raw, name, value, pct, pm."""
    found = matches(line, rf"(?U)({NUMBER})\s*(%)?\s*{any_of(PLUS_MINUS)}\s*({NUMBER})", ["value", "pct", "pm"])
    return _named_before(line, found, gap, lambda x: {"value": x["value"], "pct": x["pct"], "pm": x["pm"]})


def is_rule(cells: Column) -> Column:
    """Cells of a table's ruled line: dashes, at least two, with or without a colon at either end."""
    return F.forall(cells, lambda c: F.regexp_replace(F.regexp_replace(c, "^:", ""), ":$", "").rlike("^--+$"))


def lone_number(cell: Column) -> Column:
    """A cell that is one number, emphasised or not: value, pct, pm; nulls where it is something else."""
    marks = "*_~`"
    bare = strip(F.trim(strip(cell), F.lit(marks)))
    parts = F.transform(F.split(bare, any_of(PLUS_MINUS)), strip)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    plain = lambda p: strip(F.rtrim(p, F.lit("%")))
    one = lambda p: plain(p).rlike(_LONE_NUMBER) & (F.length(p) - F.length(F.replace(p, F.lit("%"), F.lit(""))) <= 1)
    good = one(first) & ((F.size(parts) == 1) | ((F.size(parts) == 2) & one(second)))
    return F.when(good, F.struct(plain(first).alias("value"), F.when(first.endswith("%"), "%").alias("pct"), plain(second).alias("pm")))
