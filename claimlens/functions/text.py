"""Column functions over strings: lines, tails, stripping, regex matches with their places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, as Python's splitlines() has it.
_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_lines(c: Column) -> Column:
    """Lines without their ends; no empty line after a final break, no line in an empty text."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return let(F.split(c, _BREAK, -1), cut)


def tail(c: Column, lines: int, chars: int) -> Column:
    """The last ``lines`` lines, and of these the last ``chars`` characters."""
    parts = split_lines(c)
    n = F.size(parts)
    kept = F.array_join(F.slice(parts, F.greatest(n - lines + 1, F.lit(1)), F.lit(lines)), "\n")
    return F.when(n <= 0, F.lit("")).otherwise(F.right(kept, F.lit(chars)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body (a lambda) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(c: Column, pattern: str, groups: list[str]) -> Column:
    """All matches, left to right: array of structs start, end (characters), raw and one field for each group.

    A group that took no part in the match is an empty string. One pass of the pattern marks each match and its groups by
    control characters.
    """
    template = "\x01$0" + "".join(f"\x02${k + 1}" for k in range(len(groups))) + "\x01"
    return marked_places(F.regexp_replace(F.translate(c, "\x01\x02", "\x03\x03"), pattern, template), groups)


def marked_places(marked: Column, groups: list[str]) -> Column:
    """The stretches of a text between two \\x01, each followed by its groups behind \\x02 (which count as no text): start, end, raw, groups.

    Places are sums over the lengths of what lies before.
    """

    def build(parts: Column) -> Column:
        # every second part is a match, up to its first control character; one fold gives all starts
        def step(s: Column, x: Column) -> Column:
            width = F.when(s["hit"], F.instr(x, "\x02") - 1).otherwise(F.length(x)) if groups else F.length(x)
            return F.struct((s["at"] + width).alias("at"), (~s["hit"]).alias("hit"), F.when(s["hit"], F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"))

        begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(parts, begin, step, lambda s: s["starts"])
        return F.zip_with(F.filter(parts, lambda x, i: i % 2 == 1), starts, lambda x, at: let(F.split(x, "\x02", -1), lambda h: one(h, at)))

    def one(h: Column, at: Column) -> Column:
        fields = [h[k + 1].alias(name) for k, name in enumerate(groups)]
        return F.struct(at.alias("start"), (at + F.length(h[0])).alias("end"), h[0].alias("raw"), *fields)

    return let(F.split(marked, "\x01", -1), build)


def overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))


def duration(seconds: Column) -> Column:
    """12.3s, 1m 05s, 1h 02m, or n/a."""
    whole = F.rint(seconds).cast("long")
    minute = F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60)
    hour = F.format_string("%dh %02dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60))
    short = F.format_string("%.1fs", seconds)
    return F.when(seconds.isNull(), F.lit("n/a")).when(seconds < 60, short).when(whole < 3600, minute).otherwise(hour)


def compact_number(x: Column) -> Column:
    """Six significant digits without trailing zeros; four for values of 1000 and more or under 0.001."""
    size = F.floor(F.log10(F.abs(x)))
    digits = F.when((F.abs(x) >= 1000) | (F.abs(x) < 0.001), F.lit(4)).otherwise(F.lit(6))
    step = F.pow(F.lit(10.0), digits - 1 - size)
    rounded = F.rint(x * step) / step
    exponent = F.floor(F.log10(F.abs(rounded)) + 1e-12).cast("int")
    mantissa = F.format_string("%.3f", rounded / F.pow(F.lit(10.0), exponent))
    trim = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    science = F.concat(trim(mantissa), F.lit("e"), sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    plain = trim(F.format_string("%.9f", rounded))
    return F.when(x.isNull(), F.lit("n/a")).when(x == 0, F.lit("0")).when((exponent < -4) | (exponent >= digits), science).otherwise(plain)
