"""Claimed numbers in Markdown documents: pipe tables, sentences, code blocks; their identity and lookup.

State that runs down a document (code fences, tables) is a running sum over its lines, so one window per document replaces
a loop: a fence toggles by parity, and a table is an island of pipe lines below its first ruled header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_result_metric, normalize_metric, number
from ..functions.numbering import numbered
from ..functions.patterns import MAX_BEFORE_PM, MAX_BEFORE_RANGE, METRIC_WORD
from ..functions.readings import is_rule, lone_number, ranges, spreads
from ..functions.text import strip
from .extract import lines, vocabulary_matches

CLAIM_FIELDS = (
    "metric", "raw_metric", "value", "value_text", "lo", "hi", "lo_text", "hi_text", "plus_minus", "percent", "source", "line",
    "text", "kind", "table_header", "row", "column", "confidence",
)
#: Fixed value: what follows a number that counts something and is no result.
COUNT_AFTER = r"(?i)^\s*(?:runs?|times|epochs?|seeds?|iterations?|steps?|samples?|examples?|layers?|nodes?|splits?|trials?|repeated|random)\b"


def split_row(line: Column) -> Column:
    s = strip(line)
    s = F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"\|$", "")
    return F.transform(F.split(s, r"\|", -1), strip)


def clean(text: Column) -> Column:
    """Link labels without their targets, without emphasis marks."""
    t = F.regexp_replace(F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1"), r"[*`]", "")
    return strip(F.regexp_replace(strip(t), r"^_+|_+$", ""))


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with: fenced (inside code), fence, rule and pipe of this and the next line, and the island of pipe lines."""
    ls = lines(docs.select(key, text), text, [key])
    w = Window.partitionBy(key).orderBy("line")
    ls = ls.withColumn("fence", strip(F.col("body")).startswith("```")).withColumn("pipe", F.contains("body", F.lit("|")))
    ls = ls.withColumn("fenced", F.sum(F.col("fence").cast("int")).over(w) % 2 == 1)
    follows = F.lead(is_rule(split_row(F.col("body"))) & F.col("pipe")).over(w)
    ls = ls.withColumn("head", F.col("pipe") & ~F.col("fence") & ~F.col("fenced") & F.coalesce(follows, F.lit(False)))
    breaks = ~(F.col("pipe") & (strip(F.col("body")) != ""))
    ls = ls.withColumn("island", F.sum(breaks.cast("int")).over(w))
    before = F.concat_ws(" ", F.lag("body", 3).over(w), F.lag("body", 2).over(w), F.lag("body", 1).over(w))
    return ls.withColumn("breaks", breaks).withColumn("before", before)


def _tables(marked: DataFrame, key: str) -> DataFrame:
    """Lines with head_line, head_body and context of the table whose island they are in; nulls outside tables."""
    w = Window.partitionBy(key, "island")
    first = lambda c: F.min_by(c, F.when(F.col("head") & ~F.col("breaks"), F.col("line"))).over(w)
    return marked.withColumn("head_line", first("line")).withColumn("head_body", first("body")).withColumn("context", first("before"))


def _is_body() -> Column:
    return F.coalesce(~F.col("breaks") & (F.col("line") >= F.col("head_line") + 2), F.lit(False))


def markdown_claims(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """CLAIM_FIELDS and ord for every claimed number, in document order (tables first on a line)."""
    rows = _tables(_marked(docs, key, text), key)
    none = lambda kind="string": F.lit(None).cast(kind)

    # tables
    header = F.transform(split_row(F.col("head_body")), clean)
    body = rows.filter(_is_body()).select(key, "line", "body", "context", header.alias("head"), split_row(F.col("body")).alias("cells"))
    body = body.withColumn("label", clean(F.element_at("cells", 1)))
    cells = body.select("*", F.posexplode(F.slice(F.arrays_zip("head", "cells"), F.lit(1), F.least(F.size("head"), F.size("cells")))).alias("col", "c"))
    bare = strip(F.replace(F.regexp_replace("c.cells", "<[^>]+>", ""), F.lit("&plusmn;"), F.lit("±")))
    cells = cells.withColumn("number", lone_number(bare))
    in_head, in_row = F.col("c.head").rlike(METRIC_WORD), F.col("label").rlike(METRIC_WORD)
    near = F.coalesce(F.col("context"), F.lit("")).rlike(METRIC_WORD) | F.array_join("head", " ").rlike(METRIC_WORD)
    found = cells.filter(F.col("number").isNotNull() & (in_head | in_row | near))
    raw = F.when(in_head, F.col("c.head")).when(in_row, F.col("label")).otherwise(F.col("c.head"))
    table = found.select(
        normalize_metric(raw).alias("metric"), raw.alias("raw_metric"), number(F.col("number.value")).alias("value"), F.col("number.value").alias("value_text"),
        none("double").alias("lo"), none("double").alias("hi"), none().alias("lo_text"), none().alias("hi_text"),
        number(F.col("number.pm")).alias("plus_minus"), F.col("number.pct").isNotNull().alias("percent"), F.col(key).alias("source"), "line",
        F.substring(strip(F.col("body")), 1, 400).alias("text"), F.lit("table").alias("kind"), F.array_join("head", " | ").alias("table_header"),
        F.col("label").alias("row"), F.col("c.head").alias("column"), F.when(in_head | in_row, "high").otherwise("low").alias("confidence"),
        F.struct("line", F.lit(0).alias("rank"), F.col("col").alias("start")).alias("ord"),
    )
    prose = sentence_claims(rows.filter(~F.col("fence") & ~_is_body() & F.col("body").rlike("[0-9]")), key)
    return table.unionByName(prose)


def sentence_claims(rows: DataFrame, key: str = "source") -> DataFrame:
    """Ranges, plus-minus values and plain values on lines (key, line, body, fenced)."""
    line = F.col("body")
    free = lambda xs, spans: F.filter(xs, lambda x: ~F.exists(spans, lambda y: (y["start"] <= x["start"]) & (x["start"] < y["end"])))
    rows = rows.withColumn("_r", ranges(line, MAX_BEFORE_RANGE))
    rows = rows.withColumn("_p", free(spreads(line, MAX_BEFORE_PM), F.col("_r")))
    spans = F.concat(*[F.transform(c, lambda x: F.struct(x["start"], x["end"])) for c in ("_r", "_p")])
    rows = rows.withColumn("_spans", spans)
    flag = lambda x: F.col("fenced") & F.regexp_like(line, F.concat(F.lit(r"--[\w-]*\Q"), x["name"], F.lit(r"\E")))
    rows = rows.withColumn("_v", F.filter(free(vocabulary_matches(line), F.col("_spans")), lambda x: (x["den"] == "") & ~flag(x)))
    text = lambda c: F.nullif(c, F.lit(""))
    empty = F.lit("")

    def hit(rank: int, x: Column, value: Column, lo: Column, hi: Column, pm: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["name"].alias("name"), value.alias("value"), lo.alias("lo"), hi.alias("hi"), pm.alias("pm"), x["pct"].alias("pct"))

    hits = F.concat(
        F.transform("_r", lambda x: hit(1, x, empty, x["lo"], x["hi"], empty)),
        F.transform("_p", lambda x: hit(2, x, x["value"], empty, empty, x["pm"])),
        F.transform("_v", lambda x: hit(3, x, x["value"], empty, empty, empty)),
    )
    h = rows.select(key, "line", "body", "fenced", F.explode_outer(hits).alias("h")).filter("h is not null")
    none = F.lit(None).cast("string")
    return h.select(
        normalize_metric(F.col("h.name")).alias("metric"), F.col("h.name").alias("raw_metric"), number(F.col("h.value")).alias("value"),
        text(F.col("h.value")).alias("value_text"), number(F.col("h.lo")).alias("lo"), number(F.col("h.hi")).alias("hi"),
        text(F.col("h.lo")).alias("lo_text"), text(F.col("h.hi")).alias("hi_text"), number(F.col("h.pm")).alias("plus_minus"),
        (F.col("h.pct") != "").alias("percent"), F.col(key).alias("source"), "line",
        F.substring(strip(snippet(F.col("body"), F.col("h.start"), F.col("h.end"))), 1, 400).alias("text"),
        F.when(F.col("fenced"), "code").otherwise("prose").alias("kind"), none.alias("table_header"), none.alias("row"), none.alias("column"),
        none.alias("confidence"), F.struct("line", "h.rank", "h.start").alias("ord"),
    )


def snippet(line: Column, start: Column, end: Column, reach: int = 160) -> Column:
    """A line of up to 300 characters as it is; else the match's sentence, at most ``reach`` characters to each side."""
    left_part, right_part = F.substring(line, F.lit(1), start), F.substring(line, end + 1, F.length(line))
    last = F.length(F.regexp_extract(left_part, r"(?s)^(.*[.?!] )", 1))
    left = F.when((last > 0) & (start - last + 2 <= reach), last).otherwise(F.greatest(F.lit(0), start - reach))
    stop = F.length(F.regexp_extract(right_part, r"(?s)^(.*?[.?]) ", 1))
    right = F.when(stop > 0, end + stop).otherwise(F.length(line))
    right = F.when(right - end > reach, end + reach).otherwise(right)
    cut = strip(F.substring(line, left + 1, right - left))
    tail = F.when((right < F.length(line)) & ~cut.rlike(r"[.?!]$"), "...").otherwise("")
    return F.when(F.length(line) <= 300, line).otherwise(F.concat(F.when(left > 0, "...").otherwise(""), cut, tail))


def sentences(page: Column) -> Column:
    """A page's text reflowed into sentences: hyphens at line ends mended, split before a capital or bracket."""
    flat = F.regexp_replace(F.regexp_replace(page, r"-\n(?=[a-z])", ""), r"\s*\n\s*", " ")
    return F.filter(F.split(flat, r"(?<=[.!?])\s+(?=[A-Z(\[])"), lambda s: strip(s) != "")


def paper_prose_claims(pages: DataFrame, key: str = "source", page: str = "page", text: str = "text") -> DataFrame:
    """Claims in the sentences of paper pages; counts (5 runs, 200 epochs) are none."""
    s = pages.select(key, page, F.posexplode(sentences(F.col(text))).alias("at", "body"))
    rows = s.filter(F.col("body").rlike("[0-9]")).select(F.struct(key, page).alias("_k"), (F.col("at") + 1).alias("line"), "body", F.lit(False).alias("fenced"))
    out = sentence_claims(rows, "_k")
    behind = F.expr("substring_index(text, coalesce(value_text, ''), -1)")
    return out.filter(F.col("value_text").isNull() | ~behind.rlike(COUNT_AFTER)).withColumn("page", F.col(f"source.{page}")).withColumn("source", F.col(f"source.{key}")).withColumn("kind", F.lit("paper-prose"))


def dedup(claims: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first claim of each identity; nulls are equal."""
    rest = [c for c in claims.columns if c not in keys]
    return claims.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*claims.columns)


def number_claims(claims: DataFrame, key: str, prefix: str, order: str = "ord", known: DataFrame | None = None) -> DataFrame:
    """Ids prefix1, prefix2, … by key, of any number. ``known`` (key, label, first, last) keeps the numbers of labels seen before."""
    if known is None:
        return numbered(claims, [key], [order], "id").withColumn("id", F.concat(F.lit(prefix), F.col("id").cast("string")))
    top = known.groupBy(key).agg(F.max("last").alias("_top"))
    rows = numbered(claims, [key, "label"], [order], "id").join(known.select(key, "label", "first"), [key, "label"], "left").join(top, key, "left")
    n = F.col("id") + F.coalesce(F.col("first") - 1, "_top", F.lit(0))
    return rows.withColumn("id", F.concat(F.lit(prefix), n.cast("string"))).drop("first", "_top")


def lookup(claims: DataFrame, wanted: DataFrame, on: list[str], order: str = "ord") -> DataFrame:
    """For each wanted row its first claim with equal keys (null equals null), or nulls.

    The first claims are found ahead of the join, so it meets one claim a key and holds no pairs beyond its result.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    first = claims.groupBy(*[F.col(k).alias(x) for k, x in zip(on, keys, strict=True)]).agg(F.min_by(F.struct(*claims.columns), order).alias("claim"))
    same = F.lit(True)
    for k, x in zip(on, keys, strict=True):
        same &= F.col(k).eqNullSafe(F.col(x))
    return wanted.join(first, same, "left").select(*wanted.columns, "claim")


def result_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(is_result_metric(F.col("metric")))


def manual_claim(rows: DataFrame) -> DataFrame:
    """Typed-in claims; a row needs a source, and a value or both ends of a range."""
    good = F.col("source").isNotNull() & (F.trim("source") != "") & (F.col("value").isNotNull() | (F.col("lo").isNotNull() & F.col("hi").isNotNull()))
    checked = F.when(good, F.lit("manual")).otherwise(F.raise_error(F.lit("a claim needs a source, and a value or a range")).cast("string"))
    return rows.withColumn("kind", checked)
