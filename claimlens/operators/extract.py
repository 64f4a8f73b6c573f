"""Metric values from text lines, JSON, JSON lines and delimited tables.

Text lines and JSON are projections and generators over built-in functions, without a shuffle. Python reads delimited
tables alone. Rows carry ``ord``, the order in which a reader of the
source meets them (line, pass, place), since first and last depend on it.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize_metric, number
from ..functions.patterns import NUMBER
from ..functions.readings import equations, is_exception, metric_values, tabbed
from ..functions.text import let, overlaps, split_lines, strip

MAX_LINE = 2000
MAX_TEXT = 300
MAX_ITEMS = 1000
MAX_VALUES = 5000
#: What the JSON parser takes: nested brackets, digits of a number.
MAX_NESTING, MAX_DIGITS = 1000, 1000


def lines(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per line: the columns ``keep``, line (from 1) and body."""
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(split_lines(F.col(text))).alias("at", "body")).withColumn("line", F.col("at") + 1).drop("at")


def _guard(rest: Column) -> Column:
    """What stands behind a number lets it be a value: no letter but an e, no dot with a digit."""
    bad_letter = rest.rlike(r"(?U)^[\p{IsAlphabetic}]") & ~F.lower(rest).startswith("e")
    return ~bad_letter & ~rest.rlike(r"(?U)^\.\d")


def vocabulary_matches(line: Column) -> Column:
    """Named values that are whole: start, end, raw, name, value, rest, den, den_rest, pct."""
    return F.filter(metric_values(line), lambda x: _guard(F.when(x["den"] != "", x["den_rest"]).otherwise(x["rest"])))


def text_values(rows: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Values on text lines: the columns ``keep``, line and the value's fields.

    Vocabulary matches come first, then key=value and key<TAB>value where no accepted match lies.
    """
    keep = keep if keep is not None else [c for c in rows.columns if c not in (body, "line")]
    # every value needs a digit: the cheap test comes first
    rows = rows.filter(F.col(body).rlike("[0-9]")).withColumn("_l", F.substring(F.col(body), 1, MAX_LINE)).filter(~is_exception(F.col("_l")))
    line = F.col("_l")
    nothing = F.lit("")
    vocabulary = F.filter(vocabulary_matches(line), lambda x: (x["den"] == "") | ~x["den"].rlike("^0+$"))

    def as_hit(x: Column, rank: int, den: Column, pct: Column) -> Column:
        """A match as a value: all that is read from its texts is worked out here, once, so that later filters are cheap."""
        fraction, value = den != "", number(x["value"])
        written = F.when(fraction, F.concat_ws("/", x["value"], F.regexp_replace(den, "^0+(?=.)", "")))
        fields = {
            "rank": F.lit(rank), "start": x["start"], "name": normalize_metric(x["name"]), "raw_name": x["name"], "value": F.when(fraction, value / number(den)).otherwise(value),
            "raw": strip(x["raw"]), "percent": ~fraction & (pct != ""), "fraction": written,
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    # a line without a reading's own sign need not be read
    none = F.array().cast("array<struct<start:int,end:int,raw:string,name:string,value:string>>")
    free = lambda found, sign: F.when(F.contains(line, F.lit(sign)), F.filter(found, lambda x: ~overlaps(x, F.col("_m")))).otherwise(none)
    hits = F.concat(
        F.transform("_m", lambda x: as_hit(x, 0, x["den"], x["pct"])),
        F.transform(free(equations(line), "="), lambda x: as_hit(x, 1, nothing, nothing)),
        F.transform(free(tabbed(line), "\t"), lambda x: as_hit(x, 2, nothing, nothing)),
    )
    # outer: for an inner generator the optimiser infers a filter that works all hits out once more; empty hits go below
    out = rows.withColumn("_m", vocabulary).select(*keep, "line", F.substring(strip(F.col(body)), 1, MAX_TEXT).alias("text"), F.explode_outer(hits).alias("h"))
    fields = ["h.name", "h.raw_name", "h.value", "h.raw", "h.percent", "line", "text", "h.fraction"]
    return out.select(*keep, *fields, F.struct("line", "h.rank", "h.start").alias("ord")).filter(F.col("value").isNotNull())


def _structured(key: Column, value: Column) -> list[Column]:
    return [normalize_metric(key).alias("name"), key.alias("raw_name"), value.alias("value"), F.concat_ws("=", key, value.cast("string")).alias("raw")]


def _one_json(text: Column) -> Column:
    """The text as a single JSON value; null if anything else stands beside it, which the parser alone would overlook."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(boxed, lambda b: F.when(F.try_variant_get(b, "$[1]", "variant").isNull(), F.try_variant_get(b, "$[0]", "variant")))


def nesting(text: Column) -> Column:
    """The greatest depth of open brackets outside of strings."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*+"', "")
    # runs of opening brackets, each with the closing ones behind it: the depth is greatest at the end of a run
    runs = F.regexp_extract_all(F.regexp_replace(bare, r"[^\[\]{}]+", ""), F.lit(r"[\[{]++[\]}]*+|[\]}]++"), 0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def after(a: Column, run: Column) -> Column:
        opened = F.length(F.translate(run, "]}", ""))
        top = a["now"] + opened
        return F.struct((top - (F.length(run) - opened)).alias("now"), F.greatest(a["most"], top).alias("most"))

    return F.aggregate(runs, start, after, lambda a: a["most"])


def _number_of(v: Column) -> Column:
    """A variant's number, as a double; null for all else. Containers fail the first test, which is the cheap one."""
    return F.when(F.try_variant_get(v, "$", "double").isNotNull() & F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def _deep_leaves(values: DataFrame, keep: list[str]) -> DataFrame:
    """The leaves of deeply nested values: a fold inside the row opens one level of containers a step, so nothing is shuffled."""

    def node(path: Column, pos: Column, v: Column) -> Column:
        return F.struct(path.alias("path"), pos.alias("pos"), v.alias("v"), _number_of(v).alias("value"))

    def children(n: Column) -> Column:
        at = lambda k: F.concat(n["pos"], F.array(k))
        items = F.slice(F.try_variant_get(n["v"], "$", "array<variant>"), 1, MAX_ITEMS)
        fields = F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>"))
        dot = F.when(n["path"] != "", F.lit(".")).otherwise(F.lit(""))
        in_list = F.transform(items, lambda v, k: node(F.concat(n["path"], F.lit("["), k.cast("string"), F.lit("]")), at(k), v))
        in_object = F.transform(fields, lambda f, k: node(F.concat(n["path"], dot, f["key"]), at(k), f["value"]))
        return F.coalesce(in_list, in_object, F.array().cast(nodes))

    def numbers(level: Column) -> Column:
        return F.transform(F.filter(level, lambda n: n["value"].isNotNull()), lambda n: F.struct(n["path"].alias("_path"), n["pos"].alias("_pos"), n["value"].alias("value")))

    nodes, leaves = "array<struct<path:string,pos:array<int>,v:variant,value:double>>", "array<struct<_path:string,_pos:array<int>,value:double>>"
    root = F.array(F.struct(F.lit("").alias("path"), F.array().cast("array<int>").alias("pos"), F.col("_v").alias("v"), F.lit(None).cast("double").alias("value"))).cast(nodes)
    start = F.struct(root.alias("level"), F.array().cast(leaves).alias("done"))

    def step(s: Column, _: Column) -> Column:
        # scalars stay among the open nodes for one step, in which they have no children
        below = F.flatten(F.transform(F.filter(s["level"], lambda n: n["value"].isNull()), children))
        return F.struct(below.cast(nodes).alias("level"), F.concat(s["done"], numbers(s["level"])).cast(leaves).alias("done"))

    found = F.aggregate(F.sequence(F.lit(1), nesting(F.col("_raw"))), start, step, lambda s: F.concat(s["done"], numbers(s["level"])))
    return values.select(*keep, "_lines", "_line", F.inline(found))


def _json_parts(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, _v, _raw, _lines, _line: a document as one value, or else each of its lines that is one."""
    whole = docs.withColumn("_v", _one_json(F.col(text)))
    one = whole.filter(F.col("_v").isNotNull()).select(*keep, "_v", F.col(text).alias("_raw"), split_lines(F.col(text)).alias("_lines"), F.lit(None).cast("int").alias("_line"))
    many = whole.filter(F.col("_v").isNull() & F.col(text).isNotNull()).select(*keep, F.posexplode(split_lines(F.col(text))).alias("_at", "_body"))
    many = many.select(*keep, _one_json(F.col("_body")).alias("_v"), F.col("_body").alias("_raw"), F.array("_body").alias("_lines"), (F.col("_at") + 1).alias("_line")).filter("_v is not null")
    return one.unionByName(many)


def json_values(docs: DataFrame, text: str = "text", depth: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Numbers of JSON documents by path (a.b[0].c), booleans and strings left out, lists cut at 1000 items.

    A text that is no JSON document is read as JSON lines: bad lines are skipped and the line is the physical one; in a
    document it is the first line that holds the leaf's quoted key. Values nested up to ``depth`` are flattened level by
    level by built-in generators, deeper ones by a fold over their levels, both without a shuffle, to any nesting that the
    parser takes (1000; what it refuses: ``json_refused``). A number beyond the doubles is an infinity.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    values = _json_parts(docs, text, keep)
    brackets = F.length("_raw") - F.length(F.translate("_raw", "[{", ""))
    shallow = (brackets <= depth) | (nesting(F.col("_raw")) <= depth)
    level = values.filter(shallow).select(*keep, "_lines", "_line", F.lit("").alias("_path"), "_v", F.array().cast("array<int>").alias("_pos"))
    children = docs.sparkSession.tvf.variant_explode_outer(F.col("_v").outer())
    for _ in range(depth):
        # a container becomes its children, anything else stays: one generator a level, and one scan in all
        open_ = level.lateralJoin(children.toDF("_at", "_key", "_child"))
        open_ = open_.filter(F.col("_at").isNull() | F.col("_key").isNotNull() | (F.col("_at") < MAX_ITEMS))
        index = F.concat(F.lit("["), F.col("_at").cast("string"), F.lit("]"))
        step = F.when(F.col("_key").isNull(), index).otherwise(F.concat(F.when(F.col("_path") != "", F.lit(".")).otherwise(F.lit("")), F.col("_key")))
        done = F.col("_at").isNull()
        path, v = F.when(done, F.col("_path")).otherwise(F.concat("_path", step)), F.when(done, F.col("_v")).otherwise(F.col("_child"))
        level = open_.select(*keep, "_lines", "_line", path.alias("_path"), v.alias("_v"), F.when(done, F.col("_pos")).otherwise(F.concat("_pos", F.array("_at"))).alias("_pos"))
    leaves = level.withColumn("value", _number_of(F.col("_v"))).filter("value is not null").drop("_v")
    leaves = leaves.unionByName(_deep_leaves(values.filter(~shallow), keep))
    leaf_key = F.element_at(F.split(F.regexp_replace("_path", r"\[\d+\]$", ""), r"\."), -1)
    quoted = F.concat(F.lit('"'), leaf_key, F.lit('"'))
    first = F.array_position(F.transform("_lines", lambda x: F.contains(x, quoted)), F.lit(True))
    line = F.coalesce("_line", F.greatest(first.cast("int"), F.lit(1)))
    at = F.when(F.col("_line").isNotNull(), F.lit(1)).otherwise(line)
    body = F.coalesce(F.try_element_at("_lines", at), F.lit(""))
    return leaves.select(*keep, *_structured(F.col("_path"), F.col("value")), F.lit(False).alias("percent"), line.alias("line"), F.substring(strip(body), 1, MAX_TEXT).alias("text"), F.struct(F.coalesce("_line", F.lit(0)).alias("line"), F.col("_pos").alias("pos")).alias("ord"))


def json_refused(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep, lines_read, lines_skipped, reason: the texts that are no JSON value as a whole, and why lines of them are left out.

    Blank lines do not count. The parser takes a nesting and numbers of up to 1000; it refuses an object with a key twice.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    rest = docs.filter(F.col(text).isNotNull() & _one_json(F.col(text)).isNull())
    # a line that is the whole text has been parsed; the generator keeps the filter on its counts from counting again
    full = F.filter(split_lines(F.col(text)), lambda x: x.rlike(r"(?U)\S"))
    taken = lambda lines: F.size(F.filter(lines, lambda x: (x != F.col(text)) & _one_json(x).isNotNull()))
    counts = F.transform(F.array(full), lambda lines: F.struct(F.size(lines).alias("_lines"), taken(lines).alias("lines_read")))
    reason = F.when(nesting(F.col(text)) > MAX_NESTING, f"nested over {MAX_NESTING} deep").when(F.col(text).rlike(rf"[0-9]{{{MAX_DIGITS + 1}}}"), f"a number of over {MAX_DIGITS} digits")
    reason = reason.when(F.col(text).rlike(r"^\s*[\[{]") & (F.col("lines_read") == 0), "no valid JSON document").otherwise("lines that are no JSON")
    out = rest.select(*keep, text, F.inline_outer(counts)).filter("_lines > lines_read")
    return out.select(*keep, "lines_read", (F.col("_lines") - F.col("lines_read")).alias("lines_skipped"), reason.alias("reason"))


def csv_values(docs: DataFrame, text: str = "text", separator: str = ",", keep: list[str] | None = None) -> DataFrame:
    """Every numeric cell of the first 1000 records below a header, as (column, value); the record's first cell is its label.

    Records are read by a CSV reader in Arrow batches, as quoted cells may hold separators and line ends, and a row may
    have any number of cells. ``line`` counts records; ``text`` is the physical line of that number.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    lone = re.compile(f"(?:{NUMBER})")
    field = ["col string", "cell string", "line int", "body string", "row string", "pos int"]
    kept = docs.select(*keep).schema.fields
    names = [f.name for f in kept] + [f"_{x.split()[0]}" for x in field]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"_{x}" for x in field])

    def cells(body: str) -> Iterator[tuple]:
        reader = csv.reader(io.StringIO(body, newline=""), delimiter=separator)
        head = next(reader, None)
        ls = body.splitlines()
        for at, row in enumerate(itertools.islice(reader, MAX_ITEMS), start=2):
            for k, (name, cell) in enumerate(zip(head, row, strict=False)):
                if lone.fullmatch(cell.strip().rstrip("%")):
                    yield name, cell.strip(), at, ls[at - 1] if at <= len(ls) else "", row[0], k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            owner, found = [], []
            for k, body in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for row in cells(body or ""):
                    owner.append(k)
                    found.append(row)
            own = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(batch.num_columns - 1)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds))], names=names)

    out = docs.filter(F.col(text).isNotNull()).select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)
    value = number(F.regexp_replace("_cell", "%+$", ""))
    return out.select(*keep, *_structured(F.col("_col"), value), F.col("_cell").endswith("%").alias("percent"), F.col("_line").alias("line"), F.substring(strip(F.col("_body")), 1, MAX_TEXT).alias("text"), F.col("_row").alias("row"), F.struct(F.col("_line").alias("line"), F.col("_pos").alias("pos")).alias("ord"))


def wanted(values: DataFrame, names: list[str], group: list[str] | None = None, limit: int = MAX_VALUES) -> DataFrame:
    """The values whose name is among the (normalised) names, at most ``limit`` for each group, with ``truncated``."""
    from pyspark.sql import Window

    if names:
        values = values.filter(F.col("name").isin([_plain_name(n) for n in names]))
    if not group:
        return values
    w = Window.partitionBy(*group)
    n = F.row_number().over(w.orderBy("ord"))
    total = F.count(F.lit(1)).over(w)
    return values.withColumn("_n", n).withColumn("truncated", total > limit).filter(F.col("_n") <= limit).drop("_n")


def _plain_name(name: str) -> str:
    """The driver-side counterpart of normalize_metric, for literal names."""
    parts = [p for p in re.sub(r"[\s\-]+", "_", name.strip().lower().rstrip(".:")).split("_") if p]
    from ..functions.patterns import ALIASES, SPLITS

    parts = [ALIASES.get(p, p) for p in parts]
    if len(parts) > 1 and parts[-1] in SPLITS:
        parts = parts[-1:] + parts[:-1]
    return re.sub(r"^top_?([15])(?:_accuracy)?$", r"top\1_accuracy", "_".join(parts))
