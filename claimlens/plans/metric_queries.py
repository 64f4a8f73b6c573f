"""Extraction and selection: texts rendered from the tables' columns, read back by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import compact_number, duration, tail
from ..operators import extract, select
from ..sources import files
from .registry import query, spread, table

def decimal_text() -> Column:
    """events.value, without its sign, cut to two decimals: whole part, point, two digits."""
    cents = F.floor(F.abs("value") * 100)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query("""
SELECT event_id, 'val_loss' AS name, 'val loss' AS raw_name, floor(abs(value) * 100) / 100.0 AS value, false AS percent,
  CAST(1 AS BIGINT) AS line FROM events
UNION ALL
SELECT event_id, 'accuracy', 'acc', CAST(event_id % 100 AS DOUBLE), true, CAST(2 AS BIGINT) FROM events
""")
def metric_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events").select("event_id", "value"))
    text = F.concat(F.lit("step "), F.col("event_id"), F.lit(": val loss "), decimal_text(), F.lit("\nacc="), F.col("event_id") % 100, F.lit("% after all\nlossless 3.11 build")).alias("text")
    out = extract.text_values(extract.lines(e.select("event_id", text)))
    return _long(out.select("event_id", "name", "raw_name", "value", "percent", "line"), "line")


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'accuracy' AS name, l_linenumber / 7.0::DOUBLE AS value,
  concat(l_linenumber, '/7') AS fraction, false AS percent FROM lineitem
""")
def metric_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))
    text = F.concat(F.lit("Accuracy: "), "l_linenumber", F.lit("/7 (9%)"), F.lit("\nloss=4/0"))
    out = extract.text_values(extract.lines(li.select("l_orderkey", "l_linenumber", text.alias("text")))).filter("name = 'accuracy'")
    return _long(out.select("l_orderkey", "l_linenumber", "name", "value", "fraction", "percent"), "l_linenumber")


@query("""
SELECT event_id, 'episodic_return' AS name, CAST(user_id AS DOUBLE) AS value, CAST(1 AS BIGINT) AS line FROM events
UNION ALL SELECT event_id, 'p@1', floor(abs(value) * 100) / 100.0, CAST(2 AS BIGINT) FROM events
""")
def metric_kv_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "value"))
    text = F.concat(F.lit("episodic_return=["), "user_id", F.lit(".]\nP@1\t"), decimal_text())
    out = extract.text_values(extract.lines(e.select("event_id", text.alias("text"))))
    return _long(out.select("event_id", "name", "value", "line"), "line")


@query("""
SELECT event_id, x.name, x.v AS value, x.ord FROM events,
LATERAL (SELECT unnest(['train_loss', 'val_loss', 'lr']) AS name, unnest([user_id + 0.5::DOUBLE, user_id + 0.25::DOUBLE, event_id + 0.125::DOUBLE]) AS v,
  unnest([1, 2, 3])::BIGINT AS ord) x
""")
def metric_order_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id"))
    text = F.concat(F.lit("lr="), "event_id", F.lit(".125 train loss "), "user_id", F.lit(".5, val loss "), "user_id", F.lit(".25"))
    out = extract.text_values(extract.lines(e.select("event_id", text.alias("text"))))
    by_id = out.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "value"))).alias("x"))
    return by_id.select("event_id", F.posexplode("x").alias("at", "v")).select("event_id", "v.name", "v.value", (F.col("at") + 1).cast("long").alias("ord"))


@query("SELECT event_id, 'loss' AS name, CAST(user_id AS DOUBLE) AS value FROM events WHERE event_type <> 'error'")
def exception_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(F.when(F.col("event_type") == "error", "ValueError: loss ").otherwise("loss "), "user_id")
    return extract.text_values(extract.lines(e.select("event_id", text.alias("text")))).select("event_id", "name", "value")


@query("SELECT event_id, 'k' AS raw_name, CAST(json_extract(props, '$.k') AS DOUBLE) AS value, CAST(1 AS BIGINT) AS line FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text"))
    return _long(extract.json_values(e, depth=2).select("event_id", "raw_name", "value", "line"), "line")


@query("""
SELECT o_orderkey, raw_name, value FROM orders, LATERAL (SELECT
  unnest(['test.total', 'test.parts[0]', 'test.parts[2].key']) AS raw_name,
  unnest([floor(o_totalprice), CAST(o_custkey AS DOUBLE), CAST(o_orderkey AS DOUBLE)]) AS value)
""")
def json_nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit('{"test": {"total": '), F.floor("o_totalprice"), F.lit(', "ok": true, "parts": ['), "o_custkey", F.lit(', "x", {"key": '), "o_orderkey", F.lit("}]}}"))
    return extract.json_values(o.select("o_orderkey", text.alias("text")), depth=5).select("o_orderkey", "raw_name", "value")


@query("""
SELECT event_id, x.name, x.v AS value, x.line FROM events, LATERAL (SELECT unnest(['loss', 'step', 'loss']) AS name,
  unnest([CAST(user_id AS DOUBLE), 2.0::DOUBLE, event_id + 0.5::DOUBLE]) AS v, unnest([1, 1, 3])::BIGINT AS line) x
""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"loss": '), "user_id", F.lit(', "step": 2}\nno json here\n{"loss": '), "event_id", F.lit(".5}"))
    return _long(extract.json_values(e.select("event_id", text.alias("text")), depth=2).select("event_id", "name", "value", "line"), "line")


@query("""
SELECT event_id, x.name, x.value, x.line, x.text FROM events, LATERAL (SELECT unnest(['loss', 'accuracy']) AS name,
  unnest([CAST(user_id AS DOUBLE), 0.5::DOUBLE]) AS value, unnest([1, 2])::BIGINT AS line,
  unnest([concat('caf', chr(65533), ' loss ', user_id), concat('acc 0.5 ', chr(65533), 'x', chr(65533))]) AS text) x
""")
def log_bad_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = lambda x: F.lit(x).cast("binary")
    content = F.concat(raw("caf"), F.unhex(F.lit("E9")), raw(" loss "), F.col("user_id").cast("string").cast("binary"), raw("\nacc 0.5 "), F.unhex(F.lit("FF")), raw("x"), F.unhex(F.lit("80")))
    rows = e.select(F.col("event_id"), files.decoded(content).alias("text"))
    return _long(extract.text_values(extract.lines(rows)).select("event_id", "name", "value", "line", "text"), "line")


@query("""
SELECT event_id, x.raw_name, x.value FROM events, LATERAL (SELECT
  unnest([concat('a', repeat('.a', 39), '[1].b'), 'last']) AS raw_name, unnest([CAST(user_id AS DOUBLE), CAST(event_id AS DOUBLE)]) AS value) x
""")
def json_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id"))
    text = F.concat(F.lit('{"a": ' * 40 + '[true, {"b": '), "user_id", F.lit("}]" + "}" * 39 + ', "last": '), "event_id", F.lit("}"))
    return extract.json_values(e.select("event_id", text.alias("text"))).select("event_id", "raw_name", "value")


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, concat('c', i) AS name, CAST(n_nationkey * 5000 + i AS DOUBLE) AS value,
  concat(n_name, ', a "', chr(10), '" b') AS row, CAST(2 AS BIGINT) AS line FROM nation, range(1, 5001) t(i)
""")
def csv_quoted_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    at = F.sequence(F.lit(1), F.lit(5000))
    head = F.array_join(F.transform(at, lambda i: F.concat(F.lit("c"), i)), ",")
    row = F.array_join(F.transform(at, lambda i: (F.col("n_nationkey") * 5000 + i).cast("string")), ",")
    text = F.concat(F.lit("name,"), head, F.lit('\n"'), "n_name", F.lit(', a ""\n"" b",'), row)
    return _long(extract.csv_values(n.select("n_nationkey", text.alias("text"))).select("n_nationkey", "name", "value", "row", "line"), "n_nationkey", "line")


@query("""
SELECT c_custkey, name, value, percent, row, CAST(2 AS BIGINT) AS line FROM (
  SELECT c_custkey, 'nation' AS name, CAST(c_nationkey AS DOUBLE) AS value, false AS percent, c_name AS row FROM customer
  UNION ALL SELECT c_custkey, 'accuracy', CAST(c_custkey % 100 AS DOUBLE), true, c_name FROM customer)
""")
def csv_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("model,nation,segment,acc\n"), "c_name", F.lit(","), "c_nationkey", F.lit(","), "c_mktsegment", F.lit(","), F.col("c_custkey") % 100, F.lit("%"))
    return _long(extract.csv_values(c.select("c_custkey", text.alias("text"))).select("c_custkey", "name", "value", "percent", "row", "line"), "line")


@query("""
SELECT event_id, concat('[', i, '].', k) AS raw_name, CASE WHEN i = 13 THEN 'infinity'::DOUBLE ELSE user_id + i END AS value
FROM events, range(14) t(i), LATERAL (SELECT CASE WHEN i = 13 THEN 'huge' ELSE 'n' END AS k)
""")
def json_flat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small objects side by side, nested two deep, and an integer of 400 digits."""
    e = table(spark, sf_dir, "events")
    objects = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: F.concat(F.lit('{"n": '), F.col("user_id") + i, F.lit(', "s": "[[[[{{"}'))), ",")
    text = F.concat(F.lit("["), objects, F.lit(',{"huge": ' + "9" * 400 + "}]"))
    return extract.json_values(e.select("event_id", text.alias("text"))).select("event_id", "raw_name", "value")


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, concat('a', repeat('[0].a', 249), '[0]') AS raw_name, CAST(n_regionkey AS DOUBLE) AS value FROM nation
""")
def json_500_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit('{"a": [' * 250), "n_regionkey", F.lit("]}" * 250))
    return _long(extract.json_values(n.select("n_nationkey", text.alias("text"))).select("n_nationkey", "raw_name", "value"), "n_nationkey")


@query("""
SELECT event_id, CAST(event_id % 4 = 3 AS BIGINT) AS lines_read, CAST(1 AS BIGINT) AS lines_skipped,
  ['nested over 1000 deep', 'a number of over 1000 digits', 'no valid JSON document', 'lines that are no JSON'][event_id % 4 + 1] AS reason
FROM events WHERE event_type <> 'click'
""")
def json_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bad = F.when(F.col("event_id") % 4 == 0, "[" * 1001 + "]" * 1001).when(F.col("event_id") % 4 == 1, f"[{'9' * 1001}]").when(F.col("event_id") % 4 == 2, '{"a": 1, "a": 2}').otherwise('{"a": 1}\nstep')
    text = F.when(F.col("event_type") == "click", F.col("props")).otherwise(bad)
    return _long(extract.json_refused(e.select("event_id", text.alias("text"))), "lines_read", "lines_skipped")


_NAMES = {
    "Test  Accuracy:": ("test_accuracy", "accuracy"), "acc_val": ("val_accuracy", "accuracy"), "Top-1 accuracy": ("top1_accuracy", "accuracy"),
    "F1-score": ("f1_score", "f1_score"), "best validation loss": ("best_val_loss", "loss"), "AUROC": ("roc_auc", "roc_auc"), "avg. ppl": ("avg._perplexity", "avg._perplexity"),
}


@query(
    "WITH n(raw_name, name, base, lower_better) AS (VALUES "
    + ", ".join(f"('{k}', '{a}', '{b}', {str(b in ('loss', 'perplexity') or a.endswith('perplexity')).lower()})" for k, (a, b) in _NAMES.items())
    + ") SELECT CAST(p_partkey AS BIGINT) AS p_partkey, raw_name, name, base, lower_better FROM part CROSS JOIN n"
)
def metric_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    raw = parts.select("p_partkey", F.explode(F.array(*[F.lit(k) for k in _NAMES])).alias("raw_name"))
    out = raw.withColumn("name", names.normalize_metric(F.col("raw_name")))
    return out.withColumn("base", names.metric_base(F.col("name"))).withColumn("lower_better", names.lower_is_better(F.col("name")))


@query("""
SELECT event_type, count(*) AS count, arg_max(value, event_id) AS last, max(event_id) AS last_id, arg_min(value, event_id) AS first,
  min(event_id) AS first_id, min(value) AS min, arg_min(event_id, (value, event_id)) AS min_id, max(value) AS max,
  arg_min(event_id, (-value, event_id)) AS max_id FROM events GROUP BY event_type
""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.summary(table(spark, sf_dir, "events"), ["event_type"], order="event_id", ident="event_id")


def _select_query(how: str, expression: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select.select(table(spark, sf_dir, "events"), how=how, per=["event_type"], order="event_id")

    run.__name__ = f"select_{how}"
    return query(f"SELECT event_type, {expression} AS value, count(*) AS n FROM events GROUP BY event_type")(run)


select_first = _select_query("first", "arg_min(value, event_id)")
select_last = _select_query("last", "arg_max(value, event_id)")
select_min = _select_query("min", "min(value)")
select_max = _select_query("max", "max(value)")


@query("SELECT user_id, arg_max(value, event_id) AS value, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id")
def select_each_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "name")
    return select.select(e, "click", "last", per=["user_id"], order="event_id")


@query("""
SELECT l_returnflag, CAST(l_suppkey AS BIGINT) AS l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean,
  round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max
FROM lineitem GROUP BY l_returnflag, l_suppkey
""")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select.run_stats(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_suppkey"], "l_quantity")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("""
SELECT user_id, event_id, value, n > 3 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n
  FROM events WHERE event_type IN ('click', 'view')) WHERE k <= 3
""")
def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.col("event_type").alias("name"), F.col("event_id").alias("ord"))
    return extract.wanted(e, ["Click", "view"], ["user_id"], 3).select("user_id", "event_id", "value", "truncated")


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), -2, -1), chr(10)) AS tail FROM documents WHERE NOT ends_with(text, chr(10))")
def line_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(~F.endswith("text", F.lit("\n")))
    return d.select("doc_id", tail(F.col("text"), 2, 1_000_000).alias("tail"))


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'k' ELSE 'loss' END AS name,
  CAST(CASE WHEN event_id % 4 = 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE user_id END AS DOUBLE) AS value FROM events
""")
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    ext = F.when(kind == 0, ".log").when(kind == 1, ".csv").when(kind == 2, ".tsv").otherwise(".json")
    text = F.when(kind == 0, F.concat(F.lit("loss: "), "user_id")).when(kind == 1, F.concat(F.lit("id,loss\nx,"), "user_id")).when(kind == 2, F.concat(F.lit("id\tloss\nx\t"), "user_id")).otherwise(F.col("props"))
    rows = e.select(F.concat(F.col("event_id").cast("string"), ext).alias("path"), F.length(text).alias("size"), text.alias("text"))
    out = files.metric_values(rows)
    return out.select(F.regexp_extract("source", r"^(\d+)", 1).cast("long").alias("event_id"), "name", "value")


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat(event_id % 60, '.5s')
  WHEN 1 THEN concat(event_id % 59 + 1, 'm 05s') ELSE concat(event_id % 24 + 1, 'h 02m') END AS shown FROM events
""")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 3
    seconds = F.when(k == 0, F.col("event_id") % 60 + 0.5).when(k == 1, (F.col("event_id") % 59 + 1) * 60 + 5.0).otherwise((F.col("event_id") % 24 + 1) * 3600 + 130.0)
    return e.select("event_id", duration(seconds).alias("shown"))


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CASE WHEN l_quantity % 3 = 0 THEN '0' WHEN l_quantity % 3 = 1 THEN concat(CAST(l_quantity AS BIGINT), '.25')
  ELSE concat('-', CAST(l_quantity AS BIGINT), '.125') END AS shown FROM lineitem
""")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    x = F.when(q % 3 == 0, F.lit(0.0)).when(q % 3 == 1, q + 0.25).otherwise(-q - 0.125)
    return _long(li.select("l_orderkey", "l_linenumber", compact_number(x).alias("shown")), "l_linenumber")


@query("""
WITH v AS (SELECT concat('m', user_id % 5) AS extraction, concat('m', user_id % 5, '.', event_id) AS id, event_type AS name, concat('r', event_id % 4) AS run, value, event_id AS ord FROM events),
g AS (SELECT extraction, name, run, count(*) AS n, arg_max(id, ord) AS last, arg_max(value, ord) AS last_v, arg_min(id, (value, ord)) AS low, min(value) AS low_v FROM v GROUP BY ALL),
h AS (SELECT extraction, name, count(*) AS n, arg_min(id, ord) AS first, arg_min(value, ord) AS first_v, arg_min(id, (-value, ord)) AS high, max(value) AS high_v FROM v GROUP BY ALL),
l AS (SELECT extraction, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM v GROUP BY ALL)
SELECT id AS selector, CAST(NULL AS VARCHAR) AS run, id, value, CAST(1 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS problem FROM v WHERE ord % 10 = 0
UNION ALL SELECT concat(extraction, ':', upper(name), ':first'), NULL, first, first_v, n, NULL FROM h
UNION ALL SELECT concat(extraction, ':', name, ':max'), NULL, high, high_v, n, NULL FROM h
UNION ALL SELECT concat(extraction, ':', name, '@r3'), 'r3', last, last_v, n, NULL FROM g WHERE run = 'r3'
UNION ALL SELECT concat(extraction, ':', name, ':min@each'), run, low, low_v, n, NULL FROM g
UNION ALL SELECT concat(extraction, ':none'), NULL, NULL, NULL, 0, concat('No ''none'' values in ', extraction, '. Names found: ', names) FROM l
UNION ALL SELECT concat('m9', extraction), NULL, NULL, NULL, 0, concat('Bad selector ''m9', extraction, '''') FROM l
""")
def select_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors of all forms as data, over values of five extractions and four runs."""
    e = table(spark, sf_dir, "events")
    extraction, name = F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")), F.col("event_type")
    values = e.select(extraction.alias("extraction"), F.concat(extraction, F.lit("."), "event_id").alias("id"), name.alias("name"), F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")).alias("run"), "value", F.col("event_id").alias("ord"))
    forms = [F.concat("extraction", F.lit(":"), F.upper("name"), F.lit(":first")), *[F.concat("extraction", F.lit(":"), "name", F.lit(x)) for x in (":max", "@r3", ":min@each")], F.concat("extraction", F.lit(":none")), F.concat(F.lit("m9"), "extraction")]
    wanted = values.select("extraction", "name").distinct().select(F.explode(F.array(*forms)).alias("selector")).unionByName(values.filter("ord % 10 = 0").select(F.col("id").alias("selector")))
    return select.resolve(values, wanted)
