"""Tables rebuilt from rendered grids, cell syntax, confidence and joins by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, layout, paper, report
from .registry import query, table


def _word(x: float, y: float, text: F.Column, width: float = 20.0) -> F.Column:
    d = lambda v: F.lit(float(v))
    return F.struct(d(x).alias("x0"), d(x + width).alias("x1"), d(y).alias("top"), d(y + 9).alias("bottom"), d(9).alias("size"), text.alias("text"))


def _grid_pages(suppliers: DataFrame) -> DataFrame:
    """One page for each supplier: a caption over a grid of three rows and two columns."""
    s = lambda c: F.col(c).cast("string")
    words = [_word(100, 100, F.lit("Table"), 22), _word(125, 100, F.lit("1:")), _word(150, 100, F.lit("Accuracy"), 40), _word(194, 100, F.lit("here"))]
    words += [_word(100, 120, F.lit("Model")), _word(200, 120, F.lit("SetA")), _word(300, 120, F.lit("SetB"))]
    cells = [("ours", F.concat(s("s_nationkey"), F.lit(".5")), F.concat(s("s_suppkey"), F.lit("%"))), ("base", s("s_nationkey"), F.lit("-")), ("old", F.concat(s("s_suppkey"), F.lit("*")), F.lit("3,327"))]
    for k, (name, a, b) in enumerate(cells):
        words += [_word(100, 134 + 14 * k, F.lit(name)), _word(200, 134 + 14 * k, a), _word(300, 134 + 14 * k, b)]
    rule = "array<struct<x:double,top:double,bottom:double>>"
    hrule = "array<struct<y:double,x0:double,x1:double>>"
    return suppliers.select(s("s_suppkey").alias("doc"), F.lit(1).alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.array(*words).alias("words"), F.array().cast(rule).alias("rules"), F.array().cast(hrule).alias("hrules"))


@query("""
SELECT s_suppkey, x.r AS "row", x.c AS "column", x.v AS value, x.p AS percent, 'accuracy' AS metric, 'high' AS confidence, 0.9::DOUBLE AS confidence_score FROM supplier, LATERAL (SELECT
  unnest(['ours', 'ours', 'base', 'old']) AS r, unnest(['SetA', 'SetB', 'SetA', 'SetA']) AS c, unnest([s_nationkey + 0.5::DOUBLE, CAST(s_suppkey AS DOUBLE), CAST(s_nationkey AS DOUBLE), CAST(s_suppkey AS DOUBLE)]) AS v,
  unnest([false, true, false, false]) AS p) x
""")
def table_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = layout.table_claims(layout.table_cells(_grid_pages(table(spark, sf_dir, "supplier"))))
    return claims.select(F.col("doc").cast("long").alias("s_suppkey"), "row", "column", "value", "percent", "metric", "confidence", "confidence_score")


@query("""
SELECT s_suppkey, concat('|  | SetA | SetB |', chr(10), '| --- | --- | --- |', chr(10), '| ours | ', s_nationkey, '.5 | ', s_suppkey, '% |', chr(10), '| base | ', s_nationkey, ' | - |', chr(10), '| old | ', s_suppkey, '* | 3,327 |') AS markdown FROM supplier
""")
def tables_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layout.table_cells(_grid_pages(table(spark, sf_dir, "supplier")))
    out = report.tables_markdown(cells.select("doc", "tbl", "row_index", "label", F.col("section").alias("group"), "column_index", "column", F.col("text").alias("value")), ["doc", "tbl"])
    return out.select(F.col("doc").cast("long").alias("s_suppkey"), "markdown")


@query("""
SELECT p_partkey, kind, CASE WHEN kind IN ('value', 'pair') THEN p_size + CASE WHEN k < 3 THEN 0.5::DOUBLE ELSE 0 END END AS value, CASE WHEN kind IN ('value', 'pair') THEN k = 1 END AS percent,
  CASE WHEN k = 1 THEN 0.7::DOUBLE END AS plus_minus, CASE WHEN kind = 'pair' THEN p_size + 1.5::DOUBLE END AS second
FROM (SELECT *, ['value', 'value', 'value', 'pair', 'empty', 'sci', 'count', 'count', 'bound', NULL][k + 1] AS kind FROM (SELECT p_partkey, p_size, p_partkey % 10 AS k FROM part))
""")
def parse_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey") % 10, F.col("p_size").cast("string")
    forms = [F.concat(s, F.lit(".5 (7s)")), F.concat(s, F.lit(".5 ± 0.7%")), F.concat(s, F.lit(".5^†")), F.concat(s, F.lit("/"), (F.col("p_size") + 1).cast("string"), F.lit(".5")), F.lit("–"), F.concat(s, F.lit(".3 · 10^19")), F.concat(s, F.lit("k")), F.lit("3,327"), F.concat(F.lit("> "), s), F.lit("ResNet 50")]
    cell = layout.parse_cell(F.element_at(F.array(*forms), (k + 1).cast("int")))
    return p.select("p_partkey", cell.alias("c")).select("p_partkey", "c.kind", "c.value", "c.percent", "c.plus_minus", "c.second")


@query("""
SELECT p_partkey, round(greatest(0, 1 - (CASE WHEN a THEN 0.35 WHEN b THEN 0.15 ELSE 0 END + CASE WHEN c THEN 0.15 ELSE 0 END + CASE WHEN d THEN 0.25 ELSE 0.1 END + CASE WHEN e THEN 0.5 ELSE 0 END)), 2)::DOUBLE AS score,
  CASE WHEN 1 - (CASE WHEN a THEN 0.35 WHEN b THEN 0.15 ELSE 0 END + CASE WHEN c THEN 0.15 ELSE 0 END + CASE WHEN d THEN 0.25 ELSE 0.1 END + CASE WHEN e THEN 0.5 ELSE 0 END) >= 0.7999 THEN 'high'
  WHEN 1 - (CASE WHEN a THEN 0.35 WHEN b THEN 0.15 ELSE 0 END + CASE WHEN c THEN 0.15 ELSE 0 END + CASE WHEN d THEN 0.25 ELSE 0.1 END + CASE WHEN e THEN 0.5 ELSE 0 END) >= 0.5499 THEN 'medium' ELSE 'low' END AS level
FROM (SELECT p_partkey, p_size % 2 = 0 AS a, p_size % 3 = 0 AS b, p_size % 5 = 0 AS c, p_size % 7 = 0 AS d, p_size % 11 = 0 AS e FROM part)
""")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_size")
    place = F.when(n % 7 == 0, "caption-several").otherwise("caption")
    row = F.when(n % 11 == 0, "net 94.5").otherwise("net 50")
    c = layout.confidence(F.when(n % 2 == 0, F.lit(None).cast("string")).otherwise("Cora"), n % 3 == 0, row, n % 5 == 0, place, F.lit(None).cast("string"), F.lit(False))
    return p.select("p_partkey", c.alias("c")).select("p_partkey", "c.score", "c.level")


@query("""
SELECT p_brand AS doc, count(*) AS cells, count(*) FILTER (WHERE p_size <> 1) AS claims, count(*) FILTER (WHERE p_size > 10) AS correct FROM part GROUP BY 1
""")
def table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    at = [F.col("p_brand").alias("doc"), F.lit("Table 1").alias("table"), F.lit(1).alias("page"), F.concat(F.lit("Row "), "p_partkey", F.lit(" [3]")).alias("row"), F.lit("Col").alias("column")]
    expected = p.select(*at, F.col("p_size").cast("double").alias("value"))
    got = p.filter("p_size <> 1").select(*at, F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).otherwise(-1.0).alias("value"))
    return layout.score_claims(got, expected).select("doc", "cells", "claims", "correct")


@query("""
SELECT CAST(a.l_suppkey AS BIGINT) AS l_suppkey, a.l_orderkey AS a, b.l_orderkey AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS overlap FROM
  (SELECT l_suppkey, l_orderkey, l_extendedprice AS x0, l_extendedprice + l_quantity AS x1 FROM lineitem WHERE l_linenumber = 1) a JOIN
  (SELECT l_suppkey, l_orderkey, l_extendedprice AS x0, l_extendedprice + l_quantity AS x1 FROM lineitem WHERE l_linenumber = 2) b
  ON a.l_suppkey = b.l_suppkey AND a.x0 < b.x1 AND b.x0 < a.x1 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0
""")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    spans = lambda n: li.filter(F.col("l_linenumber") == n).select(F.col("l_suppkey").cast("long").alias("l_suppkey"), "l_orderkey", F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("x1"))
    out = geometry.overlap_join(spans(1), spans(2), ["l_suppkey"], 50.0)
    return out.select("l_suppkey", F.col("l_orderkey").alias("a"), F.col("r_l_orderkey").alias("b"), "overlap")


@query("""
WITH m AS (SELECT user_id, event_id, event_id AS y FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, event_id FROM events WHERE event_type = 'error')
SELECT CAST(p.user_id AS BIGINT) AS user_id, p.event_id, CAST(arg_min(m.y, (abs(m.y - p.event_id), m.y)) AS VARCHAR) AS nearest, min(abs(m.y - p.event_id)) AS distance FROM p JOIN m USING (user_id) GROUP BY ALL
""")
def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("long"))
    labels = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("y"), F.col("event_id").cast("string").alias("label"))
    points = e.filter("event_type = 'error'").select("user_id", "event_id", F.col("event_id").alias("y"))
    return geometry.nearest_join(points, labels, ["user_id"]).filter("nearest is not null").select("user_id", "event_id", "nearest", "distance")


@query("""
SELECT s_suppkey, CAST(n AS BIGINT) AS n_lines, words FROM (SELECT s_suppkey, 2 AS n, [concat('ab', s_suppkey), 'c', 'd'] AS words FROM supplier)
""")
def line_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters at rendered places -> words -> lines."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in part.itertuples():
            chars = [(100 + 5 * k, 105 + 5 * k, 100, 109, 9, c) for k, c in enumerate(f"ab{r.s_suppkey}")]
            chars += [(200, 205, 101, 110, 9, "c"), (100, 105, 130, 139, 9, "d")]
            words = layout.words_from_chars(chars)
            lines = layout.cut_lines(words, [])
            rows.append((r.s_suppkey, len(lines), [w.text for ln in lines for w in ln.words]))
        return pd.DataFrame(rows, columns=["s_suppkey", "n_lines", "words"])

    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.mapInPandas(lambda parts: map(run, parts), "s_suppkey long, n_lines long, words array<string>")


@query("""
SELECT s_suppkey, x.r AS "row", x.c AS "column", x.v AS value, x.pm AS plus_minus, 'accuracy' AS metric, 0.3::DOUBLE AS confidence_score FROM supplier, LATERAL (SELECT
  unnest(['GCN', 'GCN', 'Ours']) AS r, unnest(['SetA', 'SetB', 'SetA']) AS c, unnest([s_nationkey + 0.5::DOUBLE, CAST(s_suppkey AS DOUBLE), CAST(s_nationkey AS DOUBLE)]) AS v, unnest([NULL, NULL, 0.25])::DOUBLE AS pm) x
""")
def text_table_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("Some prose.\nTable 2: Accuracies of models\nModel SetA SetB\nGCN [3] "), s("s_nationkey"), F.lit(".5 (7s) "), s("s_suppkey"), F.lit("\nOurs "), s("s_nationkey"), F.lit(" ± 0.25 –\nThe table shows 3 things.\nLate 4 5"))
    pages = table(spark, sf_dir, "supplier").select(s("s_suppkey").alias("doc"), F.lit(1).alias("page"), text.alias("text"))
    return paper.text_table_claims(pages).select(F.col("doc").cast("long").alias("s_suppkey"), "row", "column", "value", "plus_minus", "metric", "confidence_score")


@query("""
SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'text' ELSE 'layout' END AS reader, CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 4 END AS n, s_nationkey % 3 = 0 AS failed FROM supplier
""")
def table_layout_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a rule that has no place fail to lay out; their documents are read as text, the reason noted."""
    s = table(spark, sf_dir, "supplier")
    bad = s.filter("s_nationkey % 3 = 0").select(F.col("s_suppkey").cast("string").alias("doc"))
    pages = _grid_pages(s)
    lost = F.array(F.lit(None).cast("struct<y:double,x0:double,x1:double>"))
    words = pages.join(bad.withColumn("bad", F.lit(True)), "doc", "left").withColumn("hrules", F.when(F.col("bad"), lost).otherwise(F.col("hrules"))).drop("bad")
    texts = s.select(F.col("s_suppkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.lit("Table 1: Accuracy\nNet 5.5").alias("text"))
    out = paper.paper_tables(words, texts)
    failed = F.max(F.exists("confidence_notes", lambda n: n.startswith("layout failed")))
    return out.groupBy(F.col("doc").cast("long").alias("s_suppkey"), "reader").agg(F.count(F.lit(1)).alias("n"), failed.alias("failed"))


@query("""
SELECT s_suppkey, reader, count(*) AS n FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'layout' ELSE 'text' END AS reader, unnest(CASE WHEN s_nationkey % 2 = 0 THEN [1, 2, 3, 4] ELSE [1] END) FROM supplier) GROUP BY ALL
""")
def table_reader_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    words = _grid_pages(s.filter("s_nationkey % 2 = 0"))
    texts = s.select(F.col("s_suppkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.lit("Table 1: Accuracy\nNet 5.5").alias("text"))
    return paper.paper_tables(words, texts).groupBy(F.col("doc").cast("long").alias("s_suppkey"), "reader").agg(F.count(F.lit(1)).alias("n"))
