"""Claims in documents rendered from the tables, their identity and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims
from .registry import query, spread, table



@query("""
SELECT s_suppkey, metric, value, percent, plus_minus, line, "row", "column", confidence FROM supplier, LATERAL (SELECT
  unnest(['accuracy', 'f1', 'accuracy', 'params']) AS metric, unnest([s_nationkey + 0.5, CAST(s_nationkey AS DOUBLE), CAST(s_suppkey AS DOUBLE), CAST(s_suppkey AS DOUBLE)]) AS value,
  unnest([true, false, false, false]) AS percent, unnest([NULL, 0.25, NULL, NULL])::DOUBLE AS plus_minus, unnest([4, 4, 5, 11])::BIGINT AS line,
  unnest(['ResNet', 'ResNet', 'Ours', 'big']) AS "row", unnest(['Accuracy', 'F1', 'Accuracy', 'params']) AS "column",
  unnest(['high', 'high', 'high', 'low']) AS confidence)
""")
def claims_markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    c = lambda x: F.col(x).cast("string")
    text = F.concat(
        F.lit("# Results\n| Model | Accuracy | F1 |\n|---|:--:|---|\n| [ResNet](http://x/y) | **"), c("s_nationkey"), F.lit(".5%** | "), c("s_nationkey"), F.lit(" ± 0.25 |\n| `Ours` | "), c("s_suppkey"),
        F.lit(" | n/a |\n\nthe loss table\n\n| size | params |\n|--|--|\n| big | "), c("s_suppkey"), F.lit(" |\n```\n| acc | x |\n|--|--|\n| 1 | 2 |\n```\n"),
    )
    out = claims.markdown_claims(s.select("s_suppkey", text.alias("text")), "s_suppkey")
    return out.select(F.col("source").alias("s_suppkey"), "metric", "value", "percent", "plus_minus", F.col("line").cast("long").alias("line"), "row", "column", "confidence")


@query("""
SELECT p_partkey, metric, value, lo, hi, plus_minus, percent, kind, line FROM part, LATERAL (SELECT
  unnest(['test_accuracy', 'f1', 'best_val_loss', 'accuracy']) AS metric, unnest([NULL, p_size + 0.5, p_size + 0.25, CAST(p_size AS DOUBLE)]) AS value,
  unnest([p_size + 0.0, NULL, NULL, NULL])::DOUBLE AS lo, unnest([p_size + 1.5, NULL, NULL, NULL])::DOUBLE AS hi, unnest([NULL, 0.4, NULL, NULL])::DOUBLE AS plus_minus,
  unnest([true, false, false, true]) AS percent, unnest(['prose', 'prose', 'prose', 'code']) AS kind, unnest([1, 2, 2, 5])::BIGINT AS line)
""")
def claims_range_pm_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    s = F.col("p_size").cast("string")
    text = F.concat(F.lit("Test accuracy lies between "), s, F.lit(" and "), (F.col("p_size") + 1).cast("string"), F.lit(".5%.\nF1 of "), s, F.lit(".5 ± 0.4, best validation loss is "), s, F.lit(".25\n```\npython run.py --loss=3\naccuracy: "), s, F.lit("%\n```"))
    out = claims.markdown_claims(p.select("p_partkey", text.alias("text")), "p_partkey")
    return out.select(F.col("source").alias("p_partkey"), "metric", "value", "lo", "hi", "plus_minus", "percent", "kind", F.col("line").cast("long").alias("line"))


@query("""
SELECT p_partkey, concat('Accuracy is ', p_size, '.5 here.') AS text, CAST(p_size + 0.5 AS DOUBLE) AS value, CAST(1 AS BIGINT) AS page FROM part
""")
def paper_prose_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("We train a mo-\ndel. Accuracy\nis "), F.col("p_size").cast("string"), F.lit(".5 here. Accuracy of 100 runs was good."))
    out = claims.paper_prose_claims(p.select("p_partkey", F.lit(1).alias("page"), text.alias("text")), "p_partkey")
    return out.select(F.col("source").alias("p_partkey"), "text", "value", F.col("page").cast("long").alias("page"))


@query("""
SELECT p_brand, CAST(p_size AS BIGINT) AS p_size, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1, 2
""")
def claims_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("long").alias("p_size"), "p_partkey", "p_name")
    return claims.dedup(p, ["p_brand", "p_size"], "p_partkey")


@query("""
SELECT p_partkey, concat('p', row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS id FROM part
""")
def claim_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.number_claims(table(spark, sf_dir, "part"), "p_brand", "p", "p_partkey").select("p_partkey", "id")


@query("""
WITH k AS (SELECT p_brand, p_type, CAST(p_partkey % 7 + 3 AS BIGINT) AS first_id, p_partkey FROM part),
f AS (SELECT p_brand, p_type, arg_min(first_id, p_partkey) AS f FROM k GROUP BY ALL), t AS (SELECT p_brand, max(f) + 100 AS top FROM f WHERE length(p_type) % 2 = 0 GROUP BY 1)
SELECT p_partkey, concat('p', row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) + CASE WHEN length(p_type) % 2 = 0 THEN f - 1 ELSE coalesce(top, 0) END) AS id
FROM part JOIN f USING (p_brand, p_type) LEFT JOIN t USING (p_brand)
""")
def claim_rescan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan: known labels keep their offset, new ones go on behind the largest id."""
    p = table(spark, sf_dir, "part").withColumn("label", F.col("p_type"))
    first = p.groupBy("p_brand", "label").agg(F.min_by(F.col("p_partkey") % 7 + 3, "p_partkey").alias("first"))
    known = first.filter(F.length("label") % 2 == 0).withColumn("last", F.col("first") + 100)
    return claims.number_claims(p, "p_brand", "p", "p_partkey", known).select("p_partkey", "id")


@query("""
SELECT c_custkey, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey) AS s_suppkey FROM customer
""")
def claim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", F.col("s_suppkey").alias("ord"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    return claims.lookup(s, c, ["k"]).select("c_custkey", F.col("claim.s_suppkey").alias("s_suppkey"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'val_loss' ELSE 'mean_reward' END AS metric FROM part WHERE p_size % 4 < 3
""")
def result_metric_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    metric = F.when(k == 0, "accuracy").when(k == 1, "val_loss").when(k == 2, "mean_reward").otherwise("batch_size")
    return claims.result_claims(table(spark, sf_dir, "part").select("p_partkey", metric.alias("metric")))


@query("""
SELECT c_custkey, CAST(n AS BIGINT) AS n, said FROM (SELECT c_custkey, 3 AS n, [concat('Model ', c_custkey, ' was trained.'), 'It works (see e.g. there)!', '(Note this.)'] AS said FROM customer)
""")
def sentence_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    page = F.concat(F.lit("Model "), "c_custkey", F.lit(" was trai-\nned. It works\n(see e.g. there)!\n(Note this.)"))
    said = claims.sentences(page)
    return c.select("c_custkey", F.size(said).cast("long").alias("n"), said.alias("said"))
