"""Claims against measurements over the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, report, select, verdict
from .registry import query, spread, table


def _claims(df: DataFrame, **given: F.Column) -> DataFrame:
    """Claim columns; what is not given is null."""
    kinds = {"claim_id": "string", "metric": "string", "value": "double", "lo": "double", "hi": "double", "plus_minus": "double", "percent": "boolean", "value_text": "string", "lo_text": "string", "hi_text": "string"}
    extra = {k: v for k, v in given.items() if k not in kinds}
    return df.select(*[given[k].cast(t).alias(k) if k in given else F.lit(None).cast(t).alias(k) for k, t in kinds.items()], *[v.alias(k) for k, v in extra.items()])


def _measured(df: DataFrame, claim: F.Column, value: F.Column, **more: F.Column) -> DataFrame:
    return df.select(claim.alias("claim_id"), value.cast("double").alias("value"), *[v.alias(k) for k, v in more.items()])


@query("""
WITH claim AS (SELECT l_returnflag, avg(l_quantity) AS v FROM lineitem GROUP BY 1),
run AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, CAST(l_suppkey AS BIGINT) AS l_suppkey, CASE WHEN abs(m - v) <= 0.01 * v + 1e-12 THEN 'reproduced'
  WHEN abs(m - v) <= 0.03 * v + 1e-12 THEN 'close' ELSE 'not_reproduced' END AS verdict
FROM run JOIN claim USING (l_returnflag)
""")
def verdict_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    claim = li.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("v"))
    run = li.groupBy("l_returnflag", "l_suppkey").agg(F.avg("l_quantity").alias("m"))
    pairs = run.join(F.broadcast(claim), "l_returnflag")  # one row per return flag
    key = F.concat_ws(":", "l_returnflag", "l_suppkey")
    claims = _claims(pairs, claim_id=key, metric=F.lit("quantity"), value=F.col("v"), flag=F.col("l_returnflag"), supp=F.col("l_suppkey"))
    out = verdict.compare(claims, _measured(run, key, F.col("m")))
    return out.select(F.col("flag").alias("l_returnflag"), F.col("supp").cast("long").alias("l_suppkey"), "verdict")


@query("""
WITH run AS (SELECT l_suppkey, floor(avg(l_discount) * 1000) / 1000 AS m FROM lineitem GROUP BY 1)
SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, true AS claim_pct, round(m * 100, 6) AS mean,
  CASE WHEN abs(m * 100 - 5) <= 0.5 + 1e-9 THEN 'reproduced' WHEN abs(m * 100 - 5) <= 1.5 + 1e-9 THEN 'close' ELSE 'not_reproduced' END AS verdict
FROM run
""")
def verdict_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.floor(F.avg("l_discount") * 1000) / 1000).alias("m"))
    key = F.col("l_suppkey").cast("string")
    claims = _claims(run, claim_id=key, metric=F.lit("accuracy"), value=F.lit(5.0), value_text=F.lit("5"), percent=F.lit(True), supp=F.col("l_suppkey"), tol=F.lit(0.5 + 1e-9), close=F.lit(1.5 + 1e-9))
    out = verdict.compare(claims, _measured(run, key, F.col("m"), percent=F.lit(False)), tol="tol", close="close")
    return out.select(F.col("supp").cast("long").alias("l_suppkey"), "claim_pct", F.round("mean", 6).alias("mean"), "verdict")


@query("""
WITH c AS (SELECT p_brand, CAST(min(p_size) AS DOUBLE) + 5 AS lo, CAST(max(p_size) AS DOUBLE) - 5 AS hi FROM part GROUP BY 1)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size BETWEEN lo AND hi THEN 0.0 WHEN p_size < lo THEN lo - p_size ELSE p_size - hi END AS distance,
  CASE WHEN p_size BETWEEN lo AND hi THEN 0.0 WHEN p_size < lo THEN p_size - lo ELSE p_size - hi END AS signed_difference
FROM part JOIN c USING (p_brand)
""")
def verdict_range_pm(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    c = parts.groupBy("p_brand").agg((F.min("p_size") + 5.0).alias("a"), (F.max("p_size") - 5.0).alias("b"))
    pairs = parts.join(c, "p_brand")
    key = F.col("p_partkey").cast("string")
    # half of the claims are ranges, half the same interval as a value with its plus-minus
    even, mid, half = F.col("p_partkey") % 2 == 0, (F.col("a") + F.col("b")) / 2, (F.col("b") - F.col("a")) / 2
    claims = _claims(pairs, claim_id=key, metric=F.lit("size"), lo=F.when(even, F.col("b")), hi=F.when(even, F.col("a")), value=F.when(~even, mid), plus_minus=F.when(~even, half), part=F.col("p_partkey"))
    out = verdict.compare(claims, _measured(parts, key, F.col("p_size")))
    return out.select(F.col("part").cast("long").alias("p_partkey"), "distance", "signed_difference")


@query("""
WITH x AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.05 WHEN 2 THEN 0.005 ELSE 0.5 END AS half FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, greatest(0.001::DOUBLE * p_size, half) AS tol_abs, 3.0::DOUBLE * greatest(0.001::DOUBLE * p_size, half) AS close_abs FROM x
""")
def verdict_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    key, k, s = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit(".0"))).when(k == 2, F.concat(s, F.lit(".00"))).otherwise(F.concat(s, F.lit(".5e0")))
    claims = _claims(parts, claim_id=key, metric=F.lit("size"), value=F.col("p_size"), value_text=text, rel=F.lit(0.001), part=F.col("p_partkey"))
    out = verdict.compare(claims, _measured(parts, key, F.col("p_size")), rel="rel")
    return out.select(F.col("part").cast("long").alias("p_partkey"), "tol_abs", "close_abs")


@query("""
SELECT CAST(o_custkey AS BIGINT) AS o_custkey,
  CASE WHEN bool_or(o_orderpriority LIKE '1%') THEN 'inconclusive' WHEN bool_or(o_orderstatus = 'F') THEN 'reimplemented' ELSE 'reproduced' END AS verdict,
  CASE WHEN bool_or(o_orderpriority LIKE '1%' OR o_orderstatus = 'F') THEN 'reproduced' END AS numbers_alone,
  NOT bool_or(o_orderpriority LIKE '1%' OR o_orderstatus = 'F') AS counts_as_reproduction,
  CASE WHEN bool_or(o_orderpriority LIKE '1%') THEN 'INCONCLUSIVE (shortened run)' WHEN bool_or(o_orderstatus = 'F') THEN 'REIMPLEMENTED (numbers match)' ELSE 'REPRODUCED' END AS label
FROM orders GROUP BY o_custkey
""")
def verdict_scope_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string")
    claims = _claims(o.select("o_custkey").distinct(), claim_id=key, metric=F.lit("accuracy"), value=F.lit(1.0), cust=F.col("o_custkey"))
    scope = F.when(F.startswith("o_orderpriority", F.lit("1")), "shortened").otherwise("setup")
    runs = _measured(o, key, F.lit(1.0), scope=scope, origin=F.when(F.col("o_orderstatus") == "F", "authored").otherwise("repo"), run=F.col("o_orderkey"))
    out = verdict.compare(claims, runs)
    return out.select(F.col("cust").cast("long").alias("o_custkey"), "verdict", "numbers_alone", "counts_as_reproduction", "label")


@query("""
WITH x AS (SELECT event_id, user_id, event_id % 6 AS k, event_type = 'error' AS bad FROM events WHERE event_type IN ('error', 'purchase')),
last AS (SELECT user_id, arg_max(k, event_id) AS k, max(event_id) AS seq FROM x WHERE bad GROUP BY 1)
SELECT CAST(user_id AS BIGINT) AS user_id, seq, CASE k WHEN 0 THEN 'broken_deps' WHEN 1 THEN 'gpu_required' WHEN 2 THEN 'timeout' WHEN 3 THEN 'data_unavailable' WHEN 4 THEN 'data_unavailable' ELSE 'run_failed' END AS reason,
  CASE k WHEN 0 THEN 'COULD NOT RUN (dependencies do not install)' WHEN 1 THEN 'COULD NOT RUN (GPU required)' WHEN 2 THEN 'COULD NOT RUN (time limit reached)' WHEN 5 THEN 'COULD NOT RUN (the run failed)' ELSE 'COULD NOT RUN (data unavailable)' END AS label
FROM last
""")
def could_not_run_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase")).withColumn("k", F.col("event_id") % 6)
    texts = ["", "RuntimeError: CUDA error: device-side assert", "killed", "urllib: HTTP Error 404: gone", "FileNotFoundError: data/train.csv", "ValueError: bad shape"]
    error = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("k") + 1).cast("int"))
    bad = F.col("event_type") == "error"
    rows = e.select(F.col("user_id").cast("string").alias("claim_id"), F.col("event_id").cast("string").alias("id"), error.alias("error"), F.col("event_id").alias("seq"), "k", bad.alias("bad"))
    envs = rows.filter("k = 0").withColumn("status", F.when(F.col("bad"), "failed").otherwise("ok"))
    runs = rows.filter("k > 0").withColumn("exit_code", F.when(F.col("bad"), 1).otherwise(0)).withColumn("timed_out", (F.col("k") == 2) & F.col("bad"))
    steps = verdict.blocking_step(envs, runs, ["claim_id"])
    out = verdict.could_not_run(rows.select("claim_id").distinct(), steps)
    return out.select(F.col("claim_id").cast("long").alias("user_id"), F.col("id").cast("long").alias("seq"), "reason", "label")


@query("""
SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CASE WHEN o_orderkey < max(o_orderkey) OVER (PARTITION BY o_custkey)
  THEN max(o_orderkey) OVER (PARTITION BY o_custkey) END AS superseded_by FROM orders
""")
def current_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"))
    return verdict.current(o, "o_custkey", "o_orderkey")


@query("SELECT CAST(o_custkey AS BIGINT) AS o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def latest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderkey", "o_totalprice")
    return verdict.latest(o, "o_custkey", "o_orderkey")


@query("""
WITH cur AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS label FROM orders GROUP BY 1)
SELECT c_mktsegment, label, count(*) AS n FROM cur JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("label"))
    rows = verdict.current(o, "o_custkey", "o_orderkey").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return report.verdict_counts(rows, ["c_mktsegment"])


@query("""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, same, ratio FROM (
  SELECT p_partkey, p_size % 3 <> 2 AS same, p_size % 3 = 0 AS ratio FROM part)
""")
def name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import names

    parts, k = table(spark, sf_dir, "part"), F.col("p_size") % 3
    claim = F.when(k == 0, "accuracy").when(k == 1, "val_loss").otherwise("f1")
    found = F.when(k == 0, "test.acc").when(k == 1, "best_loss").otherwise("test.bleu")
    return parts.select(F.col("p_partkey").cast("long").alias("p_partkey"), names.same_quantity(claim, found).alias("same"), (names.is_ratio(claim) & (k == 0)).alias("ratio"))


@query("""
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, count(*) AS n_run, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_ok,
  CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS seconds, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (WHERE o_orderpriority LIKE '1%'), 0) AS BIGINT) AS run_seconds
FROM orders GROUP BY 1
""")
def command_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_custkey").cast("long").alias("o_custkey"), F.when(F.startswith("o_orderpriority", F.lit("1")), "full").otherwise("setup").alias("scope"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("exit_code"), F.floor("o_totalprice").alias("wall_seconds"))
    out = report.command_totals(runs, ["o_custkey"])
    return out.withColumn("seconds", F.col("seconds").cast("long")).withColumn("run_seconds", F.col("run_seconds").cast("long"))


@query("""
WITH v AS (SELECT event_type, user_id, arg_max(event_id % 100, event_id) AS last FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS n, round(avg(last), 6) AS mean, CASE WHEN abs(avg(last) - 50) <= 0.5 + 1e-12 THEN 'reproduced'
  WHEN abs(avg(last) - 50) <= 1.5 + 1e-12 THEN 'close' ELSE 'not_reproduced' END AS verdict FROM v GROUP BY 1
""")
def verdict_from_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: log lines, values, the last value of each run, statistics, claim, verdict."""
    e = spread(table(spark, sf_dir, "events").select("event_type", "user_id", "event_id"))
    text = F.concat(F.lit("epoch done, test accuracy: "), F.col("event_id") % 100, F.lit("%"))
    rows = e.select("event_type", "user_id", "event_id", text.alias("text"))
    values = extract.text_values(extract.lines(rows)).withColumn("at", F.col("event_id"))
    per_run = select.select(values, "test_accuracy", "last", per=["event_type", "user_id"], order="at")
    key = F.col("event_type")
    claims = _claims(e.select("event_type").distinct(), claim_id=key, metric=F.lit("test_accuracy"), value=F.lit(50.0), value_text=F.lit("50"), percent=F.lit(True))
    out = verdict.compare(claims, _measured(per_run, key, F.col("value"), percent=F.lit(True), run=F.col("user_id")))
    return out.select(F.col("claim_id").alias("event_type"), "n", F.round("mean", 6).alias("mean"), "verdict")


@query("""
WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, p_size % 2 = 0 AS hit FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, list_filter([concat('Claimed: size ', CAST(s AS BIGINT), '.'),
  concat('Measured once: ', CAST(CASE WHEN hit THEN s ELSE s + 10 END AS BIGINT), '.'),
  CASE WHEN hit THEN 'The value is exactly the claimed one.' ELSE 'Off by 10.' END,
  CASE WHEN NOT hit THEN 'That is better than claimed.' END, 'Tolerance 0.5, close band 1.5.', 'One run does not show the variation between runs.'],
  lambda t: t IS NOT NULL)[1:3] AS said FROM x
""")
def verdict_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    claims = _claims(parts, claim_id=key, metric=F.lit("size"), value=F.col("p_size"), value_text=F.col("p_size").cast("string"), part=F.col("p_partkey"))
    out = verdict.compare(claims, _measured(parts, key, F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 10)))
    return out.select(F.col("part").cast("long").alias("p_partkey"), F.slice(verdict.reasoning(), 1, 3).alias("said"))


@query("""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('REPRODUCED: size claimed ', p_size, ', measured ', p_size, ', an exact match (tolerance 0.5).')
  ELSE concat('NOT REPRODUCED: size claimed ', p_size, ', measured ', p_size + 10, ', 10 away (beyond 1.5).') END AS headline FROM part
""")
def verdict_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    claims = _claims(parts, claim_id=key, metric=F.lit("size"), value=F.col("p_size"), value_text=F.col("p_size").cast("string"), part=F.col("p_partkey"))
    out = verdict.compare(claims, _measured(parts, key, F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 10)))
    return out.select(F.col("part").cast("long").alias("p_partkey"), verdict.headline().alias("headline"))
