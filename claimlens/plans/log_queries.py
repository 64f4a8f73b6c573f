"""The evidence log and reports over the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..operators import evidence, report
from ..sources.chainlog import ChainLog
from ..sources.shared import fresh
from .registry import query, table


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER w AS seq, sha256(concat(event_id, '|', event_type)) AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, CAST(user_id AS BIGINT) AS user_id, seq, list_filter([
  CASE WHEN (CASE WHEN event_id % 17 = 0 THEN 'x' ELSE coalesce(lag(h) OVER w, repeat('0', 64)) END) <> coalesce(lag(h) OVER w, repeat('0', 64)) THEN 'chain broken' END,
  CASE WHEN event_id % 13 = 0 THEN 'content hash mismatch' END], lambda x: x IS NOT NULL) AS problems
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq)
""")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain in which every 17th link and every 13th content were tampered with."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    own = F.sha2(F.concat_ws("|", "event_id", "event_type"), 256)
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("user_id"), F.row_number().over(w).cast("long").alias("seq"), own.alias("hash"), "event_type")
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("user_id").orderBy("seq")), F.lit(evidence.GENESIS))
    log = e.withColumn("prev", F.when(F.col("event_id") % 17 == 0, "x").otherwise(before))
    again = F.when(F.col("event_id") % 13 == 0, F.sha2(F.lit("tampered"), 256)).otherwise(own)
    return evidence.verify(log, "user_id", again).select("event_id", "user_id", "seq", "problems")


@query("""
WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS seq, sha256(concat(event_id, '|', event_type)) AS h FROM events)
SELECT event_id, seq, list_filter([
  CASE WHEN event_id % 17 = 0 AND seq > 1 THEN 'chain broken' END,
  CASE WHEN event_id % 13 = 0 THEN 'content hash mismatch' END], lambda x: x IS NOT NULL) AS problems
FROM e
""")
def chain_verify_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one study, with every 17th link and every 13th content tampered with."""
    e = table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256).alias("hash"))
    e = numbered(e, [], ["event_id"], "seq").withColumn("seq", F.col("seq").cast("long"))
    before = e.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("prev"))
    linked = e.join(before, "seq", "left").withColumn("prev", F.when((F.col("event_id") % 17 == 0) & (F.col("seq") > 1), "x").otherwise(F.coalesce("prev", F.lit(evidence.GENESIS))))
    again = F.when(F.col("event_id") % 13 == 0, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("hash"))
    return evidence.verify(linked.withColumn("study", F.lit("all")), "study", again, segment=4096).select("event_id", "seq", "problems")


@query("""
WITH RECURSIVE e AS (SELECT CAST(o_custkey AS VARCHAR) AS study, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) AS seq FROM orders),
c AS (
  SELECT study, CAST(0 AS BIGINT) AS seq, '' AS prev, repeat('0', 64) AS hash FROM e GROUP BY study
  UNION ALL SELECT e.study, e.seq, c.hash, sha256(concat('{"key": ', o_orderkey, ', "kind": "order", "prev": "', c.hash, '", "seq": ', e.seq, ', "status": "é', o_orderstatus, '", "ts": "2025-01-01T00:00:00Z"}'))
  FROM c JOIN e ON e.study = c.study AND e.seq = c.seq + 1)
SELECT study, seq, prev, hash FROM c WHERE seq > 0
""")
def chain_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appends to a log of one study a customer, the last of them tried twice."""
    o = table(spark, sf_dir, "orders")
    payload = F.concat(F.lit('{"status": "é'), "o_orderstatus", F.lit('", "key": '), "o_orderkey", F.lit(', "seq": -1}'))
    rows = o.select(F.col("o_custkey").alias("study"), F.lit("order").alias("kind"), payload.alias("payload"), F.col("o_orderkey").alias("ord"))
    log = ChainLog(spark, fresh(spark, "log"))
    for k in (0, 1, 2, 2):
        log.append(rows.filter(F.col("ord") % 3 == k), token=f"batch-{k}", ts="2025-01-01T00:00:00Z")
    return log.entries().select("study", "seq", "prev", "hash")


@query("""
WITH RECURSIVE e AS (SELECT CAST(o_custkey AS BIGINT) AS study, CAST(o_orderkey AS VARCHAR) AS content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders),
c AS (SELECT study, content, seq, repeat('0', 64) AS prev, sha256(concat(repeat('0', 64), '|', content)) AS hash FROM e WHERE seq = 1
  UNION ALL SELECT e.study, e.content, e.seq, c.hash, sha256(concat(c.hash, '|', e.content)) FROM c JOIN e ON e.study = c.study AND e.seq = c.seq + 1)
SELECT study, content, seq, prev, hash FROM c
""")
def chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("long").alias("study"), "o_orderkey", F.col("o_orderkey").cast("string").alias("content"))
    return evidence.build(rows, "study", "o_orderkey", "content").select("study", "content", "seq", "prev", "hash")


@query("""
SELECT CAST(user_id AS BIGINT) AS user_id, event_type AS id, arg_max(value, event_id) AS value, max(event_id) AS seq, min(event_id) AS first_seq FROM events GROUP BY 1, 2
""")
def log_replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_type").alias("id"), "value", F.col("event_id").alias("seq"))
    return evidence.replay(log, ["user_id"]).select("user_id", "id", "value", "seq", "first_seq")


@query("""
WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, event_id % 3 = 0 AS restored FROM events WHERE event_type IN ('error', 'signup')),
s AS (SELECT user_id, max(event_id) FILTER (WHERE ok) AS g, max(event_id) FILTER (WHERE NOT ok AND NOT restored) AS b FROM e GROUP BY 1)
SELECT CAST(user_id AS BIGINT) AS user_id, CASE WHEN b IS NULL OR g > b THEN CAST(g AS VARCHAR) END AS active_env FROM s
""")
def active_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup"))
    envs = e.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.when((F.col("event_id") % 3) == 0, "env").alias("restored"), F.col("event_id").alias("seq"))
    return evidence.active_env(envs, "user_id")


@query("SELECT CAST(user_id AS BIGINT) AS user_id, concat('r', count(*) FILTER (WHERE event_type = 'click') + 1) AS next_id FROM events GROUP BY 1")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_type").alias("kind"))
    return evidence.next_id(log, ["user_id"], "r", "click")


@query("""
SELECT event_id, seq, kind, sha256(concat('{"kind": "', event_type, '", "prev": "0", "seq": ', event_id, '}')) AS hash FROM (
  SELECT event_id, event_id AS seq, event_type AS kind, event_type FROM events)
""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('{"seq": '), "event_id", F.lit(', "prev": "0", "hash": "none", "kind": "'), "event_type", F.lit('"}'))
    log = evidence.scan(e.select("event_id", raw.alias("value")), ["event_id"])
    return log.select("event_id", "seq", "kind", evidence.canonical_hash(F.col("raw")).alias("hash"))


@query("""
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_size > 40 THEN 'file missing' WHEN p_size % 5 = 0 THEN 'file changed' END AS problem FROM part
""")
def file_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = F.col("p_partkey").cast("string").alias("path")
    stated = p.select(path, F.sha2("p_name", 256).alias("sha256"))
    found = p.filter("p_size <= 40").select(path, F.sha2(F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), 256).alias("sha256"))
    return evidence.verify_files(stated, found).select(F.col("path").cast("long").alias("p_partkey"), "problem")


@query("""
WITH open AS (SELECT c_nationkey, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM open)
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n, list(c_custkey ORDER BY c_custkey) FILTER (WHERE k <= 6) AS sample FROM r GROUP BY 1
""")
def not_checked_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("c_nationkey"), F.col("c_custkey").alias("claim_id"), F.col("c_custkey").alias("ord"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("claim_id"))
    return report.not_compared(c, done, "c_nationkey")


@query("""
SELECT CAST(k AS BIGINT) AS k, rank, text FROM (
  SELECT c_nationkey AS k, 0 AS rank, concat('env ', c_custkey) AS text FROM customer WHERE c_custkey % 50 = 0
  UNION ALL SELECT c_nationkey, 1, concat(c_custkey, ': cut') FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT c_nationkey, 2, concat('note ', c_custkey) FROM customer WHERE c_custkey % 70 = 0)
""")
def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), "c_custkey", "c_mktsegment", F.col("c_custkey").alias("seq"))
    envs = c.filter("c_custkey % 50 = 0").select("k", "seq", F.array(F.concat(F.lit("env "), "c_custkey")).alias("deviations"))
    runs = c.select("k", "seq", F.col("c_custkey").cast("string").alias("id"), F.lit("cut").alias("note"), F.when(F.col("c_mktsegment") == "BUILDING", "shortened").otherwise("full").alias("scope"))
    notes = c.select("k", "seq", F.when(F.col("c_custkey") % 70 == 0, "deviation").otherwise("observation").alias("note_kind"), F.concat(F.lit("note "), "c_custkey").alias("text"))
    return report.deviations(envs, runs, notes, "k").select("k", "rank", "text")


@query("""
SELECT event_id, concat('https://img.shields.io/badge/claim--lens-', replace(replace(replace(concat(upper(event_type), '_OK ', event_id, '% vs ', user_id, '%'), '_', '__'), '%', '%25'), ' ', '%20'),
  CASE WHEN event_type = 'click' THEN '-1f7a3a' ELSE '-b42318' END) AS url FROM events
""")
def badge_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    shown = lambda c: F.concat(F.col(c).cast("string"), F.lit("%"))
    verdict = F.when(F.col("event_type") == "click", "reproduced").otherwise("not_reproduced")
    url = report.badge_url(F.lit("claim-lens"), F.concat(F.upper("event_type"), F.lit("_OK")), shown("event_id"), shown("user_id"), verdict)
    return e.select("event_id", url.alias("url"))


@query("""
SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS n_values, list_sort(list(DISTINCT event_type))[1:3] AS names FROM events GROUP BY 1
""")
def metric_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("event_type").alias("name"))
    return report.metric_status(e, ["user_id"], 3)


@query("""
SELECT c_mktsegment, concat(count(*), ' claims compared: ', count(*) FILTER (WHERE c_custkey % 5 > 0), ' reproduced, ', count(*) FILTER (WHERE c_custkey % 5 = 0), ' partial.') AS overall
FROM customer GROUP BY 1
""")
def overall_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("label", F.when(F.col("c_custkey") % 5 == 0, "PARTIAL").otherwise("REPRODUCED"))
    return report.overall(report.verdict_counts(c, ["c_mktsegment"]), ["c_mktsegment"])


@query("""
SELECT CAST(n_regionkey AS BIGINT) AS study, CAST(to_json({'claims': list({'id': n_nationkey, 'name': n_name} ORDER BY n_nationkey)}) AS VARCHAR) AS claims FROM nation GROUP BY 1
""")
def report_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("study"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    none = n.limit(0).select("study", F.col("name").alias("x"))
    doc = report.assemble(n, none, none, "study")
    return doc.select("study", F.to_json(F.struct(F.from_json("report", "claims array<struct<id int, name string>>")["claims"].alias("claims"))).alias("claims"))


@query("""
SELECT CAST(n_regionkey AS BIGINT) AS study, concat('| Claim | Verdict | Summary |', chr(10), '|---|---|---|', chr(10), string_agg(concat('| ', n_name, ' | PARTIAL | near |'), chr(10) ORDER BY n_name), chr(10), chr(10), '## Not checked', chr(10), chr(10), '- ', min(n_nationkey), ' left') AS report FROM nation GROUP BY 1
""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("study"), F.col("n_name").alias("claim_id"), F.lit("PARTIAL").alias("label"), F.lit("near").alias("headline"), "n_nationkey")
    checks = n.groupBy("study").agg(F.min("n_nationkey").alias("k")).select("study", F.lit(0).alias("rank"), F.concat(F.col("k").cast("string"), F.lit(" left")).alias("text"))
    return report.markdown(n, checks, "study")
