"""The queries opN_<name> over the documents tables, one for each operator of this package."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dualtree, knlm, linededup, lmscore, media, neardup, ngramjoin, packing, pii, tokcount, toxicity, vectorcodes
from .common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_flagged", "worst_start", "worst_end", "worst_score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")  # noqa: E731
    counts = [of(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokcount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = remainder(10)
    out = lmscore.score_texts(table(spark, sf_dir, "documents"), rest != 0)
    return out.select("doc_id", (rest == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store_texts(table(spark, sf_dir, "documents")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knlm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(table(spark, sf_dir, "embeddings")).drop("label")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return dualtree.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, s[i] AS line, lower_ascii AS k FROM (
    SELECT doc_id, s, i, translate(trim(s[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))),
frequent AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.doc_id, l.i, l.line, f.k IS NOT NULL AND l.doc_id <> f.last AS dropped
  FROM lines l LEFT JOIN frequent f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: Vectors as whole numbers; those that are null or hold null or non-finite components are left out.
_WHOLE = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _round(k: int) -> str:
    """Assignment of all parts to the entries of codebook k, as table a{k}."""
    return f"""a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, x, arg_min(struct_pack(e := entry, d := d), (d, entry)) AS best FROM (
    SELECT p.*, c.entry, list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN c{k} c USING (part)) GROUP BY vec_id, label, part, x)"""


def _refined(k: int) -> str:
    """Codebook k + 1 from the assignment to codebook k."""
    return f"""m{k} AS (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM (
    SELECT part, best.e AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n
    FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM parts))) AS i) GROUP BY ALL) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.y, c.y) AS y FROM c{k} c LEFT JOIN m{k} m USING (part, entry))"""


OP11_SQL = f"""
WITH w AS MATERIALIZED ({_WHOLE}),
parts AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM w, (SELECT unnest(range(16)) AS part)),
c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS y FROM parts
  WHERE vec_id IN (SELECT vec_id FROM w ORDER BY vec_id LIMIT 64)),
{_round(0)}, {_refined(0)}, {_round(1)}, {_refined(1)}, {_round(2)},
coded AS (
  SELECT vec_id, label, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""

OP12_SQL = f"""
WITH w AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_WHOLE}) WHERE label IS NOT NULL),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same,
    list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM w a JOIN w c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""


def _jaccard_sql(size: int, percent: int, kept: str = "") -> str:
    """Documents linked by the similarity of their word shingles, and the smallest id reachable from each."""
    return rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {size - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {size - 1}], ' '))) AS s FROM words WHERE len(w) > 0),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b USING (item) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT doc_id, least(doc_id, min(other)) AS root FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id{kept}
FROM documents LEFT JOIN sets USING (doc_id) LEFT JOIN least USING (doc_id)
"""


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": _jaccard_sql(3, 85, ", coalesce(root, doc_id) = doc_id AS kept"), "op9_line_dedup": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_jaccard_join": _jaccard_sql(4, 85)}
