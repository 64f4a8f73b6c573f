"""A training-corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. Empty tables pass through;
rows with null texts count as empty texts, and extra columns are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import decontam, linededup, neardup, packing, toxicity
from claimlens.llm.common import forget, materialize, table, text_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, learnt from the labels of these documents, calls toxic go."""
    docs = docs.select(*COLUMNS)
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines stay in one document only; documents left without any line but blank ones go with them."""
    docs = docs.select(*COLUMNS)
    lines = linededup.dedup_lines(docs, carry=("lang", "source", "n_chars"))
    out = lines.filter("n_dropped = 0 or length(btrim(text)) > 0")
    cut = F.col("n_dropped") > 0
    out = out.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars"))).withColumn("text", F.when(cut, F.col("text")).otherwise(F.col("before")))
    return out.select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the rows of the smallest doc_id stay.

    A row is known by its doc_id and its text, so the rows of a repeated id are decided one by one.
    """
    docs = docs.select(*COLUMNS)
    gone = neardup.near_duplicates(docs, keyed=True).filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, [docs["doc_id"] == gone["gone_id"], text_key() == gone["gone_key"]], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or within its edit budget, go."""
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in near-equal windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Learned scores and differencing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(before)  # the stage's input, unless it is the table itself
    return STAGES[-1][1](spark, docs, sf_dir)
