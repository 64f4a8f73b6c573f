"""Joins by place: overlapping spans and nearest points, without a product of the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, *, start: str = "x0", end: str = "x1") -> DataFrame:
    """Pairs of rows of a key whose open spans overlap, with ``overlap``, its length; columns of ``right`` begin with r_.

    Spans are cut at multiples of ``width`` (about their usual length), so the join is an equality on (keys, cut); a pair
    counts in the first cut that both share.
    """
    cuts = lambda df: df.withColumn("_cut", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    r = cuts(right).select(*keys, "_cut", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    length = F.least(end, f"r_{end}") - F.greatest(start, f"r_{start}")
    pairs = cuts(left).join(r, [*keys, "_cut"]).withColumn("overlap", length).filter("overlap > 0")
    return pairs.filter(F.col("_cut") == F.floor(F.greatest(start, f"r_{start}") / width)).drop("_cut")


def nearest_join(points: DataFrame, labels: DataFrame, keys: list[str], *, at: str = "y", label: str = "label") -> DataFrame:
    """Each point with the nearest label of its keys; the one before wins a tie. One sort of both sides by place."""
    rest = [c for c in points.columns if c not in keys]
    row = F.struct(*rest)
    marks = labels.select(*keys, F.col(at).alias("_at"), F.col(label).alias("_label"), F.lit(None).cast(points.select(row).schema[0].dataType).alias("_row"))
    both = marks.unionByName(points.select(*keys, F.col(at).alias("_at"), F.lit(None).cast("string").alias("_label"), row.alias("_row")))
    w = Window.partitionBy(*keys).orderBy("_at", F.col("_label").isNull())
    back = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.col("_label").isNull())
    mark = F.when(F.col("_label").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_label").alias("label")))
    out = both.withColumn("_before", F.last(mark, ignorenulls=True).over(w)).withColumn("_after", F.last(mark, ignorenulls=True).over(back)).filter("_row is not null")
    before, after = F.col("_at") - F.col("_before.at"), F.col("_after.at") - F.col("_at")
    pick = F.when(before.isNull() | (after < before), F.col("_after")).otherwise(F.col("_before"))
    return out.select(*keys, "_row.*", pick["label"].alias("nearest"), F.abs(pick["at"] - F.col("_at")).alias("distance"))
