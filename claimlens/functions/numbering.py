"""Numbers from 1 within a key, for keys of any size: no task holds a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with ``name``, the row's number within its key by ``order`` (ties: any order).

    A prefix sum in two passes. The rows are dealt to ranges of (key, order) and written; each range numbers its part of
    a key by itself, and a key's part starts behind what the ranges before it hold. Only a key that crosses the bound of two
    ranges has such parts, so the starts are fewer than the ranges, and are broadcast.
    """
    place = [F.col(c) for c in (*key, *order)]
    part = written(rows.repartitionByRange(*place).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = part.groupBy("_range", *key).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.sum("_size").over(before)).filter("_start is not null").select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_start")
    own = F.row_number().over(Window.partitionBy("_range", *key).orderBy(*order))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = part.withColumn("_own", own).join(F.broadcast(starts), same, "left")
    return out.withColumn(name, F.col("_own") + F.coalesce("_start", F.lit(0))).select(*rows.columns, name)
