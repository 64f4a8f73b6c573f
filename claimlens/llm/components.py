"""Connected components of a link table by alternating star contraction, in DataFrame operations only.

Each round hangs every node below the smallest node that it knows (large star), then joins the smaller neighbours (small
star), until all that is left are stars. Minima come from aggregations that combine before the shuffle, so a node with many links
costs one row per task; each round is written to the shared folder, and the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

#: Rows (16 bytes) of one file between rounds.
ROWS_PER_FILE = 2_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a < b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b")
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a < b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """No node is a root and hangs below one, or hangs below two."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("root"), F.lit(0).alias("leaf")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("root"), F.lit(1).alias("leaf")))
    seen = ends.groupBy("node").agg(F.max("root").alias("root"), F.sum("leaf").alias("leaf"))
    return seen.filter("leaf > 1 or leaf = 1 and root = 1").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links (a, b); loops and repeats do no harm."""
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = materialize(pairs, "components")
    while not _all_stars(edges):
        # a round leaves about as many rows as it had: no more files than they fill
        parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // ROWS_PER_FILE))
        after = materialize(_star(_star(edges, True), False).coalesce(parts), "components")
        forget(edges)
        edges = after
    roots = edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
