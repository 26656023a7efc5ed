"""Connected components by alternating large-star and small-star steps over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, stored


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return spread_join(both, least, ["u"], "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = spread_join(edges, least, ["u"], "n", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b), but for the roots: ``root`` is the least node it is connected to.

    Rows with a = b or a null are ignored. A hub with many links is never gathered: its least neighbour comes from a
    partial aggregation and its links are spread over the tasks when they meet that one row."""
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, mark = stored(edges, "components"), (None, None)
    n = edges.count()
    while True:
        wide = stored(_large_star(edges, n), "components")
        discard(spark, edges)
        edges = stored(_small_star(wide, wide.count()), "components")
        discard(spark, wide)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == mark:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._stored_at = edges._stored_at
            return out
        mark, n = now, now.n
