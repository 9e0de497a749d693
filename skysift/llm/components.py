"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round regroups edges around smaller nodes with a grouped minimum and a join; no neighbour list is ever
collected. Rounds end when a checksum of the edges no longer changes. Every round is written to the shared
folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import written


def _rounds(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # large star: the larger neighbours of a node move to its least neighbour
    large = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    # small star: a node and its smaller neighbours move to the least of these
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't the least of its component; root is the least."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    checksum = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    before = checksum(now)
    while before[0]:
        now = written(_rounds(now))
        after = checksum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
