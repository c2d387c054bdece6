"""Connected components of a graph given as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.session import saved


def _starred(links: DataFrame, larger: bool) -> DataFrame:
    """One half step: every node tells its larger (else its smaller) neighbours, and itself, the least node around it."""
    both = links if not larger else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = both.join(least, "a")
    told = joined.where("b > a") if larger else joined.where("b < a")
    out = told.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not larger:
        out = out.unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached, for every node of ``links`` (a, b).

    Alternates large and small stars until every node hangs on the least one of its component. Both are a pre-aggregated
    minimum and a join whose large partitions Spark splits, so a hub costs no single task; the number of rounds grows with
    the logarithm of the graph's size. Each round is kept in the shared checkpoint folder.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    before, now = None, digest(edges)
    while now != before:
        edges = saved(_starred(_starred(edges, True), False))
        before, now = now, digest(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
