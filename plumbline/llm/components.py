"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang every node's neighbours (the larger ones, or the smaller ones and itself) on its least one."""
    sides = _both(edges) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = sides.join(least, sides.a == least.n)
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return out.unionByName(own).where("a <> b").distinct()


def connected_components(links: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, root) for every node of a link that isn't itself the least of its component.

    Hubs cost no more than their degree: minima combine before the shuffle and joins on a hub can be
    split by adaptive execution. Every round is written to the shared folder.
    """
    edges = written(links.where("a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).distinct(), spark)
    before = None
    while True:
        edges = written(_star(_star(edges, True), False), spark)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a))")).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)
