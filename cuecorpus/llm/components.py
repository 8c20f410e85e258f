"""Connected components as joins and aggregations (the alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecorpus.llm.workspace import staged


def connected(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for each node of ``links`` (``a``, ``b``), itself excepted
    when it is the smallest. Each step is written to the shared folder; links shrink to stars in a few steps."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    size = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = size(edges)
    while last[0]:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
        least = both.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, "n").where("w > n").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = size(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
