"""Connected components by alternating large-star and small-star steps, each a join over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge and isn't the root itself; root is the least node of the component.

    Self-loops, repeated and reversed edges don't matter; edges with a null end are left out.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before = cut(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = cut(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        drop_cut(large)
        drop_cut(e)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        e = after
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
