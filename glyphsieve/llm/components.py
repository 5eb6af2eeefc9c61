"""Connected components of a graph of pairs, by alternating star contractions over a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.llm._common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a long, b long): root is the smallest node that it's connected with.

    Each round is two shuffles of the edges that remain; rounds grow with the logarithm of the longest chain. Loops, repeated edges and nulls are ignored.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e)
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.select("u", "v", low.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", low.alias("m"))
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p")).select(F.col("p.v").alias("u"), F.col("p.m").alias("v"))
        e = materialise(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
