"""Connected components by alternating large and small stars, as joins and aggregations over edges alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of edges other than each component's least node; component is that least node.

    Null ends and loops are ignored. Each round writes its edges to the shared folder, so lineage stays short; minima
    are pre-aggregated, and the joins are plain equi-joins whose hot keys adaptive execution can split. Nothing but two
    sums a round comes to the driver.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = written(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    seen = None
    while (now := tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())) != seen:
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        new = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(large)
        forget(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
