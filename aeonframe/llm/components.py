"""Connected components of a distributed edge list.

Large-star and small-star steps: each step hangs neighbours on the smallest node known nearby, and the number of
rows never exceeds that of edges. Both steps are a grouped minimum and a join on its key, so a node with very many
neighbours is split by the join, not gathered. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): node and root, the smallest node it can reach, for each node that is not itself a root. Loops are ignored."""
    spark = edges.sparkSession
    now = materialize(spark, edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        # large star: the neighbours above u go to the least of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # now.u > now.v: an edge whose larger end has no larger neighbour is kept by its smaller end's star
        large = large.where("u <> v")
        # small star: u's smaller neighbours, and u, go to the least of them
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialize(spark, small.union(under.select("u", F.col("m").alias("v"))).distinct(), "edges")
        found = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        discard(spark, now)
        now = after
        if found == state or not found["n"]:
            break
        state = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
