"""Connected components over edges of any number, without bringing nodes or edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.common import forget, stored


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long); component is the smallest node that can be reached.

    Alternating large and small stars: each round ties every node to the smallest node near it, until edges no longer change. Smallest
    neighbours are aggregated before the shuffle, and joins on a node with very many edges are split at run time. Each round is written to the shared folder. Loops and
    repeated edges are allowed.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large.unionByName(now.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b"))).filter("a > b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = stored(small, "small-star")
        forget(now, large)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return found.unionByName(roots).unionByName(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
