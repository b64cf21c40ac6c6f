"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import dropped, written


def _toward_minimum(pairs: DataFrame, with_self: bool) -> DataFrame:
    """Each neighbour v of u to the least id among u and its neighbours; minima are combined before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))) if with_self else out


def connected_components(spark: SparkSession, edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(a, b) of bigint nodes -> (node, label), label the least node of its component.

    Each round is written to the shared folder, so lost executors cost one round at most. Rounds grow with the
    logarithm of the longest chain. Loops, repeated edges and an empty table are fine; a null end drops the edge.
    """
    now = written(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v").distinct(), "edges")
    state = None
    for _ in range(most):
        n, digest = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or state == (n, digest):
            break
        state = (n, digest)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both, False).where("u > v").distinct()
        small = _toward_minimum(large, True).where("u > v").distinct()
        new = written(spark, small, "edges")
        dropped(spark, now)
        now = new
    else:
        raise RuntimeError(f"components not settled after {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
