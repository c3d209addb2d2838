"""Connected components and candidate links over tables, without ever holding a graph in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.common import cut, drop


def _digest(edges: DataFrame) -> tuple:
    """Number of distinct edges and a 64-bit digest of them, without a shuffle of the edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """id, component (the least id that links reach) for every id in the edges.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step points nodes to
    the least node of their neighbourhood and lets a chain shrink by a constant factor, so the
    number of steps grows with the logarithm of the longest path. Only minima per node are
    aggregated, with partial sums before the shuffle, so a node with very many links is no
    bottleneck. Null ends and loops are dropped; an empty table gives no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = _digest(e)
    for _ in range(most):
        # large star: every larger neighbour of u goes to the least node around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u itself, goes to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        after = cut(small.select("x.u", "x.v").filter("u <> v").distinct())
        now = _digest(after)
        drop(e)
        e = after
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
