"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def contract(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """Edges (u, v), u > v, that connect the same nodes as the given ones: after the last round, stars
    whose centre is the smallest node.  With ``rounds``, at most so many are made (edges in between).

    A round is a few narrow shuffles of the edge table, which never grows; rounds end when the edges no
    longer change.  Only a count and a checksum reach the driver.  The first step joins (Spark splits a
    hub's edges); after it, a node's edges lead to few distinct smaller ones, so one partitioning by
    node serves the rest of the round.
    """
    e = (edges.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = materialize(e)
    before = _signature(e)
    while before[0] and rounds != 0:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.repartition("u").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = materialize(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        rounds = rounds and rounds - 1
        after = _signature(e) if rounds != 0 else None
        if after == before:
            break
        before = after or before
    return e


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node it can reach.

    A self-loop or a null end is ignored; without edges the result is empty.
    """
    e = contract(edges, a, b)
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
