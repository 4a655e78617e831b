"""Connected components of a link table by alternating star contractions, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)`` for every node with a link; the component is its smallest node.

    Each round points every larger neighbour of a node to the node's smallest neighbour (large star), then every smaller
    one (small star); the number of rounds grows with the logarithm of the longest chain. Rounds end in ``checkpoint()``,
    so the lineage stays short and lost executors don't cost earlier rounds. Null ends and loops are ignored; no links
    give an empty table.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    last = None
    while last != (now := state(edges)):
        last = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        near = big.join(low, F.col("u") == F.col("w"))
        edges = (
            near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
            .where("u <> v").distinct().checkpoint()
        )
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
