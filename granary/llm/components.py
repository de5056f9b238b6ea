"""Connected components of a links table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from granary.session import settle


def connected(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` for every node of at least one link; root is the smallest node reachable.

    Each step replaces links by links to the smallest neighbour (Kiveris et al. 2014, "Connected Components in
    MapReduce and Beyond"), which keeps the components and about halves the paths.  Minima are aggregated
    before the shuffle and joins are free to split a hot node.  Loops and repeated links are allowed; an empty table
    gives an empty table.
    """
    edges = settle(
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct()
    )
    before = state(edges)
    while before[0]:
        edges = settle(small_star(large_star(edges)))
        after = state(edges)
        if after == before:
            break
        before = after
    # every link now leads from a node to its root
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def state(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the links; equal before and after a step at the end."""
    mixed = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(mixed)).first()
    return tuple(row)


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; links run from large to small."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(smallest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
