"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pitspark.session import materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least_neighbour(both), "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = down.join(_least_neighbour(down), "u")
    return met.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
        met.select("u", F.col("least").alias("v"))
    )


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is its least node.

    Each round is a large and a small star (joins and minima), written to the
    shared folder, so a lost executor costs one round at most. Edges only ever
    point to smaller nodes, and the table never grows beyond the edges given. Stops when a
    round changes nothing; raises if that takes more than ``max_rounds``.
    """
    edges = materialize(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "cc-edges")
    before = None
    for _ in range(max_rounds):
        starred = _small_star(_large_star(edges)).where(F.col("u") != F.col("v")).distinct()
        edges = materialize(starred, "cc-edges")
        mark = edges.agg(
            F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"),
        ).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select("u", F.col("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").union(
        roots.select(F.col("component").alias("node"), "component").distinct()
    )
