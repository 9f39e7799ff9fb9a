"""Connected components of a graph, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b), longs; vertices have the same root if and only if they are connected.

    Every vertex moves to the least of itself and its neighbours and the edges move along,
    until none has two ends. Ids should be hashes, so that their order is a random one:
    then each round leaves a fixed share of the vertices, and there are about log n rounds.
    """
    moved = None
    edges = staged(edges.where("a <> b").distinct(), "component-edges")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m")), "component-least")
        at = lambda c: least.select(F.col("v").alias(c), F.col("m").alias(f"m{c}"))
        if moved is None:
            moved = least.select("v", F.col("m").alias("root"))
        else:
            moved = moved.join(least.select(F.col("v").alias("root"), "m"), "root", "left").select("v", F.coalesce("m", "root").alias("root"))
        moved = staged(moved, "component-moved")
        edges = edges.join(at("a"), "a").join(at("b"), "b").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).where("a <> b").distinct()
        edges = staged(edges, "component-edges")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")) if moved is None else moved
