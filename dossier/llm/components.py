"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame) -> DataFrame:
    """Each node's rows (node, neighbour) with the least of the node and its neighbours. The minimum is combined before any
    shuffle. Joined back, a node with very many neighbours is one key of the join: its rows stay small (two numbers), the other
    side has one row for it, and adaptive execution splits such a partition (or broadcasts a small other side)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(id, component_id) of every node that has a link; component_id is the smallest id reachable.

    Null ends and self-links are left out. Each round is written to the shared folder, which cuts the lineage."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        starred = _star(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(starred.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = written(small, "links")
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
