"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, settle


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge; root is the least node of its component.

    Each round points every node at its least neighbour, follows the pointers
    once more, and contracts the edges; it ends when no edge joins two nodes.
    Edges with a null end are ignored, repeated edges and loops count once.  The
    tables of each round go to the shared folder, nothing but a row count to the driver.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = settle(left.union(left.select("b", "a")).distinct(), "edges")
    roots = None
    while True:
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        hop = least.select(F.col("a").alias("p"), F.col("p").alias("q"))
        point = settle(least.join(hop, "p").select(F.col("a").alias("node"), F.col("q").alias("to")), "pointers")
        if roots is None:
            new = point.select("node", F.col("to").alias("root"))
        else:
            moved = point.select(F.col("node").alias("root"), "to")
            new = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        new = settle(new, "roots")
        ends = both.join(point.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("b", "x")
        ends = ends.join(point.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        rest = settle(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        for old in (both, point, roots):
            if old is not None:
                discard(old)
        roots, both = new, rest
        if both.isEmpty():
            discard(both)
            return roots
