"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._scratch import keep


def connected_components(edges: DataFrame) -> DataFrame:
    """(``v``, ``root``) for each vertex of ``edges`` (``a``, ``b``): root is the smallest vertex it can reach.

    Contraction: every vertex points to its smallest neighbour, pointers are
    followed twice, and edges are renamed to the roots found so far; the edges
    left over shrink by half or more in a round.  Nothing is gathered on the
    driver but the answer to "is an edge left"; each round is a written table.
    Empty edges give an empty result; repeated edges and loops change nothing.
    """
    edges = keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "up")
        for _ in range(2):
            above = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            up = up.join(above, "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        up = keep(up, "up")
        to = up.select(F.col("a").alias("v"), F.col("p").alias("root"))
        if roots is None:
            roots = to
        else:
            step = up.select(F.col("a").alias("root"), "p")
            roots = keep(roots.join(step, "root", "left").select("v", F.coalesce("p", "root").alias("root")), "roots")
        ua, ub = up.select("a", F.col("p").alias("pa")), up.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(ua, "a").join(ub, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        edges = keep(edges.distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots
