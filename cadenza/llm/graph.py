"""Connected components of an edge table, without collecting nodes or links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

    The minimum of a node's neighbours is an aggregate with map-side combine, and its return to the neighbours a join that adaptive
    execution may split, so that a node with very many links is no task of its own.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rows: int | None = None, most_rounds: int = 60) -> DataFrame:
    """edges: (u, v) of one ordered type, about ``rows`` of them. Returns (node, root) for each node that has a link; root is the least node
    reachable.

    Every round is cut in the shared folder. Rounds grow with the logarithm of the node count; running out of them is an error, never a
    partial answer.
    """
    edges = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), rows)
    before, n = None, edges.count()
    for _ in range(most_rounds if n else 0):
        edges = cut(_star(_star(edges, large=True), large=False), n)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, n = state, state["n"]
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")
