"""Connected components of an edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinloom.llm.workspace import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """edges (a, b) longs; returns (id, comp): every node but the smallest of its
    component, with that smallest node.

    Each step points all larger (then all smaller) neighbours of a node to its
    smallest neighbour; edges never increase in number, and steps are about the
    logarithm of the longest path.  Each step is written to the shared folder.
    A node's neighbours are never gathered: a minimum is aggregated map-side and
    joined back, so a node with very many neighbours is one skewed join key.
    """
    e = work.stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # One row for each edge, from its smaller end.
        e = work.stage(both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        lows = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(lows, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = work.stage(small.select("x.*").filter("u <> v").distinct(), "small")
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _stars(e: DataFrame) -> bool:
    """Whether every node points to one node that points to none."""
    many = e.groupBy("u").count().filter("count > 1").select("u")
    inner = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
    return many.unionByName(inner).isEmpty()
