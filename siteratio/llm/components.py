"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteratio.llm.store import stored


def _settled(edges: DataFrame) -> bool:
    """Whether every id of ``edges`` (u > v, distinct) is either a root or linked with one root and nothing else."""
    ends = edges.selectExpr("u as id", "1L as up", "0 as root").unionByName(edges.selectExpr("v as id", "0L as up", "1 as root"))
    ids = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return ids.where("up + root > 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id that an edge of ``edges`` (a, b) has.

    Alternates two steps until only stars are left: every node hands its larger neighbours to its
    smallest one, then its smaller ones. The number of steps grows with the logarithm of the number
    of nodes; every step is a grouped minimum and a join, so a node with very many edges is reduced
    inside tasks first. Looking for what is not a star takes one shuffle, a step five, and edges that
    are stars from the start take no step.
    """
    edges = stored(
        edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u > v").distinct(), "edges"
    )
    while not _settled(edges):
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = both.join(least, "u").where("v > u").selectExpr("v as u", "m as v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").selectExpr("v as u", "m as v")
        edges = stored(small.unionByName(least.selectExpr("u", "m as v")).distinct(), "edges")
    roots = edges.selectExpr("v as id", "v as component").distinct()
    return edges.selectExpr("u as id", "v as component").unionByName(roots)
