"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _larger_to_smallest(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the node's smallest neighbour or itself."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, moves to the smallest of them (u > v); without repeats, which would meet at the hubs."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one edge, to a smaller centre (u > v in every edge)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("out").alias("outs"), F.min("out").alias("least")).where("outs > 1 or outs = 1 and least = 0").isEmpty()


def with_centres(stars: DataFrame) -> DataFrame:
    """`stars` (node, component) with a row for each centre, which is its own component."""
    return stars.union(stars.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component")))


def stars(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns node, component (the smallest node reached) for every node of `edges` (u, v: long) but the smallest of each component.

    Loops, repeated edges and nulls are ignored.  Each round joins the edges
    with one row for each node; joins are skew-splittable, a hub's neighbours
    are never gathered, and no step makes more edges than it is given.  Rounds
    end when the edges are a forest of stars, whose centres are the smallest
    nodes.  Smaller neighbours move first: where stars share members, their
    centres meet by that, and the members follow in the same round.  `edges`
    is read more than once; the result is a table in the shared folder.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    for _ in range(most_rounds):
        e = scratch.store_narrow(_larger_to_smallest(_smaller_to_smallest(e)).distinct(), "edges")
        if _is_star_forest(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")


def components(scratch: Scratch, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Columns node, component (the smallest node reached) for every node of `edges`: `stars` and their centres."""
    return with_centres(stars(scratch, edges, most_rounds))
