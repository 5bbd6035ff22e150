"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.llm.common import no_wider, saved

#: Edges in a task.
EDGES = 50_000


def _least_neighbour(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("m"))


def _are_stars(edges: DataFrame, rows: int) -> bool:
    """Whether every node of ``edges`` (u > v, each once) has one lesser neighbour or only greater ones: no step changes that."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    nodes = no_wider(nodes, rows, EDGES)
    return nodes.agg(F.count(F.when(F.col("up") + F.col("down") > 1, 1))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v long): root is the smallest node of its component.

    Every step links neighbours to the least neighbour, so paths shrink by a
    constant factor and a few rounds suffice; each round is written to the
    shared folder.  No more rows than edges are ever made.  No edges, no rows.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(now, rows := now.count()):
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # repeats go in the step below: no shuffle for them here
        large = sym.join(_least_neighbour(sym), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = saved(no_wider(large, rows, EDGES), "large_star")
        small = large.join(_least_neighbour(large), "u")  # u > v holds
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        small = no_wider(small.where("u <> v"), rows, EDGES).distinct()
        now = saved(no_wider(small, rows, EDGES), "small_star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
