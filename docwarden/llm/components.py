"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), each step a shuffle of the edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is the smallest node that can be reached.

    Each round's edge list is written to the shared folder and replaces the one before. Every node's edges are joined with its smallest
    neighbour, so a hub's edges are many rows of a join, which AQE can split, and never one collected group."""
    edges = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark, held = _mark(edges), [x for x in scratch.paths if x == "edges"]
    for k in range(rounds):
        # Edges lead from the larger node (a) to the smaller (b), so a node's smallest neighbour is a b, or itself where it has none.
        low = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = edges.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        linked = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        star = linked.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))).where("a <> b").distinct()
        edges = scratch.cut(star, f"edges{k}")
        scratch.drop(*held)
        held = [f"edges{k}"]
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
