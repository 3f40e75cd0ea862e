"""Markov clustering in stages, for graphs that are too large to cluster whole.

Each node joins its nearest neighbours; the components of that small graph are
merged where edges between them say so; clusters are then sought within what has
been merged, with all edges there.  A node never loses its nearest neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinspark.operators.components import connected_components
from kinspark.operators.graphs import component_graph, nearest_neighbours
from kinspark.operators.mcl import mcl
from kinspark.scratch import Scratch


def neighbour_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) by the edges to nearest neighbours only, ties included."""
    near = nearest_neighbours(edges).select(F.col("node").alias("src"), F.col("neighbour").alias("dst"))
    return connected_components(near, scratch)


def scaled_component_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, w): number of edges between two components over the root of the product of their sizes."""
    counted = component_graph(edges.select("src", "dst", F.lit(1.0).alias("w")), labels)
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    sized = counted.join(sizes.select(F.col("component").alias("src"), F.col("n").alias("n_src")), "src").join(sizes.select(F.col("component").alias("dst"), F.col("n").alias("n_dst")), "dst")
    return sized.select("src", "dst", (F.col("w") / F.sqrt(F.col("n_src") * F.col("n_dst"))).alias("w"))


def merged_components(edges: DataFrame, scratch: Scratch, how: str = "connected", inflation: float = 1.2, floor: float = 0.0) -> DataFrame:
    """(node, component): the components of nearest neighbours after merging.

    ``how``: "connected" merges along every edge; "scaled" along pairs of
    components with a scaled number of edges over ``floor``; "mcl" merges the
    Markov clusters of that scaled graph.
    """
    edges = edges.where("src <> dst")
    own = scratch.keep(neighbour_components(edges, scratch), "neighbours")
    if how == "connected":
        found = connected_components(component_graph(edges, own), scratch)
    elif how == "scaled":
        found = connected_components(scaled_component_graph(edges, own).where(F.col("w") > floor), scratch)
    elif how == "mcl":
        found = mcl(scaled_component_graph(edges, own), scratch, inflation).select("node", F.col("cluster").alias("component"))
    else:
        raise ValueError(f"unknown way to merge: {how}")
    merged = own.join(found.select(F.col("node").alias("component"), F.col("component").alias("merged")), "component", "left")
    return merged.select("node", F.coalesce("merged", "component").alias("component"))


def staged_mcl(edges: DataFrame, scratch: Scratch, how: str = "connected", inflation: float = 1.5, merge_inflation: float = 1.2, floor: float = 0.0, rounds: int = 100) -> DataFrame:
    """(node, cluster): Markov clusters within merged components, after up to ``rounds`` rounds."""
    given = scratch.keep(edges.where("src <> dst").select("src", "dst", "w"), "edges")
    labels = scratch.keep(merged_components(given, scratch, how, merge_inflation, floor), "merged")
    src = labels.select(F.col("node").alias("src"), F.col("component").alias("cs"))
    dst = labels.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
    return mcl(given.join(src, "src").join(dst, "dst").where("cs = cd").select("src", "dst", "w"), scratch, inflation, rounds=rounds)
