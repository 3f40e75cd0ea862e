"""Markov clustering of weighted graphs.

Three forms of one algorithm.  The relational form holds the matrix as a table of
entries (i, j, w): expansion is a join on the inner index and a sum, inflation a
power, normalisation a sum by column; all products go through disk.  The form by
columns (:mod:`kinspark.operators.columns`) takes large components without that.
The local form runs numpy on one component at a time, for the many small ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinspark.operators import columns
from kinspark.operators.components import connected_components
from kinspark.operators.graphs import mirrored, prune_rows
from kinspark.scratch import Scratch

EPSILON = 1e-8
PRUNE = 1e-5


def matrix(edges: DataFrame) -> DataFrame:
    """Entries of the symmetric matrix, with each node's largest weight on the diagonal."""
    both = mirrored(edges.where("src <> dst")).groupBy("src", "dst").agg(F.max("w").alias("w")).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("double").alias("w"))
    loops = both.groupBy("i").agg(F.max("w").alias("w")).select("i", F.col("i").alias("j"), "w")
    return both.unionByName(loops)


def normalise_columns(entries: DataFrame) -> DataFrame:
    """Columns that sum to 1."""
    sums = entries.groupBy("j").agg(F.sum("w").alias("total"))
    return entries.join(sums, "j").select("i", "j", (F.col("w") / (F.col("total") + EPSILON)).alias("w"))


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """Product of two sparse matrices."""
    a = left.select("i", F.col("j").alias("k"), F.col("w").alias("x"))
    b = right.select(F.col("i").alias("k"), "j", F.col("w").alias("y"))
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("w"))


def step(entries: DataFrame, inflation: float = 1.5, prune: float = PRUNE) -> DataFrame:
    """One round: normalise, square, inflate, prune."""
    unit = normalise_columns(entries)
    return multiply(unit, unit).select("i", "j", F.pow("w", F.lit(float(inflation))).alias("w")).where(F.col("w") >= prune)


def iterate(edges: DataFrame, rounds: int, inflation: float = 1.5, scratch: Scratch | None = None) -> DataFrame:
    """The matrix after a fixed number of rounds."""
    now = matrix(edges)
    for _ in range(rounds):
        now = step(now, inflation)
        if scratch is not None:
            now = scratch.keep(now, "mcl")
    return now


def relational_mcl(edges: DataFrame, scratch: Scratch, inflation: float = 1.5, rounds: int = 100, widest: int | None = None) -> DataFrame:
    """(node, cluster) by rounds of joins; every fifth round looks for convergence.

    Entries below PRUNE go after each round, as in the local form.  ``widest``
    asks for an approximation: only so many entries of a row are kept, which
    bounds the fill-in but cuts clusters that are larger.
    """
    now = scratch.keep(matrix(edges), "mcl")
    for k in range(rounds):
        unit = scratch.keep(normalise_columns(now), "unit")
        new = multiply(unit, unit).select("i", "j", F.pow("w", F.lit(float(inflation))).alias("w")).where(F.col("w") >= PRUNE)
        now = scratch.keep(prune_rows(new, PRUNE, widest, widest) if widest else new, "mcl")
        if k and k % 5 == 0:
            both = now.join(unit.withColumnRenamed("w", "old"), ["i", "j"], "full")
            old, w = F.coalesce("old", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
            gap = both.agg(F.max(F.abs(w - old) - 1e-5 * F.abs(old)).alias("gap")).first()["gap"]
            if gap is None or gap <= EPSILON:
                break
    parts = connected_components(now.where(F.col("w") > PRUNE).select(F.col("i").alias("src"), F.col("j").alias("dst")), scratch)
    return parts.select("node", F.col("component").alias("cluster"))


def local_mcl(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, inflation: float = 1.5, rounds: int = 100) -> np.ndarray:
    """Cluster (an index into ``nodes``) of each node of a small graph, by dense matrices."""
    n = len(nodes)
    a, b = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    m = np.zeros((n, n))
    np.maximum.at(m, (a, b), w)
    m = np.maximum(m, m.T)
    np.fill_diagonal(m, 0)
    np.fill_diagonal(m, m.max(0))
    for k in range(rounds):
        m = m / (m.sum(0) + EPSILON)
        old = m
        m = (m @ m) ** inflation
        m[m < PRUNE] = 0
        if k and k % 5 == 0 and (np.abs(m - old) - 1e-5 * np.abs(old)).max() <= EPSILON:
            break
    label = np.arange(n)
    link = (m > PRUNE) | (m > PRUNE).T
    while True:
        new = np.minimum(label, np.where(link, label[None, :], n).min(1))
        if (new == label).all():
            return label
        label = new


def mcl(edges: DataFrame, scratch: Scratch, inflation: float = 1.5, small: int = 1000, rounds: int = 100) -> DataFrame:
    """(node, cluster): clusters named by their smallest node.

    Clusters never cross components.  Those of up to ``small`` nodes are solved
    one by one in tasks, the larger by blocks of columns.  After ``rounds`` rounds
    a matrix is read as it is, at rest or not.
    """
    given = scratch.keep(edges.where("src <> dst").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("w").cast("double").alias("w")), "edges")
    parts = scratch.keep(connected_components(given, scratch), "parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    labelled = given.join(parts.withColumnRenamed("node", "src"), "src").join(sizes, "component")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([rows["src"].to_numpy(str), rows["dst"].to_numpy(str)]))
        label = local_mcl(nodes, rows["src"].to_numpy(str), rows["dst"].to_numpy(str), rows["w"].to_numpy(), inflation, rounds)
        return pd.DataFrame({"node": nodes, "cluster": nodes[label]})

    found = labelled.where(F.col("n") <= small).select("component", "src", "dst", "w").groupBy("component").applyInPandas(solve, "node string, cluster string")
    giant = labelled.where(F.col("n") > small).select("src", "dst", "w")
    if not giant.isEmpty():
        found = found.unionByName(columns.clusters(matrix(giant), scratch, inflation, rounds, PRUNE))
    return found
