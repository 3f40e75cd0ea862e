"""Affinity propagation over the observed similarities of a sparse graph.

Messages are a table (i, k, s, r, a): similarity, responsibility, availability.
Absent pairs do not take part.  The diagonal holds the preference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kinspark.operators.components import connected_components
from kinspark.operators.graphs import mirrored
from kinspark.scratch import Scratch


def messages(edges: DataFrame, preference: float) -> DataFrame:
    """The table before the first round."""
    both = mirrored(edges.where("src <> dst")).groupBy("src", "dst").agg(F.max("w").alias("w")).select(F.col("src").alias("i"), F.col("dst").alias("k"), F.col("w").cast("double").alias("s"))
    loops = both.select("i").distinct().select("i", F.col("i").alias("k"), F.lit(float(preference)).alias("s"))
    return both.unionByName(loops).withColumn("r", F.lit(0.0)).withColumn("a", F.lit(0.0))


def step(table: DataFrame, damping: float = 0.5) -> DataFrame:
    """One round: responsibilities from each row's two largest r + a, then availabilities by column."""
    row = Window.partitionBy("i").orderBy(F.desc(F.col("r") + F.col("a")), "k")
    ranked = table.withColumn("rank", F.row_number().over(row))
    whole = Window.partitionBy("i")
    total = F.col("r") + F.col("a")
    ranked = ranked.withColumn("m1", F.max(F.when(F.col("rank") == 1, total)).over(whole)).withColumn("m2", F.max(F.when(F.col("rank") == 2, total)).over(whole))
    other = F.when(F.col("rank") == 1, F.coalesce("m2", F.lit(0.0))).otherwise(F.col("m1"))
    now = ranked.select("i", "k", "s", (damping * F.col("r") + (1 - damping) * (F.col("s") - other)).alias("r"), "a")
    column = Window.partitionBy("k")
    off = F.col("i") != F.col("k")
    positive = F.sum(F.when(off, F.greatest("r", F.lit(0.0))).otherwise(0.0)).over(column)
    own = F.max(F.when(~off, F.col("r"))).over(column)
    fresh = F.when(off, F.least(F.lit(0.0), own + positive - F.greatest("r", F.lit(0.0)))).otherwise(positive)
    return now.select("i", "k", "s", "r", (damping * F.col("a") + (1 - damping) * fresh).alias("a"))


def exemplars(table: DataFrame) -> DataFrame:
    """(node, exemplar): the column with the largest r + a of each row; ties go to the smallest."""
    best = Window.partitionBy("i").orderBy(F.desc(F.col("r") + F.col("a")), "k")
    return table.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(F.col("i").alias("node"), F.col("k").alias("exemplar"))


def relational_affinity(edges: DataFrame, scratch: Scratch, preference: float, damping: float = 0.5, rounds: int = 100, patience: int | None = 15) -> DataFrame:
    """(node, cluster) by rounds of windows, until exemplars rest for ``patience`` rounds; all rounds without."""
    now = messages(edges, preference)
    last, still = None, 0
    for _ in range(rounds):
        now = scratch.keep(step(now, damping), "ap")
        if patience is None:
            continue
        mark = exemplars(now).agg(F.sum(F.xxhash64("node", "exemplar").cast("decimal(38,0)"))).first()[0]
        still = still + 1 if mark == last else 0
        last = mark
        if still > patience:
            break
    parts = connected_components(exemplars(now).select(F.col("node").alias("src"), F.col("exemplar").alias("dst")), scratch)
    return parts.select("node", F.col("component").alias("cluster"))


def local_affinity(i: np.ndarray, k: np.ndarray, s: np.ndarray, n: int, damping: float = 0.5, rounds: int = 100, patience: int | None = 15) -> np.ndarray:
    """Exemplar of each of ``n`` nodes from entries that hold the diagonal; dense form."""
    sim = np.full((n, n), -np.inf)
    sim[i, k] = s
    there = np.isfinite(sim)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    label, still = None, 0
    rows = np.arange(n)
    for _ in range(rounds):
        total = np.where(there, r + a, -np.inf)
        k1 = total.argmax(1)
        m1 = total[rows, k1]
        total[rows, k1] = -np.inf
        m2 = total.max(1)
        other = np.repeat(m1[:, None], n, 1)
        other[rows, k1] = np.where(np.isfinite(m2), m2, 0)
        r = np.where(there, damping * r + (1 - damping) * (np.where(there, sim, 0) - other), 0)
        plus = np.where(there, np.maximum(r, 0), 0)
        np.fill_diagonal(plus, 0)
        positive = plus.sum(0)
        fresh = np.minimum(0, np.diag(r)[None, :] + positive[None, :] - np.maximum(r, 0))
        fresh[rows, rows] = positive
        a = np.where(there, damping * a + (1 - damping) * fresh, 0)
        new = np.where(there, r + a, -np.inf).argmax(1)
        still = still + 1 if label is not None and (new == label).all() else 0
        label = new
        if patience is not None and still > patience:
            break
    return label


def affinity(edges: DataFrame, scratch: Scratch, preference: float, damping: float = 0.5, small: int = 1000, rounds: int = 100, patience: int | None = 15) -> DataFrame:
    """(node, cluster): components of the links to exemplars, named by their smallest node.

    Components of up to ``small`` nodes are solved one by one in tasks.  Exemplars
    that rest for ``patience`` rounds may still change later; with None all
    ``rounds`` are run.
    """
    given = scratch.keep(edges.where("src <> dst").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("w").cast("double").alias("w")), "edges")
    parts = scratch.keep(connected_components(given, scratch), "parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    labelled = given.join(parts.withColumnRenamed("node", "src"), "src").join(sizes, "component")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([rows["src"].to_numpy(str), rows["dst"].to_numpy(str)]))
        n = len(names)
        a, b = np.searchsorted(names, rows["src"].to_numpy(str)), np.searchsorted(names, rows["dst"].to_numpy(str))
        m = np.full((n, n), -np.inf)
        np.maximum.at(m, (a, b), rows["w"].to_numpy())
        m = np.maximum(m, m.T)
        np.fill_diagonal(m, preference)
        i, k = np.nonzero(np.isfinite(m))
        chosen = local_affinity(i, k, m[i, k], n, damping, rounds, patience)
        label = np.arange(n)
        while True:
            new = np.minimum(label, label[chosen])
            np.minimum.at(new, chosen, label)
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"node": names, "cluster": names[label]})

    found = labelled.where(F.col("n") <= small).select("component", "src", "dst", "w").groupBy("component").applyInPandas(solve, "node string, cluster string")
    giant = labelled.where(F.col("n") > small).select("src", "dst", "w")
    if not giant.isEmpty():
        found = found.unionByName(relational_affinity(giant, scratch, preference, damping, rounds, patience))
    return found


def min_max_scaled(edges: DataFrame) -> DataFrame:
    """Edges with their weights between 0, the smallest, and 1, the largest; all 1 if they are equal."""
    ends = F.broadcast(edges.agg(F.min("w").alias("low"), F.max("w").alias("high")))  # one row
    scaled = F.when(F.col("high") > F.col("low"), (F.col("w") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    return edges.join(ends).select("src", "dst", scaled.alias("w"))


def taxa_preference(nodes: DataFrame, separator: str = "|", each: float = -20.0) -> float:
    """The preference that follows the number of taxa among the ids in column ``node``."""
    return each * nodes.agg(F.countDistinct(F.substring_index("node", separator, 1))).first()[0]
