"""Density-peak clustering of a sparse table of distances (x, y, d)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from kinspark.operators.graphs import mirrored
from kinspark.scratch import Scratch


def _both(distances: DataFrame) -> DataFrame:
    edges = distances.where("x <> y").select(F.col("x").alias("src"), F.col("y").alias("dst"), F.col("d").cast("double").alias("w"))
    return mirrored(edges).groupBy("src", "dst").agg(F.min("w").alias("d")).select(F.col("src").alias("x"), F.col("dst").alias("y"), "d")


def cutoff(distances: DataFrame, quantile: float = 0.02) -> float:
    """The distance below which ``quantile`` of the distances lie, to one in a million of their number."""
    return distances.agg(F.percentile_approx("d", F.lit(quantile), F.lit(1_000_000))).first()[0]


def densities(distances: DataFrame, dc: float) -> DataFrame:
    """(node, rho): sum of exp(-(d / dc) ** 2) over a node's distances."""
    return _both(distances).groupBy(F.col("x").alias("node")).agg(F.sum(F.exp(-F.pow(F.col("d") / dc, F.lit(2.0)))).alias("rho"))


def peaks(distances: DataFrame, dc: float) -> DataFrame:
    """(node, rho, delta, higher): distance to the nearest node of higher density, and that node.

    Equal densities are ordered by node.  A node without a denser neighbour gets
    the largest delta there is, or its largest distance where none has any.
    """
    rho = densities(distances, dc)
    pairs = _both(distances).join(rho.withColumnsRenamed({"node": "x", "rho": "rho_x"}), "x").join(rho.withColumnsRenamed({"node": "y", "rho": "rho_y"}), "y")
    denser = (F.col("rho_y") > F.col("rho_x")) | ((F.col("rho_y") == F.col("rho_x")) & (F.col("y") < F.col("x")))
    near = pairs.groupBy(F.col("x").alias("node")).agg(F.max("rho_x").alias("rho"), F.min(F.when(denser, F.struct("d", "y"))).alias("up"), F.max("d").alias("far"))
    return deltas(near.select("node", "rho", "up.d", "up.y", "far"))


def deltas(near: DataFrame) -> DataFrame:
    """(node, rho, delta, higher) of (node, rho, d, y, far): its nearest denser node if any, and its largest distance."""
    top = near.agg(F.coalesce(F.max("d"), F.max("far")).alias("top"))
    return near.join(F.broadcast(top)).select("node", "rho", F.coalesce("d", "top").alias("delta"), F.col("y").alias("higher"))


def density_peaks(distances: DataFrame, scratch: Scratch, dc: float | None = None) -> DataFrame:
    """(node, cluster, rho, delta, halo): clusters named by their centre.

    Centres have a density above the mean and a delta above its deviation, or no
    denser neighbour at all.  The others follow their nearest denser node, by
    pointer jumping.  Halo: density below the border of the cluster.
    """
    distances = scratch.keep(distances.select("x", "y", F.col("d").cast("double").alias("d")), "distances")
    dc = cutoff(distances) if dc is None else dc
    found = scratch.keep(peaks(distances, dc), "peaks")

    def borders(own: DataFrame) -> DataFrame:
        pairs = _both(distances).where(F.col("d") <= dc).join(own.select(F.col("node").alias("x"), F.col("cluster").alias("cx"), F.col("rho").alias("rx")), "x").join(own.select(F.col("node").alias("y"), F.col("cluster").alias("cy"), F.col("rho").alias("ry")), "y")
        return pairs.where("cx <> cy").groupBy(F.col("cx").alias("cluster")).agg(F.max((F.col("rx") + F.col("ry")) / 2).alias("border"))

    return clusters(found, scratch, borders)


def clusters(found: DataFrame, scratch: Scratch, borders: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The clusters of peaks; ``borders`` gives (cluster, border) of (node, cluster, rho)."""
    limits = F.broadcast(found.agg(F.avg("rho").alias("mean_rho"), F.stddev_pop("delta").alias("sd_delta")))
    centre = F.col("higher").isNull() | ((F.col("rho") > F.col("mean_rho")) & (F.col("delta") > F.col("sd_delta")))
    tree = scratch.keep(found.join(limits).select("node", F.when(centre, F.col("node")).otherwise(F.col("higher")).alias("up")), "tree")
    while True:
        jump = tree.join(tree.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved"))
        jump = scratch.keep(jump, "jump")
        tree = jump.select("node", "up")
        if jump.where("moved").isEmpty():
            break
    marks = found.join(tree.withColumnRenamed("up", "cluster"), "node")
    border = borders(marks.select("node", "cluster", "rho"))
    return marks.join(border, "cluster", "left").select("node", "cluster", "rho", "delta", F.coalesce(F.col("rho") < F.col("border"), F.lit(False)).alias("halo"))
