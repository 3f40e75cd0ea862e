"""Operations on weighted graphs as edge tables (src, dst, w) and on groups of genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kinspark.operators.components import connected_components
from kinspark.scratch import Scratch


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, src <= dst; of repeated edges the largest weight."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; loops once."""
    back = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").unionByName(back)


def sum_edges(edges: DataFrame) -> DataFrame:
    """Weights of repeated edges added up."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def nearest_neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour, w): the best edges of every node, ties included."""
    both = mirrored(edges.where("src <> dst"))
    rows = both.withColumn("r", F.rank().over(Window.partitionBy("src").orderBy(F.desc("w"))))
    return rows.where("r = 1").select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "w")


def component_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, w): total weight between components; ``labels`` is (node, component)."""
    src = labels.select(F.col("node").alias("src"), F.col("component").alias("cs"))
    dst = labels.select(F.col("node").alias("dst"), F.col("component").alias("cd"))
    joined = edges.join(src, "src").join(dst, "dst").where("cs <> cd")
    return joined.groupBy(F.least("cs", "cd").alias("src"), F.greatest("cs", "cd").alias("dst")).agg(F.sum("w").alias("w"))


def prune_rows(entries: DataFrame, floor: float, most: int, least: int) -> DataFrame:
    """Entries (i, j, w) of a sparse matrix, pruned by row.

    A row keeps its entries above ``floor``, but ``most`` of them if there are
    more, and its ``least`` largest if there are fewer.
    """
    row = Window.partitionBy("i")
    ranked = entries.withColumn("r", F.row_number().over(row.orderBy(F.desc("w"), "j"))).withColumn("n", F.sum(F.when(F.col("w") > floor, 1).otherwise(0)).over(row))
    keep = F.when(F.col("n") > most, F.lit(most)).when(F.col("n") < least, F.lit(least)).otherwise(F.col("n"))
    return ranked.where(F.col("r") <= keep).select("i", "j", "w")


def two_largest(entries: DataFrame) -> DataFrame:
    """(i, k1, m1, m2): the largest entry of each row, where it is, and the second largest."""
    ranked = entries.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("w"), "j"))).where("r <= 2")
    return ranked.groupBy("i").agg(F.max(F.when(F.col("r") == 1, F.col("j"))).alias("k1"), F.max(F.when(F.col("r") == 1, F.col("w"))).alias("m1"), F.max(F.when(F.col("r") == 2, F.col("w"))).alias("m2"))


def groups(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(group_id, gene): connected components, named by their smallest gene."""
    found = connected_components(edges, scratch)
    return found.select(F.col("component").alias("group_id"), F.col("node").alias("gene"))


def members(grouped: DataFrame) -> DataFrame:
    """(group_id, members): sorted members of each group, for output by line."""
    return grouped.groupBy("group_id").agg(F.array_sort(F.collect_set("gene")).alias("members"))


def compare_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: groups on either side, and those that are equal as sets.

    A group is told by its size and two hashes of its members, so groups of any
    size are compared without being gathered.
    """

    def marks(grouped: DataFrame) -> DataFrame:
        rows = grouped.select("group_id", "gene").distinct()
        return rows.groupBy("group_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("gene")).alias("h1"), F.bit_xor(F.xxhash64("gene", F.lit(1))).alias("h2")).select("n", "h1", "h2")

    a, b = marks(left).withColumn("side", F.lit(0)), marks(right).withColumn("side", F.lit(1))
    by = a.unionByName(b).groupBy("n", "h1", "h2").agg(F.sum(1 - F.col("side")).alias("in_a"), F.sum("side").alias("in_b"))
    both = F.col("in_a") * F.col("in_b") > 0
    sums = by.agg(F.sum("in_a").alias("n_left"), F.sum("in_b").alias("n_right"), F.sum(F.when(both, F.col("in_a")).otherwise(0)).alias("equal_left"), F.sum(F.when(both, F.col("in_b")).otherwise(0)).alias("equal_right"))
    return sums.select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in sums.columns])
