"""Roll-up of annotations along an ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinspark.scratch import Scratch


def ancestors_at(edges: DataFrame, scratch: Scratch, level: int = 2, root: str = "root") -> DataFrame:
    """(node, ancestor): the node at ``level`` on the shortest path from the root.

    ``edges``: (parent, child).  A node above that level is its own ancestor; of
    several shortest paths the smallest ancestor counts.  Breadth first: one join
    for each level of the ontology, nodes already reached are left out.
    """
    edges = scratch.keep(edges.select("parent", "child").distinct(), "ontology")
    front = scratch.keep(edges.where(F.col("parent") == root).select(F.col("child").alias("node"), F.lit(1).alias("depth"), F.col("child").alias("ancestor")).distinct(), "front")
    seen = front
    depth = 1
    while True:
        depth += 1
        own = F.col("child") if depth <= level else F.col("ancestor")
        step = front.join(edges, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node")).agg(F.min(own).alias("ancestor"))
        step = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "ancestor")
        front = scratch.keep(step, "front")
        if front.isEmpty():
            return seen.select("node", "ancestor")
        seen = seen.unionByName(front)


def contingency(annotations: DataFrame, ancestors: DataFrame, classes: DataFrame) -> DataFrame:
    """(ancestor, class, n): distinct (gene, term) by ancestor and gene class.

    ``annotations``: (gene, term); ``classes``: (gene, class), "unknown" for others.
    """
    rows = annotations.select("gene", "term").distinct().join(ancestors.withColumnRenamed("node", "term"), "term")
    rows = rows.join(classes.select("gene", "class"), "gene", "left").withColumn("class", F.coalesce("class", F.lit("unknown")))
    return rows.groupBy("ancestor", "class").agg(F.count("*").alias("n"))


def terms(lines: DataFrame, column: str = "value") -> DataFrame:
    """(gene, term): every GO id in a line whose first field is a gene."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"(GO:\d{7})"), F.lit(1))
    return lines.select(F.substring_index(F.col(column), "\t", 1).alias("gene"), F.explode(found).alias("term")).distinct()
