"""Reciprocal best hits, between all taxa or against a reference taxon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kinspark.operators.relations import taxon


def _best(hits: DataFrame, separator: str) -> DataFrame:
    """Best subject of each query in each other taxon; ties go to the smallest subject."""
    rows = hits.select("q", "s", "score", taxon(F.col("q"), separator).alias("qt"), taxon(F.col("s"), separator).alias("st")).where("qt <> st")
    order = Window.partitionBy("q", "st").orderBy(F.desc("score"), "s")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def reciprocal_best_hits(hits: DataFrame, separator: str = "|") -> DataFrame:
    """(a, b, weight): pairs that are each other's best, with the mean score."""
    best = _best(hits, separator)
    pairs = best.groupBy(F.least("q", "s").alias("a"), F.greatest("q", "s").alias("b")).agg(F.count("*").alias("n"), F.avg("score").alias("weight"))
    return pairs.where("n = 2").drop("n")


def taxon_census(genes: DataFrame, separator: str = "|") -> DataFrame:
    """(taxon, n_genes) of a table with a column ``gene``."""
    return genes.select("gene").distinct().groupBy(taxon(F.col("gene"), separator).alias("taxon")).agg(F.count("*").alias("n_genes"))


def reference_taxon(genes: DataFrame, separator: str = "|") -> DataFrame:
    """One row (taxon): the taxon with most genes, the smallest of equals."""
    return taxon_census(genes, separator).orderBy(F.desc("n_genes"), "taxon").limit(1).select("taxon")


def rbh_against(hits: DataFrame, reference: DataFrame, separator: str = "|", share: float = 0.9) -> DataFrame:
    """(ref, taxon, gene): reciprocal best hits of reference genes that most taxa confirm.

    ``reference``: one row with the reference taxon.  A gene is kept when it is
    confirmed in ``share`` of the taxa, its own included.
    """
    best = _best(hits, separator)
    ref = F.broadcast(reference.limit(1).select(F.col("taxon").alias("rt")))  # one row
    forward = best.join(ref, F.col("qt") == F.col("rt"), "left_semi").select(F.col("q").alias("ref"), F.col("st").alias("taxon"), F.col("s").alias("gene"))
    back = best.join(ref, F.col("st") == F.col("rt"), "left_semi").select(F.col("s").alias("ref"), F.col("q").alias("gene"))
    pairs = forward.join(back, ["ref", "gene"], "left_semi")
    n_taxa = hits.select(F.explode(F.array(taxon(F.col("q"), separator), taxon(F.col("s"), separator))).alias("t")).agg(F.countDistinct("t").alias("n_taxa"))
    kept = pairs.groupBy("ref").agg((F.countDistinct("taxon") + 1).alias("found")).join(F.broadcast(n_taxa), F.col("found") >= share * F.col("n_taxa"))
    return pairs.join(kept.select("ref"), "ref", "left_semi")


def ortholog_stars(edges: DataFrame, reference: DataFrame, separator: str = "|") -> DataFrame:
    """(ref, members): orthologs of each gene of the reference taxon; only the largest stars."""
    ot = edges.where(F.col("rel").isin("O", "OT"))
    both = ot.select(F.col("a").alias("ref"), F.col("b").alias("mate")).unionByName(ot.select(F.col("b").alias("ref"), F.col("a").alias("mate")))
    rt = F.broadcast(reference.limit(1).select(F.col("taxon").alias("rt")))  # one row
    own = both.join(rt, taxon(F.col("ref"), separator) == F.col("rt"), "left_semi")
    stars = own.groupBy("ref").agg(F.array_sort(F.collect_set("mate")).alias("members"))
    size = stars.agg(F.max(F.size("members")).alias("top"))
    return stars.join(F.broadcast(size), F.size("members") == F.col("top")).select("ref", "members")
