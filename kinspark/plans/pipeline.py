"""The whole analysis, from sequences to groups and their pan-genome profile."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinspark.operators import affinity, mcl, operons, pangenome, relations, search, sequences
from kinspark.scratch import Scratch
from kinspark.session import local_session
from kinspark.sources import text


def hits_to_relations(hits: DataFrame, min_coverage: float = 0.5, min_identity: float = 0.0, norm: str = "no", separator: str = "|") -> DataFrame:
    """Relations (rel, a, b, weight) of a table of hits."""
    good = relations.quality_filter(relations.with_query_length(hits), min_coverage, min_identity)
    return relations.relations(relations.best_per_pair(relations.normalise_scores(good, norm)), separator)


def relations_to_groups(edges: DataFrame, scratch: Scratch, how: str = "mcl", inflation: float = 1.5, preference: float | None = None, separator: str = "|") -> DataFrame:
    """(group_id, gene) by Markov clustering ("mcl") or affinity propagation ("apc")."""
    graph = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").alias("w"))
    if how == "mcl":
        found = mcl.mcl(graph, scratch, inflation)
    elif how == "apc":
        if preference is None:
            nodes = graph.select(F.col("src").alias("node")).unionByName(graph.select(F.col("dst").alias("node")))
            preference = affinity.taxa_preference(nodes, separator)
        found = affinity.affinity(graph, scratch, preference)
    else:
        raise ValueError(f"unknown clustering: {how}")
    return found.select(F.col("cluster").alias("group_id"), F.col("node").alias("gene"))


def sequences_to_hits(records: DataFrame, scratch: Scratch, dedupe: bool = True, **options) -> DataFrame:
    """All-against-all hits of records (id, seq); equal sequences are searched once."""
    own = scratch.keep(sequences.representatives(records) if dedupe else records.select("id", "seq"), "records")
    hits = search.search(own, own, **options)
    return sequences.expand_members(hits, scratch.keep(sequences.memberships(records), "members")) if dedupe else hits


def run(spark: SparkSession, fasta: str, out: str, how: str = "mcl", operon_path: str | None = None, min_coverage: float = 0.5, min_identity: float = 50.0, norm: str = "no", inflation: float = 1.5, low: float = 0.05, high: float = 0.95, separator: str = "|", **options) -> None:
    """Every stage, each written under ``out`` and read again by the next."""
    scratch = Scratch(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    records = keep(text.read_fasta(spark, fasta, separator), "sequences")
    hits = keep(sequences_to_hits(records.select("id", "seq"), scratch, **options), "hits")
    edges = keep(hits_to_relations(hits, min_coverage, min_identity, norm, separator), "relations")
    groups = keep(relations_to_groups(edges, scratch, how, inflation, separator=separator), "groups")
    genes = records.select(F.col("id").alias("gene"))
    full = keep(pangenome.with_singletons(groups, genes), "groups_all")
    profile = keep(pangenome.presence(full, separator), "profile")
    classes = keep(pangenome.classify(profile, low=low, high=high), "classes")
    keep(pangenome.totals(classes), "totals")
    taxa = [r["taxon"] for r in records.select("taxon").distinct().collect()]  # taxa are few
    orders = spark.createDataFrame(pangenome.shuffles(taxa), "perm int, place int, taxon string")
    samples = keep(pangenome.rarefaction(profile, orders, low, high), "rarefaction")
    keep(pangenome.fit_profile(samples), "curves")
    if operon_path:
        found = operons.parse(spark.read.text(operon_path))
        keep(operons.overlaps(operons.assign_families(found, full)), "operons")
    scratch.drop()


def main(args: list[str] | None = None) -> None:
    """Command line: sequences in, tables out."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("-i", "--fasta", required=True)
    parser.add_argument("-o", "--out", required=True)
    parser.add_argument("-p", "--operons")
    parser.add_argument("-s", "--pattern", default="1111111")
    parser.add_argument("-c", "--coverage", type=float, default=0.5)
    parser.add_argument("-y", "--identity", type=float, default=50.0)
    parser.add_argument("-n", "--norm", choices=["no", "bsr", "bal"], default="no")
    parser.add_argument("-l", "--low", type=float, default=0.05)
    parser.add_argument("-u", "--high", type=float, default=0.95)
    parser.add_argument("-A", "--algorithm", choices=["mcl", "apc"], default="apc")
    parser.add_argument("-I", "--inflation", type=float, default=1.5)
    parser.add_argument("-v", "--most", type=int, default=1000)
    parser.add_argument("-e", "--expect", type=float, default=1e-5)
    a = parser.parse_args(args)
    run(local_session(), a.fasta, a.out, a.algorithm, a.operons, a.coverage, a.identity, a.norm, a.inflation, a.low, a.high, pattern=a.pattern, most=a.most, expect=a.expect)


if __name__ == "__main__":
    main()
