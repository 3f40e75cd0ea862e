"""Command line of the single stages: files in, files out.

python -m kinspark.plans.cli COMMAND -i IN -o OUT ...; the whole analysis is
kinspark.plans.pipeline.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinspark.operators import affinity, graphs, mcl, merging, pangenome, rbh, relations, search, seeds, sequences
from kinspark.scratch import Scratch
from kinspark.session import local_session
from kinspark.sources import text


def _records(spark: SparkSession, path: str, a: argparse.Namespace, scratch: Scratch, lower: int = -1, upper: int = -1) -> DataFrame:
    """(id, seq) of a FASTA file, or of the records from ``lower`` up to ``upper`` in the order of their ids."""
    rows = text.read_fasta(spark, path, a.separator)
    if lower >= 0 or upper >= 0:
        rows = sequences.slice_ordinals(sequences.add_ordinals(rows, scratch, ["id"]), lower, upper)
    return rows.select("id", "seq")


def makedb(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """Keep the seed index of a FASTA file as a table bucketed by seed."""
    seeds.save_index(seeds.seeds(_records(spark, a.input, a, scratch), a.pattern), a.output, a.buckets)


def search_(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """Hits of the queries in the subjects."""
    query = _records(spark, a.input, a, scratch, a.lower, a.upper)
    subjects = _records(spark, a.database or a.input, a, scratch, a.first, a.last)
    options = {"pattern": a.pattern, "expect": a.expect, "most": a.most, "width": a.width, "patience": a.patience, "masked": not a.unmasked}
    if a.parts > 1:
        hits = search.search_parts(query, subjects, a.parts, scratch, **options)
    else:
        hits = search.search(query, subjects, index=seeds.load_index(spark, a.index) if a.index else None, **options)
    text.write_hits(hits, a.output)


def relate(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """Relations of a table of hits, as rel, a, b, weight."""
    hits = text.read_hits(spark, a.input, a.separator)
    good = relations.quality_filter(relations.with_query_length(hits), a.coverage, a.identity, a.both)
    best = scratch.keep(relations.best_per_pair(relations.normalise_scores(good, a.norm)), "best")
    text.write_rows(relations.relations(best, a.separator), a.output)


def cluster(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """Groups of a table of edges or relations: a line of genes for each."""
    edges = scratch.keep(graphs.canonical_edges(graphs.sum_edges(text.read_edges(spark, a.input)) if a.sum else text.read_edges(spark, a.input)), "edges")
    if a.algorithm in ("mcl", "whole"):
        found = mcl.mcl(edges, scratch, a.inflation) if a.algorithm == "whole" else merging.staged_mcl(edges, scratch, a.merge, a.inflation)
    elif a.algorithm in ("apc", "sap"):
        scaled = affinity.min_max_scaled(edges) if a.algorithm == "sap" else edges
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
        each = -10.0 if a.algorithm == "sap" else -20.0
        preference = affinity.taxa_preference(nodes, a.separator, each) if a.preference is None else a.preference
        found = affinity.affinity(scaled, scratch, preference)
    else:
        found = graphs.groups(edges, scratch).select(F.col("gene").alias("node"), F.col("group_id").alias("cluster"))
    text.write_groups(found.select(F.col("cluster").alias("group_id"), F.col("node").alias("gene")), a.output)


def best_hits(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """Reciprocal best hits, of all taxa or of the taxon with most genes."""
    hits = text.read_hits(spark, a.input, a.separator).select("q", "s", F.col("bit").alias("score"))
    if not a.reference:
        text.write_rows(rbh.reciprocal_best_hits(hits, a.separator), a.output)
        return
    genes = hits.select(F.explode(F.array("q", "s")).alias("gene"))
    text.write_rows(rbh.rbh_against(hits, rbh.reference_taxon(genes, a.separator), a.separator, a.share), a.output)


def dedupe(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """One record for each sequence, its ids joined."""
    text.write_fasta(sequences.dedupe(_records(spark, a.input, a, scratch)), a.output)


def expand(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """Hits between joined ids as hits between all their single ids."""
    text.write_hits(sequences.expand_hits(text.read_hits(spark, a.input, a.separator, check_ids=False)), a.output)


def merge(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """Records of several files, their ids with a label: the file's number, or what ``--label`` captures of its path."""
    rows = text.read_fasta(spark, a.input, a.separator)
    if a.label:
        rows = rows.withColumn("id", sequences.add_prefix(F.col("id"), F.col("path"), a.label))
    else:
        rows = sequences.label_by_file(rows)
    text.write_fasta(rows, a.output)


def profile(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """Numbered groups with their class and their genes in each taxon."""
    grouped = text.read_groups(spark, a.input)
    if a.database:
        grouped = pangenome.with_singletons(grouped, _records(spark, a.database, a, scratch).select(F.col("id").alias("gene")))
    found = scratch.keep(pangenome.presence(grouped, a.separator), "presence")
    classes = sequences.add_ordinals(pangenome.classify(found, low=a.low, high=a.high), scratch, ["group_id"])
    text.write_rows(classes.select(text.group_label(F.col("ordinal")).alias("label"), "group_id", "n_taxa", "n_genes", "class"), a.output)


def core(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """Sequences of one gene of each core group."""
    grouped = scratch.keep(text.read_groups(spark, a.input), "groups")
    chosen = pangenome.core_representatives(grouped, pangenome.classify(pangenome.presence(grouped, a.separator), low=a.low, high=a.high))
    text.write_fasta(sequences.by_ids(_records(spark, a.database, a, scratch), chosen.select(F.col("gene").alias("id"))), a.output)


def curves(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """Fits of the rarefaction, as points of their curves."""
    found = scratch.keep(pangenome.presence(text.read_groups(spark, a.input), a.separator), "presence")
    taxa = [r["taxon"] for r in found.select("taxon").distinct().collect()]  # taxa are few
    orders = spark.createDataFrame(pangenome.shuffles(taxa, a.times), "perm int, place int, taxon string")
    samples = scratch.keep(pangenome.rarefaction(found, orders, a.low, a.high), "samples")
    points = pangenome.curve_points([tuple(r) for r in pangenome.fit_profile(samples).collect()], len(taxa))  # three short curves
    text.write_rows(spark.createDataFrame(points, "curve string, n int, value double"), a.output)


def compare(spark: SparkSession, a: argparse.Namespace, scratch: Scratch) -> None:
    """How many groups of two files are equal."""
    text.write_rows(graphs.compare_groups(text.read_groups(spark, a.input), text.read_groups(spark, a.database)), a.output)


COMMANDS = {"makedb": makedb, "search": search_, "relations": relate, "cluster": cluster, "rbh": best_hits, "dedupe": dedupe, "expand": expand, "merge": merge, "profile": profile, "core": core, "curves": curves, "compare": compare}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=__doc__)
    out.add_argument("command", choices=COMMANDS)
    out.add_argument("-i", "--input", required=True)
    out.add_argument("-o", "--output", required=True)
    out.add_argument("-d", "--database", help="subjects, sequences or the second file")
    out.add_argument("--separator", default="|")
    group = out.add_argument_group("search")
    group.add_argument("-s", "--pattern", default="1111111")
    group.add_argument("-e", "--expect", type=float, default=1e-5)
    group.add_argument("-v", "--most", type=int, default=500)
    group.add_argument("-l", "--lower", type=int, default=-1)
    group.add_argument("-u", "--upper", type=int, default=-1)
    group.add_argument("-L", "--first", type=int, default=-1)
    group.add_argument("-U", "--last", type=int, default=-1)
    group.add_argument("-c", "--parts", type=int, default=1)
    group.add_argument("-w", "--width", type=int, default=1)
    group.add_argument("-t", "--patience", type=float)
    group.add_argument("-M", "--buckets", type=int, default=200)
    group.add_argument("--index")
    group.add_argument("--unmasked", action="store_true")
    group = out.add_argument_group("relations")
    group.add_argument("--coverage", type=float, default=0.5)
    group.add_argument("-y", "--identity", type=float, default=0.0)
    group.add_argument("-n", "--norm", choices=["no", "bsr", "bal"], default="no")
    group.add_argument("--both", action="store_true", help="coverage of the subject too")
    group.add_argument("-r", "--reference", action="store_true", help="best hits against the taxon with most genes")
    group.add_argument("--share", type=float, default=0.9)
    group = out.add_argument_group("clusters")
    group.add_argument("-a", "--algorithm", choices=["mcl", "whole", "apc", "sap", "connected"], default="mcl")
    group.add_argument("-I", "--inflation", type=float, default=1.5)
    group.add_argument("-p", "--preference", type=float)
    group.add_argument("--merge", choices=["connected", "scaled", "mcl"], default="connected")
    group.add_argument("--sum", action="store_true", help="add up the weights of repeated edges")
    group = out.add_argument_group("profiles")
    group.add_argument("--low", type=float, default=0.05)
    group.add_argument("--high", type=float, default=0.95)
    group.add_argument("--times", type=int, default=20)
    group.add_argument("--label", help="pattern that captures a file's label in its path")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or local_session()
    scratch = Scratch(spark)
    COMMANDS[a.command](spark, a, scratch)
    scratch.drop()


if __name__ == "__main__":
    main()
