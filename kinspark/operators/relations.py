"""Ortholog, in-paralog and co-ortholog relations from similarity hits.

A hit is (q, s, score) with optional alignment columns; the taxon of a gene is
the part of its id before a separator.  Everything is windows, grouped
aggregates and equi-joins, so the only state of a task is one key's rows in a
sorted stream; no key needs the hits of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def taxon(gene: Column, separator: str = "|") -> Column:
    """Taxon code of a gene id."""
    return F.substring_index(gene, separator, 1)


def with_query_length(hits: DataFrame) -> DataFrame:
    """Fill a missing qlen with the largest query coordinate of the query's first hit (by file_pos)."""
    reach = F.greatest("qst", "qed")
    own = Window.partitionBy("q")
    first = F.min_by(reach, F.col("file_pos")).over(own) if "file_pos" in hits.columns else F.max(reach).over(own)
    return hits.withColumn("qlen", F.coalesce(F.col("qlen"), first))


def coverage() -> Column:
    """Part of the query that the alignment covers."""
    return (1 + F.abs(F.col("qed") - F.col("qst"))) / F.col("qlen")


def quality_filter(hits: DataFrame, min_coverage: float = 0.5, min_identity: float = 0.0, both: bool = False) -> DataFrame:
    """Hits with enough query coverage and identity; with ``both`` with enough subject coverage too."""
    good = (coverage() >= min_coverage) & (F.col("identity") >= min_identity)
    if both:
        good = good & ((1 + F.abs(F.col("sed") - F.col("sst"))) / F.col("slen") >= min_coverage)
    return hits.where(good)


def normalise_scores(hits: DataFrame, how: str = "no") -> DataFrame:
    """score: the bit score ("no"), over the aligned length ("bal"), or over the query's first score ("bsr")."""
    if how == "no":
        score = F.col("bit")
    elif how == "bal":
        score = F.col("bit") / F.col("aln_len")
    elif how == "bsr":
        own = Window.partitionBy("q")
        first = F.min_by("bit", F.col("file_pos")).over(own) if "file_pos" in hits.columns else F.max("bit").over(own)
        score = F.col("bit") / first
    else:
        raise ValueError(f"unknown normalisation: {how}")
    return hits.withColumn("score", score.cast("double"))


def best_per_pair(hits: DataFrame) -> DataFrame:
    """(q, s, score): the best score of each directed pair."""
    return hits.groupBy("q", "s").agg(F.max("score").alias("score"))


def classify(best: DataFrame, separator: str = "|", with_self: bool = False) -> DataFrame:
    """(rel, q, s, a, b, score): candidates of each relation, the pair in order of its ids.

    A cross-taxon hit that reaches the query's best in that taxon is an ortholog
    candidate (OT), any other a co-ortholog candidate (CO); a same-taxon hit
    that reaches the query's best cross-taxon score is an in-paralog candidate (IP);
    a gene's hit with itself only is one ``with_self``.
    """
    rows = best.select("q", "s", "score", taxon(F.col("q"), separator).alias("qt"), taxon(F.col("s"), separator).alias("st"))
    cross = F.col("qt") != F.col("st")
    top = F.max("score").over(Window.partitionBy("q", "st"))
    outer = F.coalesce(F.max(F.when(cross, F.col("score"))).over(Window.partitionBy("q")), F.lit(0.0))
    rel = F.when(cross & (F.col("score") >= top), "OT").when(cross, "CO").when(((F.col("q") != F.col("s")) | F.lit(with_self)) & (F.col("score") >= outer), "IP")
    rows = rows.withColumn("rel", rel).where("rel is not null")
    return rows.select("rel", "q", "s", F.least("q", "s").alias("a"), F.greatest("q", "s").alias("b"), "score")


def reciprocal(candidates: DataFrame, rel: str) -> DataFrame:
    """(a, b, weight): pairs found from both sides, with their mean score."""
    pairs = candidates.where(F.col("rel") == rel).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("score").alias("weight"))
    return pairs.where("n = 2").select("a", "b", "weight")


def co_candidates(candidates: DataFrame) -> DataFrame:
    """(a, b, weight): the best score of each co-ortholog candidate pair."""
    return candidates.where("rel = 'CO'").groupBy("a", "b").agg(F.max("score").alias("weight"))


def expand_co(ot: DataFrame, ip: DataFrame, qco: DataFrame) -> DataFrame:
    """Co-ortholog candidates that in-paralogs of an ortholog pair reach.

    ({a} + IP(a)) x ({b} + IP(b)) of every ortholog (a, b), less (a, b) itself,
    restricted to candidates.  The candidates are looked up from the first side,
    so the product of two families is never laid out.
    """
    both = ip.select(F.col("a").alias("gene"), F.col("b").alias("mate")).unionByName(ip.select(F.col("b").alias("gene"), F.col("a").alias("mate")))
    edges = ot.select("a", "b")
    left = edges.select("a", "b", F.col("a").alias("x")).unionByName(edges.join(both.select(F.col("gene").alias("a"), F.col("mate").alias("x")), "a"))
    ends = qco.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight")
    ends = ends.unionByName(qco.select(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))
    reached = left.join(ends, "x")
    mates = both.select(F.col("gene").alias("b"), F.col("mate").alias("y"))
    direct = reached.where("y = b and x <> a")
    indirect = reached.join(mates, ["b", "y"], "left_semi")
    found = direct.select("x", "y", "weight").unionByName(indirect.select("x", "y", "weight"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight").distinct()


def normalise_paralogs(ip: DataFrame, ot: DataFrame, separator: str = "|") -> DataFrame:
    """Weights over the taxon's mean: of the pairs with a gene that has an ortholog if any, else of all."""
    genes = ot.select(F.col("a").alias("g")).unionByName(ot.select(F.col("b").alias("g"))).distinct().withColumn("hit", F.lit(1))
    marked = ip.join(genes.withColumnsRenamed({"g": "a", "hit": "hit_a"}), "a", "left").join(genes.withColumnsRenamed({"g": "b", "hit": "hit_b"}), "b", "left")
    anchored = F.col("hit_a").isNotNull() | F.col("hit_b").isNotNull()
    own = Window.partitionBy("t")
    mean = F.coalesce(F.avg(F.when(anchored, F.col("weight"))).over(own), F.avg("weight").over(own))
    return marked.withColumn("t", taxon(F.col("a"), separator)).select("a", "b", (F.col("weight") / mean).alias("weight"))


def normalise_cross(edges: DataFrame, separator: str = "|") -> DataFrame:
    """Weights over the mean of their pair of taxa."""
    pair = Window.partitionBy(taxon(F.col("a"), separator), taxon(F.col("b"), separator))
    return edges.select("a", "b", (F.col("weight") / F.avg("weight").over(pair)).alias("weight"))


def relations(best: DataFrame, separator: str = "|") -> DataFrame:
    """(rel, a, b, weight): all relations with normalised weights."""
    found = classify(best, separator)
    ot, ip = reciprocal(found, "OT"), reciprocal(found, "IP")
    return normalised(ot, ip, expand_co(ot, ip, co_candidates(found)), separator)


def normalised(ot: DataFrame, ip: DataFrame, co: DataFrame, separator: str = "|") -> DataFrame:
    """(rel, a, b, weight): the relations (a, b, weight) with weights over their means."""
    parts = {"IP": normalise_paralogs(ip, ot, separator), "OT": normalise_cross(ot, separator), "CO": normalise_cross(co, separator)}
    out = None
    for rel, edges in parts.items():
        own = edges.select(F.lit(rel).alias("rel"), "a", "b", "weight")
        out = own if out is None else out.unionByName(own)
    return out


def invalid_relations(edges: DataFrame, separator: str = "|") -> DataFrame:
    """Edges that break the definition: in-paralogs across taxa, orthologs within one."""
    same = taxon(F.col("a"), separator) == taxon(F.col("b"), separator)
    return edges.where(((F.col("rel") == "IP") & ~same) | ((F.col("rel") != "IP") & same))
