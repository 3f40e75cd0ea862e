"""Relations, reciprocal best hits and groups on small worked cases."""

import pytest

from kinspark.operators import graphs, rbh, relations
from kinspark.operators.components import connected_components

HITS = """A|a1 A|a1 100  A|a1 A|a2 80  A|a1 B|b1 70
A|a2 A|a2 100  A|a2 A|a1 80  A|a2 B|b1 60
A|a3 A|a3 100  A|a3 B|b2 50
B|b1 B|b1 100  B|b1 A|a1 70  B|b1 A|a2 60
B|b2 B|b2 100  B|b2 A|a3 50"""


@pytest.fixture(scope="module")
def best(spark):
    f = HITS.split()
    rows = [(f[i], f[i + 1], float(f[i + 2])) for i in range(0, len(f), 3)]
    return spark.createDataFrame(rows, "q string, s string, score double").cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_relations_of_the_worked_case(best):
    got = {(r.rel, r.a, r.b): round(r.weight, 6) for r in relations.relations(best).collect()}
    assert got == {("IP", "A|a1", "A|a2"): 1.0, ("OT", "A|a1", "B|b1"): 1.166667, ("OT", "A|a3", "B|b2"): 0.833333, ("CO", "A|a2", "B|b1"): 1.0}
    assert relations.invalid_relations(relations.relations(best)).isEmpty()


def test_one_direction_only_is_no_ortholog(spark):
    one = spark.createDataFrame([("A|a", "B|b", 5.0)], "q string, s string, score double")
    assert relations.relations(one).isEmpty()


def test_single_taxon_gives_in_paralogs_only(spark):
    two = spark.createDataFrame([("A|a", "A|b", 5.0), ("A|b", "A|a", 7.0)], "q string, s string, score double")
    assert rows(relations.relations(two)) == [("IP", "A|a", "A|b", 1.0)]


def test_empty_input(spark):
    none = spark.createDataFrame([], "q string, s string, score double")
    assert relations.relations(none).isEmpty()
    assert rbh.reciprocal_best_hits(none).isEmpty()


def test_reciprocal_best_hits(best):
    assert [(r.a, r.b) for r in rbh.reciprocal_best_hits(best).orderBy("a").collect()] == [("A|a1", "B|b1"), ("A|a3", "B|b2")]


def test_reference_taxon_and_stars(best, spark):
    genes = best.selectExpr("q as gene").distinct()
    reference = rbh.reference_taxon(genes)
    assert rows(reference) == [("A",)]
    assert sorted(r.ref for r in rbh.rbh_against(best, reference).collect()) == ["A|a1", "A|a3"]
    stars = rbh.ortholog_stars(relations.relations(best), reference)
    assert sorted((r.ref, tuple(r.members)) for r in stars.collect()) == [("A|a1", ("B|b1",)), ("A|a3", ("B|b2",))]


def test_quality_filter_and_missing_lengths(spark):
    hits = spark.createDataFrame([("A|x", "B|y", 90.0, 1, 340, None, 1, 50.0, 340), ("A|x", "B|z", 90.0, 1, 100, None, 2, 25.0, 100)], "q string, s string, identity double, qst int, qed int, qlen int, file_pos long, bit double, aln_len int")
    full = relations.with_query_length(hits)
    assert {r.qlen for r in full.collect()} == {340}
    assert [r.s for r in relations.quality_filter(full).collect()] == ["B|y"]
    assert sorted(r.score for r in relations.normalise_scores(full, "bsr").collect()) == [0.5, 1.0]
    with pytest.raises(ValueError):
        relations.normalise_scores(full, "other")


def test_components_match_union_find(spark, scratch):
    import random

    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for x in list(parent))
    df = spark.createDataFrame(edges, "src long, dst long")
    assert rows(connected_components(df, scratch)) == want


def test_components_of_nothing_and_loops(spark, scratch):
    empty = spark.createDataFrame([], "src long, dst long")
    assert connected_components(empty, scratch).isEmpty()
    loops = spark.createDataFrame([(1, 1), (2, None)], "src long, dst long")
    assert rows(connected_components(loops, scratch)) == [(1, 1)]


def test_group_comparison(spark):
    def table(text):
        return spark.createDataFrame([(k, c) for k, word in enumerate(text.split(",")) for c in word], "group_id long, gene string")

    r = graphs.compare_groups(table("ab,c"), table("ab,cd")).first()
    assert (r.n_left, r.n_right, r.equal_left, r.equal_right) == (2, 2, 1, 1)


def test_nearest_neighbours_keep_ties(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 0.5)], "src string, dst string, w double")
    assert rows(graphs.nearest_neighbours(e).select("node", "neighbour")) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]
