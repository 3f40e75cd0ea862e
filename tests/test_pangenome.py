"""Profiles, rarefaction, fits, operons and the ontology on worked cases."""

import random

import numpy as np
import pytest

from kinspark.operators import ontology, operons, pangenome


def test_classes_of_the_worked_case(spark):
    grouped = spark.createDataFrame([("g0", x) for x in ("A|1", "B|1", "C|1", "D|1")] + [("g1", x) for x in ("A|2", "B|2", "B|3")] + [("g2", x) for x in ("C|2", "C|3")], "group_id string, gene string")
    genes = grouped.select("gene").unionAll(spark.createDataFrame([("D|9",)], "gene string"))
    full = pangenome.with_singletons(grouped, genes)
    classes = pangenome.classify(pangenome.presence(full))
    assert {r["group_id"]: r["class"] for r in classes.collect()} == {"g0": "Core", "g1": "Share", "g2": "Specific", "D|9": "Specific"}
    assert {r["class"]: r["n_groups"] for r in pangenome.totals(classes).collect()} == {"Core": 1, "Share": 1, "Specific": 2}
    assert [tuple(r) for r in pangenome.core_representatives(full, classes).collect()] == [("g0", "A|1")]
    wide = pangenome.wide(pangenome.presence(full), ["A", "B", "C", "D"])
    assert tuple(wide.where("group_id = 'g1'").first())[1:] == (1, 2, 0, 0)


def test_rarefaction_matches_counting(spark):
    rng = np.random.default_rng(4)
    taxa = [f"t{k}" for k in range(25)]
    there = rng.random((60, 25)) < rng.random((60, 1))
    rows = [(f"g{g}", taxa[k], 1) for g in range(60) for k in range(25) if there[g, k]]
    orders = pangenome.shuffles(taxa, 3)
    got = {(r.perm, r.n): (r.core, r.specific, r.pan) for r in pangenome.rarefaction(spark.createDataFrame(rows, "group_id string, taxon string, n int"), spark.createDataFrame(orders, "perm int, place int, taxon string")).collect()}
    for p in range(3):
        order = [taxa.index(t) for _, _, t in sorted(o for o in orders if o[0] == p)]
        for j in range(2, 26):
            y = there[:, order[:j]].sum(1)
            new = there[:, order[j - 1]] & (y - 1 <= max(0.05 * j, 1) - 1)
            assert got[p, j] == ((y >= 0.95 * j).sum(), new.sum(), (y > 0).sum())


def test_fits_find_the_parameters():
    n = np.repeat(np.arange(2, 30), 3).astype(float)
    got = {k: v for k, v, _ in pangenome.fit_curve("core", n, 900 * np.exp(-n / 6) + 400)}
    assert abs(got["k"] - 900) < 5 and abs(got["tau"] - 6) < 0.1 and abs(got["omega"] - 400) < 2
    got = {k: v for k, v, _ in pangenome.fit_curve("pan", n, 120 * n**0.4)}
    assert abs(got["k"] - 120) < 0.1 and abs(got["gamma"] - 0.4) < 1e-3
    assert abs(pangenome.student_t(0.975, 10) - 2.228) < 1e-3


def test_operons_of_the_worked_case(spark):
    lines = spark.createDataFrame([("gene_id\tx",), ("x1-->x2-->x3\tq",), ("y1<--y2<--y3<--z9",), ("x1-->z9",)], "value string")
    found = operons.parse(lines)
    groups = spark.createDataFrame([("1", "x1"), ("1", "y1"), ("2", "x2"), ("2", "y2"), ("3", "x3"), ("3", "y3"), ("9", "z9")], "group_id string, gene string")
    got = operons.overlaps(operons.assign_families(found, groups)).collect()
    assert [(r.shared, round(r.score, 6)) for r in got] == [(3, 0.857143)]


def test_ontology_levels(spark, scratch):
    edges = spark.createDataFrame([("root", "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "parent string, child string")
    assert {r.node: r.ancestor for r in ontology.ancestors_at(edges, scratch).collect()} == {"a": "a", "b": "b", "c": "c", "d": "b", "e": "b"}
    lines = spark.createDataFrame([("g1\tGO:0000001 GO:0000002",), ("g2\tnone",)], "value string")
    assert sorted(tuple(r) for r in ontology.terms(lines).collect()) == [("g1", "GO:0000001"), ("g1", "GO:0000002")]


def test_operon_overlaps_match_all_pairs(spark):
    import random

    rng = random.Random(5)
    sets = {k: set(rng.sample(range(12), rng.randrange(1, 8))) for k in range(40)} | {100 + k: set(range(k, 60)) for k in range(3)}
    df = spark.createDataFrame([(k, f"f{x}") for k, s in sets.items() for x in s], "operon_id long, family string")
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 3 and 2 * len(sets[a] & sets[b]) > min(len(sets[a]), len(sets[b]))}
    assert {(r.a, r.b): r.shared for r in operons.overlaps(df).collect()} == want
    assert (0 in sets) and all(r.a <= r.b for r in operons.overlaps(df, with_self=True).collect())


def test_equal_operons_are_compared_once(spark, monkeypatch):
    """The pairs of 2 x 30 copies come from the one pair of their classes, whatever the size of a chunk of members."""
    compared = []
    real = operons._class_overlaps
    monkeypatch.setattr(operons, "_class_overlaps", lambda sets, *a: compared.append(sets.count()) or real(sets, *a))
    monkeypatch.setattr(operons, "MEMBERS", 7)
    sets = {k: {"f1", "f2", "f3"} if k < 30 else {"f1", "f2", "f3", "f4"} for k in range(60)}
    df = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "operon_id long, family string")
    rows = operons.overlaps(df).collect()
    assert compared == [2] and len(rows) == 60 * 59 // 2
    assert {(r.a, r.b): r.shared for r in rows} == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}


@pytest.mark.parametrize(("least", "longest", "keys"), [(3, 40, 300), (2, 4, 60), (1, 5, 10**6), (4, 6, 200)])
def test_pairs_of_operons_are_neither_shuffled_nor_stored(spark, monkeypatch, least, longest, keys):  # F1
    """Copies, short and long operons in one block or many: the same pairs, and no exchange of pairs."""
    monkeypatch.setattr(operons, "KEYS", keys, raising=False)
    monkeypatch.setattr(operons, "PAIRS", 20, raising=False)
    monkeypatch.setattr(operons, "MEMBERS", 3)
    rng = random.Random(7)
    kinds = [frozenset(rng.sample(range(11), rng.randrange(1, 9))) for _ in range(20)]
    sets = {k: rng.choice(kinds) for k in range(60)}
    df = spark.createDataFrame([(k, f"f{x}") for k, s in sets.items() for x in s], "operon_id long, family string")
    found = operons.overlaps(df, least, longest=longest)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted((a, b, n, 2 * n / (len(sets[a]) + len(sets[b]))) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) >= least and 2 * n > min(len(sets[a]), len(sets[b])))
    got = sorted(map(tuple, found.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])
