"""Clustering against small dense versions."""

import duckdb
import numpy as np
import pytest

from kinspark.operators import affinity, columns, components, density, mcl, merging
from kinspark.plans import bindings


@pytest.fixture(scope="module")
def edges(spark):
    rng = np.random.default_rng(5)
    rows = []
    for block in range(4):
        names = [f"n{block}{i}" for i in range(6)]
        rows += [(a, b, float(rng.uniform(0.5, 1))) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.8]
    rows += [("n00", "n10", 0.05), ("n20", "n30", 0.05)]
    return spark.createDataFrame(rows, "src string, dst string, w double").cache()


def as_sets(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.node)
    return sorted(map(sorted, out.values()))


def test_mcl_forms_agree_and_part_the_blocks(edges, scratch):
    local = as_sets(mcl.mcl(edges, scratch))
    assert local == as_sets(mcl.relational_mcl(edges, scratch))
    assert len(local) == 4 and sum(map(len, local)) == 24


def test_mcl_keeps_a_hub_of_many_neighbours_whole(spark, scratch):
    names = np.array(["hub", *(f"leaf{k:04d}" for k in range(1500))])
    star = spark.createDataFrame([("hub", str(x), 1.0) for x in names[1:]], "src string, dst string, w double")
    label = mcl.local_mcl(names, np.repeat(names[:1], 1500), names[1:], np.ones(1500))
    assert set(label) == {0}
    assert as_sets(mcl.relational_mcl(star, scratch)) == as_sets(mcl.mcl(star, scratch)) == [names.tolist()]


@pytest.fixture(scope="module")
def wide(spark):
    """One component of more than 1000 nodes: groups of 5 on a ring, and the clusters that dense matrices find."""
    rng = np.random.default_rng(4)
    names = np.array([f"n{k:04d}" for k in range(1010)])
    pairs = [(a + i, a + j) for a in range(0, 1010, 5) for i in range(5) for j in range(i + 1, 5)] + [(a, (a + 7) % 1010) for a in range(0, 1010, 5)]
    src, dst = (np.array([x[k] for x in pairs]) for k in (0, 1))
    w = np.where(src // 5 == dst // 5, rng.uniform(0.5, 1, len(src)), 0.1)
    label = mcl.local_mcl(names, names[src], names[dst], w)
    rows = [(str(names[a]), str(names[b]), float(x)) for a, b, x in zip(src, dst, w)]
    return spark.createDataFrame(rows, "src string, dst string, w double"), sorted((str(n), str(names[k])) for n, k in zip(names, label))


def no_products(monkeypatch):
    def refuse(*_args, **_options):
        raise AssertionError("a table of all products")

    monkeypatch.setattr(mcl, "multiply", refuse)


def test_mcl_of_a_large_component_makes_no_table_of_products(wide, scratch, monkeypatch):  # F19
    no_products(monkeypatch)
    edges, wanted = wide
    assert len({k for _, k in wanted}) > 100
    assert sorted(map(tuple, mcl.mcl(edges, scratch).select("node", "cluster").collect())) == wanted


def test_staged_mcl_of_a_large_component_makes_no_table_of_products(wide, scratch, monkeypatch):  # F22
    no_products(monkeypatch)
    edges, wanted = wide
    assert sorted(map(tuple, merging.staged_mcl(edges, scratch).select("node", "cluster").collect())) == wanted


@pytest.mark.parametrize(("part", "cells", "width"), [(50, 40, 7), (1, 100_000, 13), (300, 900, 90)])
def test_mcl_by_columns_adds_up_its_parts(spark, scratch, monkeypatch, part, cells, width):
    monkeypatch.setattr(columns, "PART", part)
    monkeypatch.setattr(columns, "CELLS", cells)
    rng = np.random.default_rng(5)
    rows = [(f"n{i:02d}", f"n{j:02d}", float(rng.uniform(0.3, 1))) for i in range(60) for j in rng.choice(60, 2) if i != j]
    graph = spark.createDataFrame(rows, "src string, dst string, w double")
    found = columns.clusters(mcl.matrix(graph), scratch, 1.5, 100, mcl.PRUNE, width)
    assert as_sets(found) == as_sets(mcl.mcl(graph, scratch))


def test_blocks_of_columns_are_bounded_by_their_cells(spark, scratch, monkeypatch):  # F22
    monkeypatch.setattr(columns, "BLOCK_CELLS", 600, raising=False)
    pack, seen = columns.pack, []
    monkeypatch.setattr(columns, "pack", lambda entries, n, scratch, width: seen.append((n, width)) or pack(entries, n, scratch, width))
    rng = np.random.default_rng(5)
    graph = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", float(rng.uniform(0.3, 1))) for i in range(60) for j in rng.choice(60, 2) if i != j], "src string, dst string, w double")
    found = columns.clusters(mcl.matrix(graph), scratch, 1.5, 100, mcl.PRUNE)
    assert seen == [(60, 10)]
    assert as_sets(found) == as_sets(mcl.mcl(graph, scratch))


@pytest.fixture(scope="module")
def slow(spark):
    """Two triangles and a node between them, nearly as close to one as to the other: apart only after over 30 rounds."""
    rows = [(f"{t}{i}", f"{t}{j}", 1.0) for t in "ab" for i in range(3) for j in range(i)] + [("a0", "x", 0.5), ("b0", "x", 0.5 + 1e-8)]
    return spark.createDataFrame(rows, "src string, dst string, w double")


def rounds_of_sql(spark, monkeypatch, query, graph):
    """The clusters of a query on ``graph`` as its edges, and those of its SQL."""
    head = f"WITH RECURSIVE {bindings.EDGES},"
    sql = bindings.oracle_sql()[query]
    assert sql.startswith(head)
    con = duckdb.connect()
    con.execute("CREATE TABLE given (a VARCHAR, b VARCHAR, w DOUBLE)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?)", [tuple(r) for r in graph.collect()])
    wanted = con.execute("WITH RECURSIVE e2 AS (SELECT a, b, w FROM given UNION ALL SELECT b, a, w FROM given)," + sql.removeprefix(head)).fetchall()
    monkeypatch.setattr(bindings, "ortholog_edges", lambda *_: graph)
    return sorted(map(tuple, bindings.queries()[query](spark, "").select("node", "cluster").collect())), sorted(wanted)


def test_mcl_clusters_runs_the_rounds_of_its_sql(spark, monkeypatch, slow, scratch):  # F3
    found, wanted = rounds_of_sql(spark, monkeypatch, "mcl_clusters", slow)
    assert found == wanted and len(as_sets(mcl.mcl(slow, scratch))) > len({c for _, c in wanted})
    assert as_sets(mcl.mcl(slow, scratch, small=1, rounds=30)) == as_sets(mcl.mcl(slow, scratch, rounds=30))


def test_mcl_staged_runs_the_rounds_of_its_sql(spark, monkeypatch, slow, scratch):  # F4
    found, wanted = rounds_of_sql(spark, monkeypatch, "mcl_staged", slow)
    assert found == wanted and len(as_sets(merging.staged_mcl(slow, scratch))) > len({c for _, c in wanted})


def test_columns_sum_to_one(edges):
    sums = mcl.normalise_columns(mcl.matrix(edges)).groupBy("j").sum("w").collect()
    assert all(abs(r[1] - 1) < 1e-6 for r in sums)


def test_product_matches_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.random((7, 7)) * (rng.random((7, 7)) < 0.4)
    df = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i int, j int, w double")
    got = np.zeros((7, 7))
    for r in mcl.multiply(df, df).collect():
        got[r.i, r.j] = r.w
    assert np.allclose(got, m @ m)


def test_affinity_forms_agree(edges, scratch):
    assert as_sets(affinity.affinity(edges, scratch, 0.3)) == as_sets(affinity.relational_affinity(edges, scratch, 0.3))


def test_affinity_round_matches_dense(edges):
    now = affinity.messages(edges, 0.3)
    for _ in range(2):
        now = affinity.step(now)
    rows = now.collect()
    names = sorted({r.i for r in rows})
    at = {x: k for k, x in enumerate(names)}
    n = len(names)
    s = np.full((n, n), -np.inf)
    for r in rows:
        s[at[r.i], at[r.k]] = r.s
    there = np.isfinite(s)
    r_, a_ = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(2):
        t = np.where(there, r_ + a_, -np.inf)
        for i in range(n):
            order = sorted(np.flatnonzero(there[i]), key=lambda k: (-t[i, k], names[k]))
            m1, m2 = t[i, order[0]], t[i, order[1]]
            for k in order:
                r_[i, k] = 0.5 * r_[i, k] + 0.5 * (s[i, k] - (m2 if k == order[0] else m1))
        plus = np.where(there, np.maximum(r_, 0), 0)
        np.fill_diagonal(plus, 0)
        c = plus.sum(0)
        for i, k in zip(*np.nonzero(there)):
            a_[i, k] = 0.5 * a_[i, k] + 0.5 * (c[k] if i == k else min(0, r_[k, k] + c[k] - max(r_[i, k], 0)))
    for row in rows:
        assert abs(row.r - r_[at[row.i], at[row.k]]) < 1e-9 and abs(row.a - a_[at[row.i], at[row.k]]) < 1e-9


def test_density_peaks_part_two_clouds(spark, scratch):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 0.3, (15, 2)), rng.normal(5, 0.3, (15, 2))])
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    rows = [(f"p{i:02d}", f"p{j:02d}", float(d[i, j])) for i in range(30) for j in range(i + 1, 30)]
    got = density.density_peaks(spark.createDataFrame(rows, "x string, y string, d double"), scratch, 0.5)
    side = {}
    for r in got.collect():
        side.setdefault(r.cluster, set()).add(int(r.node[1:]) < 15)
    assert all(len(x) == 1 for x in side.values()) and len(side) >= 2


@pytest.mark.parametrize("chunk", [7, 400_000])
def test_components_of_paths_stars_and_loops(spark, scratch, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    rows = [(int(k), int(k + 1)) for k in range(1, 200)] + [(1000, int(k)) for k in range(1001, 1100)] + [(5000, 5000), (6000, 1050), (None, 3), (1, 2)]
    rows = [rows[k] if rng.random() < 0.5 else rows[k][::-1] for k in rng.permutation(len(rows))]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(rows, "src long, dst long").repartition(5), scratch).collect()}
    assert got == {k: 1 for k in range(1, 201)} | {k: 1000 for k in range(1000, 1100)} | {6000: 1000, 5000: 5000}


@pytest.fixture
def dealt(spark):
    """Exchanges keep all their partitions, as those of large tables do."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_components_of_a_small_graph_need_no_rounds(spark, scratch, monkeypatch, dealt):
    monkeypatch.setattr(components, "_large_star", None)
    rows = [(f"a{k:03d}", f"a{k + 1:03d}") for k in range(200)] + [("b", "b"), ("c", "b"), ("d", "d"), ("d", "d"), ("e", None), ("b", "c")]
    got = components.connected_components(spark.createDataFrame(rows, "src string, dst string").repartition(9), scratch).collect()
    assert sorted(map(tuple, got)) == [(f"a{k:03d}", "a000") for k in range(201)] + [("b", "b"), ("c", "b"), ("d", "d")]


@pytest.mark.parametrize("few", [0, 150, 100_000])
def test_components_by_rounds_and_by_one_task_are_the_same(spark, scratch, monkeypatch, dealt, few):
    monkeypatch.setattr(components, "FEW", few, raising=False)
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(k, k) for k in [5, 1050, 2000, 2000, 2001]]
    want = dict(components.stars(rows))
    want |= {x: x for r in rows for x in r if x not in want}
    edges = spark.createDataFrame([((a, "x"), (b, "x")) for a, b in rows], "src struct<k: long, h: string>, dst struct<k: long, h: string>").repartition(6)
    got = components.connected_components(edges, scratch).collect()
    assert sorted((tuple(r.node), tuple(r.component)) for r in got) == sorted(((x, "x"), (top, "x")) for x, top in want.items())


def test_components_of_structs_follow_their_order(spark, scratch):
    edges = spark.createDataFrame([((2, "b"), (2, "a")), ((2, "a"), (10, "a"))], "src struct<k: long, h: string>, dst struct<k: long, h: string>")
    assert {tuple(r.node): tuple(r.component) for r in components.connected_components(edges, scratch).collect()} == {k: (2, "a") for k in [(2, "a"), (2, "b"), (10, "a")]}


def test_affinity_runs_the_rounds_it_is_asked_for(spark, scratch):
    """Exemplars of this graph rest for more than 15 rounds, then change again."""
    rng, n = np.random.default_rng(10), 8
    m = np.triu(rng.uniform(0.3, 0.5, (n, n)) * (rng.random((n, n)) < 0.5), 1).round(3)
    rows = [(f"n{i}", f"n{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    found = affinity.affinity(spark.createDataFrame(rows, "src string, dst string, w double"), scratch, 0.1, rounds=60, patience=None)
    assert as_sets(found) == [["n0", "n1", "n4", "n6", "n7"], ["n2", "n3", "n5"]]
