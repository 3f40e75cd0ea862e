"""Queries over vectors, which make no table of all hits, against their SQL."""

import numpy as np
import pytest

from kinspark.operators import cosines, search
from kinspark.plans import bindings

duckdb = pytest.importorskip("duckdb")

#: Queries that need the hits of all pairs, but not in a table.
QUERIES = [
    "relations_ot",  # F23
    "relations_ip",  # F20
    "relations_candidates",  # F9
    "relations_co_candidates",  # F18
    "co_expanded",  # F13
    "relations_normalised",  # F11
    "relations_invalid",  # F10
    "ortholog_stars",  # F8
    "connected",  # F3
    "component_graph",  # F2
    "cluster_compare",  # F1
    "nearest_neighbours",  # F7
    "neighbour_components",  # F16
    "scaled_component_graph",  # F21
    "merged_components",  # F15
    "edges_scaled",  # F5
    "density_peaks_delta",  # F14
    "density_clusters",  # F4
    "affinity_one_round",  # F12
    "mcl_two_rounds",  # F6
    "sparse_product",  # F24
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Vectors around some centres and some that are alone, with copies across and within taxa, in several blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 16))
    vecs = [centres[k % 9] + 0.6 * rng.normal(size=16) for k in range(45)] + list(rng.normal(size=(25, 16)))
    vecs += [vecs[k] for k in (0, 0, 1, 5)]
    path = str(tmp_path_factory.mktemp("vectors"))
    rows = [(k, [float(np.float32(x)) for x in v], int(rng.integers(4))) for k, v in enumerate(vecs)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def both(spark, folder, name):
    got = bindings.queries()[name](spark, folder)
    connection = duckdb.connect()
    connection.sql(f"create view embeddings as from '{folder}/embeddings.parquet/*.parquet'")
    wanted = connection.sql(bindings.oracle_sql()[name])
    columns = wanted.columns
    return sorted(map(tuple, got.select(*columns).collect()), key=str), sorted(wanted.fetchall(), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_query_makes_no_table_of_hits(spark, folder, monkeypatch, tmp_path, name):
    def refuse(*_args, **_options):
        raise AssertionError("a table of all hits")

    monkeypatch.setattr(search, "cosine_hits", refuse)
    monkeypatch.setattr(cosines, "hits", refuse, raising=False)
    monkeypatch.setattr(cosines, "BLOCK", 11)
    if name == "density_clusters":  # its SQL lets the order of a sum decide between copies
        spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 70").write.parquet(f"{tmp_path}/embeddings.parquet")
        folder = str(tmp_path)
    got, wanted = both(spark, folder, name)
    assert wanted and got == wanted


def test_repeated_ids_are_counted_row_by_row(spark, folder, tmp_path):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows.unionAll(rows.where("vec_id % 9 = 0")).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("hits_filtered", "relations_ot", "relations_ip"):
        got, wanted = both(spark, str(tmp_path), name)
        assert got == wanted
