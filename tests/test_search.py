"""Alignment kernels, seeds, the search, and the text formats."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.functions import align, scores
from kinspark.operators import search, seeds, sequences
from kinspark.plans import pipeline
from kinspark.sources import text


def random_protein(rng, n):
    return "".join(rng.choice(list(align.RESIDUES), n))


def mutate(rng, s, rate):
    return "".join(rng.choice(list(align.RESIDUES)) if rng.random() < rate else c for c in s)


def test_substitution_table_is_symmetric():
    assert (align.TABLE == align.TABLE.T).all()
    assert align.TABLE[ord("W"), ord("w")] == 11 and align.TABLE[ord("B"), ord("D")] == 4 and align.TABLE[ord("A"), ord("?")] == -4


def plain_local(a, b):
    """Best raw score of the one-matrix affine alignment, cell by cell."""
    m, n = len(b), len(a)
    score = np.zeros((m + 1, n + 1), int)
    move = np.zeros((m + 1, n + 1), int)
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d = score[i - 1, j - 1] + align.TABLE[b[i - 1], a[j - 1]]
            x = score[i, j - 1] + (-1 if move[i, j - 1] == 2 else -11)
            y = score[i - 1, j] + (-1 if move[i - 1, j] == 3 else -11)
            score[i, j] = max(0, d, x, y)
            move[i, j] = 1 if score[i, j] == d else 2 if score[i, j] == x else 3 if score[i, j] == y else 0
    return score.max()


def test_full_alignment_matches_plain_and_wide_band():
    rng = np.random.default_rng(0)
    pairs = []
    for _ in range(12):
        a = random_protein(rng, int(rng.integers(5, 40)))
        cut = int(rng.integers(0, len(a)))
        pairs.append((align.codes(a), align.codes(a[:cut] + random_protein(rng, 3) + mutate(rng, a[cut:], 0.2))))
    full, wide = align.align_batch(pairs, None), align.align_batch(pairs, 60)
    for (a, b), f, w in zip(pairs, full, wide):
        short, long = (a, b) if len(a) < len(b) else (b, a)
        assert f.raw == w.raw == plain_local(short, long)
        assert (f.q_start, f.q_end, f.s_start, f.s_end) == (w.q_start, w.q_end, w.s_start, w.s_end)


def test_identical_sequences():
    c = align.codes("MKVLAWHRRED")
    one = align.align_batch([(c, c)])[0]
    assert (one.identity, one.length, one.mismatches, one.gaps, one.q_start, one.q_end) == (100.0, 11, 0, 0, 0, 11)
    assert one.raw == int(align.TABLE[c, c].sum())
    assert align.align_batch([]) == []
    assert align.align_batch([(align.codes(""), c)])[0].length == 0


def test_every_second_column_of_a_gap_counts():
    a, b = align.codes("WWWWWWWWWW" + "CCCCCCCCCC"), align.codes("WWWWWWWWWW" + "GGG" + "CCCCCCCCCC")
    one = align.align_batch([(a, b)])[0]
    assert one.length == 23 and one.mismatches == 3 and one.gaps == 2


def test_ungapped_extension_stops_after_a_drop():
    q = align.codes("A" + "W" * 10 + "D" * 30 + "W" * 30)
    s = align.codes("A" + "W" * 10 + "F" * 30 + "W" * 30)
    score, q0, q1, _, _ = align.ungapped(q, s, 5, 5)
    assert score == 110 and (q0, q1) == (1, 10)


def test_masks():
    assert align.mask_low_complexity("A" * 24) == "x" * 24
    varied = "ARNDCQEGHILKMFPSTWYV"
    assert align.mask_low_complexity(varied) == varied
    assert abs(align.window_entropy("ABCDEFGHIJKL", plain=True)[0] - np.log2(12)) < 1e-12


def test_scores(spark):
    row = spark.range(1).select(scores.bit_score(F.lit(100)).alias("b"), scores.e_value(F.lit(43), 10, F.lit(100), F.lit(100)).alias("e"), scores.e_value_text(F.lit(2.8817e-261)).alias("t"), scores.e_value_text(F.lit(0.0)).alias("z"), scores.two_decimals(F.lit(99.999)).alias("d")).first()
    assert row.b == 43 and abs(row.e - 1.1369e-8) < 1e-11 and row.t == "2.88e-261" and row.z == "0" and row.d == 99.99


def test_seeds_of_a_pattern(spark):
    rows = spark.createDataFrame([("a", "ABCD"), ("b", "AxCD"), ("c", "AB")], "id string, seq string")
    assert sorted(tuple(r) for r in seeds.seeds(rows, "101").collect()) == [("a", "AC", 0), ("a", "BD", 1)]
    reduced = rows.select(seeds.reduce_alphabet(F.col("seq"), "ABC,D").alias("r")).first().r
    assert reduced == "AAAD"


def test_dedupe_and_expansion(spark):
    rows = spark.createDataFrame([("s1", "MM"), ("s2", "MM"), ("s3", "LL")], "id string, seq string")
    assert sorted(tuple(r) for r in sequences.dedupe(rows).collect()) == [("s1;;;s2", "MM"), ("s3", "LL")]
    hits = spark.createDataFrame([("s1;;;s2", "s3", 5.0)], "q string, s string, bit double")
    assert sorted((r.q, r.s) for r in sequences.expand_hits(hits).collect()) == [("s1", "s3"), ("s2", "s3")]


def test_ordinals_are_dense(spark, scratch):
    rows = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "id string")
    got = sequences.add_ordinals(rows, scratch, ["id"])
    assert sorted((r.ordinal, r.id) for r in got.collect()) == [(i, f"k{i:03d}") for i in range(50)]
    assert sorted(r.ordinal for r in sequences.slice_ordinals(got, 5, 9).collect()) == [5, 6, 7, 8]


def test_search_finds_relatives(spark):
    rng = np.random.default_rng(7)
    base = [random_protein(rng, 120) for _ in range(4)]
    rows = [(f"A|{k}", s) for k, s in enumerate(base)] + [(f"B|{k}", mutate(rng, s, 0.1)) for k, s in enumerate(base)]
    df = spark.createDataFrame(rows, "id string, seq string")
    got = {(r.q, r.s): r for r in search.search(df, df, pattern="11111", masked=False).collect()}
    for k in range(4):
        assert (f"A|{k}", f"B|{k}") in got and got[f"A|{k}", f"A|{k}"].identity == 100.0
        assert ("A|0", "B|1") not in got


def test_cosines_match_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 8)).astype("float32")
    df = spark.createDataFrame([(f"v{i:02d}", [float(x) for x in v[i]]) for i in range(30)], "id string, vec array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    want = {(f"v{i:02d}", f"v{j:02d}") for i in range(30) for j in range(30) if i != j and round(float(u[i] @ u[j]), 6) > 0.2}
    assert {(r.q, r.s) for r in search.cosine_hits(df, 0.2, block=7).collect()} == want


@pytest.fixture
def fasta(tmp_path):
    rng = np.random.default_rng(11)
    base = [random_protein(rng, 90) for _ in range(5)]
    lines = []
    for taxon in "ABC":
        for k, s in enumerate(base):
            if not (taxon == "C" and k == 4):
                m = mutate(rng, s, 0.08)
                lines.append(f">{taxon}|g{k} some gene\n{m[:50]}\n{m[50:]}")
    path = tmp_path / "in.fsa"
    path.write_text("\n".join(lines))  # no newline at the end
    return str(path)


def test_fasta(spark, fasta):
    rows = text.read_fasta(spark, fasta).collect()
    assert len(rows) == 14 and {r.taxon for r in rows} == set("ABC") and all(r.len == 90 for r in rows)
    assert rows[0].id == rows[0].header.split(" ")[0]


def test_hits_round_trip_and_bad_rows(spark, tmp_path):
    path = tmp_path / "hits.sc"
    path.write_text("A|a\tB|b\t53.52\t340\t158\t0\t111\t450\t240\t579\t1.60e-105\t380\t450\t583\nA|a\tB|c\tbad\t1\t1\t0\t1\t2\t1\t2\t1\t1\n\nA|a\tB|d\t50\t10\t1\t0\t1\t10\t1\t10\t1e-5\t30\n")
    hits = text.read_hits(spark, str(path))
    assert sorted((r.s, r.qlen) for r in hits.collect()) == [("B|b", 450), ("B|d", None)]
    text.write_hits(hits, str(tmp_path / "out"))
    back = text.read_hits(spark, str(tmp_path / "out"))
    assert {r.identity for r in back.collect()} == {53.52, 50.0}
    path.write_text("a\tB|b\t53.52\t340\t158\t0\t111\t450\t240\t579\t1.60e-105\t380\n")
    with pytest.raises(Exception, match="without separator"):
        text.read_hits(spark, str(path)).collect()


def test_obo(spark, tmp_path):
    path = tmp_path / "x.obo"
    path.write_text("format-version: 1.2\n\n[Term]\nid: GO:0000001\nname: one\nnamespace: p\n\n[Term]\nid: GO:0000002\nname: two\nnamespace: p\nis_a: GO:0000001 ! one\n\n[Term]\nid: GO:0000003\nname: old\nis_obsolete: true\n\n[Typedef]\nid: part_of\n")
    rows = text.read_obo(spark, str(path))
    assert sorted((r.id, r.name, tuple(r.parents)) for r in rows.collect()) == [("GO:0000001", "one", ()), ("GO:0000002", "two", ("GO:0000001",))]
    assert sorted(tuple(r) for r in text.ontology_edges(rows).collect()) == [("GO:0000001", "GO:0000002"), ("root", "GO:0000001")]


def test_whole_pipeline(spark, fasta, tmp_path):
    out = str(tmp_path / "out")
    pipeline.run(spark, fasta, out, pattern="11111", expect=1e-5)
    totals = {r["class"]: r["n_groups"] for r in spark.read.parquet(f"{out}/totals").collect()}
    assert totals == {"Core": 4, "Share": 1}
    assert os.path.exists(f"{out}/curves")


def test_streamed_queries(spark, tmp_path):
    from kinspark.streaming.hits import stream_search

    rng = np.random.default_rng(1)
    base = [random_protein(rng, 80) for _ in range(3)]
    subjects = spark.createDataFrame([(f"A|{k}", s) for k, s in enumerate(base)], "id string, seq string")
    queries = spark.createDataFrame([(f"B|{k}", mutate(rng, s, 0.1)) for k, s in enumerate(base)], "id string, seq string")
    queries.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, seq string").parquet(str(tmp_path / "in"))
    stream_search(stream, subjects, str(tmp_path / "out"), str(tmp_path / "ck"), pattern="11111", masked=False).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.q, r.s) for r in got.collect()} >= {(f"B|{k}", f"A|{k}") for k in range(3)}


def test_centre_star():
    got = align.centre_star(["MKVLAW", "MKLAW", "MKVLAAW"])
    assert len({len(x) for x in got}) == 1 and [x.replace("-", "") for x in got] == ["MKVLAW", "MKLAW", "MKVLAAW"]


def test_kmer_numbers(spark):
    from kinspark.functions import kmers

    df = spark.createDataFrame([("acd",), ("",), ("foobar",)], "s string")
    rows = df.select("s", kmers.fnv1a_32(F.col("s")).alias("h"), kmers.kmer_number(F.col("s"), "abcd").alias("n")).collect()
    assert {r.s: r.h for r in rows if r.s != "acd"} == {"": 2166136261, "foobar": 0xBF9CF968}
    assert rows[0].n == 1 + 3 * 5 + 4 * 25
    back = df.limit(1).select(kmers.kmer_text(kmers.kmer_number(F.col("s"), "abcd"), "abcd", 3).alias("t")).first()
    assert back.t == "acd"


def test_concatenated_alignment(spark):
    from kinspark.operators import msa

    records = spark.createDataFrame([("A|1", "A", "MKVLAW"), ("B|1", "B", "MKLAW"), ("A|2", "A", "WWHHR"), ("C|1", "C", "WWHHR")], "id string, taxon string, seq string")
    pairs = spark.createDataFrame([("A|1", "B", "B|1"), ("A|2", "C", "C|1")], "ref string, taxon string, gene string")
    got = {r.taxon: r.aligned for r in msa.concatenated_alignment(pairs, records).collect()}
    assert got == {"A": "MKVLAWWWHHR", "B": "MK-LAW-----", "C": "------WWHHR"}


def test_blocks_with_several_sequences_of_a_taxon_are_an_error(spark):
    from kinspark.operators import msa

    rows = [(1, "A", "MKVLAW"), (1, "A", "MKVLAW"), (1, "B", "MKLAW")]
    schema = "block_id int, taxon string, seq string"
    got = {r.taxon: r.aligned for r in msa.align_blocks(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"A": "MKVLAW", "B": "MK-LAW"}
    with pytest.raises(Exception, match="several sequences of taxon A in block 1"):
        msa.align_blocks(spark.createDataFrame([*rows, (1, "A", "WWHHR")], schema)).collect()


def test_every_part_is_in_the_aligned_blocks(spark, tmp_path):
    from kinspark.plans import bindings

    parts = [(1, "x", "t", "red cat"), (2, "x", "t", "blue dog"), (3, "x", "u", "red cat"), (4, "y", "u", "owl")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.taxon: r.aligned.replace("-", "") for r in bindings.queries()["aligned_blocks"](spark, str(tmp_path)).collect()}
    assert got == {"t": "BLUEDOGREDCAT", "u": "REDCATOWL"}


def test_e_values_round_as_their_sql_does(spark, tmp_path):
    from kinspark.plans import bindings

    # 53580.50 / 100 is a little below 535.805: 535.8, of 210 bits, not 535.81, of 211
    row = [(48812, 19715, 1, 7, 10.0, 53580.50, 0.05)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(row, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.bits for r in bindings.queries()["e_values"](spark, str(tmp_path)).collect()] == [210]
