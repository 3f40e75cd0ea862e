"""Single stages from the command line, and options of the search and of clustering."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.functions import align, scores
from kinspark.operators import graphs, mcl, merging, pangenome, relations, search, seeds
from kinspark.plans import cli
from kinspark.sources import text

from .test_search import mutate, random_protein


@pytest.fixture(scope="module")
def families():
    """Two families of related proteins and some that are alone, with their taxa."""
    rng = np.random.default_rng(7)
    rows = []
    for family in range(3):
        base = random_protein(rng, 120)
        rows += [(f"t{k}|f{family}", base if k == 0 else mutate(rng, base, 0.12)) for k in range(4)]
    return rows + [(f"t{k}|alone{k}", random_protein(rng, 90)) for k in range(3)]


@pytest.fixture(scope="module")
def proteins(spark, families):
    return spark.createDataFrame(families, "id string, seq string").cache()


def key(hits):
    return sorted((r.q, r.s, r.bit, r.qst, r.qed) for r in hits.collect())


def test_longest_chains_match_all_subsets():
    rng = np.random.default_rng(2)
    for _ in range(60):
        rows = [tuple(x) for x in rng.integers(0, 9, (rng.integers(0, 9), 2)).tolist()]
        got = align.longest_chain(rows)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:])) and set(got) <= set(rows)
        best = max((n for n in range(len(rows) + 1) for c in itertools.combinations(sorted(set(rows)), n) if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best


def test_bands_of_diagonals_chain_across_a_gap(spark):
    rng = np.random.default_rng(3)
    a, b = random_protein(rng, 60), random_protein(rng, 60)
    rows = spark.createDataFrame([("x|1", a + b), ("y|1", a + random_protein(rng, 3) + b)], "id string, seq string")
    found = seeds.seed_hits(*[seeds.seeds(rows, "111111")] * 2).where("q = 'y|1' and s = 'x|1'")
    narrow, wide = (search.candidates(rows, rows, found, width=w).first().raw for w in (1, 8))
    assert wide > 1.5 * narrow


def test_parts_of_the_subjects_give_the_same_hits(proteins, scratch):
    whole = search.search(proteins, proteins, "11111", masked=False)
    parts = search.search_parts(proteins, proteins, 3, scratch, pattern="11111", masked=False)
    # seed limits follow the part's buckets, so that chance hits may differ; those of relatives do not
    assert {x[:2] for x in key(whole)} == {x[:2] for x in key(parts)} and len(key(whole)) >= 3 * 16


def test_patience_only_spares_what_comes_late(proteins):
    whole = search.search(proteins, proteins, "11111", masked=False)
    patient = search.search(proteins, proteins, "11111", masked=False, patience=1.0)
    assert key(patient) == key(whole)
    pairs = proteins.select(F.col("id").alias("q")).crossJoin(proteins.select(F.col("id").alias("s"))).where("q = 't0|f0'").withColumns({"raw": F.lit(30), "shift": F.lit(0)})
    many = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(60)))).withColumn("raw", F.col("raw") + F.col("copy")).drop("copy")
    found = search.align_until(many, proteins, proteins, 15, 1e-3, most=2, patience=0.01).count()
    every = search.e_value_filter(search.align_pairs(many, proteins, proteins), 15).count()
    assert every == 240 and found == 12  # two and ten more


def test_kept_index_gives_the_same_hits(spark, proteins, tmp_path):
    spark.sql("DROP TABLE IF EXISTS kept_seeds")
    seeds.save_index(seeds.seeds(proteins, "11111"), "kept_seeds", 4)
    own = search.search(proteins, proteins, "11111", masked=False, index=seeds.load_index(spark, "kept_seeds"))
    assert key(own) == key(search.search(proteins, proteins, "11111", masked=False))
    spark.sql("DROP TABLE kept_seeds")


def test_masks_reach_further(spark):
    low = "MKVLAWHRRE" + "A" * 14 + "DTSGHKWYFE"
    plain = align.mask_low_complexity(low)
    around = align.mask_around(plain)
    at = [k for k, c in enumerate(plain) if c == "x"]
    assert at and around == "".join("x" if any(abs(k - x) <= 8 for x in at) else c for k, c in enumerate(plain))
    assert align.mask_around("") == "" and align.mask_around("ABC") == "ABC"
    rows = spark.createDataFrame([("a", low), ("b", None)], "id string, seq string")
    assert {r.id: r.seq for r in search.mask(rows, reach=8).collect()} == {"a": around, "b": None}


def test_small_functions(spark):
    got = spark.range(1).select(*[scores.choose(F.lit(n), F.lit(k)).alias(f"c{n}_{k}") for n, k in ((5, 2), (30, 15), (4, 0), (3, 7))], scores.raw_score(scores.bit_score(F.lit(500))).alias("raw")).first()
    assert got[:4] == (10, math.comb(30, 15), 1, 0) and abs(got.raw - 500) < 3
    hits = spark.createDataFrame([("a|1", "a|1", 9.0), ("a|1", "b|1", 5.0), ("a|1", "a|2", 4.0)], "q string, s string, score double")
    assert {(r.rel, r.s) for r in relations.classify(hits, with_self=True).collect()} == {("OT", "b|1"), ("IP", "a|1")}
    assert {(r.rel, r.s) for r in relations.classify(hits).collect()} == {("OT", "b|1")}


def test_subsets_of_taxa(spark):
    taxa = ["a", "b", "c"]
    profile = spark.createDataFrame([("g1", "a", 1), ("g1", "b", 2), ("g1", "c", 1), ("g2", "b", 1), ("g3", "a", 0)], "group_id string, taxon string, n int")
    subsets = spark.createDataFrame(pangenome.combinations_of(taxa), "subset int, size int, taxon string")
    got = {(r["subset"], r["size"]): (r.core, r.specific, r.pan) for r in pangenome.subset_profile(profile, subsets).collect()}
    assert got[(0, 1)] == (1, 1, 1) and got[(1, 1)] == (2, 2, 2) and got[(3, 2)] == (1, 1, 2) and got[(6, 3)] == (1, 1, 2) and len(got) == 7
    assert len(pangenome.combinations_of(taxa, 1)) == 6
    medians = pangenome.size_medians(pangenome.subset_profile(profile, subsets)).collect()
    assert {r["size"]: r.pan for r in medians} == {1: 1.0, 2: 2.0, 3: 2.0}


def test_staged_clusters(spark, scratch):
    rng = np.random.default_rng(5)
    rows = []
    for block in range(3):
        names = [f"t{i}|b{block}" for i in range(5)]
        rows += [(a, b, float(rng.uniform(0.6, 1))) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows += [("t0|b0", "t0|b1", 0.1)]
    edges = spark.createDataFrame(rows, "src string, dst string, w double")
    blocks = sorted(sorted(f"t{i}|b{k}" for i in range(5)) for k in range(3))

    def sets(found):
        out = {}
        for r in found.collect():
            out.setdefault(r.cluster, []).append(r.node)
        return sorted(sorted(x) for x in out.values())

    assert sets(merging.staged_mcl(edges, scratch)) == sets(mcl.mcl(edges, scratch)) == blocks
    assert sets(merging.staged_mcl(edges, scratch, "scaled", floor=0.5)) == blocks
    assert len({r.component for r in merging.merged_components(edges, scratch).collect()}) == 2
    assert len({r.component for r in merging.merged_components(edges, scratch, "mcl").collect()}) == 2
    with pytest.raises(ValueError):
        merging.merged_components(edges, scratch, "other")


def read_lines(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_commands_from_sequences_to_curves(spark, families, tmp_path):
    fasta, out = str(tmp_path / "in.fa"), lambda x: str(tmp_path / x)
    with open(fasta, "w") as f:
        f.writelines(f">{i}\n{s}\n" for i, s in families)
    cli.main(["search", "-i", fasta, "-o", out("hits"), "-s", "11111", "-e", "1e-5", "--unmasked"], spark)
    hits = text.read_hits(spark, out("hits"))
    assert {(r.q, r.s) for r in hits.collect()} >= {(f"t0|f{k}", f"t1|f{k}") for k in range(3)}
    cli.main(["search", "-i", fasta, "-o", out("few"), "-s", "11111", "-l", "0", "-u", "3", "-c", "2", "--unmasked"], spark)
    assert len({r.q for r in text.read_hits(spark, out("few")).collect()}) == 3
    cli.main(["relations", "-i", out("hits"), "-o", out("rel"), "--both"], spark)
    found = text.read_relations(spark, out("rel")).collect()
    assert {r.rel for r in found} >= {"OT"} and all(r.a < r.b for r in found)
    for how in ("mcl", "whole", "apc", "sap", "connected"):
        cli.main(["cluster", "-i", out("rel"), "-o", out(how), "-a", how], spark)
    want = sorted("\t".join(f"t{k}|f{f}" for k in range(4)) for f in range(3))
    assert read_lines(spark, out("mcl")) == read_lines(spark, out("whole")) == read_lines(spark, out("connected")) == want
    assert sum(len(x.split("\t")) for x in read_lines(spark, out("apc"))) == 12
    cli.main(["compare", "-i", out("mcl"), "-d", out("whole"), "-o", out("cmp")], spark)
    assert read_lines(spark, out("cmp")) == ["3\t3\t3\t3"]
    cli.main(["rbh", "-i", out("hits"), "-o", out("rbh")], spark)
    cli.main(["rbh", "-i", out("hits"), "-o", out("ref"), "-r", "--share", "0.5"], spark)
    assert len(read_lines(spark, out("rbh"))) == 18 and len(read_lines(spark, out("ref"))) == 9
    cli.main(["profile", "-i", out("mcl"), "-d", fasta, "-o", out("classes")], spark)
    lines = [x.split("\t") for x in read_lines(spark, out("classes"))]
    assert [x[0] for x in lines] == [f"group_{k:09d}" for k in range(6)] and sorted(x[-1] for x in lines) == ["Core"] * 3 + ["Specific"] * 3
    cli.main(["core", "-i", out("mcl"), "-d", fasta, "-o", out("core")], spark)
    assert sorted(r.id for r in text.read_fasta(spark, out("core")).collect()) == [f"t0|f{k}" for k in range(3)]
    cli.main(["curves", "-i", out("mcl"), "-o", out("curves"), "--times", "3"], spark)
    assert {x.split("\t")[0] for x in read_lines(spark, out("curves"))} == {"core", "specific", "pan"}


def test_commands_on_records(spark, tmp_path):
    folder = tmp_path / "fa"
    folder.mkdir()
    (folder / "a.fa").write_text(">x\nMKV\n>y\nMKV\n")
    (folder / "b.fa").write_text(">z\nAAA\n")
    out = lambda x: str(tmp_path / x)
    cli.main(["merge", "-i", str(folder), "-o", out("merged")], spark)
    assert sorted(r.id for r in text.read_fasta(spark, out("merged")).collect()) == ["0|x", "0|y", "1|z"]
    cli.main(["merge", "-i", str(folder), "-o", out("named"), "--label", "([a-z])[.]fa$"], spark)
    assert sorted(r.id for r in text.read_fasta(spark, out("named")).collect()) == ["a|x", "a|y", "b|z"]
    cli.main(["dedupe", "-i", out("merged"), "-o", out("unique")], spark)
    assert sorted((r.id, r.seq) for r in text.read_fasta(spark, out("unique")).collect()) == [("0|x;;;0|y", "MKV"), ("1|z", "AAA")]
    rows = [("0|x;;;0|y", "1|z", 50.0, 3, 0, 0, 1, 3, 1, 3, 1e-9, 30.0, 3, 3)]
    names = text.HIT_COLUMNS.replace(" string", "").split(", ")
    text.write_hits(spark.createDataFrame(rows, names), out("hits"))
    cli.main(["expand", "-i", out("hits"), "-o", out("all")], spark)
    assert sorted((r.q, r.s) for r in text.read_hits(spark, out("all")).collect()) == [("0|x", "1|z"), ("0|y", "1|z")]
    spark.sql("DROP TABLE IF EXISTS made_seeds")
    cli.main(["makedb", "-i", out("merged"), "-o", "made_seeds", "-s", "11", "-M", "2"], spark)
    assert seeds.load_index(spark, "made_seeds").count() == 6
    spark.sql("DROP TABLE made_seeds")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("a", "b", 1.0)], "src string, dst string, w double")
    assert [tuple(r) for r in graphs.canonical_edges(graphs.sum_edges(edges)).collect()] == [("a", "b", 2.0)]
