"""Quality, toxicity and rules: held-out accuracy, brute force, edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinspark.llm import crf, mil, rules, samples, text as T

from .conftest import sentence_text, words


def counts(text):
    """The statistics of a text, counted plainly."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def test_statistics_match_plain_counts(docs, texts):
    got = rules.judge_rules(docs, rules.Model(None, 2.0)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = counts(texts[r.doc_id])
        assert [r[c] for c in rules.COUNTS] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)


def labelled(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = sentence_text(rng, rng.randrange(40, 120))
        bad, toxic = k % 3 == 0, k % 4 == 0
        if bad:
            text = " ".join(w + rng.choice(["###", "&&&", "!!"]) for w in text.split(" "))
        if toxic:
            w = text.split(" ")
            w.insert(rng.randrange(len(w)), rng.choice(["vilething", "vileness", "cursedly"]))
            text = " ".join(w)
        rows.append((k, text, int(not bad), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"), {r[0]: r for r in rows}


def test_stuttered_words_are_rejected(spark):
    docs, labels, truth = labelled(spark)
    rng = random.Random(3)
    rows = [(1000 + k, " ".join(w for w in words(rng, 9) for _ in range(5)), 0) for k in range(30)]
    more = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    assert not any(set(r[1]) & set("#*$%&|<>!") or rules.base_failed(rules.measure(T.Chunk([r[1].encode()])))[0] for r in rows)
    model = rules.fit(docs.unionAll(more.select("doc_id", "text")), labels.select("doc_id", "quality").unionAll(more.select("doc_id", "quality")))
    assert not any(r.kept for r in rules.judge_rules(more, model).collect())
    kept = {r.doc_id: r.kept for r in rules.judge_rules(docs, model).collect()}
    good = [k for k, r in truth.items() if r[2]]
    assert sum(kept[k] for k in good) >= 0.99 * len(good) and not any(kept[k] for k, r in truth.items() if not r[2])


def test_forest_rejects_junk_and_keeps_the_rest(spark):
    docs, labels, truth = labelled(spark)
    model = rules.fit(docs, labels)
    got = {r.doc_id: r.kept for r in rules.judge_rules(docs, model).collect()}
    good = [k for k, r in truth.items() if r[2]]
    bad = [k for k, r in truth.items() if not r[2]]
    assert np.mean([got[k] for k in good]) > 0.97 and np.mean([not got[k] for k in bad]) > 0.9
    assert {r.doc_id for r in rules.keep_clean(docs, model).collect()} == {k for k, v in got.items() if v}


def test_forest_scores_isolated_points_higher():
    rng = np.random.default_rng(0)
    forest = rules.Forest.grow(rng.normal(size=(400, 3)))
    assert forest.score(np.array([[8.0, 8, 8]]))[0] > 0.65 > 0.55 > forest.score(np.zeros((1, 3)))[0]


@pytest.mark.parametrize("module, column, score", [(crf, "quality", "score_quality"), (mil, "toxic", "score_toxicity")])
def test_held_out_accuracy(spark, module, column, score):
    docs, labels, truth = labelled(spark, 400)
    model = module.fit(docs, labels, F.col("doc_id") < 250)
    got = {r.doc_id: r for r in getattr(module, score)(docs, model).collect()}
    k = 2 if column == "quality" else 3
    held = [i for i in truth if i >= 250]
    assert np.mean([got[i].predicted == truth[i][k] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    unary, move = rng.normal(size=7), rng.normal(size=(2, 2))
    p, pairs, log_z = crf.Chains(doc).marginals(unary, move)
    want, z_sum, want_pairs = np.zeros(7), 0.0, np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total, mass, own = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for bits in np.ndindex(*[2] * len(at)):
            w = np.exp(sum(unary[a] * b for a, b in zip(at, bits)) + sum(move[x, y] for x, y in zip(bits, bits[1:])))
            total += w
            mass += w * np.array(bits)
            for x, y in zip(bits, bits[1:]):
                own[x, y] += w
        want[at] = mass / total
        want_pairs += own / total
        z_sum += np.log(total)
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, z_sum)


def test_offending_sentences_are_located(spark):
    docs, labels, _ = labelled(spark, 300)
    model = mil.fit(docs, labels, F.lit(True))
    one = spark.createDataFrame([(1, "A quiet start. Then vilething came! Éin ruhiges end.")], "doc_id long, text string")
    hits = mil.offending_sentences(one, model).collect()
    assert len(hits) == 1
    raw = one.first().text.encode()
    assert b"vilething" in raw[hits[0].start : hits[0].end]


def test_lines_are_labelled(spark):
    docs, labels, _ = labelled(spark, 200)
    model = crf.fit(docs, labels, F.lit(True))
    text = "Aaao bbbo quiet words here.\n\nNoise### more&&& noise!!! ###"
    got = crf.label_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).orderBy("start").collect()
    assert [text.encode()[r.start : r.end].decode() for r in got] == [x for x in text.split("\n") if x]
    assert all(0 <= r.good <= 1 for r in got)


@pytest.mark.parametrize("run", [
    lambda d: crf.score_quality(d, crf.Model()),
    lambda d: mil.score_toxicity(d, mil.Model()),
    lambda d: rules.judge_rules(d, rules.Model(None, 2.0)),
])
def test_edge_rows_and_empty_tables(docs, no_docs, texts, run):
    rows = run(docs).collect()
    assert len(rows) == len(texts) + 1
    assert run(no_docs).collect() == []


def test_no_usable_labels(spark, docs):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert rules.fit(docs, none).forest is None
    assert crf.fit(docs, none, F.lit(True)).slope == 0
    assert mil.fit(docs, none, F.lit(True)).bias == -20


def test_words_are_hashed_by_content_only():
    chunk = T.Chunk([b"one two  one", b"", b"two one"])
    start, end, doc = chunk.runs(T.SPACE)
    h = chunk.hashes(start, end)
    assert doc.tolist() == [0, 0, 0, 2, 2] and h[0] == h[2] == h[4] and h[1] == h[3] != h[0]
    big = pa.array(["w" * 10] * 200_000)
    assert sum(j - i for i, j, _ in T.parts(big)) == 200_000


def test_vocabulary_helper_is_random():
    assert len(set(words(random.Random(1), 500))) > 100


def test_path_lengths_match_a_walk_down_each_tree():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(300, 2)), [[9.0, 9], [0, 7]]])
    forest = rules.Forest.grow(points, trees=16, sample=64)
    got = forest.score(points)
    for k in (0, 1, 17, 300, 301):
        lengths = []
        for t in range(16):
            node, deep = 0, 0
            while forest.column[t][node] >= 0:
                node = int((forest.left if points[k][forest.column[t][node]] < forest.value[t][node] else forest.right)[t][node])
                deep += 1
            # a leaf holds its depth and what a tree of its other points would add
            assert forest.depth[t][node] >= deep
            lengths.append(forest.depth[t][node])
        harmonic = sum(1 / i for i in range(1, 64))
        assert np.isclose(got[k], 2 ** (-np.mean(lengths) / (2 * harmonic - 2 * 63 / 64)), rtol=2e-3)
    assert got[300] > np.quantile(got[:300], 0.99)


def test_growth_sees_no_labels(spark):
    docs, labels, truth = labelled(spark)
    turned = labels.selectExpr("doc_id", "1 - quality as quality")
    own, other = rules.fit(docs, labels), rules.fit(docs, turned)
    for (a, _), (b, _) in zip(own.forest, other.forest, strict=True):
        assert np.array_equal(a.value, b.value) and np.array_equal(a.column, b.column)


@pytest.mark.parametrize("good, bad, spare, lost", [([1, 2, 3, 4], [5, 6], 0, 0), (list(range(1000)), [999.5] * 10, 0.005, 0), (list(range(1000)), [10] * 10, 0.005, 0)])
def test_thresholds_spare_good_rows(good, bad, spare, lost):
    score = np.array([*good, *bad]) / 2000
    is_good = np.arange(len(score)) < len(good)
    least = rules.calibrate(score, is_good, spare)
    assert (score[is_good] >= least).sum() <= lost
    assert ((score[~is_good] >= least).all()) == (min(bad) > max(good))


def test_scores_are_a_plain_noisy_or(spark, docs, texts):
    train, labels, _ = labelled(spark)
    model = mil.fit(train, labels, F.lit(True))
    got = {r.doc_id: r.score for r in mil.score_toxicity(docs, model).collect()}
    got |= {r.doc_id + 10_000: r.score for r in mil.score_toxicity(train, model).collect()}
    every = dict(texts) | {r.doc_id + 10_000: r.text for r in train.collect()}

    def bucket(piece, k):
        chunk = T.Chunk([piece])
        at = np.array([1]), np.array([1 + len(piece)])
        return int(T.mix(chunk.hashes(*at, lower=True) + T.U(k + 1))[0]) & mil.BUCKETS - 1

    for i, x in every.items():
        harmless = 1.0
        for sentence in re.split(rb"[.!?\n]", (x or "").encode()):
            features = set()
            for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence):
                features |= {bucket(w, 0)} | {bucket(w[:n], k) for k, n in enumerate(mil.PREFIXES) if n and len(w) > n}
            if sentence:
                harmless *= 1 - 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[f]) for f in features))))
        assert np.isclose(got[i], 1 - harmless, atol=1e-6), i


def test_samples_are_bounded_by_rows_and_bytes_and_hold_whole_texts(spark):
    rows = [(k, "word " * (20_000 if k == 7 else 10), k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    every = samples.labelled_sample(df, df, "quality", F.lit(True), 100, 1 << 30)
    assert len(every) == 40 and every["text"].str.len().max() == 100_000
    assert samples.labelled_sample(df, df, "quality", F.lit(True), 5, 1 << 30)["_y"].tolist().count(1) == 5
    few = samples.labelled_sample(df, df, "quality", F.lit(True), 100, 400)
    assert (few["_y"] == 0).sum() == 4 and 1 <= (few["_y"] == 1).sum() <= 4
    with_corpus = samples.labelled_sample(df, df.where("quality = 1"), "quality", F.lit(True), 3, 1 << 30, 10)
    assert with_corpus["_corpus"].sum() == 10 and with_corpus["_y"].notna().sum() == 3


def test_thresholds_count_all_labelled_rows(spark, monkeypatch):
    """The rows of every label are counted, also beyond 2000 of a class; a count is the same as so many rows."""
    plain = " ".join(f"word{k}" for k in range(40))
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit(plain), F.lit(" "), F.col("id").cast("string")).alias("text"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    real = rules.calibrate
    monkeypatch.setattr(rules, "calibrate", lambda score, good, spare, weight=None: seen.append(len(score) if weight is None else int(weight.sum())) or (real(score, good, spare) if weight is None else real(score, good, spare, weight)))
    rules.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert seen[0] == 5000
    rng = np.random.default_rng(2)
    score, good = np.round(rng.random(300), 2), rng.random(300) < 0.7
    score[~good] += 0.3
    keys, n = np.unique(np.stack([score, good]), axis=1, return_counts=True)
    assert real(keys[0], keys[1] == 1, 0.005, n) == real(score, good, 0.005)
