"""The stages on a small corpus against their plain versions."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinspark.llm import queries

from .conftest import sentence_text
from .test_duplicates import components, plain_removal, shingle_set


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    passage = sentence_text(rng, 60)
    rows = []
    for k in range(240):
        text = sentence_text(rng, rng.randrange(40, 160))
        bad, toxic = k % 6 == 0, k % 6 == 1
        if bad:
            text = " ".join(w + rng.choice(["###", "&&&"]) for w in text.split(" "))
        if toxic:
            w = text.split(" ")
            w.insert(rng.randrange(len(w)), rng.choice(["vilething", "vileness"]))
            text = " ".join(w)
        if k % 6 == 2 and k > 100:
            text = text + "\n" + passage
        rows.append((k, text, "en", "src0", len(text), int(not bad), int(toxic)))
    rows += [(1000 + r[0], r[1], *r[2:]) for r in rows[3:60:6]]
    folder = str(tmp_path_factory.mktemp("sf"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    df.drop("quality", "toxic").write.parquet(f"{folder}/documents.parquet")
    df.select("doc_id", "quality", "toxic").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_take_effect(spark, corpus, tmp_path):
    folder, rows = corpus
    docs = queries.table(spark, folder, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    truth = {r[0]: r for r in rows}
    after_rules = {r.doc_id for r in seen["quality_rules"].collect()}
    assert not any(truth[i][5] == 0 for i in after_rules) and sum(truth[i][5] for i in after_rules) >= 0.97 * sum(r[5] for r in rows)
    after_toxic = {r.doc_id: r.text for r in seen["toxicity"].collect()}
    assert not any(truth[i][6] for i in after_toxic) and len(after_toxic) >= 0.97 * sum(not truth[i][6] for i in after_rules)
    want = set(components({i: shingle_set(t, 5) for i, t in after_toxic.items()}).values())
    after_near = {r.doc_id: r.text for r in seen["near_dedup"].collect()}
    assert set(after_near) == want
    ids = sorted(after_near)
    left = dict(zip(ids, plain_removal([after_near[i] for i in ids])))
    after_suffix = {r.doc_id: r for r in seen["suffix_dedup"].collect()}
    assert {i: len(r.text.encode()) for i, r in after_suffix.items()} == {i: left[i][0] - left[i][1] for i in ids}
    assert all(r.n_chars == len(r.text) for r in after_suffix.values())
    packed = seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in seen["packing"].collect()} == set(ids) and max(r.n for r in packed) <= 1024


def test_run_returns_the_last_stage(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert set(got.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and got.count() > 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows_and_empty_tables(spark, corpus, texts, docs, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    extra = docs.unionAll(docs.where("doc_id in (1, 501, 505)").withColumn("doc_id", F.lit(None).cast("long")))
    got = stage(spark, extra, corpus[0]).collect()
    assert stage(spark, no_docs, corpus[0]).collect() == []
    ids = [r.doc_id for r in got]
    if name == "packing":
        assert {r.doc_id for r in got} == {*texts, None}
        return
    assert stage(spark, extra, corpus[0]).columns == docs.columns
    if name == "quality_rules":
        assert not {500, 501, 502, 503} & set(ids) and {1, 505, None} <= set(ids) and ids.count(3) == 2
    elif name == "near_dedup":
        assert {500, 501, 502, 505} <= set(ids) and ids.count(3) == 1 and ids.count(None) == 3
    else:
        assert {500, 501, 502, 503} <= set(ids) and ids.count(3) == 2 and ids.count(None) >= 2
