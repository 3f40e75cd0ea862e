"""Toxicity by multiple-instance learning with a noisy-or over sentences.

A document is a bag of sentences.  A sentence's score is a logistic function of
hashed features of its words (the word, its first bytes, and its beginning in
two lengths, so that inflected forms of a word meet).  The document is toxic
unless every sentence is harmless: P = 1 - prod(1 - p).  Only document labels
train it; the sentence scores then locate the offending sentences.

Defined cases: a null or empty text has one harmless sentence without words;
repeated rows and ties score alike; an empty table gives an empty result; without
usable labels nothing is toxic.  Whole texts are read, very long ones in segments;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from kinspark.llm import samples, text as T

BUCKETS = 1 << 18
#: Lengths of word beginnings, in bytes; 0 is the whole word.
PREFIXES = (0, 4, 5, 7)
BREAK = np.zeros(256, bool)
BREAK[list(b".!?\n")] = True
#: Bytes outside words: all ASCII but letters and digits.
OUTSIDE = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def sentences(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the maximal runs of bytes between sentence ends."""
    return chunk.runs(BREAK)


def word_features(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's features (one column for each of PREFIXES, -1: none) and its start."""
    start, end, _ = chunk.runs(OUTSIDE)
    size = end - start
    out = np.empty((len(start), len(PREFIXES)), np.int32)
    for k, n in enumerate(PREFIXES):
        stop = end if n == 0 else np.minimum(start + n, end)
        h = T.mix(chunk.hashes(start, stop, lower=True) + T.U(k + 1)) & T.U(BUCKETS - 1)
        out[:, k] = np.where((n == 0) | (size > n), h.astype(np.int32), -1)
    return out, start


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    bias: float = -20.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + 1, np.float32))  # the last is that of -1

    def sentence_scores(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """p, start, end and document of every sentence."""
        start, end, doc = sentences(chunk)
        features, at = word_features(chunk)
        word, k = np.nonzero(self.weights[features])  # few: most weights are 0
        owner = np.searchsorted(start, at[word], "right") - 1
        pairs = np.unique(owner << 18 | features[word, k])  # a feature counts once in a sentence
        z = T.sum_by(self.weights[pairs & (BUCKETS - 1)].astype(np.float64), pairs >> 18, len(start)) + self.bias
        return logistic(z), start, end, doc

    def raw(self, chunk: T.Chunk) -> np.ndarray:
        p, _, _, doc = self.sentence_scores(chunk)
        return -np.expm1(T.sum_by(np.log1p(-np.minimum(p, 1 - 1e-12)), doc, len(chunk)))[:, None]

    def score(self, column: pa.Array) -> np.ndarray:
        return T.per_document(column, self.raw, 1)[:, 0]


def train(texts: pa.Array, toxic: np.ndarray, rounds: int = 120, rate: float = 0.3, lasso: float = 4e-4, least: int = 3) -> Model:
    """Adagrad on the noisy-or likelihood; features of under ``least`` documents are left out.

    ``lasso`` keeps the weights of most features at exactly 0: in a long clean
    text, thousands of slightly suspect words would else add up.  No weight is
    negative: harmless words beside an offence do not excuse it.
    """
    rows, bags = [], []
    n_sentences = 0
    for i, _, chunk in T.chunks(texts):
        start, _, doc = sentences(chunk)
        features, at = word_features(chunk)
        owner = np.searchsorted(start, at, "right") - 1 + n_sentences
        ok = features >= 0
        rows.append(np.stack([np.broadcast_to(owner[:, None], features.shape)[ok].astype(np.int32), features[ok]]))
        bags.append(doc + i)
        n_sentences += len(start)
    model = Model()
    if not n_sentences or toxic.all() or not toxic.any():
        return model
    bag = np.concatenate(bags)
    pairs = np.concatenate(rows, 1)
    del rows
    pairs = np.unique(pairs[0].astype(np.int64) << 18 | pairs[1])  # a feature counts once in a sentence
    owner, feature = (pairs >> 18).astype(np.int32), (pairs & (BUCKETS - 1)).astype(np.int32)
    in_docs = np.unique(bag[owner].astype(np.int64) << 18 | feature) & (BUCKETS - 1)
    often = np.bincount(in_docs, minlength=BUCKETS) >= least
    owner, feature = owner[often[feature]], feature[often[feature]]
    del pairs, in_docs
    n = len(toxic)
    y = toxic.astype(float)
    w, b = np.zeros(BUCKETS), -5.0
    for refit in (False, True):  # the lasso chooses features; their weights are then fitted without it
        square, square_b = np.full(BUCKETS, 1e-8), 1e-8
        shrink = 0.0 if refit else lasso
        if refit:
            owner, feature = owner[w[feature] != 0], feature[w[feature] != 0]
        for _ in range(rounds * (3 if refit else 1)):
            p = logistic(np.bincount(owner, weights=w[feature], minlength=n_sentences) + b)
            none = np.exp(T.sum_by(np.log1p(-np.minimum(p, 1 - 1e-9)), bag, n))
            factor = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0)
            slope = factor[bag] * p / n
            g = np.bincount(feature, weights=slope[owner], minlength=BUCKETS)
            square += g**2
            w -= rate * g / np.sqrt(square)
            w = np.maximum(w - rate * shrink / np.sqrt(square), 0)
            gb = slope.sum() - 1e-5
            square_b += gb**2
            b -= rate * gb / np.sqrt(square_b)
    return Model(float(b), np.append(w, 0.0).astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 2000, max_bytes: int = 16 << 20) -> Model:
    """Train on at most ``per_class`` usable labelled documents of each class, of ``max_bytes`` in all (see samples)."""
    rows = samples.labelled_sample(docs, labels, "toxic", usable, per_class, max_bytes)
    return train(pa.array(rows["text"], pa.string()), rows["_y"].to_numpy() == 1) if len(rows) else Model()


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) of every document."""

    def compute(column: pa.Array) -> dict[str, pa.Array]:
        score = model.score(column)
        return {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return T.map_texts(docs, ["doc_id"], compute, "score double, predicted int")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, byte start and end, and score of every sentence with a score of ``least`` or more."""
    read = docs.select("doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, _, chunk in T.chunks(batch.column(1)):
                p, start, end, doc = model.sentence_scores(chunk)
                hit = p >= least
                base = chunk.start[doc[hit]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + doc[hit])), pa.array(start[hit] - base), pa.array(end[hit] - base), pa.array(p[hit])], names=["doc_id", "start", "end", "score"])

    return read.mapInArrow(run, f"doc_id {kind}, start bigint, end bigint, score double")


def keep_harmless(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    return T.keep_texts(docs, lambda column: model.score(column) < 0.5)
