"""Text quality by a linear-chain conditional random field over lines.

Every line with a word is good or bad.  Its features are rates of symbols,
capitals, repetition and the like, of the line itself and of the lines before
and after it; the chain adds weights for pairs of neighbouring labels.  The
weights maximise the conditional likelihood of line labels taken over from
labelled documents.  A document's quality is the length-weighted mean of the
forward-backward marginals, put on a probability scale by a logistic fit.

Defined cases: a text without a word (null, empty, blank) has quality 0 before
that scale, the lowest score there is; repeated rows and ties score alike; an
empty table gives an empty result; without usable labels every score is 0.5.
Whole texts are read, very long ones in segments; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from kinspark.llm import rules, samples, text as T


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, DIGIT, STOPS = _table(bytes(range(65, 91))), _table(bytes(range(48, 58))), _table(b".,;:?")
ENDS = _table(b".!?:;\"')")
OWN = 13  # features of a line


def line_features(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, weight (bytes) and document of every line that has a word."""
    buf = chunk.buf
    filled = ~T.SPACE[buf]
    again, _ = rules.duplicate_lines(chunk, filled)
    start, end, doc = chunk.lines()
    w_start, w_end, w_doc = chunk.runs(T.SPACE)
    hashes = chunk.hashes(w_start, w_end)
    first = np.searchsorted(w_start, start)
    last = np.searchsorted(w_start, end)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[last] - sums[first]) / words

    n_words = last - first
    words = np.maximum(n_words, 1)
    chars = np.maximum(chunk.total(filled, start, end), 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (w_doc[1:] == w_doc[:-1])
    marked = chunk.total(rules.MARKED[buf], w_start, w_end) > 0
    f = np.column_stack(
        [
            np.log1p(n_words),
            chars / words,
            np.minimum(chunk.total(rules.SYMBOLS[buf], start, end) / words, 4),
            share(marked),
            chunk.total(UPPER[buf], start, end) / chars,
            chunk.total(buf == ord("!"), start, end) / chars,
            chunk.total(buf == ord("|"), start, end) / words,
            chunk.total(DIGIT[buf], start, end) / chars,
            np.minimum(chunk.total(STOPS[buf], start, end) / words, 2),
            share(same),
            share(rules.repeated_words(hashes, w_doc)),
            again,
            ENDS[buf[np.maximum(end - 1, 0)]],
        ]
    )
    real = n_words > 0
    return f[real], (end - start)[real].astype(float), doc[real]


def with_neighbours(f: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after, two edge flags and a constant."""
    n = len(f)
    before, after = np.zeros_like(f), np.zeros_like(f)
    joined = doc[1:] == doc[:-1]
    before[1:][joined] = f[:-1][joined]
    after[:-1][joined] = f[1:][joined]
    edge = np.ones((n, 3))
    edge[1:, 0] = ~joined
    edge[:-1, 1] = ~joined
    return np.hstack([f, before, after, edge])


class Chains:
    """Lines of several documents as columns of equally placed lines, longest document first."""

    def __init__(self, doc: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(doc)]]))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        self.steps = [first[: np.searchsorted(-size, -t, "left")] + t for t in range(int(size[0]) if len(size) else 0)]
        self.last = first + size - 1

    def marginals(self, unary: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, expected label pairs, and the log partition sum.

        ``unary``: score of good against bad; ``move``: 2 x 2 scores of label pairs.
        """
        hop = np.exp(move - move.max())
        up = np.stack([np.exp(-np.maximum(unary, 0)), np.exp(np.minimum(unary, 0))], 1)  # (bad, good), the larger is 1
        log_z = float(np.maximum(unary, 0).sum())
        alpha, beta, norm = np.empty_like(up), np.ones_like(up), np.ones(len(up))
        for t, at in enumerate(self.steps):
            a = up[at] if t == 0 else up[at] * (alpha[at - 1] @ hop)
            norm[at] = z = a.sum(1)
            alpha[at] = a / z[:, None]
            if t:
                log_z += len(at) * float(move.max())
        log_z += float(np.log(norm).sum())
        pairs = np.zeros((2, 2))
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            right = up[at] * beta[at] / norm[at][:, None]
            pairs += (alpha[at - 1].T @ right) * hop
            beta[at - 1] = right @ hop.T
        return alpha[:, 1] * beta[:, 1], pairs, log_z


@dataclass
class Model:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(OWN))
    scale: np.ndarray = field(default_factory=lambda: np.ones(OWN))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * OWN + 3))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    offset: float = 0.0

    def line_marginals(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good), weight and document of every line."""
        f, weight, doc = line_features(chunk)
        x = with_neighbours((f - self.mean) / self.scale, doc)
        return Chains(doc).marginals(x @ self.weights, self.move)[0], weight, doc

    def raw(self, chunk: T.Chunk) -> np.ndarray:
        """Length-weighted mean marginal of each document, 0 without lines."""
        good, weight, doc = self.line_marginals(chunk)
        total = T.sum_by(weight, doc, len(chunk))
        return (T.sum_by(good * weight, doc, len(chunk)) / np.maximum(total, 1e-9))[:, None]

    def score(self, column: pa.Array) -> np.ndarray:
        raw = T.per_document(column, self.raw, 1)[:, 0]
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - 0.5) + self.offset, -30, 30)))


def train(texts: pa.Array, good: np.ndarray, rounds: int = 160, rate: float = 0.1, ridge: float = 1e-3) -> Model:
    """Maximum conditional likelihood by Adam; every line takes its document's label."""
    found = [(i, *line_features(c)) for i, _, c in T.chunks(texts)]
    f, doc = np.concatenate([x[1] for x in found]), np.concatenate([x[3] + x[0] for x in found])
    model = Model()
    if not len(f) or good.all() or not good.any():
        return model
    model.mean, model.scale = f.mean(0), f.std(0) + 1e-6
    x = with_neighbours((f - model.mean) / model.scale, doc)
    y = good[doc].astype(float)
    chains = Chains(doc)
    joined = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][joined].astype(int), y[1:][joined].astype(int)), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        p, pairs, _ = chains.marginals(x @ w, move)
        step = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model.weights, model.move = theta[:-4], theta[-4:].reshape(2, 2)
    raw = T.per_document(texts, model.raw, 1)[:, 0] - 0.5
    a, b = 4.0, 0.0
    for _ in range(300):  # logistic fit of the document scale
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        a += 8 * (float(((good - p) * raw).mean()) - 1e-4 * a)
        b += 2 * float((good - p).mean())
    model.slope, model.offset = a, b
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 2000, max_bytes: int = 16 << 20) -> Model:
    """Train on at most ``per_class`` usable labelled documents of each class, of ``max_bytes`` in all (see samples)."""
    rows = samples.labelled_sample(docs, labels, "quality", usable, per_class, max_bytes)
    return train(pa.array(rows["text"], pa.string()), rows["_y"].to_numpy() == 1) if len(rows) else Model()


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) of every document."""

    def compute(column: pa.Array) -> dict[str, pa.Array]:
        score = model.score(column)
        return {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return T.map_texts(docs, ["doc_id"], compute, "score double, predicted int")


def label_lines(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, byte start and end, and P(good) of every line that has a word."""
    read = docs.select("doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, _, chunk in T.chunks(batch.column(1)):
                good, _, doc = model.line_marginals(chunk)
                start, end, line_doc = chunk.lines()
                real = chunk.total(~T.SPACE[chunk.buf], start, end) > 0
                base = chunk.start[doc]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + doc)), pa.array(start[real] - base), pa.array(end[real] - base), pa.array(good)], names=["doc_id", "start", "end", "good"])

    return read.mapInArrow(run, f"doc_id {kind}, start bigint, end bigint, good double")
