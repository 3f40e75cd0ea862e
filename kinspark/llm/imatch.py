"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon holds the terms (runs of letters and digits, A-Z lower-cased) in a
band of inverse document frequency: those in a part between ``rare`` and
``common`` of all documents, and in two at least.  The band is relative, so the
lexicon has at most (mean distinct terms of a document) / ``rare`` terms at any
corpus size, and each task can hold it.  A text's distinct lexicon terms are
sorted (by a 64-bit hash that stands for the term), and each of SUBSETS random
subsets of the lexicon at each of the sampling rates gives one 32-bit hash of the
sequence of those it contains: dense subsets tell apart, sparse ones survive
edits.  A text without lexicon terms is hashed over all its terms, with another
seed, so that it is only ever like such a text.

The likeness of two fingerprints is the best part of equal hashes at any rate,
among subsets that are filled for one of the two at least; 0 without any.

Each document is also compared with the next one in ascending doc_id.  For that
texts are dealt out by ranges of (doc_id, hash of the text) of about equal bytes,
sorted, and walked through; the first row of a range is sent to the range before
it as well.  Bounds come from a sample of ids, which decides where ranges end and
nothing else.

Defined cases: a null text is empty; a fingerprint of a text without terms is
all zeros, and two such are alike (likeness 1) only if both have no terms;
null ids come first; rows of one id follow each other by a hash of the text, so
they may lie in several ranges; a single row is its own next; an empty table
gives an empty result.  Ids may be of any type that has an order.  Very long
texts are read whole and have to fit in a row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from kinspark.llm import text as T
from kinspark.llm.mil import OUTSIDE

SUBSETS = 32
#: Sampling rates as shifts: a half, an eighth, ...
RATES = (1, 3, 5, 7, 9)
FLUSH = 1 << 20
#: Bytes of text in a range, and the most ranges there are.
RANGE_BYTES = 8 << 20
MOST_RANGES = 20_000


def terms(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term hash) of a chunk, sorted by document and term."""
    start, end, doc = chunk.runs(OUTSIDE)
    h = chunk.hashes(start, end, lower=True)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): in how many documents each term hash occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

        for batch in batches:
            for _, _, chunk in T.chunks(batch.column(0)):
                held.append(terms(chunk)[1])
                size += len(held[-1])
                if size >= 4 * FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return T.bounded(docs).select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, rare: float = 0.002, common: float = 0.1) -> np.ndarray:
    """Sorted term hashes of the band; see the module on its bound."""
    count = docs.count()
    found = document_frequencies(docs).where(f"n >= 2 and n >= {rare!r} * {count} and n <= {common!r} * {count}").select("term").toPandas()
    return np.sort(found["term"].to_numpy(np.int64).view(np.uint64))


def _member_table(lexicon: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[(lexicon >> T.U(44)).astype(np.int64)] = True
    return table


def fingerprints(chunk: T.Chunk, lexicon: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One row of len(RATES) * SUBSETS 32-bit hashes for each document; 0: no term."""
    doc, h = terms(chunk)
    n = len(chunk)
    known = table[(h >> T.U(44)).astype(np.int64)]
    at = np.flatnonzero(known)
    if len(at):
        place = np.minimum(np.searchsorted(lexicon, h[at]), len(lexicon) - 1)
        known[at] = lexicon[place] == h[at]
    none = np.bincount(doc[known], minlength=n) == 0
    known |= none[doc]
    doc, h = doc[known], h[known]
    edges = np.searchsorted(doc, np.arange(n + 1))
    out = np.zeros((n, len(RATES), SUBSETS), np.uint32)
    value = T.mix(h + T.U(0x2545F4914F6CDD1D))
    value[none[doc]] ^= T.U(0x5DEECE66D)
    forward, backward = T._power_tables(len(h) + 1)
    for j in range(SUBSETS):
        draw = T.mix(h + T.mix(np.array([j + 1], T.U)))
        inside = np.arange(len(h))
        for k, shift in enumerate(RATES):
            inside = inside[draw[inside] < T.U(1 << (64 - shift))]
            # a polynomial over the terms in order: it depends on what comes where
            sums = np.concatenate([np.zeros(1, T.U), np.cumsum(value[inside] * forward[: len(inside)], dtype=T.U)])
            cut = np.searchsorted(inside, edges)
            total = T.mix((sums[cut[1:]] - sums[cut[:-1]]) * backward[cut[:-1]]) >> T.U(32)
            out[:, k, j] = np.where(cut[1:] > cut[:-1], np.maximum(total, T.U(1)), T.U(0))
    return out.reshape(n, -1)


def likeness(a: np.ndarray, b: np.ndarray, least: int = 4) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    a, b = a.reshape(len(a), len(RATES), SUBSETS), b.reshape(len(b), len(RATES), SUBSETS)
    filled = (a != 0) | (b != 0)
    same = ((a == b) & filled).sum(2)
    compared = filled.sum(2)
    rate = np.where(compared >= least, same / np.maximum(compared, 1), 0).max(1)
    pooled = same.sum(1) / np.maximum(compared.sum(1), 1)
    empty = compared.sum(1) == 0
    return np.where(empty, 1.0, np.where((compared >= least).any(1), rate, pooled))


def _keys(ids: list, hashes: list[int]) -> list[tuple]:
    """Sortable (doc_id, hash), null ids first."""
    return [(1, i, h) if i is not None else (0, h) for i, h in zip(ids, hashes)]


def _ranges(docs: DataFrame, parts: int | None, per_range: int = 20) -> tuple[list[tuple], dict[int, tuple]]:
    """Bounds of the ranges, and the first key of each range that has rows.

    The driver sees about ``per_range`` sampled ids for each range.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    total = rows.agg(F.count("*").alias("rows"), F.sum(F.col("n") + 100).alias("bytes")).first()
    if not total["rows"]:
        return [], {}
    parts = parts or min(MOST_RANGES, -(-total["bytes"] // RANGE_BYTES))
    one_in = max(1, total["rows"] // (per_range * parts))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "h", F.lit(3)), F.lit(one_in)) == 0).toArrow()
    found = sorted(zip(_keys(sample["doc_id"].to_pylist(), sample["h"].to_pylist()), sample["n"].to_pylist()))
    size = np.cumsum([n + 100 for _, n in found])
    at = np.searchsorted(size, [size[-1] * k / parts for k in range(1, parts)]) if found else []
    bounds = sorted({found[k][0] for k in at})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple] = {}
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key in _keys(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = bisect_right(bounds, key)
                if part not in least or key < least[part]:
                    least[part] = key
        if least:
            ids = pa.array([k[1] if k[0] else None for k in least.values()], id_type)
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), ids, pa.array([k[-1] for k in least.values()], pa.int64())], names=["part", "doc_id", "h"])

    first = rows.select("doc_id", "h").mapInArrow(run, f"part bigint, doc_id {kind}, h bigint").groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("f")).select("part", "f.doc_id", "f.h").toArrow()
    return bounds, dict(zip(first["part"].to_pylist(), _keys(first["doc_id"].to_pylist(), first["h"].to_pylist())))


def fingerprint_documents(docs: DataFrame, lexicon: np.ndarray, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    The edited text is the text with its last quarter (n_chars // 4 code points)
    replaced by as many from the beginning of the next document.
    """
    bounds, first = _ranges(T.bounded(docs), parts)
    filled = sorted(first)
    # where the first row of a range is sent besides: to the range before, of the first to the last
    also = {first[p]: (filled[k - 1], int(k == 0)) for k, p in enumerate(filled)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        sent = set()
        for batch in batches:
            for i, j, views in T.parts(batch.column(2)):
                rows = batch.slice(i, j - i)
                keys = _keys(rows.column(0).to_pylist(), rows.column(1).to_pylist())
                more = []
                for x, key in enumerate(keys):
                    if key in also and key not in sent:
                        sent.add(key)  # rows with equal keys hold equal texts: one a task will do
                        more.append((x, *also[key]))
                at = pa.array([*range(len(keys)), *(x for x, _, _ in more)], pa.int64())
                packed = [squeeze.compress(v.tobytes()) for v in views]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*(bisect_right(bounds, key) for key in keys), *(p for _, p, _ in more)], pa.int32()),
                        pa.array([0] * len(keys) + [1] * len(more), pa.int32()),
                        rows.column(0).take(at),
                        rows.column(1).take(at),
                        pa.array([*packed, *(packed[x] for x, _, _ in more)], pa.binary()),
                    ],
                    names=["part", "guest", "doc_id", "h", "packed"],
                )

    dealt = read.mapInArrow(deal, f"part int, guest int, doc_id {kind}, h bigint, packed binary")
    dealt = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "guest", "doc_id", "h").select("part", "guest", "doc_id", "packed")
    table = _member_table(lexicon)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, nexts = zip(*rows)
        edited = [t[: len(t) - len(t) // 4] + x[: len(t) // 4] for t, x in zip(texts, nexts)]
        raw = [[t.encode() for t in texts], [t.encode() for t in edited], [t.encode() for t in nexts]]
        prints = [fingerprints(T.Chunk(r), lexicon, table) for r in raw]
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(ids, id_type)]),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in raw[1]]),
                pa.array([r.tobytes().hex() for r in prints[0].astype(">u4")]),
                pa.array([r.tobytes().hex() for r in prints[1].astype(">u4")]),
                pa.array(likeness(prints[0], prints[1])),
                pa.array(likeness(prints[0], prints[2])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        before, rows, size = None, [], 0
        for batch in batches:
            for part, guest, doc_id, packed in zip(*(batch.column(k).to_pylist() for k in range(4))):
                text = expand.decompress(packed).decode()
                if before is not None and before[0] == part and not before[1]:
                    rows.append((before[2], before[3], text))
                    size += 3 * len(before[3])
                    if size >= 2 * T.CHUNK_BYTES:
                        yield emit(rows)
                        rows, size = [], 0
                before = (part, guest, doc_id, text)
        if rows:
            yield emit(rows)

    return dealt.mapInArrow(walk, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
