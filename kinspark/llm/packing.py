"""Packing of tokenized documents into sequences by exact-complement hashing.

Documents become pieces of at most ``size`` tokens.  How pieces combine depends
on their lengths only, so the plan is made from the histogram of lengths (at
most ``size`` counts, whatever the corpus): the sums of single, pair and triple
lengths are indexed by the gap that they fill; a length whose gap is in the index
is combined with what fills it as often as the counts allow, which fills
sequences exactly; what is left is packed best-fit, longest first.  The plan is
a list of patterns (lengths, repetitions), a few for each length.

Pieces then take their places in parallel.  A task numbers its own pieces of
each length as it writes them; counts by task and length give the number of the
first, and the number decides the place.  No piece is sorted or shuffled for
that but in the join with those counts.

Defined cases: a null or empty text is one piece that holds the end token only;
repeated rows are packed each; pieces of equal length may swap places; an empty
table gives an empty result; a very long text is encoded in segments.  Extra
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinspark.llm import text as T
from kinspark.llm.bpe import byte_letters
from kinspark.llm.pretoken import Cache, segments
from kinspark.scratch import Scratch


_STOPS = frozenset(".,!?;:")


class ByteBpe:
    """Ids of the ``tokenizers`` library, looked up by pieces between spaces.

    In a text whose white space is single spaces and newlines between words, no
    token crosses the space before a word or a newline, so each such piece has
    the same ids wherever it stands.  Any other text goes to the library whole.
    A new piece is encoded with the same vocabulary by ``tiktoken``, which is
    faster at single words; without it, by the library too.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.pieces = Cache(self._piece)
        self.single = None
        try:
            import tiktoken
        except ImportError:
            return
        byte = {x: b for b, x in enumerate(byte_letters())}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(byte[x] for x in s): i for s, i in vocab.items()}
        self.single = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        given = " " + piece if piece[:1] != "\n" else piece
        word = given[1:]
        if self.single is not None:
            head, tail = (word[:-1], word[-1:]) if word[-1:] in _STOPS else (word, "")
            if head.isalpha():  # one word for the library's pattern, then perhaps one mark
                ids = [*self.single(b"\n"), *self.single(head.encode())] if given[0] == "\n" else self.single(b" " + head.encode())
                return array("I", [*ids, *self.single(tail.encode())] if tail else ids).tobytes()
        if not word or word.split() != [word] or "<|" in word:
            raise ValueError  # not such a text
        return self._ids(given)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join([self._segment(part) for part in segments(text)])

    def _segment(self, text: str) -> bytes:
        first, *rest = text.replace("\n", " \n").split(" ")
        found = self.pieces
        try:
            if first and first.split() != [first]:
                raise ValueError
            return (self._ids(first) if first else b"") + b"".join([found[p] for p in rest])
        except ValueError:
            return self._ids(text)


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def pieces(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, in one narrow pass.

    A document's ids end in ``end``.  One over ``size`` ids is cut; the first
    piece takes the remainder, the others are full.
    """
    read = T.bounded(docs).select("doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows, number, start, length, crc = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = memoryview((bpe.encode(text) if text else b"") + tail)
                    n = len(ids) // 4
                    edge, k = 0, 0
                    while edge < n:
                        stop = edge + ((n - 1) % size + 1 if k == 0 else size)
                        rows.append(row)
                        number.append(k)
                        start.append(edge)
                        length.append(stop - edge)
                        crc.append(zlib.crc32(ids[4 * edge : 4 * stop]))
                        edge, k = stop, k + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return read.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Sums:
    """Index of the sums of one, two and three of the lengths left, by the gap that they fill.

    Pairs are listed by their sum.  Triples are listed by their sum too, each by
    its first length: the other two are among the pairs of what then remains.
    """

    def __init__(self, left: dict[int, int], size: int) -> None:
        self.left = left
        lengths = sorted(left, reverse=True)
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for k, a in enumerate(lengths):
            for b in lengths[k:]:
                if a + b < size:
                    self.pairs.setdefault(a + b, []).append((a, b))
        self.triples: dict[int, list[int]] = {}
        for a in reversed(lengths):
            for total in self.pairs:
                if a + total < size:
                    self.triples.setdefault(a + total, []).append(a)

    def fits(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left.get(n, 0) >= c for n, c in Counter(lengths).items())

    def pair(self, gap: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths that fill ``gap`` beside those held."""
        found = self.pairs.get(gap, [])
        while found and not (found[-1][0] in self.left and found[-1][1] in self.left):
            found.pop()  # a length is used up: this pair never comes back
        return next((p for p in reversed(found) if self.fits((*held, *p))), None)

    def triple(self, gap: int, held: tuple[int, ...]) -> tuple[int, int, int] | None:
        """Three lengths that fill ``gap`` beside those held, the longest first length that does."""
        found = self.triples.get(gap, [])
        while found and not (found[-1] in self.left and self.pairs.get(gap - found[-1])):
            found.pop()
        for a in reversed(found):
            two = self.pair(gap - a, (*held, a)) if self.fits((*held, a)) else None
            if two:
                return (a, *two)
        return None

    def fill(self, n: int, gap: int) -> tuple[int, ...] | None:
        """The fewest lengths that fill ``gap`` beside ``n``."""
        if gap in self.left and self.fits((n, gap)):
            return (gap,)
        return self.pair(gap, (n,)) or self.triple(gap, (n,))


def plan(counts: dict[int, int], size: int = 1024) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with repetitions that use every count up.

    First the exact complements, longest length first, with one, two or three
    others; then best-fit for the rest.  Each step takes as many repetitions as
    its rarest length allows, so steps follow the number of lengths, not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        times = min(left[n] // c for n, c in need.items())
        for n, c in need.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
        out.append((lengths, times))

    if size in left:
        take((size,))
    sums = Sums(left, size)
    for n in sorted(left, reverse=True):
        while n in left:
            found = sums.fill(n, size - n)
            if not found:
                break
            take((n, *found))
    # best-fit of the residue: open sequences by gap, longest pieces first
    open_: dict[int, Counter] = {}
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo:
            gap = min((g for g in open_ if g >= n), default=0)
            if gap:
                shape, times = next(iter(open_[gap].items()))
                used = min(times, todo)
                open_[gap][shape] -= used
                if not open_[gap][shape]:
                    del open_[gap][shape]
                    if not open_[gap]:
                        del open_[gap]
                todo -= used
            else:
                shape, gap = (), size
                each = min(size // n, todo)
                used = todo // each
                todo -= used * each
                open_.setdefault(size - each * n, Counter())[(n,) * each] += used
                continue
            open_.setdefault(gap - n, Counter())[(*shape, n)] += used
    out += [(shape, times) for by_shape in open_.values() for shape, times in by_shape.items()]
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Ranges of piece numbers by length: (length, first number, first sequence, offset)."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def _numbered(cut: DataFrame) -> DataFrame:
    """``cut`` with its task, as _part, and the number of each piece among those of its length there, as _rank."""
    read = cut.withColumn("_part", F.spark_partition_id())
    at = read.columns.index("length")

    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            length = batch.column(at).to_numpy()
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            fresh = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            if len(ordered) and ordered[-1] >= len(seen):
                seen = np.concatenate([seen, np.zeros(int(ordered[-1]) + 1 - len(seen), np.int64)])
            times = np.diff(np.append(fresh, len(ordered)))
            rank = np.empty(len(ordered), np.int64)
            rank[order] = np.arange(len(ordered)) - np.repeat(fresh, times) + seen[ordered]
            seen[ordered[fresh]] += times
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "_rank"])

    return read.mapInArrow(run, StructType([*read.schema.fields, StructField("_rank", LongType())]))


def pack(cut: DataFrame, scratch: Scratch, size: int = 1024) -> DataFrame:
    """``cut`` (see :func:`pieces`) with sequence_id and offset.

    The driver holds the histogram of lengths and the plan, both bounded by
    ``size``; counts by length and task stay distributed.
    """
    work = scratch.child()
    # written in between: one Python worker for each task is enough
    cut = work.keep(cut.select("doc_id", "piece", "start", "length", "ids_crc32"), "cut")
    cut = scratch.keep(_numbered(cut), "pieces")
    by_task = work.keep(cut.groupBy("length", "_part").agg(F.count("*").alias("_n")), "counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    first = scratch.keep(by_task.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")), "first")
    work.drop()
    ranked = cut.join(first, ["length", "_part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_first")).alias("_number"))
    by, number, sequence, offset = places(plan(counts, size))
    wide = int(number.max(initial=0)).bit_length() + 40
    top = np.int64(1) << np.int64(min(wide, 50))

    def run(batches):
        key = by * top + number
        for batch in batches:
            length, mine = (batch.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(key, length * top + mine, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + mine - number[at]), pa.array(offset[at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
