"""Byte-level text kernels shared by the operators of this package.

Documents arrive as Arrow string columns.  They are laid out in one byte
buffer per chunk (about half a megabyte, so that the working arrays stay in
the CPU cache whatever the batch size) and words, lines and their 64-bit
hashes come out of a handful of numpy passes; no loop runs per character.  A
document over GIANT bytes is a chunk of its own; what has 64 bits a byte is then
made in segments and kept only where words and lines begin and end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 19
GIANT = 1 << 22
#: Rows of texts that a Python worker gets at once.
BATCH_ROWS = 2000
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Separators of words ``[^\x20\x09-\x0D]+``; newline; bytes that continue a code point.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0..n at least."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(2 * n, CHUNK_BYTES * 2)
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size + 1, base, U)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=U))
        if size > 8 * CHUNK_BYTES:
            return both[0], both[1]  # a giant document: not kept
        _powers = (both[0], both[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Chunk:
    """Some documents in one buffer: a newline, then each document and a newline."""

    def __init__(self, parts: list[bytes | memoryview | np.ndarray]) -> None:
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes + 1)
        self.start = ends - sizes  # first byte of each document
        self.end = ends
        self.buf = np.full(int(ends[-1]) + 1 if len(parts) else 1, 10, np.uint8)
        for s, e, p in zip(self.start.tolist(), self.end.tolist(), parts):
            if e > s:
                self.buf[s:e] = np.frombuffer(p, np.uint8)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hash of each byte range; equal bytes have equal hashes wherever they lie.  Ranges ascend."""
        if len(self.buf) > GIANT:
            sums, scale = self._sums_at(start, lower, True)
            return mix((self._sums_at(end, lower, False)[0] - sums) * scale)
        forward, backward = _power_tables(len(self.buf))
        if self._sums is None:
            data = LOWER[self.buf] if lower else self.buf
            sums = np.empty(len(data) + 1, U)
            sums[0] = 0
            np.cumsum((data.astype(U) + U(1)) * forward[: len(data)], out=sums[1:])
            self._sums = sums
        return mix((self._sums[end] - self._sums[start]) * backward[start])

    def _sums_at(self, places: np.ndarray, lower: bool, scaled: bool) -> tuple[np.ndarray, np.ndarray]:
        """The hash sums up to ascending places, and (if ``scaled``) the factors that shift them to 0; in segments."""
        forward, backward = _power_tables(CHUNK_BYTES)
        sums = np.empty(len(places), U)
        scale = np.empty(len(places) if scaled else 0, U)
        total, times, back = 0, 1, 1
        at = 0
        for a in range(0, len(self.buf) + 1, CHUNK_BYTES):
            data = self.buf[a : a + CHUNK_BYTES]
            data = LOWER[data] if lower else data
            own = np.zeros(len(data) + 1, U)
            np.cumsum((data.astype(U) + U(1)) * forward[: len(data)], out=own[1:])
            stop = int(np.searchsorted(places, a + CHUNK_BYTES, "left"))
            near = places[at:stop] - a
            sums[at:stop] = own[near] * U(times) + U(total)
            if scaled:
                scale[at:stop] = backward[near] * U(back)
            at = stop
            total = (total + int(own[-1]) * times) % (1 << 64)
            times = times * pow(_BASE, CHUNK_BYTES, 1 << 64) % (1 << 64)
            back = back * pow(_INVERSE, CHUNK_BYTES, 1 << 64) % (1 << 64)
        return sums, scale

    def runs(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every maximal run of bytes outside ``separator``."""
        flag = separator[self.buf]
        edges = np.flatnonzero(flag[1:] != flag[:-1]) + 1
        start, end = edges[0::2], edges[1::2]
        return start, end, self._documents(start)

    def _documents(self, start: np.ndarray) -> np.ndarray:
        """The document that each place lies in."""
        return np.searchsorted(self.start, start, "right") - 1 if len(self) > 1 else np.zeros(len(start), np.int32)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start, end and document of the \n-split lines, empty ones included."""
        end = np.flatnonzero(self.buf == 10)[1:]
        start = np.empty_like(end)
        if len(end):
            start[0] = 1
            start[1:] = end[:-1] + 1
        return start, end, self._documents(start)

    def total(self, mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of set bytes of ``mask`` in each range; ranges ascend and do not overlap."""
        if not len(start):
            return np.zeros(0, np.int64)
        if len(mask) > GIANT:
            return self._counts_at(mask, end) - self._counts_at(mask, start)
        sums = np.empty(len(mask) + 1, np.int64)
        sums[0] = 0
        np.cumsum(mask, out=sums[1:])
        return sums[end] - sums[start]

    @staticmethod
    def _counts_at(mask: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Number of set bytes before ascending places, in segments."""
        out = np.empty(len(places), np.int64)
        total, at = 0, 0
        for a in range(0, len(mask) + 1, CHUNK_BYTES):
            own = np.concatenate([[0], np.cumsum(mask[a : a + CHUNK_BYTES], dtype=np.int64)])
            stop = int(np.searchsorted(places, a + CHUNK_BYTES, "left"))
            out[at:stop] = own[places[at:stop] - a] + total
            at, total = stop, total + int(own[-1])
        return out


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, whose session hands texts to Python in batches of BATCH_ROWS rows at most.

    Spark's default of 10,000 is meant for narrow rows.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


def parts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Slices of a string column as (first, last, byte views); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK_BYTES, "right")) - 1)
        j = min(j, n)
        edges = bounds[i : j + 1].tolist()
        yield i, j, [data[a:b] for a, b in zip(edges[:-1], edges[1:])]
        i = j


def chunks(column: pa.Array) -> Iterator[tuple[int, int, Chunk]]:
    """As :func:`parts`, laid out as chunks."""
    for i, j, views in parts(column):
        yield i, j, Chunk(views)


def per_document(column: pa.Array, measure: Callable[[Chunk], np.ndarray], width: int) -> np.ndarray:
    """``measure`` of every chunk, stacked: one row of ``width`` values for each document."""
    found = [measure(c) for _, _, c in chunks(column)]
    return np.concatenate(found) if found else np.zeros((0, width))


def sum_by(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, weights=values, minlength=n)[:n] if len(group) else np.zeros(n)


def map_texts(docs: DataFrame, columns: list[str], compute: Callable[[pa.Array], dict[str, pa.Array]], schema: str, small: bool = False) -> DataFrame:
    """``columns`` of ``docs`` beside what ``compute`` returns for its texts, in one narrow pass.

    ``small``: hand over a few hundred rows at a time, for work on Python strings.
    """
    bounded(docs)
    read = docs.select(*columns, "text") if "text" not in columns else docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)) if small else batches:
            made = compute(batch.column(batch.schema.get_field_index("text")))
            given = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*given, *made.values()], names=[*columns, *made])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name in columns)
    return read.mapInArrow(run, f"{kinds}, {schema}" if columns else schema)


def keep_texts(docs: DataFrame, accept: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text is accepted, all columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(accept(batch.column(at))))

    return bounded(docs).mapInArrow(run, docs.schema)
