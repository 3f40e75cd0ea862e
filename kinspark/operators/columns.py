"""Rounds of Markov clustering on a matrix in blocks of columns.

A column of the square is a sum of columns of the matrix, so a task that meets
the whole matrix makes a block of columns alone: it squares, inflates and prunes
them before they are written.  Neither products nor entries are shuffled; on
disk are two matrices, the one before a round and the one after it.  A task
holds up to PART entries at once and adds up what it gets from each part; what it
adds up is bounded by the cells of its block.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kinspark.operators.components import connected_components
from kinspark.operators.sequences import add_ordinals
from kinspark.scratch import Scratch

#: Columns of a block, and cells: the more nodes there are, the fewer columns.
COLUMNS = 1024
BLOCK_CELLS = 50_000_000
#: Entries of the matrix that a task holds, besides its own block.
PART = 8_000_000
#: Sums that a task holds as an array, and products that it makes at once.
CELLS = 1_000_000
EPSILON = 1e-8

#: Pairs of blocks that Python gets at once; Spark's 64 MB would be held several times over in each task.
BATCH_ROWS = 4

FORM = "b long, ptr binary, rows binary, w binary, gap double"


@dataclass
class Block:
    """Columns from ``first`` on, one after another; ``w`` sums to 1 in each."""

    number: int
    first: int
    ptr: np.ndarray
    rows: np.ndarray
    w: np.ndarray


class Part:
    """Columns that are held: where each starts and how long it is, or that it is not there."""

    def __init__(self, n: int, columns: int, most: int) -> None:
        self.n, self.columns, self.size = n, columns, 0
        self.start, self.length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.rows, self.w = np.empty(most, np.int32), np.empty(most)

    def add(self, x: Block) -> None:
        end = self.size + len(x.rows)
        if end > len(self.rows):
            self.rows, self.w = np.resize(self.rows, end), np.resize(self.w, end)
        there = slice(x.first, min(self.n, x.first + self.columns))
        many = there.stop - there.start
        self.start[there], self.length[there] = x.ptr[:many] + self.size, np.diff(x.ptr)[:many]
        self.rows[self.size : end], self.w[self.size : end] = x.rows, x.w
        self.size = end

    def clear(self) -> None:
        self.length[:] = 0
        self.size = 0


def _row(number: int, ptr: np.ndarray, rows: np.ndarray, w: np.ndarray, gap: float) -> pa.RecordBatch:
    raw = [ptr.astype(np.int64).tobytes(), rows.astype(np.int32).tobytes(), w.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in raw), pa.array([gap], pa.float64())], names=["b", "ptr", "rows", "w", "gap"])


def _block(batch: pa.RecordBatch, k: int, side: str, columns: int) -> Block:
    number, ptr, rows, w = (batch.column(batch.schema.get_field_index(side + name))[k] for name in ("b", "ptr", "rows", "w"))
    ptr, rows, w = (np.frombuffer(x.as_buffer(), kind) for x, kind in ((ptr, np.int64), (rows, np.int32), (w, np.float64)))
    lens = np.diff(ptr)
    sums = np.bincount(np.repeat(np.arange(columns), lens), w, columns) + EPSILON
    return Block(number.as_py(), number.as_py() * columns, ptr, rows, w / np.repeat(sums, lens))


def pack(entries: DataFrame, n: int, scratch: Scratch, columns: int) -> DataFrame:
    """The blocks of entries (i, j, w) whose places are numbers below ``n``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["j", "i"])
        number = int(rows["b"].iloc[0])
        ptr = np.concatenate([[0], np.cumsum(np.bincount(rows["j"] - number * columns, minlength=columns))])
        return _row(number, ptr, rows["i"].to_numpy(), rows["w"].to_numpy(np.float64), np.inf).to_pandas()

    numbered = entries.select(F.floor(F.col("j") / columns).alias("b"), "i", "j", "w").repartitionByRange(max(1, -(-n // columns)), "b")
    return scratch.keep(numbered.groupBy("b").applyInPandas(run, FORM), "blocks", 1)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile hands up to BATCH_ROWS rows to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _reduced(key: np.ndarray, value: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, in the order of the keys."""
    if 4 * len(key) > cells:
        sums = np.bincount(key, value, cells)
        at = np.flatnonzero(sums)
        return at, sums[at]
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(value, first) if len(first) else value


def _products(own: Block, part: Part, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every ``width`` columns of ``own``: sums of products with the columns of ``part``, by column and row; ``most`` products at once."""
    n, columns = part.n, part.columns
    for c in range(0, columns, width):
        lo, hi = own.ptr[c], own.ptr[min(columns, c + width)]
        inner, factor = own.rows[lo:hi], own.w[lo:hi]
        column = np.repeat(np.arange(min(columns, c + width) - c), np.diff(own.ptr[c : c + width + 1]))
        lens = part.length[inner]
        ends = np.cumsum(lens)
        cuts = np.unique(np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most)) + 1)
        found = []
        for a, b in zip([0, *cuts], [*cuts, len(inner)]):
            many = lens[a:b]
            at = np.repeat(part.start[inner[a:b]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found.append(_reduced(part.rows[at] + np.repeat(column[a:b] * n, many), part.w[at] * np.repeat(factor[a:b], many), width * n))
            if len(found) > 1 and sum(len(x) for x, _ in found[1:]) > most:
                found = [_reduced(*map(np.concatenate, zip(*found)), width * n)]
        yield found[0] if len(found) == 1 else _reduced(*map(np.concatenate, zip(*found)), width * n)


def _gap(old: Block, keys: np.ndarray, w: np.ndarray, n: int, columns: int) -> float:
    """The largest change of an entry, less a part of what it was."""
    before = np.repeat(np.arange(columns), np.diff(old.ptr)) * n + old.rows
    at = np.searchsorted(keys, before)
    same = at < len(keys)
    same[same] = keys[at[same]] == before[same]
    now, fresh = np.zeros(len(before)), np.ones(len(keys), bool)
    now[same] = w[at[same]]
    fresh[at[same]] = False
    return float(max((np.abs(now - old.w) - 1e-5 * old.w).max(initial=0), w[fresh].max(initial=0)))


def step(now: DataFrame, n: int, scratch: Scratch, columns: int, inflation: float, prune: float) -> DataFrame:
    """One round: normalise, square, inflate, prune; ``gap`` tells how far the block is from rest."""
    names = ("ptr", "rows", "w")
    most, held = CELLS, PART
    width = max(1, min(columns, most // n))
    floor = prune ** (1 / inflation) * (1 - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block | None = None
        part = Part(n, columns, held)
        parts: list[list] = []

        def add() -> None:
            parts.append(list(_products(own, part, width, most)))
            part.clear()

        def made() -> pa.RecordBatch:
            sums = _products(own, part, width, most)
            if parts:
                if part.size:
                    add()
                sums = (_reduced(*map(np.concatenate, zip(*found)), width * n) for found in zip(*parts))
            keys, values = [], []
            for k, (key, value) in enumerate(sums):
                high = value >= floor
                key, value = key[high], value[high] ** inflation
                good = value >= prune
                keys.append(key[good] + k * width * n)
                values.append(value[good])
            parts.clear()
            part.clear()
            key, value = np.concatenate(keys), np.concatenate(values)
            ptr = np.concatenate([[0], np.cumsum(np.bincount(key // n, minlength=columns))])
            return _row(own.number, ptr, key % n, value, _gap(own, key, value, n, columns))

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(batch.schema.get_field_index("l_w"))[k].is_valid:
                    if own is not None:
                        yield made()
                    own = _block(batch, k, "l_", columns)
                assert batch.column(batch.schema.get_field_index("l_b"))[k].as_py() == own.number
                other = _block(batch, k, "r_", columns)
                if part.size and part.size + len(other.rows) > held:
                    add()
                part.add(other)
        if own is not None:
            yield made()

    left = now.select(*[F.col(c).alias(f"l_{c}") for c in ("b", *names)])
    # one partition: each block meets all others, one after another, and comes itself with the first
    right = now.coalesce(1).select(F.monotonically_increasing_id().alias("at"), *[F.col(c).alias(f"r_{c}") for c in ("b", *names)])
    rows = left.join(right.hint("shuffle_replicate_nl"), how="cross")
    rows = rows.select("l_b", *[F.when(F.col("at") == 0, F.col(f"l_{c}")).alias(f"l_{c}") for c in names], "r_b", *[f"r_{c}" for c in names])
    with _small_batches(scratch.spark):
        return scratch.keep(rows.mapInArrow(run, FORM), "blocks", 1)


def _links(now: DataFrame, prune: float, columns: int) -> DataFrame:
    """(src, dst): places of entries over ``prune``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w = np.frombuffer(row["w"], np.float64) > prune
                column = np.repeat(np.arange(columns), np.diff(np.frombuffer(row["ptr"], np.int64))) + row["b"] * columns
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["rows"], np.int32)[w].astype(np.int64)), pa.array(column[w])], names=["src", "dst"])

    return now.select("b", "ptr", "rows", "w").mapInArrow(run, "src long, dst long")


def clusters(entries: DataFrame, scratch: Scratch, inflation: float, rounds: int, prune: float, columns: int | None = None) -> DataFrame:
    """(node, cluster) of a matrix (i, j, w), whose nodes all stand on the diagonal; every fifth round looks for convergence."""
    entries = scratch.keep(entries, "entries")
    nodes = scratch.keep(add_ordinals(entries.select(F.col("i").alias("node")).distinct(), scratch, ["node"]), "nodes")
    n = nodes.count()
    columns = columns or max(1, min(COLUMNS, BLOCK_CELLS // max(n, 1)))
    places = entries.join(nodes.withColumnsRenamed({"node": "i", "ordinal": "x"}), "i").join(nodes.withColumnsRenamed({"node": "j", "ordinal": "y"}), "j")
    held = scratch.child()
    now = pack(places.select(F.col("x").alias("i"), F.col("y").alias("j"), "w"), n, held, columns)
    for k in range(rounds):
        work = scratch.child()
        now = step(now, n, work, columns, inflation, prune)
        rests = k and k % 5 == 0 and now.agg(F.max("gap")).first()[0] <= EPSILON
        held.drop()
        held = work
        if rests:
            break
    # places are in the order of the names, so the smallest place has the smallest name
    parts = scratch.keep(connected_components(_links(now, prune, columns), scratch), "places")
    held.drop()
    named = parts.join(nodes.select(F.col("ordinal").alias("node"), F.col("node").alias("name")), "node")
    return named.join(nodes.select(F.col("ordinal").alias("component"), F.col("node").alias("cluster")), "component").select(F.col("name").alias("node"), "cluster")
