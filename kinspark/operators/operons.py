"""Overlap of operons: ordered gene lists that share gene families."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinspark.scratch import Scratch

#: Members of two classes whose pairs are told at once.
MEMBERS = 1000
#: Keys of a block: subsets of its operons' families, these and members.
KEYS = 2_000_000
#: Candidates that a task holds at once, unless one class has more.
PAIRS = 1_000_000
#: Blocks that a task holds.
HELD = 4


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(operon_id, strand, genes) of lines whose first field is a-->b or a<--b; headers are skipped."""
    field = F.substring_index(F.col(column), "\t", 1)
    plus = field.contains("-->")
    genes = F.when(plus, F.split(field, "-->")).otherwise(F.split(field, "<--"))
    rows = lines.where(~F.col(column).startswith("gene_id") & (F.length(F.trim(F.col(column))) > 0))
    return rows.select(F.xxhash64(field).alias("operon_id"), F.when(plus, "-->").otherwise("<--").alias("strand"), genes.alias("genes")).dropDuplicates(["operon_id"])


def harmonic(c0: Column | np.ndarray, c1: Column | np.ndarray) -> Column | np.ndarray:
    """Harmonic mean of the two coverages."""
    return 2 * c0 * c1 / (c0 + c1)


def _keys(n: Column, size: int, longest: int) -> Column:
    """Keys of a set of ``n`` families, and its families."""
    many = {1: n, 2: n * (n - 1) / 2, 3: n * (n - 1) * (n - 2) / 6}[size]
    return (n + F.when(n <= longest, many).otherwise(n)).cast("long")


@dataclass
class Block:
    """Classes of operons with equal families, by size: ``codes`` of the families of one after another, places in the sorted ``names``; ``ids`` of the members of one after another."""

    number: int
    ids: pa.Array
    many: np.ndarray
    sizes: np.ndarray
    codes: np.ndarray
    names: np.ndarray
    held: dict = field(default_factory=dict)

    def keys(self, k: int, longest: int, codes: np.ndarray | None = None, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(class, key) of all sorted subsets of ``k`` families of classes of up to ``longest``; ``codes`` for another block's names, -1 where it has none."""
        own = codes is None
        if own and (k, longest) in self.held:
            return self.held[k, longest]
        codes, base = (self.codes, len(self.names)) if own else (codes, base)
        start = np.cumsum(self.sizes) - self.sizes
        classes, keys = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for n in np.unique(self.sizes[self.sizes <= longest]):
            at = np.flatnonzero(self.sizes == n)
            rows = codes[start[at][:, None] + np.arange(n)].astype(np.int64)
            key, there = np.int64(0), True
            for places in np.array([*combinations(range(n), k)], np.int64).reshape(-1, k).T:
                key, there = key * base + rows[:, places], there & (rows[:, places] >= 0)
            owner = np.repeat(at.astype(np.int32), key.shape[1])
            classes.append(owner if own else owner[there.ravel()])
            keys.append(key.ravel() if own else key[there])
        out = np.concatenate(classes), np.concatenate(keys)
        if own:
            self.held[k, longest] = out
        return out

    def index(self, k: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different keys in order, where the classes of each begin, and these."""
        if ("index", k, longest) not in self.held:
            classes, keys = self.keys(k, longest)
            order = np.argsort(keys, kind="stable")
            keys, first = np.unique(keys[order], return_index=True)
            self.held["index", k, longest] = keys, np.append(first, len(order)), classes[order]
        return self.held["index", k, longest]


def _block(batch: pa.RecordBatch, k: int, side: str) -> Block:
    b, ids, many, sizes, codes, names = (batch.column(batch.schema.get_field_index(side + c))[k] for c in ("b", "ids", "many", "sizes", "codes", "names"))
    return Block(b.as_py(), ids.values, *(np.frombuffer(x.as_buffer(), np.int32) for x in (many, sizes, codes)), names.values.to_numpy(zero_copy_only=False))


def _coded(sets: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names in order, the place there of each element, and the length of each set."""
    coded = sets.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(names)
    return names[order], np.argsort(order)[coded.indices.to_numpy(zero_copy_only=False)], np.diff(sets.offsets.to_numpy())


def _lists(values: pa.Array, lens: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), values)


def _bounded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in tables whose ``keys`` add up to ``most`` at the most, or of one row."""
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        begun, sums = 0, np.cumsum(batch.column(batch.schema.get_field_index("keys")).to_numpy())
        while begun < batch.num_rows:
            before = int(sums[begun - 1]) if begun else 0
            end = max(int(np.searchsorted(sums, before + most - weight, "right")), begun + (not held))
            if end > begun:
                held.append(batch.slice(begun, end - begun))
                weight += int(sums[end - 1]) - before
            if end < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, weight = [], 0
            begun = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table[name].combine_chunks()
    return pa.concat_arrays([found])  # without an offset


def _classes(sets: DataFrame, size: int, longest: int) -> DataFrame:
    """(f, ids): operons with equal families as one row, unless they fall into two tasks or are too many for a block."""
    sets = sets.withColumn("keys", _keys(F.size("f"), size, longest))
    total, most = sets.agg(F.sum("keys")).first()[0] or 0, KEYS
    kind = sets.schema["operon_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _bounded(batches, most):
            names, codes, lens = _coded(_column(table, "f"))
            codes = codes[np.lexsort((codes, np.repeat(np.arange(len(lens)), lens)))]
            start = np.cumsum(lens) - lens
            for n in np.unique(lens):
                at = np.flatnonzero(lens == n)
                rows, which = np.unique(codes[start[at][:, None] + np.arange(n)], axis=0, return_inverse=True)
                ids = _column(table, "operon_id").take(pa.array(at[np.argsort(which.ravel(), kind="stable")]))
                # in parts: lists of strings are long
                many = np.bincount(which.ravel(), minlength=len(rows))
                done = np.concatenate([[0], np.cumsum(many)])
                for k in range(0, len(rows), 10_000):
                    part = slice(k, k + 10_000)
                    f = _lists(pa.array(names[rows[part].ravel()], pa.string()), np.full(len(rows[part]), n))
                    yield pa.RecordBatch.from_arrays([f, _lists(ids[int(done[k]) : int(done[min(k + 10_000, len(rows))])], many[part])], names=["f", "ids"])

    # by families and then by operons, so no task gets all operons that have the same families
    dealt = sets.repartitionByRange(max(1, -(-total // most)), "f", "operon_id")
    return dealt.mapInArrow(run, f"f array<string>, ids array<{kind}>")


def _pack(classes: DataFrame, size: int, longest: int, scratch: Scratch) -> DataFrame:
    """Classes (f, ids) in blocks of up to KEYS keys."""
    most = KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _bounded(batches, most):
            names, codes, sizes = _coded(_column(table, "f"))
            ids = _column(table, "ids")
            raw = [np.diff(ids.offsets.to_numpy()), sizes, codes]
            lists = [_lists(x, [len(x)]) for x in (ids.flatten(), pa.array(names, pa.string()))]
            yield pa.RecordBatch.from_arrays([lists[0], *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in raw), lists[1]], names=["ids", "many", "sizes", "codes", "names"])

    kind = classes.schema["ids"].dataType.simpleString()
    packed = classes.withColumn("keys", _keys(F.size("f"), size, longest) + F.size("ids")).mapInArrow(run, f"ids {kind}, many binary, sizes binary, codes binary, names array<string>")
    # the numbers stand in the table, so they are the same in all that reads it
    return scratch.keep(packed.select(F.monotonically_increasing_id().alias("b"), "*"), "blocks", 1)


def _translated(x: Block, y: Block) -> np.ndarray:
    """The codes of ``x`` by the names of ``y``, -1 for those that it has not."""
    at = np.searchsorted(y.names, x.names)
    at[at == len(y.names)] = 0
    return np.where(y.names[at] == x.names, at, -1)[x.codes]


def _counted(x: Block, y: Block, k: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(class of ``x``, class of ``y``, families that they share) of classes of up to ``longest`` families that share ``k`` or more."""
    base = len(y.names)
    owner, key = x.keys(k, longest) if x.number == y.number or np.array_equal(x.names, y.names) else x.keys(k, longest, _translated(x, y), base)
    keys, first, classes = y.index(k, longest)
    if not len(keys) or not len(key):
        return
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    same = np.flatnonzero(keys[at] == key)
    owner, at = owner[same], at[same]
    many = first[at + 1] - first[at]
    # subsets of k of what is shared: a pair comes once for each of them
    subsets = np.array([comb(n, k) for n in range(longest + 1)])
    ends = np.cumsum(many)
    lasts = np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)  # a class is not cut
    lo = 0
    while lo < len(owner):
        upto = np.searchsorted(ends[lasts], (ends[lo - 1] if lo else 0) + PAIRS)
        hi = max(int(lasts[max(0, upto - 1)]) + 1, int(lasts[np.searchsorted(lasts, lo)]) + 1)
        n = many[lo:hi]
        places = np.repeat(first[at[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.repeat(owner[lo:hi].astype(np.int64) * len(y.sizes), n) + classes[places]
        pair.sort()
        begins = np.flatnonzero(np.diff(pair, prepend=-1))
        times = np.diff(begins, append=len(pair))
        pair = pair[begins]
        i, j = pair // len(y.sizes), pair % len(y.sizes)
        yield i, j, np.searchsorted(subsets, times)
        lo = hi


def _counted_long(x: Block, y: Block, longest: int, others: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of classes of ``x`` of over ``longest`` families and those of ``y`` of up to ``others``."""
    long = np.flatnonzero(x.sizes > longest)
    if not len(long):
        return
    _, first, classes = y.index(1, int(y.sizes.max(initial=0)))  # each name of a block is in one of its classes
    codes, start = _translated(x, y), np.cumsum(x.sizes) - x.sizes
    for i in long:
        own = codes[start[i] : start[i] + x.sizes[i]]
        shared = np.bincount(np.concatenate([classes[first[c] : first[c + 1]] for c in own[own >= 0]] or [np.empty(0, np.int32)]), minlength=len(y.sizes))
        j = np.flatnonzero((shared > 0) & (y.sizes <= others))
        yield np.full(len(j), i), j, shared[j]


def overlaps(families: DataFrame, least: int = 3, cover: float = 0.5, with_self: bool = False, longest: int = 40, digits: int | None = None) -> DataFrame:
    """(a, b, shared, score) of operons that share ``least`` families or more and are covered by over ``cover`` on one side.

    ``families``: (operon_id, family).  Operons that share three families meet at
    a triple of them, so a family that many operons have makes no pairs by itself.
    Operons of more than ``longest`` families, which have many triples, meet the
    others family by family; they are few.  Operons with equal families are
    compared as one.  Each pair of blocks of operons meets in one task, which
    makes the pairs and tells them; pairs are neither shuffled nor stored.
    ``digits`` rounds the scores half away from zero, as SQL does on doubles.
    """
    scratch, work = Scratch(families.sparkSession), Scratch(families.sparkSession)
    sets = families.where("operon_id is not null").groupBy("operon_id").agg(F.array_sort(F.collect_set(F.col("family").cast("string"))).alias("f")).where(F.size("f") >= max(least, 1))
    size = max(1, min(least, 3))
    found = _class_overlaps(_classes(work.keep(sets, "sets"), size, longest), scratch, size, least, cover, with_self, longest, digits)
    work.drop()
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "score")


def _class_overlaps(classes: DataFrame, scratch: Scratch, size: int, least: int, cover: float, with_self: bool, longest: int, digits: int | None) -> DataFrame:
    """(x, y, shared, score) of the members of classes (f, ids)."""
    blocks = _pack(classes, size, longest, scratch)
    most = MEMBERS**2

    def told(x: Block, y: Block, i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> Iterator[pa.RecordBatch]:
        c0, c1 = shared / x.sizes[i], shared / y.sizes[j]
        good = (shared >= least) & (np.maximum(c0, c1) > cover)
        if x.number == y.number:
            good &= i <= j
        i, j, shared, c0, c1 = (v[good] for v in (i, j, shared, c0, c1))
        score = harmonic(c0, c1)
        if digits is not None:
            scaled = score * 10.0**digits
            score = (np.floor(scaled) + (scaled - np.floor(scaled) >= 0.5)) / 10.0**digits
        starts = [np.cumsum(v.many) - v.many for v in (x, y)]
        width = y.many[j].astype(np.int64)
        ends = np.cumsum(x.many[i] * width)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
            # members of the pairs of classes lo to hi: rows of the product of the two lists
            hi = min(lo + most, int(ends[-1]))
            a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi - 1, "right") + 1
            begin = np.concatenate([[0], ends])[a:b]
            rows = np.minimum(ends[a:b], hi) - np.maximum(begin, lo)
            p = np.repeat(np.arange(a, b), rows)
            place = np.arange(lo, hi) - np.repeat(begin, rows)
            m, n = starts[0][i[p]] + place // width[p], starts[1][j[p]] + place % width[p]
            if x.number == y.number:
                one = (i[p] != j[p]) | ((m <= n) if with_self else (m < n))
                p, m, n = p[one], m[one], n[one]
            yield pa.RecordBatch.from_arrays([x.ids.take(pa.array(m)), y.ids.take(pa.array(n)), pa.array(shared[p].astype(np.int64)), pa.array(score[p])], names=["x", "y", "shared", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Block] = OrderedDict()

        def got(batch: pa.RecordBatch, k: int, side: str) -> Block:
            number = batch.column(batch.schema.get_field_index(f"{side}b"))[k].as_py()
            if number not in held:
                held[number] = _block(batch, k, side)
                if len(held) > HELD:
                    held.popitem(last=False)
            held.move_to_end(number)
            return held[number]

        for batch in batches:
            for row in range(batch.num_rows):
                x, y = got(batch, row, "l_"), got(batch, row, "r_")
                k = size if max(len(x.names), len(y.names)) < 2_000_000 else min(size, 2)
                for found in _counted(x, y, k, longest):
                    yield from told(x, y, *found)
                for found in _counted_long(x, y, longest, int(y.sizes.max())):
                    i, j, shared = found
                    if x.number == y.number:  # two long ones come twice
                        once = (y.sizes[j] <= longest) | (i <= j)
                        i, j, shared = np.minimum(i, j)[once], np.maximum(i, j)[once], shared[once]
                    yield from told(x, y, i, j, shared)
                if x.number != y.number:
                    for j, i, shared in _counted_long(y, x, longest, longest):
                        yield from told(x, y, i, j, shared)

    left, right = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "lr")
    kind = classes.schema["ids"].dataType.elementType.simpleString()
    return left.join(right.hint("shuffle_replicate_nl"), how="cross").where("l_b <= r_b").mapInArrow(run, f"x {kind}, y {kind}, shared long, score double")


def assign_families(operons: DataFrame, grouped: DataFrame) -> DataFrame:
    """(operon_id, family) of operons with a gene list; genes in no group are left out."""
    genes = operons.select("operon_id", F.explode("genes").alias("gene"))
    return genes.join(grouped.select("gene", F.col("group_id").alias("family")), "gene").select("operon_id", "family")
