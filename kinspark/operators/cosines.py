"""Relations and densities of vectors by their cosines, without a table of the hits.

The hits of all against all grow with the square of the vectors, what is asked
of them mostly does not.  Vectors are packed in blocks, one row each; a cross
join brings each pair of blocks to one task, which makes the hits of the two as
a matrix, takes what is asked, and drops them.  Nothing is shuffled but partial
results.  What depends on all hits of a vector (its best score in each taxon,
its density) is taken in a pass of its own, put beside the blocks, and used in
another pass over the same matrices.

Ids are unique for all but :func:`hits`; see :func:`kinspark.operators.relations.classify` and
:mod:`kinspark.operators.density` for tables of hits of any kind.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinspark.operators.density import deltas
from kinspark.scratch import Scratch

BLOCK = 1000
#: Blocks that a task holds as matrices.
HELD = 32
#: Scores of the best hits are whole numbers of this part.
UNIT = 1e6


@dataclass
class Block:
    """A block in a task: unit vectors and what was put beside them."""

    number: int
    ids: pa.Array
    names: np.ndarray
    unit: np.ndarray
    beside: dict = field(default_factory=dict)


def pack(vectors: DataFrame, scratch: Scratch, block: int | None = None, in_file: int = 4) -> DataFrame:
    """(b, ids, vec, width): rows (id, vec) as blocks of up to ``block`` rows; null vectors have no cosine and are left out."""
    block = block or BLOCK
    narrow = vectors.schema["vec"].dataType.elementType.simpleString() == "float"
    given = vectors.select(F.col("id").cast("string").alias("id"), F.col("vec").cast(f"array<{'float' if narrow else 'double'}>").alias("vec")).where("id is not null and vec is not null")
    n = given.count()
    kind = np.float32 if narrow else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(table: pa.Table) -> pa.RecordBatch:
            vec = table["vec"].combine_chunks()
            raw = vec.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([table["id"].to_pylist()], pa.list_(pa.string())), pa.array([raw], pa.binary())], names=["ids", "vec"])

        for batch in batches:
            held.append(batch)
            while sum(x.num_rows for x in held) >= block:
                table = pa.Table.from_batches(held)
                yield made(table.slice(0, block))
                held = table.slice(block).to_batches()
        if sum(x.num_rows for x in held):
            yield made(pa.Table.from_batches(held))

    packed = given.coalesce(max(1, n // (in_file * block))).mapInArrow(run, "ids array<string>, vec binary")
    # the numbers stand in the table, so they are the same in all that reads it
    return scratch.keep(packed.select(F.monotonically_increasing_id().alias("b"), "ids", "vec", F.lit(np.dtype(kind).itemsize).alias("width")), "blocks")


def beside(blocks: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """The blocks with further columns of ``more`` (b, ...)."""
    return scratch.keep(blocks.join(more, "b", "left"), "blocks")


def _block(batch: pa.RecordBatch, k: int, side: str, extra: list[str]) -> Block:
    def value(name: str):
        return batch.column(batch.schema.get_field_index(side + name))[k]

    ids = value("ids").values
    kind = np.float32 if value("width").as_py() == 4 else np.float64
    x = np.frombuffer(value("vec").as_buffer(), kind).reshape(len(ids), -1).astype(np.float64)
    return Block(value("b").as_py(), ids, ids.to_numpy(zero_copy_only=False), x / np.linalg.norm(x, axis=1)[:, None], {c: value(c).as_py() for c in extra})


Hits = tuple[Block, Block, np.ndarray, np.ndarray, np.ndarray]


def each_pair(blocks: DataFrame, least: float, run: Callable[[Iterator[Hits]], Iterator[pa.RecordBatch]], schema: str, prepare: Callable[[Block], None] | None = None, digits: int = 6) -> DataFrame:
    """``run`` over the hits of the pairs of blocks in a task: two blocks, rows of either, and scores over ``least``.

    Each unordered pair of vectors comes once.  ``prepare`` is called once for a block.
    """
    extra = [c for c in blocks.columns if c not in ("b", "ids", "vec", "width")]
    left = blocks.select(*[F.col(c).alias(f"l_{c}") for c in blocks.columns])
    right = blocks.select(*[F.col(c).alias(f"r_{c}") for c in blocks.columns])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[Hits]:
        held: OrderedDict[int, Block] = OrderedDict()

        def got(batch: pa.RecordBatch, k: int, side: str) -> Block:
            number = batch.column(batch.schema.get_field_index(f"{side}b"))[k].as_py()
            if number not in held:
                held[number] = _block(batch, k, side, extra)
                if prepare:
                    prepare(held[number])
                if len(held) > HELD:
                    held.popitem(last=False)
            held.move_to_end(number)
            return held[number]

        for batch in batches:
            for k in range(batch.num_rows):
                a, b = got(batch, k, "l_"), got(batch, k, "r_")
                raw = a.unit @ b.unit.T
                i, j = np.nonzero(raw > least - 10.0**-digits)
                if a.number == b.number:
                    i, j = i[i < j], j[i < j]
                score = np.round(raw[i, j], digits)
                good = (score > least) & (a.names[i] != b.names[j]).astype(bool)
                yield a, b, i[good], j[good], score[good]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(hits(batches))

    return left.crossJoin(right).where("l_b <= r_b").mapInArrow(whole, schema)


def hits(blocks: DataFrame, least: float) -> DataFrame:
    """(q, s, score): ordered pairs of vectors of different ids with a cosine over ``least``."""

    def run(pairs: Iterator[Hits]) -> Iterator[pa.RecordBatch]:
        for a, b, i, j, score in pairs:
            x, y = a.ids.take(pa.array(i)), b.ids.take(pa.array(j))
            for q, s in ((x, y), (y, x)):
                yield pa.RecordBatch.from_arrays([q, s, pa.array(score)], names=["q", "s", "score"])

    return each_pair(blocks, least, run, "q string, s string, score double")


def _summed(parts: DataFrame, kind: type, how: Callable, name: str, digits: int = 0) -> DataFrame:
    """Partial arrays (b, part) of each block as one."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.frombuffer(rows["part"].iloc[0], kind).copy()
        for part in rows["part"].iloc[1:]:
            how(out, np.frombuffer(part, kind), out=out)
        if digits:
            out = out.round(digits)
        return pd.DataFrame({"b": [rows["b"].iloc[0]], name: [out.tobytes()]})

    return parts.groupBy("b").applyInPandas(one, f"b long, {name} binary")


def _parts(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for number, own in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([own.tobytes()], pa.binary())], names=["b", "part"])


def _taxa(blocks: DataFrame, separator: str) -> list[str]:
    return sorted(r[0] for r in blocks.select(F.explode("ids").alias("id")).select(F.substring_index("id", separator, 1)).distinct().collect())  # taxa are few


def with_tops(blocks: DataFrame, least: float, scratch: Scratch, separator: str = "|") -> DataFrame:
    """The blocks with the best score of each vector in each taxon, 0 without a hit."""
    taxa = _taxa(blocks, separator)
    code = {x: k for k, x in enumerate(taxa)}

    def prepare(block: Block) -> None:
        block.beside["taxon"] = np.array([code[x.split(separator, 1)[0]] for x in block.names], np.int64)

    def run(pairs: Iterator[Hits]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for a, b, i, j, score in pairs:
            whole = np.rint(score * UNIT).astype(np.int32)
            for own, other, x, y in ((a, b, i, j), (b, a, j, i)):
                tops = held.setdefault(own.number, np.zeros(len(own.names) * len(taxa), np.int32))
                np.maximum.at(tops, x * len(taxa) + other.beside["taxon"][y], whole)
        yield from _parts(held)

    tops = _summed(each_pair(blocks, least, run, "b long, part binary", prepare), np.int32, np.maximum, "tops")
    return beside(blocks.withColumn("taxa", F.array(*[F.lit(x) for x in taxa])), tops, scratch)


def _judged(least: float, blocks: DataFrame, run: Callable, schema: str, separator: str) -> DataFrame:
    """``run`` over (a, b, i, j, score, cross, forth, back): whether the taxa differ, and whether the hit of either direction reaches its query's best."""

    def prepare(block: Block) -> None:
        taxa = block.beside["taxa"]
        code = {x: k for k, x in enumerate(taxa)}
        own = block.beside["taxon"] = np.array([code[x.split(separator, 1)[0]] for x in block.names], np.int64)
        tops = block.beside["tops"]
        tops = np.zeros((len(own), len(taxa)), np.int32) if tops is None else np.frombuffer(tops, np.int32).reshape(len(own), -1).copy()
        at = np.arange(len(own))
        tops[at, own] = 0
        tops[at, own] = tops.max(1)  # an in-paralog is measured by the best of the other taxa
        block.beside["tops"] = tops

    def whole(pairs: Iterator[Hits]) -> Iterator[pa.RecordBatch]:
        def judged():
            for a, b, i, j, score in pairs:
                whole = np.rint(score * UNIT).astype(np.int32)
                ta, tb = a.beside["taxon"][i], b.beside["taxon"][j]
                yield a, b, i, j, score, ta != tb, whole >= a.beside["tops"][i, tb], whole >= b.beside["tops"][j, ta]

        return run(judged())

    return each_pair(blocks, least, whole, schema, prepare)


def candidates(blocks: DataFrame, least: float, separator: str = "|") -> DataFrame:
    """(rel, q, s, a, b, score): as :func:`kinspark.operators.relations.classify`, of blocks with tops."""
    rels = pa.array(["IP", "CO", "OT"])

    def run(judged) -> Iterator[pa.RecordBatch]:
        for a, b, i, j, score, cross, forth, back in judged:
            for own, other, x, y, best in ((a, b, i, j, forth), (b, a, j, i, back)):
                kept = np.flatnonzero(cross | best)
                q, s = own.ids.take(pa.array(x[kept])), other.ids.take(pa.array(y[kept]))
                rel = rels.take(pa.array(np.where(cross[kept], 1 + best[kept], 0)))
                yield pa.RecordBatch.from_arrays([rel, q, s, pa.array(score[kept])], names=["rel", "q", "s", "score"])

    found = _judged(least, blocks, run, "rel string, q string, s string, score double", separator)
    return found.select("rel", "q", "s", F.least("q", "s").alias("a"), F.greatest("q", "s").alias("b"), "score")


def pairs(blocks: DataFrame, least: float, rel: str, over: float | None = None, separator: str = "|") -> DataFrame:
    """(a, b, weight) of one relation: OT or IP found from both sides, or CO candidates from either; with weights over ``over``."""

    def run(judged) -> Iterator[pa.RecordBatch]:
        for a, b, i, j, score, cross, forth, back in judged:
            good = {"OT": cross & forth & back, "IP": ~cross & forth & back, "CO": cross & ~(forth & back)}[rel]
            kept = np.flatnonzero(good if over is None else good & (score > over))
            if not len(kept):
                continue
            x, y = a.ids.take(pa.array(i[kept])), b.ids.take(pa.array(j[kept]))
            yield pa.RecordBatch.from_arrays([x, y, pa.array(score[kept])], names=["x", "y", "weight"])

    found = _judged(least, blocks, run, "x string, y string, weight double", separator)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")


def expanded(vectors: DataFrame, ot: DataFrame, ip: DataFrame, least: float, digits: int = 6) -> DataFrame:
    """(a, b, weight): co-ortholog pairs that in-paralogs of an ortholog pair reach, with a cosine over ``least``.

    Cosines are made of the pairs that are reached only: ({a} + IP(a)) x ({b} + IP(b)) of every ortholog (a, b).
    """
    mates = ip.select(F.col("a").alias("gene"), F.col("b").alias("mate")).unionByName(ip.select(F.col("b").alias("gene"), F.col("a").alias("mate")))
    edges = ot.select("a", "b")
    near = edges.select(F.col("a").alias("x"), "b").unionByName(edges.join(mates.withColumnRenamed("gene", "a"), "a").select(F.col("mate").alias("x"), "b")).distinct()
    far = near.select("x", F.col("b").alias("y")).unionByName(near.join(mates.withColumnRenamed("gene", "b"), "b").select("x", F.col("mate").alias("y")))
    reached = far.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(edges, ["a", "b"], "left_anti")
    rows = vectors.select(F.col("id").cast("string").alias("id"), "vec")
    both = reached.join(rows.withColumnsRenamed({"id": "a", "vec": "va"}), "a").join(rows.withColumnsRenamed({"id": "b", "vec": "vb"}), "b")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x, y = (np.stack(part[c]).astype(np.float64) for c in ("va", "vb"))
            x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
            weight = np.round(np.einsum("ij,ij->i", x, y), digits)
            good = weight > least
            yield pd.DataFrame({"a": part["a"][good], "b": part["b"][good], "weight": weight[good]})

    return both.select("a", "b", "va", "vb").mapInPandas(run, "a string, b string, weight double")


def squared(blocks: DataFrame, least: float, digits: int = 6) -> DataFrame:
    """(i, j, w): the square of the matrix of hits, whose entries are the cosines over ``least``, 0 or more.

    A task makes one block of the square after another, from the matrices that
    its two blocks have with every block, in the order of these.  Neither hits
    nor products are shuffled or stored.
    """
    columns = [F.col(c) for c in ("b", "ids", "vec", "width")]
    sides = [blocks.select(*[c.alias(f"{side}_{n}") for c, n in zip(columns, ("b", "ids", "vec", "width"))]) for side in "lrm"]
    # one partition of the middle: every task meets all of it, for one pair after another
    rows = sides[0].crossJoin(sides[1]).where("l_b <= r_b").join(sides[2].coalesce(1).hint("shuffle_replicate_nl"), how="cross")

    def entries(x: Block, y: Block) -> np.ndarray:
        score = np.round(x.unit @ y.unit.T, digits)
        score[score <= least] = 0
        if x.number == y.number:
            np.fill_diagonal(score, 0)
        return score

    def made(x: Block, y: Block, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(w), 50):
            i, j = np.nonzero(w[k : k + 50])
            value = pa.array(w[k : k + 50][i, j])
            p, q = x.ids.take(pa.array(i + k)), y.ids.take(pa.array(j))
            for a, b in ((p, q), (q, p)) if x.number != y.number else ((p, q),):
                yield pa.RecordBatch.from_arrays([a, b, value], names=["i", "j", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Block] = OrderedDict()
        now, w = None, None

        def got(batch: pa.RecordBatch, k: int, side: str) -> Block:
            number = batch.column(batch.schema.get_field_index(f"{side}b"))[k].as_py()
            if number not in held:
                held[number] = _block(batch, k, side, [])
                if len(held) > HELD:
                    held.popitem(last=False)
            held.move_to_end(number)
            return held[number]

        for batch in batches:
            for k in range(batch.num_rows):
                x, y, z = (got(batch, k, side) for side in ("l_", "r_", "m_"))
                if now is None or (x.number, y.number) != (now[0].number, now[1].number):
                    if now is not None:
                        yield from made(*now, w)
                    now, w = (x, y), np.zeros((len(x.names), len(y.names)))
                w += entries(x, z) @ entries(z, y)
        if now is not None:
            yield from made(*now, w)

    return rows.mapInArrow(run, "i string, j string, w double")


# --- densities: distances are 1 - cosine -------------------------------------------------------


def _distance(score: np.ndarray) -> np.ndarray:
    return np.round(1 - score, 6)


def with_densities(blocks: DataFrame, least: float, dc: float, scratch: Scratch) -> DataFrame:
    """The blocks with the sum of exp(-(d / dc) ** 2) over the hits of each vector.

    It is rounded, or the order of the sum would decide between copies of a vector.
    """

    def run(pairs: Iterator[Hits]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for a, b, i, j, score in pairs:
            value = np.exp(-((_distance(score) / dc) ** 2))
            for own, x in ((a, i), (b, j)):
                held[own.number] = held.get(own.number, 0) + np.bincount(x, value, len(own.names))
        yield from _parts(held)

    return beside(blocks, _summed(each_pair(blocks, least, run, "b long, part binary"), np.float64, np.add, "rho", 9), scratch)


def peaks(blocks: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(node, rho, delta, higher): as :func:`kinspark.operators.density.peaks`, of blocks with densities."""

    def prepare(block: Block) -> None:
        n = len(block.names)
        block.beside["rho"] = np.zeros(n) if block.beside["rho"] is None else np.frombuffer(block.beside["rho"], np.float64)
        block.beside["order"] = np.argsort(block.names, kind="stable")
        block.beside["rank"] = np.argsort(block.beside["order"], kind="stable")

    def run(pairs: Iterator[Hits]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        none = np.int64(1) << 62
        for a, b, i, j, score in pairs:
            d = np.rint(_distance(score) * UNIT).astype(np.int64)
            smaller = (b.names[j] < a.names[i]).astype(bool)
            for own, other, x, y, first in ((a, b, i, j, smaller), (b, a, j, i, ~smaller)):
                if own.number not in held:
                    n = len(own.names)
                    held[own.number] = (own.ids, own.beside["rho"], np.full(n, -1, np.int64), np.full(n, none), np.full(n, None, object))
                _, rho, far, best, who = held[own.number]
                np.maximum.at(far, x, d)
                denser = (other.beside["rho"][y] > rho[x]) | ((other.beside["rho"][y] == rho[x]) & first)
                key = np.full(len(rho), none)
                np.minimum.at(key, x[denser], d[denser] * (1 << 20) + other.beside["rank"][y[denser]])
                at = np.flatnonzero(key < none)
                near, names = key[at] >> 20, other.names[other.beside["order"][key[at] & ((1 << 20) - 1)]]
                better = near < best[at]
                tied = np.flatnonzero(near == best[at])
                better[tied] = (names[tied] < who[at[tied]]).astype(bool)
                best[at[better]], who[at[better]] = near[better], names[better]
        for ids, rho, far, best, who in held.values():
            there = np.flatnonzero(far >= 0)
            up = best[there] < none
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(there)), pa.array(rho[there]), pa.array(far[there] / UNIT), pa.array(best[there] / UNIT, mask=~up), pa.array(who[there], pa.string())], names=["node", "rho", "far", "d", "y"])

    found = each_pair(blocks, least, run, "node string, rho double, far double, d double, y string", prepare)
    near = found.groupBy("node").agg(F.max("rho").alias("rho"), F.min(F.when(F.col("y").isNotNull(), F.struct("d", "y"))).alias("up"), F.max("far").alias("far"))
    return deltas(scratch.keep(near.select("node", "rho", "up.d", "up.y", "far"), "near"))


def borders(blocks: DataFrame, marks: DataFrame, least: float, dc: float, scratch: Scratch) -> DataFrame:
    """(cluster, border): the largest mean density of two vectors up to ``dc`` apart of which one is in another cluster.

    ``marks``: (node, cluster, rho).
    """
    places = blocks.select("b", F.posexplode("ids").alias("at", "node")).join(marks.select("node", "cluster", "rho"), "node", "left")
    own = places.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("cluster", F.lit("")).alias("cluster"), F.coalesce("rho", F.lit(0.0)).alias("rho")))).alias("m"))
    marked = beside(blocks.select("b", "ids", "vec", "width"), own.select("b", F.col("m.cluster").alias("cluster"), F.col("m.rho").alias("rho")), scratch)

    def prepare(block: Block) -> None:
        block.beside["cluster"] = np.array(block.beside["cluster"], object)
        block.beside["rho"] = np.array(block.beside["rho"], np.float64)
        block.beside["names"], block.beside["code"] = np.unique(block.beside["cluster"], return_inverse=True)

    def run(pairs: Iterator[Hits]) -> Iterator[pa.RecordBatch]:
        held: dict[str, float] = {}
        for a, b, i, j, score in pairs:
            close = np.flatnonzero(_distance(score) <= dc)
            i, j = i[close], j[close]
            apart = a.beside["cluster"][i] != b.beside["cluster"][j]
            i, j = i[apart], j[apart]
            value = (a.beside["rho"][i] + b.beside["rho"][j]) / 2
            for own, x in ((a, i), (b, j)):
                most = np.full(len(own.beside["names"]), -np.inf)
                np.maximum.at(most, own.beside["code"][x], value)
                for k in np.flatnonzero(np.isfinite(most)):
                    name = own.beside["names"][k]
                    held[name] = max(held.get(name, -np.inf), float(most[k]))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.float64())], names=["cluster", "border"])

    found = each_pair(marked, least, run, "cluster string, border double", prepare)
    return found.groupBy("cluster").agg(F.max("border").alias("border"))
