"""Connected components of an undirected graph, for graphs of any size.

Alternating star contractions (large star, small star): each round links every
node to the smallest node it has seen, in two joins; the number of rounds grows
with the logarithm of the graph, not with the length of its paths.  Every round
is written to the shared scratch folder, so a lost executor costs one round.
The smallest neighbours are written before they are joined with the edges: a
join of two tables can be split where one node has a great part of all edges.

Before the first round and between rounds each task replaces the edges that it
holds, up to CHUNK at a time, by stars around the smallest node of what they
connect.  That changes no component, and leaves little for the rounds to do.
What is then left of a graph is solved by one task if it has at most FEW edges,
so no task gets more than that; only larger ones need rounds, whose joins cost
the same few seconds each however small the graph is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinspark.scratch import Scratch

CHUNK = 400_000
#: Edges that one task solves.
FEW = 100_000


def stars(pairs: list[tuple], centres: bool = False) -> list[tuple]:
    """(node, smallest node it is connected to) of the nodes that are not the smallest themselves.

    A node that is connected with itself only points at itself; with ``centres`` every smallest node does.
    """
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for u, v in pairs:
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    found = [(x, top) for x in parent if (top := root(x)) != x]
    tops = {top for _, top in found}
    return found + [(x, x) for x, top in parent.items() if x == top and (centres or x not in tops)]


def _contracted(edges: DataFrame, whole: bool = False) -> DataFrame:
    """The edges (u, v) of each task as stars; ``whole``: at once, with their centres."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            kinds = [table.schema.field(c).type for c in ("u", "v")]
            struct = pa.types.is_struct(kinds[0])
            u, v = ([*zip(*(x.to_pylist() for x in table[c].chunk(0).flatten()))] if struct else table[c].to_pylist() for c in ("u", "v"))
            found = stars([*zip(u, v)], whole)
            if struct:
                names = kinds[0].names
                found = [(dict(zip(names, a)), dict(zip(names, b))) for a, b in found]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK and not whole:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return edges.select("u", "v").mapInArrow(run, f"u {kind}, v {kind}")


def _solved(edges: DataFrame) -> bool:
    """Whether every node points at one node only, which points at none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.keep(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = down.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Edges may repeat, point either way or be loops; null ends are ignored.
    """
    work = scratch.child()
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    left = work.keep(_contracted(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
    loops, now = left.where("u = v"), left.where("u <> v")
    while not (few := left.count() <= FEW) and not _solved(now):
        large = work.keep(_large_star(now, work), "large").where("u <> v").distinct()
        now = work.keep(_contracted(_small_star(large, work).where("u <> v").distinct()), "star")
        left = now.unionAll(loops)
    if few:
        found = _contracted(left.coalesce(1), whole=True).select(F.col("u").alias("node"), F.col("v").alias("component"))
    else:
        found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        found = found.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        found = found.unionAll(loops.select(F.col("u").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
    out = scratch.keep(found, "components")
    work.drop()
    return out
