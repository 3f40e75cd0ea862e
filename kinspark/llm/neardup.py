"""Near-duplicate documents by min-max hashing of word shingles.

A document's set holds the hashes of its distinct 4-word shingles.  Under each
of 64 permutations both the minimum and the maximum are kept, so 128 signature
values cost 64 hash evaluations; 32 bands of 4 values (two minima, two maxima)
make the buckets.  At the threshold of 0.8 a pair misses all buckets with a
probability of (1 - 0.8**4)**32 = 5e-8.

Documents with the same set are one class from the start.  Every bucket has a
head, the member that shares most buckets with others: in a family of near
copies that is the text they stem from.  All members of a bucket are compared
with its head; that links most families in a star, without pairs of members.
Where the members around a head then still lie in several components, those
outside the largest are compared with all the others, in blocks: a task gets two
blocks of texts, compares those that share a band, are of like size and not
linked yet, and returns links only.  With up to FEW members outside, that is so
many copies of the others at most.  Where there are more, all members are dealt
out by their bands again, with new heads, and then by pairs of bands; members
that agree in three bands, so in 12 values, are mostly linked by then, and the
rest goes to blocks whatever its number.  Candidates with a similarity of 0.8
that share one such bucket only are missed by these two steps: their probability
is 1e-6.  Every link is confirmed on the full sets, and tasks return links, never
pairs.  A head that many compare with is copied to several tasks, so no group
meets in one task.

Texts travel, not sets: the hashes of a set take more room than its text.

Defined cases: a text without a word (null, empty, blank) has the empty set, is
linked with nothing and kept; a row with a null id is linked with nothing, has
a null component and is kept; rows that repeat an id are one document in the
components, while keep_first tells them apart by their texts; an empty table
gives an empty result.  Ids may be of any type that has an order.  Whole texts
are read, of any length that fits in a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinspark.llm import text as T
from kinspark.operators.components import connected_components
from kinspark.scratch import Scratch

BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS // 2
BLOCK = 2048
#: Members outside the largest component of a bucket that all others are compared with; more are dealt out further.
FEW = 4096
_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64) * T.U(2)
_TIMES = _rng.integers(0, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64) * T.U(2) + T.U(1)
_STEP = T.U(0x9FB21C651E98DF25)


def shingle_sets(chunk: T.Chunk, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document; words are lower-cased (A-Z)."""
    start, end, doc = chunk.runs(T.SPACE)
    words = chunk.hashes(start, end, lower=True)
    edges = np.searchsorted(doc, np.arange(len(chunk) + 1))
    n = max(len(words) - width + 1, 0)
    rolled = np.zeros(n, T.U)
    for k in range(width):
        rolled = rolled * _STEP + words[k : k + n]
    rolled = T.mix(rolled)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], T.U)
            for k in range(a, b):
                whole = whole * _STEP + words[k : k + 1]
            out.append(T.mix(whole))
        else:
            out.append(np.zeros(0, T.U))
    return out


def signature(items: np.ndarray) -> np.ndarray:
    """The 2 * PERMUTATIONS extreme values of a set: minimum and maximum under each permutation."""
    low = np.full(PERMUTATIONS, ~T.U(0))
    high = np.zeros(PERMUTATIONS, T.U)
    for k in range(0, len(items), BLOCK):
        moved = (items[None, k : k + BLOCK] ^ _FLIP) * _TIMES
        np.minimum(low, moved.min(1), out=low)
        np.maximum(high, moved.max(1), out=high)
    return np.column_stack([low, high]).ravel()


def bands(items: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band."""
    rows = signature(items).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=T.U)
    for k in range(ROWS):
        key = T.mix(key * _STEP + rows[:, k])
    return key


def digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    return tuple(np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64).tolist())


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, hash of the text, n_shingles, d0 and d1 (the set's digest) and the bucket keys."""
    read = T.bounded(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, chunk in T.chunks(batch.column(2)):
                sets = shingle_sets(chunk, width)
                ids = [digest(s) for s in sets]
                keys = [bands(s) if len(s) else np.zeros(0, T.U) for s in sets]
                edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([a for a, _ in ids], pa.int64()),
                        pa.array([b for _, b in ids], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(keys).view(np.int64))),
                    ],
                    names=["doc_id", "h", "n_shingles", "d0", "d1", "bands"],
                )

    return read.mapInArrow(run, f"doc_id {kind}, h bigint, n_shingles bigint, d0 bigint, d1 bigint, bands array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, work: Scratch, width: int, percent: int, per_task: int = 256) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of ``percent`` / 100 or more.

    ``texts``: (id, text), one row for each id.  A ``b`` with many pairs is
    copied once for every ``per_task`` of them.
    """
    hubs = work.keep(pairs.groupBy("b").agg(F.ceil(F.count("*") / per_task).cast("int").alias("n")), "hubs")
    salt = F.pmod(F.xxhash64("a"), F.col("n").cast("bigint"))
    spokes = pairs.join(hubs, "b").select("b", salt.alias("salt"), "a").join(texts.withColumnRenamed("id", "a"), "a").select("b", "salt", "a", "text")
    heads = hubs.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("salt"))
    heads = heads.join(texts.withColumnRenamed("id", "b"), "b").select("b", "salt", F.lit(None).cast(pairs.schema["a"].dataType).alias("a"), "text")
    ordered = heads.unionAll(spokes).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, head = None, None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            members = batch.column(2).to_pylist()
            left, right = [], []
            for i, j, chunk in T.chunks(batch.column(3)):
                for k, own in zip(range(i, j), shingle_sets(chunk, width)):
                    if members[k] is None:
                        group, head = keys[k], own
                        continue
                    if group != keys[k]:
                        raise RuntimeError("a pair without its second text")
                    both = len(np.intersect1d(own, head, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(head) - both):
                        left.append(members[k])
                        right.append(keys[k][0])
            yield pa.RecordBatch.from_arrays([pa.array(left, batch.schema.field(2).type), pa.array(right, batch.schema.field(0).type)], names=["a", "b"])

    return ordered.mapInArrow(run, f"a {kind}, b {kind}")


def links_among(sets: list[np.ndarray], keys: np.ndarray, parts_: list, left: list[int], right: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) between ``left`` and ``right`` that connect what no link connects yet.

    Only sets that share a band (a row of ``keys``) and are of like size are
    compared.  ``parts_``: the component of each, from the links known so far.
    """
    number: dict = {}
    part = np.array([number.setdefault(str(x), len(number)) for x in parts_])
    size = np.array([len(x) for x in sets])
    right_ = np.array(right, np.int64)
    known, at = np.unique(np.concatenate([sets[j] for j in right]), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size[right_])[:-1]])
    table = np.zeros(len(known), bool)
    out = []
    for i in left:
        maybe = (part[right_] != part[i]) & (100 * np.minimum(size[right_], size[i]) >= percent * np.maximum(size[right_], size[i]))
        maybe &= (keys[right_] == keys[i]).any(1)
        if not maybe.any():
            continue
        if maybe.sum() > 12:
            place = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
            place = place[known[place] == sets[i]]
            table[place] = True
            both = np.add.reduceat(table[at], start, dtype=np.int64)
            table[place] = False
            maybe &= 100 * both >= percent * (size[i] + size[right_] - both)
        for j in right_[maybe].tolist():
            if part[i] == part[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (size[i] + size[j] - both):
                out.append((i, j))
                part[part == part[j]] = part[i]
    return out


def confirm_blocks(groups: DataFrame, texts: DataFrame, width: int, percent: int, block: tuple[int, int] = (256, 512)) -> DataFrame:
    """Links (a, b) between members of one bucket that lie in different parts.

    ``groups``: (bucket, id, part, n, m, main): n members, m of them outside the
    largest part.  Those meet all members, in blocks of about ``block`` rows.
    """
    n_left = F.ceil(F.col("m") / block[0]).cast("int")
    n_right = F.ceil(F.col("n") / block[1]).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = groups.where("part <> main").select("bucket", F.pmod(F.xxhash64("id"), n_left).cast("int").alias("i"), every(n_right).alias("j"), F.lit(0).alias("side"), "id", "part")
    right = groups.select("bucket", every(n_left).alias("i"), F.pmod(F.xxhash64("id", F.lit(1)), n_right).cast("int").alias("j"), F.lit(1).alias("side"), "id", "part")
    kind = groups.schema["id"].dataType.simpleString()

    def meet(table: pa.Table) -> pa.Table:
        ids, parts_, side = (table[c].to_pylist() for c in ("id", "part", "side"))
        of = [[k for k, x in enumerate(side) if x == own] for own in (0, 1)]
        found = []
        if of[0] and of[1]:
            sets = [x for _, _, chunk in T.chunks(table["text"]) for x in shingle_sets(chunk, width)]
            keys = np.array(table["bands"].to_pylist(), np.int64).reshape(len(sets), -1)
            found = links_among(sets, keys, parts_, *of, percent)
        id_type = table.schema.field("id").type
        return pa.table({"a": pa.array([ids[i] for i, _ in found], id_type), "b": pa.array([ids[j] for _, j in found], id_type)})

    dealt = left.unionAll(right).join(texts, "id").select("bucket", "i", "j", "side", "id", "part", "bands", "text")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}")


def _dealt_on(crowded: DataFrame, nodes: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """Smaller buckets (bucket, id, last) of the members by one band more, and their pairs (a, b) with new heads.

    ``crowded``: (bucket, id, part, last), ``last`` the number of the last band that the bucket stands for.
    """
    own = crowded.join(nodes.select("id", "bands"), "id").select("bucket", "id", "part", "last", F.posexplode("bands").alias("at", "key")).where("at > last")
    own = work.keep(own.select(F.xxhash64("bucket", "key").alias("bucket"), "id", "part", F.col("at").alias("last")), "dealt")
    shared = own.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct(F.xxhash64("bucket", "id").alias("turn"), "id", "part")).alias("head")).where("low <> high")
    shared = work.keep(shared.select("bucket", F.col("head.id").alias("head"), F.col("head.part").alias("head_part")), "heads")
    around = work.keep(own.join(shared, "bucket"), "around")
    pairs = around.where("part <> head_part").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    return around.select("bucket", "id", "last"), pairs


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest doc_id of its component)."""
    work = scratch.child()
    rows = work.keep(describe(docs, width), "sets")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = usable.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("bands").alias("bands"))
    nodes = work.keep(nodes.select("d0", "d1", F.col("least.doc_id").alias("id"), F.col("least.h").alias("h"), "bands"), "nodes")
    # what meets a crowded key is written first: only then can a join on it be split
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    shared = work.keep(shared.select("key", "n"), "shared")
    members = work.keep(keyed.join(shared, "key").select("key", "id", "n"), "members")
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    heads = members.join(degree, "id").groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("back"), "id")).alias("top"))
    heads = work.keep(heads.select("key", F.col("top.id").alias("head")), "heads")
    around = work.keep(members.join(heads, "key").select("head", "id").distinct(), "around")
    wanted = nodes.select("id", "h", "bands").join(around.select("id").distinct(), "id")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text").join(wanted, ["id", "h"]).groupBy("id", "h").agg(F.first("text").alias("text"), F.first("bands").alias("bands"))
    texts = work.keep(texts.select("id", "text", "bands"), "texts")

    plain = texts.select("id", "text")
    pairs = around.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    links = work.keep(confirm(pairs, plain, work, width, percent), "links")
    groups = around.select(F.xxhash64("head").alias("bucket"), "id", F.lit(-1).alias("last"))
    for level in range(3):
        parts = connected_components(links, work, "a", "b")
        now = work.keep(groups.join(parts.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("part"), "last"), "now")
        by_part = now.groupBy("bucket", "part").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "part")).alias("top"))
        open_ = by_part.select("bucket", "n", (F.col("n") - F.col("top.c")).alias("m"), F.col("top.part").alias("main")).where("m > 0 and n > 2")
        open_ = work.keep(open_, "open")
        if open_.isEmpty():
            break
        now = work.keep(now.join(open_, "bucket"), "left")
        few = now if level == 2 else now.where(F.col("m") <= FEW)
        links = links.unionAll(work.keep(confirm_blocks(few, texts, width, percent), "links"))
        crowded = now.where(F.col("m") > FEW)
        if level == 2 or crowded.isEmpty():
            parts = connected_components(links, work, "a", "b")
            break
        groups, pairs = _dealt_on(crowded.drop("n", "m", "main"), nodes, work)
        links = links.unionAll(work.keep(confirm(pairs, plain, work, width, percent), "links"))
    classes = nodes.select("d0", "d1", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("d0", "d1", F.coalesce("component", "id").alias("_c"))
    found = rows.select("doc_id", "n_shingles", "d0", "d1").join(classes, ["d0", "d1"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_c", "doc_id"))
    out = scratch.keep(found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near")
    work.drop()
    return out


def keep_first(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates; all columns as they are.

    A document is an id with the hash of its text: of rows that repeat an id
    only those with equal or similar texts become one.
    """
    h = F.xxhash64("text")
    named = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", h.alias("h"))).alias("doc_id"), "text")
    kept = near_duplicates(named, scratch, width, percent).where("kept and doc_id is not null").select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.h").alias("_h")).distinct()
    known = docs.where("doc_id is not null").join(kept, (F.col("doc_id") == F.col("_id")) & (h == F.col("_h")), "left_semi")
    whole = known.groupBy("doc_id", h).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row")).select("_row.*")
    return whole.unionAll(docs.where("doc_id is null"))
