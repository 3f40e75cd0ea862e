"""Removal of passages that occur twice, by bucket-pointer refinement of suffixes.

A byte goes if a 200-byte string covers it that also starts anywhere else, in
the same document or another.

1. Equal texts become one, with a weight of 2 (two or more rows).  Everything
   below sees each text once, however many copies there are.
2. Every 200-byte string (window) is led by its rarest 48-gram: the one with the
   smallest hash, the leftmost of equals.  Equal windows have equal leading grams
   at equal places, so the leading gram is the bucket that a window starts in.  A
   maximal row of windows with one leading gram is a strip, about 75 windows long;
   its bytes are those that the windows cover.  Buckets of total weight 1 are
   done: most are.
3. The strips of all other buckets are refined, bucket by bucket, in tasks.  Equal
   strips of a bucket are refined once, with the sum of their weights.  Initial
   buckets are 8-grams, taken as they are; the members of a bucket are told apart
   by the bucket numbers at an offset equal to the depth reached, and the new
   numbers serve the next step: 8, 16, 32, 64, 128, 200.  Windows that share a
   bucket at depth 200, or have a weight of 2 there, go.
4. A bucket with more than CROWD different strips is refined further before any
   task takes it: strips are cut by the place of the gram in the window (32, 8, 2
   and at last 1 windows a piece), and a piece moves to the bucket of the bytes
   that all its windows share.  At one window a piece that is the window itself.

Step 3 compares bytes.  Only that equal texts and equal strips of a bucket are
equal stands on hashes: 128 bits for either (79 bits where a strip looks its text
up).  Texts travel once, compressed, and are then kept in buckets of their hash.

Defined cases: a null text is empty; texts under 200 bytes lose nothing, a text
that occurs twice and has 200 bytes or more loses all; repeated ids are judged
each by its own text; an empty table gives an empty result.  A very long text is
read in segments of 4 MB; it has to fit in a row.  Extra columns are ignored.
Results are in bytes: what is kept may split a code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from kinspark.llm import text as T
from kinspark.scratch import Scratch

GRAM = 48
START = 8
SEGMENT = 1 << 22
_PLACE = T.U((1 << 24) - 1)
#: Different strips of a bucket that one task refines; buckets with more are cut first.
CROWD = 1_000
#: Windows a piece when crowded buckets are cut, level by level.
WIDTHS = (32, 8, 2, 1)

# A strip's place is one number: weight - 1, tag of the text, first window, offset of the gram from it, windows - 1.
_WEIGHT_BIT, _TAG_BIT, _FIRST_BIT, _OFFSET_BIT = 62, 47, 16, 8
_FIRST_MASK, _TAG_MASK = (1 << 31) - 1, (1 << 15) - 1


def first_of(place: Column) -> Column:
    return F.shiftright(place, _FIRST_BIT).bitwiseAND(_FIRST_MASK)


def tag_of(place: Column) -> Column:
    """Bits of k1 that tell texts with one k0 apart."""
    return F.shiftright(place, _TAG_BIT).bitwiseAND(_TAG_MASK)


def weight_of(place: Column) -> Column:
    return F.shiftright(place, _WEIGHT_BIT) + 1


def runs(data: np.ndarray, length: int, edges: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """First window, number of windows, gram offset, gram hash and content hash of every strip.

    ``edges``: where texts in ``data`` end; no window crosses one.
    """
    found = [_runs(data[s : s + SEGMENT + length - 1], length, s, edges) for s in range(0, max(len(data) - length + 1, 0), SEGMENT)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, T.U), np.zeros(0, T.U)
    return tuple(np.concatenate(x) for x in zip(*found))


def _runs(data: np.ndarray, length: int, shift: int, edges: np.ndarray | None) -> tuple[np.ndarray, ...]:
    n = len(data)
    forward, backward = T._power_tables(n + 1)
    sums = np.empty(n + 1, T.U)
    sums[0] = 0
    np.cumsum((data.astype(T.U) + T.U(1)) * forward[:n], out=sums[1:])
    gram = T.mix((sums[GRAM:] - sums[:-GRAM]) * backward[: n - GRAM + 1])
    width = length - GRAM + 1
    key = (gram & ~_PLACE) | np.arange(len(gram), dtype=T.U)
    blocks = -(-len(key) // width)
    full = np.full(blocks * width, ~T.U(0))
    full[: len(key)] = key
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    count = n - length + 1
    lead = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & _PLACE).astype(np.int64)
    new = np.ones(count, bool)
    new[1:] = lead[1:] != lead[:-1]
    first = np.flatnonzero(new)
    if edges is not None and len(edges) > 1:
        # a window is inside a text if no edge lies within it
        inside = np.ones(count + 1, bool)
        for e in (edges[:-1] - shift).tolist():
            inside[max(e - length + 1, 0) : max(e, 0)] = False
            if 0 < e < count:
                new[e] = True
            if 0 < e - length + 1 < count:
                new[e - length + 1] = True
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [count]]))
        ok = inside[first]
        first, size = first[ok], size[ok]
    else:
        size = np.diff(np.concatenate([first, [count]]))
    stop = first + size + length - 1
    content = T.mix((sums[stop] - sums[first]) * backward[first] + T.U(0x5851F42D4C957F2D) * size.astype(T.U))
    return first + shift, size, lead[first] - first, gram[lead[first]], content


def repeated_windows(strips: list[bytes], length: int, weights: list[int] | None = None) -> list[np.ndarray]:
    """For each strip, which of its windows occur elsewhere: in another strip, or in this one's copies.

    Bucket-pointer refinement from 8-grams up to the depth ``length``.  A bucket
    of total weight 1 has one member and is done.
    """
    if length < START or any(len(c) < length for c in strips):
        raise ValueError("windows of 8 bytes or more, and no shorter strips")
    if not strips:
        return []
    data = np.frombuffer(b"".join(strips), np.uint8)
    sizes = np.array([len(c) for c in strips])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    end = np.repeat(edges[1:].astype(np.int32), sizes)
    weight = None if weights is None or max(weights) == 1 else np.repeat(np.array(weights, np.int8), sizes)
    pointer = np.full(len(data), -1, np.int32)  # -1: no string of this depth elsewhere
    at = np.flatnonzero(end - np.arange(len(data), dtype=np.int32) >= START)
    keys = np.ndarray((len(data) - START + 1,), "<u8", data, strides=(1,))[at]
    depth = START
    while True:
        order = np.argsort(keys)
        ordered = keys[order]
        fresh = np.ones(len(ordered), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        bucket = np.cumsum(fresh, dtype=np.int32) - 1
        place = at[order]
        if weight is None:
            begin = np.flatnonzero(fresh)
            shared = np.repeat(np.diff(np.append(begin, len(ordered))) > 1, np.diff(np.append(begin, len(ordered))))
        else:
            shared = np.bincount(bucket, weights=weight[place])[bucket] > 1.5
        pointer[:] = -1
        pointer[place[shared]] = bucket[shared]
        if depth == length:
            break
        ahead = min(depth, length - depth)
        left = np.flatnonzero(pointer[: len(data) - ahead] >= 0)
        left = left[(left + (depth + ahead) <= end[left]) & (pointer[left + ahead] >= 0)]
        if not len(left):
            pointer[:] = -1
            break
        at = left
        keys = pointer[at].astype(np.uint64) << np.uint64(32) | pointer[at + ahead].astype(np.uint64)
        depth += ahead
    flags = pointer >= 0
    return [flags[a : b - length + 1] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[0::2], edge[1::2]


def _merged(run, rows: int = 50_000):
    """The same batches, small ones joined."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in run(batches):
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                yield pa.concat_batches(held)
                held, count = [], 0
        if held:
            yield pa.concat_batches(held)

    return merged


def _key() -> list[Column]:
    """128 bits that stand for a text."""
    whole = F.coalesce("text", F.lit(""))
    return [F.xxhash64(whole).alias("k0"), F.xxhash64(F.lit(7), whole).alias("k1")]


def distinct_texts(docs: DataFrame, work: Scratch, length: int) -> DataFrame:
    """w (1, or 2 for copies), k0, k1 and the compressed text of every text of ``length`` bytes or more, in buckets of k0."""
    read = T.bounded(docs).where(F.octet_length("text") >= length).select(*_key(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        seen: dict[tuple[int, int], bool] = {}
        for batch in batches:
            if len(seen) > 500_000:
                seen = {}
            for i, j, views in T.parts(batch.column(2)):
                rows, packed = [], []
                for k, key in enumerate(zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist())):
                    again = seen.get(key)
                    if again is None:
                        packed.append(squeeze.compress(views[k].tobytes()))
                    elif again:
                        continue  # two of a task stand for all
                    else:
                        packed.append(None)
                    seen[key] = again is not None
                    rows.append(i + k)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(packed, pa.binary())], names=["k0", "k1", "packed"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = read.mapInArrow(run, "k0 bigint, k1 bigint, packed binary").repartition(n, "k0")
    one = packed.groupBy("k0", "k1").agg(F.first("packed", True).alias("packed"), F.least(F.count("*"), F.lit(2)).cast("int").alias("w"))
    return work.keep_bucketed(one, "texts", "k0")


def find_strips(texts: DataFrame, length: int) -> DataFrame:
    """t, place, bucket and content of the strips of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()

        def found(t: list[int], tag: list[int], held: list[bytes]) -> pa.RecordBatch:
            edges = np.cumsum([len(x) for x in held])
            data = np.frombuffer(held[0] if len(held) == 1 else b"".join(held), np.uint8)
            first, size, off, gram, content = runs(data, length, edges)
            owner = np.searchsorted(edges, first, "right")
            first = first - np.concatenate([[0], edges[:-1]])[owner]
            place = np.array(tag, np.int64)[owner] | first << _FIRST_BIT | off << _OFFSET_BIT | size - 1
            return pa.RecordBatch.from_arrays([pa.array(np.array(t, np.int64)[owner]), pa.array(place), pa.array(gram.view(np.int64)), pa.array(content.view(np.int64))], names=["t", "place", "bucket", "content"])

        for batch in batches:
            t, tag, held, size = [], [], [], 0
            for a, b, w, packed in zip(*(batch.column(k).to_pylist() for k in range(4))):
                t.append(a)
                tag.append(w - 1 << _WEIGHT_BIT | (b & _TAG_MASK) << _TAG_BIT)
                held.append(expand.decompress(packed))
                size += len(held[-1])
                if size >= 1 << 17:
                    yield found(t, tag, held)
                    t, tag, held, size = [], [], [], 0
            if held:
                yield found(t, tag, held)

    return texts.select("k0", "k1", "w", "packed").mapInArrow(_merged(run), "t bigint, place bigint, bucket bigint, content bigint")


def _with_bytes(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """packed, and lists of place, weight, bucket and content of the classes' first members, by text."""
    listed = classes.groupBy(F.col("one.t").alias("k0")).agg(F.collect_list(F.struct("one.place", "w", "bucket", "content")).alias("m"))
    own = F.filter("m", lambda x: tag_of(x["place"]) == F.col("k1").bitwiseAND(_TAG_MASK))
    rows = texts.select("k0", "k1", "packed").join(listed, "k0").select("packed", own.alias("m"))
    return rows.select("packed", "m.place", "m.w", "m.bucket", "m.content")


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """bucket, content, weight and bytes of the strips in ``rows`` (see :func:`_with_bytes`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed, places, w, bucket, content in zip(*(batch.column(k).to_pylist() for k in range(5))):
                text = expand.decompress(packed)
                first = [p >> _FIRST_BIT & _FIRST_MASK for p in places]
                cut = [text[a : a + (p & 255) + length] for a, p in zip(first, places)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(content, pa.int64()), pa.array(w, pa.int32()), pa.array(cut, pa.binary())], names=["bucket", "content", "w", "bytes"])

    return rows.mapInArrow(_merged(run, 2_000), "bucket bigint, content bigint, w int, bytes binary")


def _refined(strips: DataFrame, length: int, pool: int = 1 << 20) -> DataFrame:
    """bucket, content and ranges (of windows) of the strips with repeated windows; a bucket is in one task."""
    ordered = strips.repartition("bucket").sortWithinPartitions("bucket", "content")

    def flush(buckets: list[int], contents: list[int], w: list[int], data: list[bytes]) -> pa.RecordBatch:
        rows, ranges = [], []
        for k, flags in enumerate(repeated_windows(data, length, w)):
            lo, hi = spans(flags)
            if len(lo):
                rows.append(k)
                ranges.append([{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist())])
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([buckets[k] for k in rows], pa.int64()), pa.array([contents[k] for k in rows], pa.int64()), pa.array(ranges, kind)], names=["bucket", "content", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = ([], [], [], []), 0, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if row[0] != last and size >= pool:
                    yield flush(*held)
                    held, size = ([], [], [], []), 0
                last = row[0]
                for column, x in zip(held, row):
                    column.append(x)
                size += len(row[3])
        if size:
            yield flush(*held)

    return ordered.mapInArrow(_merged(run), "bucket bigint, content bigint, ranges array<struct<lo:int,hi:int>>")


def _pieces(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Strips cut by the place of their gram: bucket, content, part (first, windows - 1), new bucket and content.

    Piece j holds the windows that start from j * width to (j + 1) * width - 1
    bytes before the gram.  Its bucket is that of the bytes which lie in all of
    these windows.
    """
    seed = width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for packed, places, _, buckets, contents in zip(*(batch.column(k).to_pylist() for k in range(5))):
                text = expand.decompress(packed)
                for place, bucket, content in zip(places, buckets, contents):
                    first, off, size = place >> _FIRST_BIT & _FIRST_MASK, place >> _OFFSET_BIT & 255, (place & 255) + 1
                    for j in range((off - size + 1) // width, off // width + 1):
                        low, high = off - (j + 1) * width + 1, off - j * width
                        a, b = max(low, 0), min(high, size - 1)
                        core = text[first + high : first + low + length]
                        head = j.to_bytes(2, "little") + (bucket & (1 << 64) - 1).to_bytes(8, "little")
                        own = (xxhash.xxh3_64_intdigest(head + core, seed), xxhash.xxh3_64_intdigest(text[first + a : first + b + length], seed))
                        for column, x in zip(out, (bucket, content, a << 8 | b - a, own[0] - (1 << 63), own[1] - (1 << 63))):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["bucket", "content", "part", "new_bucket", "new_content"])

    return rows.mapInArrow(run, "bucket bigint, content bigint, part bigint, new_bucket bigint, new_content bigint")


def repeated_spans(texts: DataFrame, work: Scratch, length: int = 200) -> DataFrame:
    """k0, k1, packed and the list of byte ranges (lo, hi) to remove, of the texts that lose something."""
    if not GRAM < length < GRAM + 256:
        raise ValueError("strings of 49 to 303 bytes")
    found = find_strips(texts, length)
    # written first, as all tables that meet crowded keys: only then can a join on one be split
    grams = work.keep(found.groupBy("bucket").agg(F.sum(weight_of(F.col("place"))).alias("w")).where("w > 1").select("bucket"), "grams")
    members = work.keep(found.join(grams, "bucket").select("t", "place", "bucket", "content"), "strips")
    out = None
    for width in (*WIDTHS, 0):
        classes = members.groupBy("bucket", "content").agg(F.least(F.sum(weight_of(F.col("place"))), F.lit(2)).cast("int").alias("w"), F.min(F.struct("t", "place")).alias("one"))
        classes = work.keep(classes, "classes")
        # within a level the strips of a bucket are many only where texts share the gram and little else
        crowded = work.keep(classes.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("bucket"), "crowded")
        cold = classes if not width else classes.join(crowded, "bucket", "left_anti")
        flagged = work.keep(_refined(_cut(_with_bytes(cold, texts), length), length), "flagged")
        start = first_of(F.col("place"))
        own = members.join(flagged, ["bucket", "content"]).select("t", tag_of(F.col("place")).alias("tag"), start.alias("first"), F.explode("ranges").alias("r"))
        own = own.select("t", "tag", (F.col("first") + F.col("r.lo")).alias("lo"), (F.col("first") + F.col("r.hi") + length - 1).alias("hi"))
        out = own if out is None else out.unionAll(own)
        if not width or crowded.isEmpty():
            break
        pieces = work.keep(_pieces(_with_bytes(classes.join(crowded, "bucket", "left_semi"), texts), length, width), "pieces")
        a = F.shiftright("part", 8)
        moved = F.col("place") - F.col("place").bitwiseAND(255) + F.col("part").bitwiseAND(255) + F.shiftleft(a, _FIRST_BIT) - F.shiftleft(a, _OFFSET_BIT)
        members = members.join(pieces, ["bucket", "content"]).select("t", moved.alias("place"), F.col("new_bucket").alias("bucket"), F.col("new_content").alias("content"))
        members = work.keep(members, "strips")
    listed = out.groupBy(F.col("t").alias("k0")).agg(F.collect_list(F.struct("tag", "lo", "hi")).alias("spans"))
    own = F.filter("spans", lambda x: x["tag"] == F.col("k1").bitwiseAND(_TAG_MASK))
    return texts.select("k0", "k1", "packed").join(listed, "k0").select("k0", "k1", "packed", F.transform(own, lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("spans"))


def merge(spans_: list[dict] | None, n: int) -> list[tuple[int, int]]:
    """Disjoint maximal ranges of the union, in order."""
    out: list[list[int]] = []
    for s in sorted((x["lo"], x["hi"]) for x in spans_ or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, min(b, n)) for a, b in out]


def rest(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """``data`` without the ranges."""
    edges = [0, *(x for r in ranges for x in r), len(data)]
    return b"".join([data[a:b] for a, b in zip(edges[0::2], edges[1::2])]) if ranges else data


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (see :func:`kept_bytes` for what is left)."""
    work = scratch.child()
    judged = repeated_spans(distinct_texts(docs, work, length), work, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, number, digest = [], [], []
            for k in range(batch.num_rows):
                text = expand.decompress(batch.column(2)[k].as_py())
                gone = merge(batch.column(3)[k].as_py(), len(text))
                removed.append(sum(b - a for a, b in gone))
                number.append(len(gone))
                digest.append(hashlib.sha256(rest(text, gone)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(digest, pa.string())], names=["k0", "k1", "removed", "number", "digest"])

    judged = scratch.keep(judged.mapInArrow(_merged(run), "k0 bigint, k1 bigint, removed bigint, number bigint, digest string"), "judged")
    work.drop()
    whole = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(whole).cast("bigint").alias("n_bytes"), F.sha2(whole.cast("binary"), 256).alias("whole"), *_key()).join(judged, ["k0", "k1"], "left")
    none = F.lit(0).cast("bigint")
    return rows.select("doc_id", "n_bytes", F.coalesce("removed", none).alias("n_removed"), F.coalesce("number", none).alias("n_spans"), F.coalesce("digest", "whole").alias("kept_sha256"))


def _joined(docs: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """``docs`` with the list of ranges of each text, unmerged, as ``_spans``."""
    work = scratch.child()
    found = repeated_spans(distinct_texts(docs, work, length), work, length)
    by_key = scratch.keep(found.select("k0", "k1", F.col("spans").alias("_spans")), "spans")
    work.drop()
    k0, k1 = _key()
    keyed = docs.withColumns({"_k0": k0, "_k1": k1}).join(by_key.withColumnsRenamed({"k0": "_k0", "k1": "_k1"}), ["_k0", "_k1"], "left")
    return keyed.select(*[F.col(f"`{c}`") for c in docs.columns], "_spans")


def kept_bytes(docs: DataFrame, scratch: Scratch, length: int = 200) -> DataFrame:
    """doc_id, ranges (removed) and kept (the bytes left) of every document."""
    found = _joined(docs.select("doc_id", "text"), scratch, length).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "_spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges, kept = [], []
            for k in range(batch.num_rows):
                data = batch.column(1)[k].as_buffer().to_pybytes()
                gone = merge(batch.column(2)[k].as_py(), len(data))
                ranges.append([list(r) for r in gone])
                kept.append(rest(data, gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranges, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=["doc_id", "ranges", "kept"])

    return found.mapInArrow(run, f"doc_id {kind}, ranges array<array<bigint>>, kept binary")


def strip_repeats(docs: DataFrame, scratch: Scratch, length: int = 200) -> DataFrame:
    """``docs`` with what is kept of each text, and n_chars (if there) to match.

    Bytes of a code point that was cut in two are left out; a null text becomes
    an empty one.
    """
    found = _joined(T.bounded(docs), scratch, length)
    at = docs.columns.index("text")
    found = found.withColumn("text", F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 512):
                batch = big.slice(i, 512)
                listed = batch.column(batch.num_columns - 1)
                texts = batch.column(at)
                if listed.null_count < len(listed):
                    made = []
                    for k in range(len(listed)):
                        data = texts[k].as_buffer().to_pybytes()
                        made.append(rest(data, merge(listed[k].as_py(), len(data))).decode(errors="ignore") if listed[k].is_valid else texts[k].as_py())
                    texts = pa.array(made, pa.string())
                columns = list(batch.columns[:-1])
                columns[at] = texts
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    schema = found.drop("_spans").schema
    made = found.mapInArrow(run, schema)
    return made.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
