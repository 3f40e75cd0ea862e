"""Similarity search: seeds, ungapped chains, banded alignment, E-values, best hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kinspark.functions import align, scores
from kinspark.operators import seeds as S
from kinspark.scratch import Scratch

HIT = "q string, s string, identity double, aln_len int, mismatch int, gap_open int, qst int, qed int, sst int, sed int, bit double, qlen int, slen int"


def mask(records: DataFrame, floor: float = 2.2, reach: int = 0) -> DataFrame:
    """Records (id, seq) with low-complexity windows masked, and ``reach`` residues around them."""

    @F.pandas_udf("string")
    def masked(seq: pd.Series) -> pd.Series:
        return seq.map(lambda x: None if x is None else align.mask_around(align.mask_low_complexity(x, floor), reach) if reach else align.mask_low_complexity(x, floor))

    return records.withColumn("seq", masked("seq"))


def seed_weights(query_seeds: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """Seeds (id, key, pos) with their window's self score and their query's length."""

    @F.pandas_udf("array<int>")
    def self_scores(seq: pd.Series) -> pd.Series:
        def one(x: str) -> list[int]:
            c = align.codes(x)
            sums = np.concatenate([[0], np.cumsum(align.TABLE[c, c])])
            return (sums[k:] - sums[:-k]).tolist() if len(c) >= k else []

        return seq.map(one)

    own = query.select("id", self_scores("seq").alias("w"), F.length("seq").alias("size"))
    return query_seeds.join(own, "id").select("id", "key", "pos", F.col("w")[F.col("pos")].alias("weight"), "size")


def candidates(query: DataFrame, subjects: DataFrame, hits: DataFrame, least: int = 25, width: int = 1) -> DataFrame:
    """(q, s, raw, shift): the best ungapped chain of each pair, over ``least``, and its mean offset.

    ``hits``: (q, s, qpos, spos).  Seeds on one diagonal make a chain; with a
    ``width`` over 1 the longest row of seeds in a band of diagonals does that
    rises in both sequences.
    """
    diagonal = F.floor((F.col("qpos") - F.col("spos")) / width).cast("int")
    chains = hits.groupBy("q", "s", diagonal.alias("diagonal")).agg(F.array_sort(F.collect_set(F.struct("qpos", "spos"))).alias("places"))
    rows = chains.join(query.select(F.col("id").alias("q"), F.col("seq").alias("qseq")), "q").join(subjects.select(F.col("id").alias("s"), F.col("seq").alias("sseq")), "s")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for q, s, places, x, y in zip(part["q"], part["s"], part["places"], part["qseq"], part["sseq"]):
                chain = [(int(p["qpos"]), int(p["spos"])) for p in places]
                raw, q0, q1, s0, s1 = align.chain_score(align.codes(x), align.codes(y), chain if width == 1 else align.longest_chain(chain))
                out.append((q, s, raw, int(((s0 - q0) + (s1 - q1)) / 2)))
            yield pd.DataFrame(out, columns=["q", "s", "raw", "shift"])

    scored = rows.select("q", "s", "places", "qseq", "sseq").mapInPandas(run, "q string, s string, raw int, shift int")
    best = scored.where(F.col("raw") >= least).groupBy("q", "s").agg(F.max(F.struct("raw", "shift")).alias("b"))
    return best.select("q", "s", "b.raw", "b.shift")


def aligned(part: pd.DataFrame, band: int) -> list[list[tuple]]:
    """The hits (HIT) of each candidate pair (q, s, shift, qseq, sseq): banded local alignment from the chain's offset."""
    shift = part["shift"].to_numpy()
    qo, so = np.maximum(-shift, 0), np.maximum(shift, 0)
    data = [(align.codes(x), align.codes(y)) for x, y in zip(part["qseq"], part["sseq"])]
    cut = [(x[a:], y[b:]) for (x, y), a, b in zip(data, qo, so)]
    long = [max(len(x), len(y)) >= 4096 for x, y in cut]
    short = iter(align.align_batch([c for c, w in zip(cut, long) if not w], band))
    out = []
    for q, s, (x, y), c, w, a, b in zip(part["q"], part["s"], data, cut, long, qo, so):
        found = align.align_long(*c, band=band) if w else [next(short)]
        out.append([(q, s, one.identity, one.length, one.mismatches, one.gaps, one.q_start + a + 1, one.q_end + a, one.s_start + b + 1, one.s_end + b, float(align.bit(one.raw)), len(x), len(y)) for one in found if one.length])
    return out


_HIT_NAMES = [c.split()[0] for c in HIT.split(", ")]


def _with_sequences(pairs: DataFrame, query: DataFrame, subjects: DataFrame) -> DataFrame:
    return pairs.join(query.select(F.col("id").alias("q"), F.col("seq").alias("qseq")), "q").join(subjects.select(F.col("id").alias("s"), F.col("seq").alias("sseq")), "s")


def align_pairs(pairs: DataFrame, query: DataFrame, subjects: DataFrame, band: int = 16, batch: int = 512) -> DataFrame:
    """Hits (HIT) of candidate pairs (q, s, shift)."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            whole = whole.iloc[np.argsort(whole["qseq"].str.len() + whole["sseq"].str.len(), kind="stable")]
            for k in range(0, len(whole), batch):
                yield pd.DataFrame([hit for hits in aligned(whole.iloc[k : k + batch], band) for hit in hits], columns=_HIT_NAMES)

    return _with_sequences(pairs, query, subjects).select("q", "s", "shift", "qseq", "sseq").mapInPandas(run, HIT)


def align_until(pairs: DataFrame, query: DataFrame, subjects: DataFrame, n_sequences: int, expect: float, most: int, patience: float, band: int = 16, batch: int = 32) -> DataFrame:
    """Hits (HIT) up to ``expect`` of candidates (q, s, raw, shift) in order of their chains, until a query has enough.

    A query stops after so many candidates without a hit in a row, or after
    ``most`` and so many with one: ``patience`` times its candidates, but 10 to
    120.  That spares alignments and may lose late hits.
    """
    order = Window.partitionBy("q").orderBy(F.desc("raw"), "s")
    ranked = pairs.withColumn("_rank", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy("q")))
    rows = _with_sequences(ranked, query, subjects).repartition("q").sortWithinPartitions("q", "_rank").select("q", "s", "shift", "qseq", "sseq", "_all")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, missed, found, stop = None, 0, 0, False
        for whole in parts:
            out = []
            k = 0
            owners = whole["q"].to_numpy()
            while k < len(whole):
                if owners[k] != now:
                    now, missed, found, stop = owners[k], 0, 0, False
                same = k + int(np.argmax(np.append(owners[k:], None) != now))
                if stop:
                    k = same
                    continue
                part = whole.iloc[k : min(same, k + batch)]
                limit = float(part["_all"].iloc[0]) * patience + 1
                limit = min(max(limit, 100 / limit, 10), 120)
                for hits in aligned(part, band):
                    good = [h for h in hits if n_sequences * h[-2] * h[-1] * 2.0 ** -h[-3] <= expect]
                    out += good
                    missed = 0 if good else missed + 1
                    found += len(good)
                    if missed >= limit or found >= most + limit:
                        stop = True
                        break
                k += len(part)
            yield pd.DataFrame(out, columns=_HIT_NAMES)

    return rows.mapInPandas(run, HIT)


def top_hits(hits: DataFrame, most: int) -> DataFrame:
    """The ``most`` best hits of each query by bit score, then subject."""
    order = Window.partitionBy("q").orderBy(F.desc("bit"), "s", "qst")
    return hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def e_value_filter(hits: DataFrame, n_sequences: int, expect: float = 1e-3) -> DataFrame:
    """Hits with an E-value, up to ``expect``."""
    return hits.withColumn("evalue", scores.e_value(F.col("bit"), n_sequences, F.col("qlen"), F.col("slen"))).where(F.col("evalue") <= expect)


def search(query: DataFrame, subjects: DataFrame, pattern: str = "111111", expect: float = 1e-3, most: int = 500, groups: str | None = None, masked: bool = True, width: int = 1, patience: float | None = None, n_sequences: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """All hits of the queries (id, seq) in the subjects (id, seq).

    ``width``: diagonals that a chain may take; ``patience``: stop early (see
    :func:`align_until`); ``n_sequences``: for E-values, if the subjects are part
    of more; ``index``: the subjects' kept seeds.
    """
    if masked:
        query = mask(query)
    index = S.seeds(subjects, pattern, groups=groups) if index is None else index
    buckets = S.histogram(index)
    own = seed_weights(S.seeds(query, pattern, groups=groups), query, len(pattern.split(",")[0]))
    accepted = S.accept_seeds(own, buckets, S.frequency_limit(buckets))
    chains = candidates(query, subjects, S.seed_hits(accepted, index), width=width)
    aim = max(100, most + 100, int(1.1 * most))
    order = Window.partitionBy("q").orderBy(F.desc("raw"), "s")
    chains = chains.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= aim).drop("_rank")
    n = n_sequences or subjects.count()
    found = align_pairs(chains, query, subjects) if patience is None else align_until(chains, query, subjects, n, expect, most, patience)
    return top_hits(e_value_filter(found, n, expect), most)


def search_parts(query: DataFrame, subjects: DataFrame, parts: int, scratch: Scratch, most: int = 500, **options) -> DataFrame:
    """As :func:`search`, one part of the subjects after another; the best hits of each query are merged.

    For subjects whose seed index would not fit the cluster's disks at once.
    E-values follow the number of all subjects.
    """
    n = subjects.count()
    found = None
    for k in range(parts):
        own = subjects.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        hits = scratch.keep(search(query, own, most=most, n_sequences=n, **options), f"part{k}")
        found = hits if found is None else found.unionByName(hits)
    return top_hits(found, most)


def cosine_hits(vectors: DataFrame, least: float, block: int = 1000, digits: int = 6) -> DataFrame:
    """(q, s, score): ordered pairs of vectors (id, vec) with a cosine over ``least``.

    All-against-all in blocks: rows are dealt to blocks by a hash, each pair of
    blocks meets once, in one task as two matrices, and only pairs over ``least``
    leave it.  Exact, so its work grows with the square of the vectors.
    """
    n_blocks = max(1, -(-vectors.count() // block))
    own = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("own"))
    left = own.select("id", "vec", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.lit(n_blocks - 1))).alias("j"))
    right = own.select(F.col("id").alias("sid"), F.col("vec").alias("svec"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "s": [], "score": []})
        x, y = (np.stack(v).astype(np.float64) for v in (a["vec"], b["svec"]))
        x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
        score = np.round(x @ y.T, digits)
        i, j = np.nonzero(score > least)
        q, s = a["id"].to_numpy()[i], b["sid"].to_numpy()[j]
        out = pd.DataFrame({"q": q, "s": s, "score": score[i, j]})
        out = out[out["q"] != out["s"]]
        if a["i"].iloc[0] == a["j"].iloc[0]:
            return out
        return pd.concat([out, out.rename(columns={"q": "s", "s": "q"})], ignore_index=True)[["q", "s", "score"]]

    kind = vectors.schema["id"].dataType.simpleString()
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(meet, f"q {kind}, s {kind}, score double")
