"""Seed index of sequences and the join of queries with it, in DataFrame functions.

A seed is what a pattern leaves of a window: residues at positions marked 1, in
a reduced alphabet.  The seed itself is the join key; Spark hashes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinspark.functions import kmers


def reduce_alphabet(seq: Column, groups: str) -> Column:
    """Residues replaced by the smallest of their comma-separated group, in upper case."""
    source, target = "", ""
    for group in filter(None, groups.upper().split(",")):
        source += group
        target += min(group) * len(group)
    return F.translate(F.upper(seq), source, target)


def spaced_seed(window: Column, pattern: str) -> Column:
    """Residues of a window at the positions that the pattern marks."""
    if "0" not in pattern:
        return window
    return F.concat(*[F.substring(window, k + 1, 1) for k, c in enumerate(pattern) if c != "0"])


def seeds(records: DataFrame, patterns: str = "111111", step: int = 1, groups: str | None = None, masked: str = "x") -> DataFrame:
    """(id, key, pos) of the windows of every sequence, without those that hold a masked residue.

    ``patterns`` are separated by commas; keys of several patterns are kept apart
    by the pattern's number.  ``records``: (id, seq).
    """
    seq = F.col("seq") if groups is None else reduce_alphabet(F.col("seq"), groups)
    out = None
    names = patterns.split(",")
    for number, pattern in enumerate(names):
        k = len(pattern)
        rows = records.select("id", seq.alias("seq")).where(F.length("seq") >= k)
        rows = rows.select("id", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(step))).alias("pos"))
        window = F.col("seq").substr(F.col("pos") + 1, F.lit(k))
        rows = rows.select("id", window.alias("window"), "pos").where(~F.lower("window").contains(masked.lower()) if masked else F.lit(True))
        key = spaced_seed(F.col("window"), pattern)
        own = rows.select("id", (F.concat(F.lit(f"{number}:"), key) if len(names) > 1 else key).alias("key"), "pos")
        out = own if out is None else out.unionByName(own)
    return out


def coded_seeds(records: DataFrame, patterns: str = "111111", step: int = 1, groups: str | None = None, buckets: int | None = None, letters: str | None = None, masked: str = "x") -> DataFrame:
    """(id, key, pos) with numbers for keys, each once: FNV-1a hashes of the seed and its pattern's number, modulo ``buckets``.

    With ``letters`` the key is the seed read as a number over these letters
    instead (see :func:`kinspark.functions.kmers.kmer_number`).
    """
    out = None
    for number, pattern in enumerate(patterns.split(",")):
        own = seeds(records, pattern, step, groups, masked)
        key = kmers.mixed_32(kmers.fnv1a_32(F.col("key")), number) if letters is None else kmers.kmer_number(F.col("key"), letters)
        own = own.select("id", (key % buckets if buckets else key).alias("key"), "pos")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def histogram(index: DataFrame) -> DataFrame:
    """(key, n): occurrences of each seed."""
    return index.groupBy("key").agg(F.count("*").alias("n"))


def frequency_limit(buckets: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """One row (mean, sd, top): statistics of the bucket sizes, with one bucket more in the divisor."""
    sums = buckets.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("t2"), F.count("*").alias("c"))
    mean = F.col("t") / (F.col("c") + 1)
    sd = F.sqrt((F.col("t2") - 2 * mean * F.col("t") + F.col("c") * mean * mean) / (F.col("c") + 1))
    return sums.select(mean.alias("mean"), sd.alias("sd"), (mean + sigmas * sd).alias("top"))


def save_index(index: DataFrame, name: str, n_buckets: int) -> None:
    """Keep a seed index as a table bucketed by seed: joins with it need no shuffle of it."""
    index.write.bucketBy(n_buckets, "key").sortBy("key").mode("overwrite").saveAsTable(name)


def load_index(spark: SparkSession, name: str) -> DataFrame:
    """A kept seed index (id, key, pos)."""
    return spark.table(name).select("id", "key", "pos")


def rarest_seeds(query: DataFrame, buckets: DataFrame, most: float) -> DataFrame:
    """Seeds of each query whose bucket is no larger than the last one that is taken.

    Buckets are taken by ascending size while those before add up to ``most`` at
    most; seeds in no bucket are taken too.  ``query``: (id, key, pos).
    """
    joined = query.join(buckets, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = Window.partitionBy("id").orderBy("n", "pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = joined.withColumn("_used", F.coalesce(F.sum("n").over(before), F.lit(0)))
    limit = F.max(F.when(F.col("_used") <= most, F.col("n"))).over(Window.partitionBy("id"))
    return ranked.withColumn("_limit", limit).where("n <= _limit").drop("_used", "_limit")


def accept_seeds(query: DataFrame, buckets: DataFrame, limit: DataFrame) -> DataFrame:
    """Seeds of each query, rarest sequence content first, while what they reach stays under the limit.

    ``query``: (id, key, pos, weight, size): a window's self score and its
    query's length.  Windows are taken by descending weight until the buckets
    before a window add up to more than the limit times the length.
    """
    joined = query.join(buckets, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = Window.partitionBy("id").orderBy(F.desc("weight"), "pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = joined.withColumn("_used", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return ranked.join(F.broadcast(limit.select("top"))).where(F.col("_used") <= F.col("top") * F.col("size")).drop("_used", "top")


def seed_hits(query: DataFrame, index: DataFrame) -> DataFrame:
    """(q, s, qpos, spos): places where a query and a sequence share a seed."""
    left = query.select(F.col("id").alias("q"), "key", F.col("pos").alias("qpos"))
    right = index.select(F.col("id").alias("s"), "key", F.col("pos").alias("spos"))
    return left.join(right, "key").select("q", "s", "qpos", "spos")


def diagonals(hits: DataFrame, width: int = 1) -> DataFrame:
    """(q, s, diagonal, n): shared seeds on each diagonal band."""
    return hits.groupBy("q", "s", F.floor((F.col("qpos") - F.col("spos")) / width).alias("diagonal")).agg(F.countDistinct("qpos", "spos").alias("n"))


def best_diagonal(bands: DataFrame) -> DataFrame:
    """(q, s, diagonal, n): the band with most seeds of each pair, the smallest of equals."""
    best = bands.groupBy("q", "s").agg(F.max(F.struct("n", (-F.col("diagonal")).alias("back"))).alias("best"))
    return best.select("q", "s", (-F.col("best.back")).alias("diagonal"), F.col("best.n").alias("n"))
