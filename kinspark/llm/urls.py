"""URL rules and a block list behind a blocked Bloom filter, in DataFrame functions only.

Rules are (verdict, host, path): a rule fits its host and all subdomains if the
path starts with the rule's; the longest wins.  A url that no rule fits is
blocked if its canonical form is on a list.  The list is folded into a blocked
Bloom filter: a hash chooses one block of eight 64-bit words and one bit in each
word.  Urls whose bits are all set are joined with the list, which removes the
false positives; the others never reach the join.

The filter has 16 bits for a listed url, and at most MAX_BLOCKS blocks (32 MB for
16 million urls), so it is broadcast at any size of the list: a longer list, of
30 million say, lets some more urls through to the exact join.

Canonical form: the host (A-Z lower-cased, a leading "www." off) and the path
without trailing slashes.  Defined cases: a null url, or one without "://", has
an empty host and path, fits no rule and is on no list; repeated rows are judged
alike; of rules of one length the first given wins; a list may repeat urls and be
empty; an empty table gives an empty result; urls may be of any length.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinspark.scratch import Scratch

BIG, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BLOCKS = 1 << 19
WORDS = 8
BITS_PER_URL = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first "://" and path up to "?" or "#"; empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), BIG, SMALL)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Canonical form; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", "")))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]], pick) -> Column:
    """``pick`` of the longest rule that fits, else null."""
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.lit(pick(verdict, rule_host, rule_path))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("string") if found is None else found


def _bits(key: Column) -> list[Column]:
    """One single-bit mask for each word of a block."""
    h = F.xxhash64(key)
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n_blocks)).cast("int")


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7): the filter of the canonical urls in column ``key``."""
    words = [F.bit_or(mask).alias(f"w{k}") for k, mask in enumerate(_bits(F.col("key")))]
    return listed.groupBy(_block(F.col("key"), n_blocks).alias("block")).agg(*words)


def n_blocks_for(n: int) -> int:
    """Blocks for ``n`` urls: a power of two, MAX_BLOCKS at most."""
    need = max(1, -(-n * BITS_PER_URL // (64 * WORDS)))
    return min(MAX_BLOCKS, 1 << (need - 1).bit_length())


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], scratch: Scratch, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, possible (passed the filter) and listed.

    ``listed``: a column ``url`` of block-listed urls, from wherever; nothing of
    it is read off the pages.
    """
    host, path = host_and_path(F.col("url"))
    listed = listed.select(*[c.alias(n) for c, n in zip(host_and_path(F.col(url)), ("host", "path"))])
    listed = scratch.keep(listed.select(canonical(F.col("host"), F.col("path")).alias("key")).where("key is not null").distinct(), "listed")
    n_blocks = n_blocks_for(listed.count())
    parsed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("key", canonical(F.col("host"), F.col("path")))
    parsed = parsed.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules, lambda v, h, p: h + p)).withColumn("ruled", rule_column(F.col("host"), F.col("path"), rules, lambda v, h, p: v))
    bloom = F.broadcast(bloom_filter(listed, n_blocks))  # at most MAX_BLOCKS rows
    probed = parsed.withColumn("block", _block(F.col("key"), n_blocks)).join(bloom, "block", "left")
    hit = F.col("key").isNotNull()
    for k, mask in enumerate(_bits(F.col("key"))):
        hit = hit & (F.coalesce(F.col(f"w{k}"), F.lit(0).cast("bigint")).bitwiseAND(mask) != 0)
    probed = probed.select("page_id", "host", "path", "rule", "ruled", "key", hit.alias("possible"))
    # the others never shuffle; a null join key would send them all to one task
    sure = probed.where("not possible").withColumn("listed", F.lit(False))
    maybe = probed.where("possible").join(listed.select(F.col("key").alias("_key"), F.lit(True).alias("listed")).hint("shuffle_hash"), F.col("key") == F.col("_key"), "left").drop("_key")
    every = sure.unionByName(maybe.withColumn("listed", F.coalesce("listed", F.lit(False))))
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return every.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "possible", "listed")
