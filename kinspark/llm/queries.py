"""The queries of this package over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinspark.llm import bpe, crf, imatch, licenses, mil, neardup, packing, rules, samples, suffixes, urls
from kinspark.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(divisor: int, rest: int):
    return F.coalesce(samples.remainder("doc_id", divisor) == rest, F.lit(False))


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; the rows with remainder 1 are never learnt from."""
    docs = table(spark, sf_dir, "documents")
    model = crf.fit(docs, table(spark, sf_dir, "labels"), ~_held_out(3, 1))
    return crf.score_quality(docs, model).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op2_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the rows with remainder 0 are never learnt from."""
    docs = table(spark, sf_dir, "documents")
    model = mil.fit(docs, table(spark, sf_dir, "labels"), ~_held_out(5, 0))
    return mil.score_toxicity(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark))


OP3_SQL = r"""
WITH b AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, (length(hex(encode(coalesce(text, '')))) // 2)::BIGINT AS n FROM documents),
w AS (SELECT r, i, md5_number(substr(h, (2 * i + 1)::BIGINT, 400)) AS k FROM (SELECT r, h, unnest(range(0, n - 199)) AS i FROM b)),
d AS (SELECT r, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CASE WHEN i > p + 200 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM d)),
s AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM g GROUP BY r, g),
k AS (SELECT r, lo, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before, hi FROM s),
t AS (SELECT r, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(max(h), 2 * max(hi) + 1) AS kept FROM k JOIN b USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN t USING (r)
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return rules.judge_rules(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the quality rules: statistics and hard limits."""
    return rules.judge_rules(table(spark, sf_dir, "documents"), rules.Model(None, 2.0)).drop("kept", "anomaly")


RULE_COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) > 1) CROSS JOIN (SELECT range AS j FROM range(8)) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packing.pack(cut, Scratch(spark))


BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), BASE_PHRASES)


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the license scan: places and labels of the base phrases."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), BASE_PHRASES)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_LICENSES_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES {", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in BASE_PHRASES.items())}) v(phrase, label, k)),
f AS (SELECT r, i, label FROM (SELECT r, w, phrase, label, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN p) WHERE array_to_string(w[i:i + k - 1], ' ') = phrase),
g AS (SELECT r, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM f GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (r)
"""


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Sites of which some pages are block-listed; neither the host nor the path tells which.
LISTED_SITES = (
    "tionsh.example.net", "blog.tionsh.example.net", "thther.example.org", "m.thther.example.org", "ththan.example.net", "blog.ththan.example.net", "m.ththth.example.net", "blog.ththth.example.org",
    "blog.ththly.example.org", "blog.ththre.example.org", "blog.ththon.example.net", "ththed.example.org", "therti.example.org", "ththble.example.net", "spam-farm.example.org",
)
LISTED_LANGUAGES = ("en", "de", "fr", "es")


def block_list(spark: SparkSession) -> DataFrame:
    """The block-listed urls: of each site and language every third page up to 3000, then every 52nd up to 260,000."""
    number = spark.range(260_000).where("id < 3000 and id % 3 = 0 or id >= 3000 and id % 52 = 3")
    site, language = (F.explode(F.array(*map(F.lit, x))) for x in (LISTED_SITES, LISTED_LANGUAGES))
    rows = number.select("id", site.alias("site")).select("id", "site", language.alias("language"))
    return rows.select(F.concat(F.lit("https://"), "site", F.lit("/"), "language", F.lit("/"), F.col("id").cast("string")).alias("url"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page; the block list is an input of its own (see :func:`block_list`)."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), block_list(spark), URL_RULES, Scratch(spark)).drop("possible")


OP7_SQL = rf"""
WITH a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS k,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM b
), l AS (
  SELECT s || '/' || g || '/' || n AS k FROM (SELECT unnest({list(LISTED_SITES)!r}) AS s) CROSS JOIN (SELECT unnest({list(LISTED_LANGUAGES)!r}) AS g)
  CROSS JOIN (SELECT range AS n FROM range(260000) WHERE range < 3000 AND range % 3 = 0 OR range >= 3000 AND range % 52 = 3)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN l.k IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  l.k IS NOT NULL AS listed
FROM c LEFT JOIN l ON c.k = l.k
"""


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 4-word shingles at a similarity of 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark), width=4)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, coalesce(least(s.doc_id, y), s.doc_id) AS component_id, s.doc_id = coalesce(least(s.doc_id, y), s.doc_id) AS kept FROM s LEFT JOIN c ON c.x = s.doc_id
"""


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents")
    return imatch.fingerprint_documents(docs, imatch.build_lexicon(docs))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every document's ids and decoded text."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES = (op1_quality_crf, op2_toxicity_mil, op3_suffix_dedup, op4_quality_rules, rule_counts, op5_packing, op6_license_scan, base_licenses, op7_url_filter, op8_minhash_neardup, op9_imatch, op10_bpe)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query functions by name."""
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL by query name, for those that SQL can express."""
    return {"op3_suffix_dedup": OP3_SQL, "rule_counts": RULE_COUNTS_SQL, "base_licenses": BASE_LICENSES_SQL, "op7_url_filter": OP7_SQL, "op8_minhash_neardup": OP8_SQL}
