"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept, as Parquet, and returns
those that it keeps with all their columns, whatever their names; the last one
returns the places of their pieces instead.

Defined cases, beside those of the operators: the quality rules drop null and
empty texts (no words); rows with a null id stay in every stage; rows that repeat
an id are judged each by its own text; of equal rows one stays after the removal
of near-duplicates; texts of any length that fits in a row are read whole; an
empty table gives an empty table; without labels nothing is predicted toxic and
only the hard limits reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinspark.llm import mil, neardup, packing, queries, rules, samples, suffixes
from kinspark.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the hard limits and are no anomalies."""
    return rules.keep_clean(docs, rules.fit(docs, queries.table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    usable = F.coalesce(samples.remainder("doc_id", 5) != 0, F.lit(False))
    return mil.keep_harmless(docs, mil.fit(docs, queries.table(spark, sf_dir, "labels"), usable))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_first(docs, Scratch(spark))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that occur twice."""
    return suffixes.strip_repeats(docs, Scratch(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 1024 tokens."""
    cut = packing.pieces(docs, queries.tokenizer("byte_bpe_50k.json"))
    return packing.pack(cut, Scratch(spark))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: Trained models, tokenizers and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last."""
    kept = Scratch(spark)
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
