"""Bounded training samples of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(divisor)


def _order() -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit(17))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_bytes: int, corpus: int = 0) -> pd.DataFrame:
    """At most ``per_class`` labelled texts of each class, chosen by a hash of the id: doc_id, text, _y.

    ``usable`` says which ids may be learnt from.  Texts are whole, whatever
    their length; a class ends with the text that brings it to half of
    ``max_bytes``.  Of contradicting labels of an id the smallest counts, of rows
    that repeat an id the smallest text.  With ``corpus``, as many documents are
    chosen from all of them too, whether labelled or not; _corpus marks them, and
    _y is null for those without a label in the sample.  Only the ids, which are
    bounded, are broadcast.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & usable)
    drawn = [marked.where(F.col("_y") == value).orderBy(_order(), "doc_id").limit(per_class).select("doc_id", "_y", F.lit(0).alias("_corpus")) for value in (0, 1)]
    if corpus:
        drawn.append(docs.select("doc_id").where("doc_id is not null").orderBy(_order(), "doc_id").limit(corpus).select("doc_id", F.lit(None).cast("int").alias("_y"), F.lit(1).alias("_corpus")))
    ids = drawn[0]
    for more in drawn[1:]:
        ids = ids.unionAll(more)
    ids = ids.groupBy("doc_id").agg(F.min("_y").alias("_y"), F.max("_corpus").alias("_corpus"))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    picked = texts.groupBy("doc_id", "_y", "_corpus").agg(F.min("text").alias("text"))
    before = Window.partitionBy("_y").orderBy(_order(), "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # a bounded number of rows
    sized = picked.withColumn("_before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("_before") < max_bytes // 2)
    return sized.select("doc_id", "_y", F.expr("_corpus = 1").alias("_corpus"), "text").toPandas().sort_values("doc_id").reset_index(drop=True)
