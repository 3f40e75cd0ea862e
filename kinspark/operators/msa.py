"""Alignments of groups of orthologs, side by side for all taxa."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinspark.functions.align import centre_star
from kinspark.operators.sequences import concat_blocks


def align_blocks(members: DataFrame) -> DataFrame:
    """(block_id, taxon, aligned): a multiple alignment of each block.

    ``members``: (block_id, taxon, seq), one sequence of a taxon in a block, so a
    block has at most as many rows as there are taxa; different sequences of a
    taxon in a block are an error.
    """
    said = F.concat(F.lit("several sequences of taxon "), F.col("taxon").cast("string"), F.lit(" in block "), F.col("block_id").cast("string"))
    one = members.groupBy("block_id", "taxon").agg(F.min("seq").alias("seq"), F.max("seq").alias("other"))
    one = one.select("block_id", "taxon", F.when(F.col("seq") != F.col("other"), F.raise_error(said).cast("string")).otherwise(F.col("seq")).alias("seq"))

    def align(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("taxon")
        return pd.DataFrame({"block_id": rows["block_id"], "taxon": rows["taxon"], "aligned": centre_star(rows["seq"].tolist())})

    kind = members.schema["block_id"].dataType.simpleString()
    return one.groupBy("block_id").applyInPandas(align, f"block_id {kind}, taxon string, aligned string")


def concatenated_alignment(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(taxon, aligned) of reference genes and their reciprocal best hits.

    ``pairs``: (ref, taxon, gene) as from a search against a reference taxon;
    ``records``: (id, taxon, seq).
    """
    own = pairs.select(F.col("ref").alias("block_id"), F.col("ref").alias("id")).distinct()
    mates = pairs.select(F.col("ref").alias("block_id"), F.col("gene").alias("id"))
    members = own.unionByName(mates).join(records.select("id", "taxon", "seq"), "id").select("block_id", "taxon", "seq")
    return concat_blocks(align_blocks(members), records.select("taxon"))
