"""Operations on sequence records (ordinal, id, taxon, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinspark.scratch import Scratch

JOINER = ";;;"


def add_ordinals(records: DataFrame, scratch: Scratch, order: list[str]) -> DataFrame:
    """A dense ordinal from 0 in the given order.

    Partitions are sorted ranges; their sizes, one number for each, give the
    first ordinal of a partition, so no task holds more than its range.
    """
    ranged = records.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = scratch.keep(ranged, "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(first.drop("_n")), "_part").withColumn("ordinal", (F.col("_first") + row - 1).cast("bigint")).drop("_part", "_first")


def slice_ordinals(records: DataFrame, lower: int = -1, upper: int = -1) -> DataFrame:
    """Records with an ordinal from ``lower`` up to, not including, ``upper``; -1 is no bound."""
    if lower >= 0:
        records = records.where(F.col("ordinal") >= lower)
    return records.where(F.col("ordinal") < upper) if upper >= 0 else records


def by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose id is listed."""
    return records.join(ids.select("id").distinct(), "id", "left_semi")


def dedupe(records: DataFrame) -> DataFrame:
    """(id, seq): one record for each sequence, its ids joined in order."""
    return records.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_list("id")), JOINER).alias("id")).select("id", "seq")


def memberships(records: DataFrame) -> DataFrame:
    """(id, first): for every record the smallest id with its sequence.

    The form to use where very many records share a sequence: no row grows.
    """
    first = records.groupBy("seq").agg(F.min("id").alias("first"))
    return records.select("id", "seq").join(first, "seq").select("id", "first")


def representatives(records: DataFrame) -> DataFrame:
    """(id, seq): one record for each sequence, the one with the smallest id."""
    return records.groupBy("seq").agg(F.min("id").alias("id")).select("id", "seq")


def expand_members(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Hits between representatives as hits between all records; other columns as they are."""
    rest = [c for c in hits.columns if c not in ("q", "s")]
    left, right = members.select(F.col("first").alias("q"), F.col("id").alias("_q")), members.select(F.col("first").alias("s"), F.col("id").alias("_s"))
    return hits.join(left, "q").join(right, "s").select(F.col("_q").alias("q"), F.col("_s").alias("s"), *rest)


def expand_hits(hits: DataFrame) -> DataFrame:
    """Hits between joined ids as hits between all their single ids; other columns as they are."""
    rest = [c for c in hits.columns if c not in ("q", "s")]
    rows = hits.select(F.explode(F.split("q", JOINER)).alias("q"), "s", *rest)
    return rows.select("q", F.explode(F.split("s", JOINER)).alias("s"), *rest)


def label_by_file(records: DataFrame, column: str = "path") -> DataFrame:
    """Ids prefixed with the ordinal of their file, files in order of their path."""
    files = records.select(column).distinct()
    ranked = files.withColumn("_k", F.row_number().over(Window.orderBy(column)))  # one row for each file
    return records.join(ranked, column).withColumn("id", F.concat_ws("|", (F.col("_k") - 1).cast("string"), F.col("id"))).drop("_k")


def add_prefix(header: Column, path: Column, pattern: str) -> Column:
    """A header with the part of a path that ``pattern`` captures in front."""
    return F.concat_ws("|", F.regexp_extract(path, pattern, 1), header)


def concat_blocks(blocks: DataFrame, taxa: DataFrame) -> DataFrame:
    """(taxon, aligned): the blocks of each taxon side by side, gaps where it has none.

    ``blocks``: (block_id, taxon, aligned), equally long within a block.  The
    result has one row for each taxon, as wide as the alignment; that is the
    size of what is asked for.
    """
    sizes = blocks.groupBy("block_id").agg(F.max(F.length("aligned")).alias("size"))
    own = blocks.groupBy("block_id", "taxon").agg(F.min("aligned").alias("aligned"))
    grid = sizes.join(taxa.select("taxon").distinct())
    filled = grid.join(own, ["block_id", "taxon"], "left").select("taxon", "block_id", F.coalesce("aligned", F.expr("repeat('-', size)")).alias("aligned"))
    rows = filled.groupBy("taxon").agg(F.array_sort(F.collect_list(F.struct("block_id", "aligned"))).alias("rows"))
    return rows.select("taxon", F.array_join(F.transform("rows", lambda r: r["aligned"]), "").alias("aligned"))
