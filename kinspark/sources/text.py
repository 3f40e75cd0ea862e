"""Readers and writers of the text formats between stages: sequences, hits, edges, groups, ontologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinspark.functions.scores import e_value_text, two_decimals

HIT_COLUMNS = "q string, s string, identity string, aln_len string, mismatch string, gap_open string, qst string, qed string, sst string, sed string, evalue string, bit string, qlen string, slen string"
_NUMBERS = {"identity": "double", "evalue": "double", "bit": "double"} | {c: "int" for c in ("aln_len", "mismatch", "gap_open", "qst", "qed", "sst", "sed", "qlen", "slen")}


def read_fasta(spark: SparkSession, path: str, separator: str = "|") -> DataFrame:
    """(path, header, id, taxon, seq, len) of FASTA files.

    Records are split where a line begins with ">", so files are read in parallel
    splits; residue lines are joined without white space.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    header = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    rows = rows.select("path", header.alias("header"), seq.alias("seq")).withColumn("id", F.substring_index("header", " ", 1))
    return rows.select("path", "header", "id", F.substring_index("id", separator, 1).alias("taxon"), "seq", F.length("seq").alias("len"))


def write_fasta(records: DataFrame, path: str, header: str = "id") -> None:
    """One ">header" line and one line of residues for each record."""
    records.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def read_hits(spark: SparkSession, path: str, separator: str = "|", check_ids: bool = True) -> DataFrame:
    """Hits of 12 columns or 14 and more; rows with a field that is no number are left out.

    An id without the separator is an error if ``check_ids``.
    """
    raw = spark.read.text(path).where(F.length("value") > 0).select(F.split("value", "\t").alias("f"))
    names = [c.split()[0] for c in HIT_COLUMNS.split(", ")]
    rows = raw.select(*[F.get("f", F.lit(k)).try_cast(_NUMBERS.get(c, "string")).alias(c) for k, c in enumerate(names)])
    needed = [c for c in names if c not in ("qlen", "slen")]
    rows = rows.na.drop(subset=needed)
    if check_ids:
        wrong = ~(F.contains("q", F.lit(separator)) & F.contains("s", F.lit(separator)))
        rows = rows.withColumn("q", F.when(wrong, F.raise_error(F.concat(F.lit("id without separator: "), "q", F.lit(" "), "s"))).otherwise(F.col("q")))
    return rows


def write_hits(hits: DataFrame, path: str) -> None:
    """Hits as tab-separated text: identity cut to two decimals, E-value in short form."""
    names = [c.split()[0] for c in HIT_COLUMNS.split(", ")]
    shown = {"identity": F.format_string("%.2f", two_decimals(F.col("identity"))), "evalue": e_value_text(F.col("evalue")), "bit": F.format_string("%.6f", F.col("bit").cast("double"))}
    hits.select(*[shown.get(c, F.col(c).cast("string")).alias(c) for c in names]).write.option("sep", "\t").option("quote", "\u0000").csv(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """All columns as tab-separated text."""
    rows.write.option("sep", "\t").option("quote", "\u0000").csv(path)


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """(rel, a, b, weight)."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return rows.select(F.get("f", F.lit(0)).alias("rel"), F.get("f", F.lit(1)).alias("a"), F.get("f", F.lit(2)).alias("b"), F.get("f", F.lit(3)).try_cast("double").alias("weight")).na.drop()


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) from the last three of three or four columns."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(F.slice(f, F.size(f) - 2, 3).alias("f"), F.size(f).alias("n")).where("n >= 3")
    return rows.select(F.get("f", F.lit(0)).alias("src"), F.get("f", F.lit(1)).alias("dst"), F.get("f", F.lit(2)).try_cast("double").alias("w")).na.drop()


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, gene): one group a line, named by its smallest gene."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.split(F.trim("value"), "\t").alias("m"))
    return rows.select(F.array_min("m").alias("group_id"), F.explode("m").alias("gene"))


def write_groups(grouped: DataFrame, path: str) -> None:
    """One tab-separated line of genes for each group."""
    lines = grouped.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("gene")), "\t").alias("value"))
    lines.select("value").write.text(path)


def group_label(number) -> object:
    """Label of a numbered group."""
    return F.format_string("group_%09d", number)


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, namespace, parents) of the [Term] stanzas that are not obsolete."""
    rows = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").rlike(r"^\[?Term\]"))
    rows = rows.where(~F.col("value").rlike(r"\nis_obsolete:\s*true"))

    def one(key: str):
        return F.regexp_extract("value", rf"\n{key}:\s*([^\r\n]*)", 1)

    parents = F.regexp_extract_all("value", F.lit(r"\nis_a:\s*([^\s!]+)"), F.lit(1))
    return rows.select(one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), parents.alias("parents"))


def ontology_edges(terms: DataFrame, root: str = "root") -> DataFrame:
    """(parent, child); terms without a parent hang under ``root``."""
    parents = F.when(F.size("parents") > 0, F.col("parents")).otherwise(F.array(F.lit(root)))
    return terms.select(F.explode(parents).alias("parent"), F.col("id").alias("child"))
