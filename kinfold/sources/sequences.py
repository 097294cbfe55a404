"""Protein FASTA files as tables: genomes, genes and recoded names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.scalars import first_token
from kinfold.sources.text_tables import place_in_file

PIPELINE_EXTENSIONS = ("fa", "faa", "fas", "fasta")
ANNOTATION_EXTENSIONS = ("faa", "fna", "fasta", "fas")


def read_fasta(spark: SparkSession, path: str, extensions: tuple[str, ...] = PIPELINE_EXTENSIONS) -> DataFrame:
    """(file, pos, header, seq) of every record of the files under ``path``; ``pos`` orders a file's records.

    Records are split by Spark's text reader at lines that begin with ``>``, so a large file is read by many tasks and a
    ``>`` within a header is part of it; ``pos`` is where a record's split begins and its place in that.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    raw = spark.read.option("lineSep", "\n>").option("pathGlobFilter", glob).text(path)
    raw = raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), place_in_file().alias("pos"), F.regexp_replace("value", r"\A\s*>", "").alias("value"))
    body = F.split("value", "\n", 2)
    header = F.trim(F.regexp_replace(body[0], "\r", ""))
    seq = F.regexp_replace(F.coalesce(F.get(body, F.lit(1)), F.lit("")), r"\s", "")
    return raw.filter(F.length(F.trim("value")) > 0).select("file", "pos", header.alias("header"), seq.alias("seq"))


def last_of_header(records: DataFrame) -> DataFrame:
    """One record of each header, the last."""
    return records.groupBy("header").agg(F.max_by("seq", F.struct("file", "pos")).alias("seq"))


def recode(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genomes, genes): genomes (genome_id, genome_code, file, n_genes) in order of file names; genes (genome_id, gene_idx, gene_code, orig_id, seq_len, seq)."""
    from pyspark.sql import Window

    files = records.groupBy("file").agg(F.count(F.lit(1)).alias("n_genes"))
    order = Window.orderBy("file")  # a row for each genome file
    genomes = files.withColumn("genome_id", (F.row_number().over(order) - 1).cast("int")).withColumn("genome_code", F.concat(F.lit("G"), "genome_id")).select("genome_id", "genome_code", "file", "n_genes")
    place = (F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1).cast("int")
    genes = records.withColumn("gene_idx", place).join(F.broadcast(genomes.select("file", "genome_id", "genome_code")), "file")
    genes = genes.select("genome_id", "gene_idx", F.concat("genome_code", F.lit("|g"), F.col("gene_idx")).alias("gene_code"), first_token(F.col("header")).alias("orig_id"), F.length("seq").alias("seq_len"), "seq")
    return genomes, genes


def recode_reference(records: DataFrame) -> DataFrame:
    """Reference records (orig_id, seq) with ids ``<header>_<file name without extension>``."""
    return records.select(F.concat_ws("_", first_token(F.col("header")), F.regexp_replace("file", r"\.[^.]*$", "")).alias("orig_id"), "seq")


def write_fasta(records: DataFrame, path: str, by: str | None = None) -> None:
    """``records`` (header, seq and maybe ``by``) as FASTA text, in a folder for each value of ``by`` if given."""
    lines = records.select(F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value"), *([by] if by else []))
    out = lines.write.mode("overwrite")
    (out.partitionBy(by) if by else out).text(path)
