"""Search results in the 12-column tabular format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.sources.text_tables import place_in_file

COLUMNS = ["query", "subject", "pident", "aln_len", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore"]
_KINDS = [T.StringType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), *[T.IntegerType()] * 4, T.DoubleType(), T.DoubleType()]


def read_outfmt6(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits with ``line_no`` and ``file``, lines that don't parse). A line that is END is a marker, neither."""
    return parsed(spark.read.text(path).select("value", place_in_file().alias("line_no"), F.col("_metadata.file_name").alias("file")))


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read_outfmt6`` of lines (value, line_no, file) that have been read."""
    raw = lines.filter(~F.trim("value").isin("END", ""))
    parts = F.split("value", "\t")
    typed = [F.get(parts, F.lit(i)).try_cast(k).alias(c) for i, (c, k) in enumerate(zip(COLUMNS, _KINDS))]
    rows = raw.select("file", "line_no", "value", *typed)
    good = F.col("query").isNotNull() & F.col("subject").isNotNull() & F.col("pident").isNotNull() & F.col("bitscore").isNotNull()
    return rows.filter(good).drop("value"), rows.filter(~good).select("file", "line_no", "value")


def genome_hits(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Hits between known genes, self hits left out, the last line of a repeated pair kept, with genomes and length product; of lines in one place the greatest score and identity.

    ``genes`` has (gene_code, genome_id, gene_idx, seq_len).
    """
    g = genes.select("gene_code", "genome_id", "gene_idx", "seq_len")
    last = Window.partitionBy("query", "subject").orderBy(F.desc("file"), F.desc("line_no"), F.desc("bitscore"), F.desc("pident"))
    kept = hits.filter("query <> subject").withColumn("_r", F.row_number().over(last)).filter("_r = 1")
    q = g.select(F.col("gene_code").alias("query"), F.col("genome_id").alias("q_genome"), F.col("gene_idx").alias("q"), F.col("seq_len").alias("q_len"))
    r = g.select(F.col("gene_code").alias("subject"), F.col("genome_id").alias("r_genome"), F.col("gene_idx").alias("r"), F.col("seq_len").alias("r_len"))
    return kept.join(q, "query").join(r, "subject").select("q_genome", "r_genome", "q", "r", F.col("pident").alias("identity"), "bitscore", (F.col("q_len").cast("long") * F.col("r_len")).alias("len_product"))
