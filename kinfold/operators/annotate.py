"""Functional annotation by best hit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.scalars import as_percent


def covered(hits: DataFrame, identity: float = 40, coverage: float = 20) -> DataFrame:
    """Hits (query, subject, pident, qstart, qend, sstart, send, q_len, s_len, ...) at or above both thresholds (at most 1: fractions).

    Coverage is the lesser of aligned length (end - start, either way round) over sequence length, in per cent.
    """
    cov = F.least(F.try_divide(F.abs(F.col("qend") - F.col("qstart")), F.col("q_len")), F.try_divide(F.abs(F.col("send") - F.col("sstart")), F.col("s_len"))) * 100
    return hits.withColumn("coverage", cov).filter((F.col("pident") >= as_percent(identity)) & (F.col("coverage") >= as_percent(coverage)))


def best_annotation(hits: DataFrame, identity: float = 40, coverage: float = 20) -> DataFrame:
    """The covered hit of each query of highest identity, then least e-value, then highest bit score, then first subject."""
    best = Window.partitionBy("query").orderBy(F.desc("pident"), "evalue", F.desc("bitscore"), "subject")
    return covered(hits, identity, coverage).withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def unfinished(genomes: DataFrame, output_lines: DataFrame) -> DataFrame:
    """Genomes (genome) whose output (genome, line_no, line) doesn't end in a line that is END."""
    last = output_lines.groupBy("genome").agg(F.max_by("line", "line_no").alias("line")).filter(F.trim("line") == "END")
    return genomes.join(last, "genome", "left_anti")
