"""The annotation run: genomes, reference families and search results to one family for each gene.

The search itself is done by an outside tool. Without ``hits`` the run writes what that tool needs: the reference
records under their recoded ids, and the genomes that have no complete result yet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.scalars import first_token
from kinfold.operators import annotate
from kinfold.plans.config import parse
from kinfold.sources import hits as hit_source
from kinfold.sources import sequences, text_tables

REFERENCE_EXTENSIONS = tuple(sorted({*sequences.PIPELINE_EXTENSIONS, *sequences.ANNOTATION_EXTENSIONS}))


@dataclass(frozen=True)
class AnnotationConfig:
    genomes: str = ""  # folder of FASTA files
    reference: str = ""  # folder of FASTA files, one for each family and named by it
    output: str = ""
    hits: str | None = None  # folder of tabular search results of genes on the recoded reference, <genome file>.out
    evalue: float = 0.001
    identity: float = 40
    coverage: float = 20


def unfinished(spark: SparkSession, genomes: DataFrame, hits: str | None) -> DataFrame:
    """``genomes`` (genome) without a result that ends in an END marker; all of them without results."""
    if hits is None:
        return genomes
    lines = spark.read.text(hits).filter(F.trim("value") != "")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.out.*$", "")
    return annotate.unfinished(genomes, lines.select(name.alias("genome"), text_tables.place_in_file().alias("line_no"), F.col("value").alias("line")))


def annotations(hits: DataFrame, genes: DataFrame, reference: DataFrame, c: AnnotationConfig) -> DataFrame:
    """The 12 columns of each gene's best hit, and ``family``: what follows the last ``_`` of the subject.

    ``genes`` and ``reference`` have (orig_id, seq); of records with one id the longest counts. Hits of unknown ids,
    above the e-value or below the thresholds give none.
    """
    lengths = lambda t, key, n: t.groupBy(F.col("orig_id").alias(key)).agg(F.max(F.length("seq")).alias(n))
    known = hits.filter(F.col("evalue") <= c.evalue).join(lengths(genes, "query", "q_len"), "query").join(lengths(reference, "subject", "s_len"), "subject")
    best = annotate.best_annotation(known, c.identity, c.coverage)
    return best.select(*hit_source.COLUMNS, F.substring_index("subject", "_", -1).alias("family"))


def run(spark: SparkSession, c: AnnotationConfig) -> dict[str, DataFrame]:
    records = sequences.read_fasta(spark, c.genomes, sequences.ANNOTATION_EXTENSIONS)
    reference = sequences.recode_reference(sequences.read_fasta(spark, c.reference, REFERENCE_EXTENSIONS))
    missing = unfinished(spark, records.select(F.col("file").alias("genome")).distinct(), c.hits)
    text_tables.write_tsv(missing, f"{c.output}/unfinished")
    out = {"unfinished": missing, "reference": reference}
    if c.hits is None:
        sequences.write_fasta(reference.select(F.col("orig_id").alias("header"), "seq"), f"{c.output}/reference")
        return out
    genes = records.select(first_token(F.col("header")).alias("orig_id"), "seq")
    annotations(hit_source.read_outfmt6(spark, c.hits)[0], genes, reference, c).write.mode("overwrite").parquet(f"{c.output}/annotations")
    out["annotations"] = spark.read.parquet(f"{c.output}/annotations")
    text_tables.write_tsv(out["annotations"], f"{c.output}/annotations_tsv")
    return out


if __name__ == "__main__":
    run(SparkSession.builder.appName("kinfold-annotation").getOrCreate(), parse(cls=AnnotationConfig, description="A reference family for each gene, by best hit."))
