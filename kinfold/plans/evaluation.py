"""The evaluation run: labelled gene pairs and other groups against an inference run's hierarchy, groups and pairs.

    python -m kinfold.plans.evaluation --run DIR --labels FILE --output DIR [--external FILE] [--marker TreeFamA]

Labelled pairs are of original ids (the token after the pipe). Written under the output, Parquet and TSV each:

* ``events``: every labelled pair with its label, whether both genes are in one group, and the event at their lowest common
  ancestor with the imbalance of its first two children;
* ``path_events``: the events on either way up to it, counted;
* ``confusion``: right and wrong pairs of the run, precision and recall;
* ``by_event``: labelled pairs by label, group status and event;
* with ``--external``: ``overlaps``, the run's group that shares most of each external one, and ``totals`` of correct, missing
  and erroneous genes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.scalars import after_pipe
from kinfold.operators import evaluate, hierarchy
from kinfold.plans.config import parse
from kinfold.plans.tables import swept, written
from kinfold.sources import text_tables


@dataclass(frozen=True)
class EvaluationConfig:
    run: str = ""  # output folder of an inference run
    labels: str = ""  # labelled pairs
    output: str = ""
    external: str | None = None  # group file with lines ``name: gene gene ...``
    marker: str | None = None  # only lines of labels that contain it, as their first field


def run(spark: SparkSession, c: EvaluationConfig) -> dict[str, DataFrame]:
    nodes, groups, pairs, genes = (spark.read.parquet(f"{c.run}/{name}") for name in ("hierarchy", "groups", "pairs", "genes"))
    ids = genes.select(after_pipe(F.col("orig_id")).alias("orig_id"), F.col("gene_code").alias("gene")).groupBy("orig_id").agg(F.min("gene").alias("gene"))
    members = groups.select(F.col("og_id").alias("og"), F.explode("gene_ids").alias("gene"))
    out: dict[str, DataFrame] = {}

    def keep(name: str, made: DataFrame) -> DataFrame:
        made.write.mode("overwrite").parquet(f"{c.output}/{name}")
        out[name] = spark.read.parquet(f"{c.output}/{name}")
        text_tables.write_tsv(out[name], f"{c.output}/{name}_tsv")
        return out[name]

    with swept(spark):
        labelled = written(evaluate.recode(text_tables.read_labelled_pairs(spark, c.labels, c.marker), ids), "labelled")
        distinct = labelled.select("gene_a", "gene_b").distinct()
        status = evaluate.same_group(distinct, members).groupBy("gene_a", "gene_b").agg(F.min("status").alias("group_status"), F.min("og_a").alias("og_a"), F.min("og_b").alias("og_b"))
        above = written(hierarchy.common_ancestors(distinct, nodes), "ancestors")
        found = labelled.join(status, ["gene_a", "gene_b"]).join(above, ["gene_a", "gene_b"])
        events = keep("events", found.select("gene_a", "gene_b", "label", "group_status", "og_a", "og_b", "status", "event", "total", "diff", "ratio"))
        keep("path_events", found.select("gene_a", "gene_b", "label", "way_a", "way_b"))
        keep("confusion", evaluate.confusion(pairs, labelled))
        keep("by_event", events.groupBy("label", "group_status", "event").agg(F.count(F.lit(1)).alias("pairs")))
        if c.external:
            other = evaluate_external(text_tables.read_external_groups(spark, c.external), ids)
            best = keep("overlaps", evaluate.max_overlap(other, members))
            keep("totals", evaluate.comparison_totals(best))
    return out


def evaluate_external(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """External groups (og, gene) by gene codes; genes that the run doesn't have are kept under their own ids, so that they count as missing."""
    named = groups.select("og", after_pipe(F.col("gene")).alias("orig_id")).distinct()
    return named.join(ids, "orig_id", "left").select("og", F.coalesce("gene", "orig_id").alias("gene"))


if __name__ == "__main__":
    run(SparkSession.builder.appName("kinfold-evaluation").getOrCreate(), parse(cls=EvaluationConfig, description="Labelled pairs and other groups against an inference run."))
