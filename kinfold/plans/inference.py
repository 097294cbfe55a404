"""The inference run: genomes and search results to network, hierarchy, orthogroups and ortholog pairs.

Each stage is a Parquet table under the output folder; with ``resume``, stages whose table is complete are read, not run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import align, community, edges, hierarchy, score
from kinfold.plans.config import Config, parse
from kinfold.plans.tables import swept
from kinfold.sources import hits as hit_source
from kinfold.sources import gml, sequences, text_tables


def _complete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _coded() -> list[Column]:
    """The codes of an edge's genes."""
    code = lambda genome, gene: F.concat(F.lit("G"), F.col(genome), F.lit("|g"), F.col(gene))
    # Within a genome, source and destination may have been turned; both genomes are the same then.
    return [code("src_genome", "src").alias("src"), code("dst_genome", "dst").alias("dst")]


def run(spark: SparkSession, c: Config) -> dict[str, DataFrame]:
    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{c.output}/{name}"
        if not (c.resume and _complete(spark, path)):
            with swept(spark):
                make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    records = sequences.read_fasta(spark, c.genomes)
    recoded: list[DataFrame] = []

    def once(k: int) -> DataFrame:
        if not recoded:
            recoded.extend(sequences.recode(records))
        return recoded[k]

    def found() -> DataFrame:
        if c.hits is not None:
            return hit_source.read_outfmt6(spark, c.hits)[0]
        # A pair is found once in each direction, so there are no lines to choose from.
        return align.search(genes.select("gene_code", "seq"), c.evalue).select("*", F.lit("").alias("file"), F.lit(0).alias("line_no"))

    genomes, genes = stage("genomes", lambda: once(0)), stage("genes", lambda: once(1))
    hits = stage("hits", lambda: hit_source.genome_hits(found(), genes))
    nbs = stage("nbs", lambda: score.normalize(hits))
    network = stage("network", lambda: edges.network_edges(edges.retain(nbs, c.mode)))
    code = lambda genome, gene: F.concat(F.lit("G"), F.col(genome), F.lit("|g"), F.col(gene))
    coded = network.select(*_coded(), "nbs", "bs", "sim")
    nodes = stage("hierarchy", lambda: hierarchy.label_events(community.hierarchy(coded, c.weight, c.quality, c.coefficient, c.seed), c.overlap))
    alone = edges.singletons(genes.select(F.col("genome_id").alias("genome"), F.col("gene_idx").alias("gene")), network).select(code("genome", "gene").alias("gene"))
    groups = stage("groups", lambda: hierarchy.named_groups(hierarchy.with_singletons(hierarchy.orthogroups(nodes), alone)))
    pairs = stage("pairs", lambda: hierarchy.ortholog_pairs(nodes, groups))
    text_tables.write_groups(groups, f"{c.output}/groups_tsv", genes)
    if c.sequences:
        text_tables.write_group_sequences(groups, genes, f"{c.output}/group_sequences")
    if c.gml:
        named = genomes.select("genome_code", "file")
        graphs = {
            "ssn": gml.network_graph(network.select(*_coded(), "nbs", "nbs_rev", "bs", "bs_rev", "sim", "sim_rev"), genes),
            "hierarchy": gml.hierarchy_graph(nodes),
            "orthogroups": gml.final_graph(nodes, groups.filter("path IS NOT NULL"), genes.select("gene_code", "orig_id"), named),
        }
        for name, (vertices, links) in graphs.items():
            gml.write_gml(vertices, links, f"{c.output}/{name}_gml")
    text_tables.write_pairs(pairs, genes, f"{c.output}/pairs_tsv")
    return {"genomes": genomes, "genes": genes, "hits": hits, "nbs": nbs, "network": network, "hierarchy": nodes, "groups": groups, "pairs": pairs}


if __name__ == "__main__":
    run(SparkSession.builder.appName("kinfold").getOrCreate(), parse())
