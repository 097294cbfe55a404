"""Graphs in GML: a reader that splits at element boundaries, and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.plans.tables import numbered, written

#: What would end a value, an element or a line, and how it is written in a value.
ESCAPED = [("&", "&amp;"), ('"', "&quot;"), ("]", "&#93;"), ("[", "&#91;"), ("\n", "&#10;")]


def _value(name: str, kind: T.DataType) -> Column:
    """An attribute of an element; ``None`` in quotes is null."""
    found = F.regexp_extract("value", rf'(?m)^\s*{name}\s+("([^"]*)"|\S+)', 1)
    bare = F.regexp_replace(found, '^"|"$', "")
    for mark, written in reversed(ESCAPED):
        bare = F.replace(bare, F.lit(written), F.lit(mark))
    bare = F.when((found == '"None"') | (found == ""), None).otherwise(bare)
    return bare.try_cast(kind).alias(name)


def read_gml(spark: SparkSession, path: str, vertex: dict[str, T.DataType], edge: dict[str, T.DataType]) -> tuple[DataFrame, DataFrame]:
    """(vertices (id and ``vertex`` attributes), edges (source, target and ``edge`` attributes)); elements are read by many tasks."""
    parts = spark.read.option("lineSep", "\n  ]").text(path)
    nodes = parts.filter(F.regexp_like("value", F.lit(r"(?s)\bnode\s*\[")))
    links = parts.filter(F.regexp_like("value", F.lit(r"(?s)\bedge\s*\[")))
    return (
        nodes.select(_value("id", T.LongType()), *[_value(n, k) for n, k in vertex.items()]),
        links.select(_value("source", T.LongType()), _value("target", T.LongType()), *[_value(n, k) for n, k in edge.items()]),
    )


def _element(kind: str, columns: list[tuple[str, str]]) -> Column:
    lines = [F.lit(f"  {kind}\n  [")]
    for name, of in columns:
        c = F.col(name)
        if of == "string":
            inner = F.coalesce(c, F.lit("None"))
            for mark, written in ESCAPED:
                inner = F.replace(inner, F.lit(mark), F.lit(written))
            text = F.concat(F.lit('"'), inner, F.lit('"'))
        else:
            text = F.coalesce(c.cast("string"), F.lit('"None"'))
        lines.append(F.concat(F.lit(f"    {name} "), text))
    return F.concat_ws("\n", *lines, F.lit("  ]"))


def write_gml(vertices: DataFrame, edges: DataFrame, path: str, directed: bool = False) -> None:
    """One folder of text parts: a head, vertices (with ``id``), edges (with ``source``, ``target``), a foot, in that order.

    Only the head and foot are single rows; parts keep the order of the union.
    """
    spark = vertices.sparkSession
    head = spark.createDataFrame([(f"graph\n[\n  directed {int(directed)}",)], "value string").coalesce(1)
    foot = spark.createDataFrame([("]",)], "value string").coalesce(1)
    v, e = vertices.select(_element("node", vertices.dtypes).alias("value")), edges.select(_element("edge", edges.dtypes).alias("value"))
    head.union(v).union(e).union(foot).write.mode("overwrite").text(path)


def relabelled(nodes: DataFrame, groups: DataFrame, genes: DataFrame, genomes: DataFrame) -> DataFrame:
    """Hierarchy nodes named by their group (else null), with original gene ids and genome file names.

    ``nodes`` has (path, gene_ids, genome_ids), ``groups`` (path, og_id), ``genes`` (gene_code, orig_id), ``genomes``
    (genome_code, file).
    """
    g = nodes.select("path", F.explode("gene_ids").alias("gene_code")).join(genes, "gene_code").groupBy("path").agg(F.array_sort(F.collect_list("orig_id")).alias("genes"))
    s = nodes.select("path", F.explode("genome_ids").alias("genome_code")).join(F.broadcast(genomes), "genome_code").groupBy("path").agg(F.array_sort(F.collect_list("file")).alias("genomes"))
    return nodes.drop("gene_ids", "genome_ids").join(groups.select("path", "og_id"), "path", "left").join(g, "path", "left").join(s, "path", "left")


def network_graph(network: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The similarity network's (vertices, edges) as ``write_gml`` takes them: all genes (gene_code), ``network`` (src, dst, nbs, nbs_rev, bs, bs_rev, sim, sim_rev) by gene codes. Vertices are numbered densely, in order of their names."""
    vertices = written(numbered(genes.select(F.col("gene_code").alias("name")), [F.asc("name")], "id").select("id", "name"), "vertices")
    a, b = vertices.select(F.col("id").alias("source"), F.col("name").alias("src")), vertices.select(F.col("id").alias("target"), F.col("name").alias("dst"))
    values = [F.col(c).alias(n) for c, n in (("nbs", "NBS"), ("nbs_rev", "NBSRev"), ("bs", "BS"), ("bs_rev", "BSRev"), ("sim", "Sim"), ("sim_rev", "SimRev"))]
    return vertices, network.join(a, "src").join(b, "dst").select("source", "target", *values)


def _tree(nodes: DataFrame, columns: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Numbered vertices of ``nodes`` (path, ...) in order of their paths, a parent before its children, and the edges from parents to children."""
    placed = written(numbered(nodes, [F.asc("path")], "id"), "vertices")
    up = placed.select(F.col("id").alias("target"), F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).filter("size(path) > 0")
    edges = up.join(placed.select(F.col("id").alias("source"), "path"), "path").select("source", "target")
    return placed.select("id", *columns), edges


def hierarchy_graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hierarchy's (vertices, edges): ``nodes`` has (path, gene_ids, genome_ids, n_genes, n_genomes, quality, event)."""
    name = F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("name")
    shown = [F.array_join("gene_ids", " ").alias("geneIDs"), F.array_join("genome_ids", " ").alias("genomeIDs"), F.col("n_genes").alias("genesNum"), F.col("n_genomes").alias("genomesNum"), F.col("quality").alias("modularity"), F.col("event").alias("Event")]
    return _tree(nodes, [name, *shown])


def final_graph(nodes: DataFrame, groups: DataFrame, genes: DataFrame, genomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hierarchy's (vertices, edges) with groups' names, original gene ids and file names, by ``relabelled``."""
    shown = [F.col("og_id").alias("name"), F.array_join("genes", " ").alias("geneIDs"), F.array_join("genomes", " ").alias("genomeIDs"), F.col("n_genes").alias("genesNum"), F.col("n_genomes").alias("genomesNum"), F.col("quality").alias("modularity"), F.col("event").alias("Event")]
    return _tree(relabelled(nodes, groups, genes, genomes), shown)
