"""Components of a hierarchy as stars of their groups, with annotations, and their statistics.

A star's centre stands for the component's root and is named by the component; its spokes are the nodes below the root that
are groups of several genes. A component of one node is that node alone, without a centre. Attributes come from the groups'
annotations and are ``None`` where a group has none, as a centre's are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalars import size_bucket, star_name

ATTRIBUTES = ["cog_id", "cog_c", "genes", "pathway"]
#: Stars of at most this many nodes count as unlinked.
UNLINKED = 2


def star_nodes(nodes: DataFrame, groups: DataFrame, annotations: DataFrame) -> DataFrame:
    """(component, star, name, path, depth, n_genes, n_genomes, cog_id, cog_c, genes, pathway): a row for each centre (depth 0) and spoke.

    ``groups`` has (path, og_id), ``annotations`` (og, cog_id, cog_c, genes, pathway); of several of one group the least holds.
    """
    of = groups.filter("path IS NOT NULL").groupBy("path").agg(F.min("og_id").alias("og"))
    said = annotations.groupBy("og").agg(F.min(F.struct(*ATTRIBUTES)).alias("_a")).select("og", *[F.col("_a")[a].alias(a) for a in ATTRIBUTES])
    component = F.col("path")[0]
    root = F.size("path") == 1
    own = nodes.select("path", "n_genes", "n_genomes").join(of, "path", "left").withColumn("component", component)
    inner = own.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    rows = own.join(inner, "component").withColumn("_centre", root & (F.col("_n") > 1))
    rows = rows.filter(F.col("_centre") | ((F.col("n_genes") > 1) & F.when(root, F.lit(True)).otherwise(F.col("og").isNotNull())))
    star = star_name(F.col("component"))
    rows = rows.withColumn("og", F.when(~F.col("_centre"), F.col("og"))).join(said, "og", "left")
    name = F.when(F.col("_centre"), star).otherwise(F.coalesce("og", F.lit("None")))
    return rows.select("component", star.alias("star"), name.alias("name"), "path", (F.size("path") - 1).alias("depth"), "n_genes", "n_genomes", *[F.coalesce(a, F.lit("None")).alias(a) for a in ATTRIBUTES])


def star_statistics(rows: DataFrame) -> DataFrame:
    """(level, linked, size_class, star, nodes, genes, annotated, categories, entropy) of ``star_nodes``: of each star, of each size class of linked or unlinked ones, of either, and of all.

    ``annotated`` counts nodes with a category, ``categories`` the different ones without ``None``; ``entropy`` is Shannon's, base 2, over all
    nodes' categories, ``None`` among them. One pass over categories' counts gives all levels; a star's size is an aggregate that is joined.
    """
    size = rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    keys = ["linked", "size_class", "star"]
    each = rows.join(size, "component").select((F.col("_n") > UNLINKED).alias("linked"), size_bucket(F.col("_n")).alias("size_class"), "star", "cog_c", "n_genes")
    sets = [[F.col(c) for c in (*keys[:k], "cog_c")] for k in range(3, -1, -1)]
    counts = each.groupingSets(sets, *[F.col(c) for c in (*keys, "cog_c")]).agg(F.count(F.lit(1)).alias("n"), F.sum("n_genes").alias("g"), F.grouping_id().alias("_level"))
    level = F.when(F.col("_level") == 0, "star").when(F.col("_level") == 2, "size_class").when(F.col("_level") == 6, "linked").otherwise("all")
    known = F.col("cog_c") != "None"
    total = F.sum("n")
    mixed = F.when(F.count(F.lit(1)) == 1, F.lit(0.0)).otherwise(F.log2(total.cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / total)
    return counts.groupBy(level.alias("level"), *keys).agg(total.alias("nodes"), F.sum("g").alias("genes"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("annotated"), F.count_if(known).alias("categories"), mixed.alias("entropy"))


def radiation(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((name, linked, size_class, ... of every node), (star, name, rooted_distance) of every spoke): the star graph's vertices and edges."""
    size = rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    vertices = rows.join(size, "component").select("name", "star", "n_genomes", "n_genes", *ATTRIBUTES, (F.col("_n") > UNLINKED).alias("linked"), size_bucket(F.col("_n")).alias("size_class"))
    return vertices, rows.filter("depth > 0").select("star", "name", F.col("depth").alias("rooted_distance"))
