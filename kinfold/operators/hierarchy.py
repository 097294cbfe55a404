"""Hierarchies of gene communities: event labels, orthogroups, ortholog pairs, common ancestors.

A node is a row (path array<int>, gene_ids array<string>, genome_ids array<string>, n_genes, n_genomes, event). The path
starts with the component and has a child number for each level; a node's parent has the path without its last element,
and the lowest common ancestor of two nodes has their longest common prefix. Nothing walks the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.scalars import common_prefix, genome_of, og_name
from kinfold.plans.tables import numbered

NODE = ["path", "gene_ids", "genome_ids", "n_genes", "n_genomes"]


def parent(path: str | Column = "path") -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.when(F.size(p) > 1, F.slice(p, F.lit(1), F.size(p) - 1))


def prefixes(path: str = "path", proper: bool = False) -> Column:
    """All ancestors' paths, the node's own last (left out if ``proper``)."""
    p = F.col(path)
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.slice(p, F.lit(1), n)), lambda q: (F.size(q) < F.size(p)) if proper else F.lit(True))


def attributes(members: DataFrame, *more: Column) -> DataFrame:
    """Nodes from (path, gene, genome) rows: sorted genes and genomes, and their counts; and ``more`` aggregates."""
    return members.groupBy("path").agg(
        F.array_sort(F.collect_list("gene")).alias("gene_ids"), F.array_sort(F.collect_set("genome")).alias("genome_ids"),
        F.count(F.lit(1)).cast("int").alias("n_genes"), F.size(F.collect_set("genome")).alias("n_genomes"), *more,
    )


def label_events(nodes: DataFrame, overlap: int = 0) -> DataFrame:
    """``nodes`` with ``event``: of an inner node by its children's genomes, of an isolated one by its own, of a leaf null."""
    children = nodes.select(parent().alias("_p"), F.struct("path", "genome_ids").alias("c")).filter("_p IS NOT NULL")
    children = children.groupBy("_p").agg(F.array_sort(F.collect_list("c")).alias("_c"))
    # Never broadcast: a row has the genomes of all children, far more than Spark guesses from the files.
    out = nodes.join(children.hint("merge"), nodes["path"] == children["_p"], "left").drop("_p")
    first, second = F.col("_c")[0]["genome_ids"], F.col("_c")[1]["genome_ids"]
    both = F.size(F.array_intersect(first, second))
    own = F.col("n_genomes")
    inner = (
        F.when(F.size("_c") > 2, "III-3").when(both == own, "II").when(both == 0, "I").when((both <= overlap) & (both < own), "I")
        .when((F.size(F.array_distinct(first)) == own) | (F.size(F.array_distinct(second)) == own), "III-1").otherwise("III-2")
    )
    alone = F.when((F.size("path") == 1) & (own == F.col("n_genes")), "I")
    return out.withColumn("event", F.when(F.size("_c") >= 2, inner).otherwise(F.when(F.col("_c").isNull(), alone))).drop("_c")


def orthogroups(nodes: DataFrame) -> DataFrame:
    """(path, genome_num, n_genomes, gene_num, gene_ids, top): groups of a labelled hierarchy.

    Topmost ``I`` nodes of more than one genome are groups. If exactly one sibling of such a node has no event, its genes
    join, and the parent names the group; of several nodes that would take the same sibling, the first does. Nodes
    without an event that are neither below a group nor taken are groups of one genome, as far as ``genome_num`` goes.
    ``top`` is the path of the ``I`` node.
    """
    chosen = nodes.filter("event = 'I' AND n_genomes > 1").select("path", "gene_ids", "genome_ids", "n_genomes")
    above = chosen.select(F.col("path").alias("a"))
    nested = chosen.select("path", F.explode(prefixes(proper=True)).alias("a")).join(above, "a").select("path").distinct()
    top = chosen.join(nested, "path", "left_anti").withColumn("_p", parent())
    silent = nodes.filter("event IS NULL").select(parent().alias("_p"), F.col("path").alias("s_path"), F.col("gene_ids").alias("s_genes"), F.col("genome_ids").alias("s_genomes")).filter("_p IS NOT NULL")
    lone = silent.groupBy("_p").agg(F.count(F.lit(1)).alias("k"), F.first("s_path").alias("s_path"), F.first("s_genes").alias("s_genes"), F.first("s_genomes").alias("s_genomes")).filter("k = 1").drop("k")
    winner = F.row_number().over(Window.partitionBy("_p").orderBy("path"))
    joined = top.join(lone, "_p", "left").withColumn("_win", F.when(F.col("s_path").isNotNull(), winner == 1))
    takes = F.coalesce("_win", F.lit(False))
    genes = F.when(takes, F.concat("gene_ids", "s_genes")).otherwise(F.col("gene_ids"))
    genomes = F.when(takes, F.array_union("genome_ids", "s_genomes")).otherwise(F.col("genome_ids"))
    main = joined.select(
        F.when(takes, F.col("_p")).otherwise(F.col("path")).alias("path"), F.col("n_genomes").alias("genome_num"), F.size(genomes).alias("n_genomes"),
        F.size(genes).alias("gene_num"), F.array_sort(F.array_distinct(genes)).alias("gene_ids"), F.col("path").alias("top"), F.when(takes, F.col("s_path")).alias("taken"),
    )
    taken = main.filter("taken IS NOT NULL").select(F.col("taken").alias("path"))
    tops = main.select(F.col("top").alias("a"))
    left = nodes.filter("event IS NULL").select("path", "gene_ids", "n_genomes")
    below = left.select("path", F.explode(prefixes()).alias("a")).join(tops, "a").select("path").distinct()
    rest = left.join(below.unionByName(taken).distinct(), "path", "left_anti")
    rest = rest.select("path", F.lit(1).alias("genome_num"), "n_genomes", F.size("gene_ids").alias("gene_num"), F.array_sort(F.array_distinct("gene_ids")).alias("gene_ids"), F.lit(None).cast("array<int>").alias("top"))
    return main.drop("taken").unionByName(rest)


def with_singletons(groups: DataFrame, genes: DataFrame) -> DataFrame:
    """``groups`` and one of genome number 0 for each of ``genes`` (gene): vertices without edges."""
    alone = genes.select(F.lit(None).cast("array<int>").alias("path"), F.lit(0).alias("genome_num"), F.lit(1).alias("n_genomes"), F.lit(1).alias("gene_num"), F.array("gene").alias("gene_ids"), F.lit(None).cast("array<int>").alias("top"))
    return groups.unionByName(alone)


def named_groups(groups: DataFrame) -> DataFrame:
    """``groups`` with ``og_id``, numbered by descending genome number, then path, then genes."""
    return numbered(groups, [F.desc("genome_num"), F.asc_nulls_last("path"), F.asc("gene_ids")], "_n").withColumn("og_id", og_name(F.col("_n"))).drop("_n")


def ortholog_pairs(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct (gene_a, gene_b) of different genomes within a group.

    Across leaves, a pair whose lowest common ancestor has event ``I``, the gene of the earlier leaf first: for each
    ``I`` node within a group, genes below one child with genes below a later one. Within a leaf of a group of several
    leaves, both orders.
    """
    inner = nodes.select(parent().alias("p")).filter("p IS NOT NULL").distinct()
    leaves = nodes.join(inner, nodes["path"] == inner["p"], "left_anti").select("path", "gene_ids")
    tops = groups.filter("top IS NOT NULL").select(F.col("top").alias("a"))
    under = leaves.select("path", "gene_ids", F.explode(prefixes()).alias("a")).join(tops, "a").filter("path <> a")
    events = nodes.filter("event = 'I'").select(F.col("path").alias("v"))
    reach = under.select("gene_ids", "path", F.explode(F.filter(prefixes(proper=True), lambda q: F.size(q) >= F.size("a"))).alias("v")).join(events, "v")
    genes = reach.select("v", F.element_at("path", F.size("v") + 1).alias("child"), F.explode("gene_ids").alias("gene"))
    x, y = genes.alias("x"), genes.alias("y")
    across = x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.child") < F.col("y.child")) & (genome_of(F.col("x.gene")) != genome_of(F.col("y.gene"))))
    across = across.select(F.col("x.gene").alias("gene_a"), F.col("y.gene").alias("gene_b"))
    absorbed = nodes.join(groups.filter("top IS NOT NULL AND path <> top").select(F.col("path").alias("gp"), "top"), parent(F.col("path")) == F.col("gp")).filter("event IS NULL AND path <> top").select("gene_ids")
    inside = under.select("gene_ids").unionByName(absorbed).filter("size(gene_ids) > 1")
    inside = inside.select(F.explode("gene_ids").alias("gene_a"), F.col("gene_ids").alias("g")).select("gene_a", F.explode("g").alias("gene_b")).filter(genome_of(F.col("gene_a")) != genome_of(F.col("gene_b")))
    return across.unionByName(inside).distinct()


def common_ancestors(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (gene_a, gene_b) with status, event, total, diff, ratio and the event counts on either way up.

    Only genes that are a leaf of their own are found; others are ``inseparable``. ``diff`` compares the genome numbers
    of the ancestor's first two children.
    """
    leaf = nodes.filter("n_genes = 1").select(F.col("gene_ids")[0].alias("gene"), "path")
    # A gene's chain of single-gene nodes, if any, ends in its leaf.
    leaf = leaf.groupBy("gene").agg(F.max_by("path", F.size("path")).alias("path"))
    p = pairs.join(leaf.select(F.col("gene").alias("gene_a"), F.col("path").alias("pa")), "gene_a", "left").join(leaf.select(F.col("gene").alias("gene_b"), F.col("path").alias("pb")), "gene_b", "left")
    p = p.withColumn("lca", common_prefix(F.col("pa"), F.col("pb")))
    kids = nodes.select(parent().alias("lca"), F.struct("path", "n_genomes").alias("c")).filter("lca IS NOT NULL").groupBy("lca").agg(F.array_sort(F.collect_list("c")).alias("c"))
    top = nodes.select(F.col("path").alias("lca"), "event", F.col("n_genomes").alias("total")).join(kids, "lca", "left")
    found = p.join(top, "lca", "left")
    status = F.when(F.col("pa").isNull() | F.col("pb").isNull(), "inseparable").when(F.size("lca") == 0, "not connected").otherwise("found")
    diff = F.abs(F.col("c")[0]["n_genomes"] - F.col("c")[1]["n_genomes"])
    found = found.select("gene_a", "gene_b", "pa", "pb", "lca", status.alias("status"), "event", "total", diff.alias("diff"), (diff / F.col("total")).alias("ratio"))

    def way(side: str) -> DataFrame:
        between = F.filter(prefixes(side, proper=True), lambda q: F.size(q) > F.size("lca"))
        steps = found.filter("status = 'found'").select("gene_a", "gene_b", F.explode(between).alias("path")).join(nodes.select("path", F.col("event").alias("e")), "path")
        counts = steps.groupBy("gene_a", "gene_b", F.coalesce("e", F.lit("None")).alias("e")).agg(F.count(F.lit(1)).alias("n"))
        order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "e")))
        return counts.groupBy("gene_a", "gene_b").agg(F.array_join(F.transform(order, lambda x: F.concat(x["e"], F.lit(":"), (-x["m"]).cast("string"))), " ").alias(f"way_{side}"))

    out = found
    for side in ("pa", "pb"):
        out = out.join(way(side), ["gene_a", "gene_b"], "left")
    text = lambda c: F.when(F.col("status") == "found", F.coalesce(c, F.lit("No Path")))
    return out.select("gene_a", "gene_b", "status", "event", "total", "diff", "ratio", text("way_pa").alias("way_a"), text("way_pb").alias("way_b"))


def subtree(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes at or below the largest common ancestor of all ``pairs``' leaves, component by component."""
    leaf = nodes.filter("n_genes = 1").select(F.col("gene_ids")[0].alias("gene"), "path")
    genes = pairs.select(F.explode(F.array("gene_a", "gene_b")).alias("gene")).distinct()
    # The longest common prefix of many paths is that of the least and the greatest.
    ends = leaf.join(genes, "gene").groupBy(F.col("path")[0].alias("component")).agg(F.min("path").alias("a"), F.max("path").alias("b"))
    tops = ends.select("component", common_prefix(F.col("a"), F.col("b")).alias("lca"))
    return nodes.join(tops, nodes["path"][0] == tops["component"]).filter("slice(path, 1, size(lca)) = lca").drop("component", "lca")


def stars(nodes: DataFrame) -> DataFrame:
    """(component, star, node path, depth) of each component's star: its root is the centre and is named by the component; nodes of one gene are left out."""
    from kinfold.functions.scalars import star_name

    return nodes.filter("size(path) > 1 AND n_genes <> 1").select(F.col("path")[0].alias("component"), star_name(F.col("path")[0]).alias("star"), "path", (F.size("path") - 1).alias("depth"), "n_genes", "n_genomes")


def core_genes(spokes: DataFrame, genomes: int, single: bool = True, most_depth: int = 200) -> DataFrame:
    """Core nodes of each star: all, or the shallowest alone where their depths sum to ``most_depth`` or more."""
    size = (F.col("n_genes") == genomes) if single else (F.col("n_genes") > genomes)
    found = spokes.filter((F.col("n_genomes") == genomes) & size)
    star = Window.partitionBy("component")
    found = found.withColumn("_s", F.sum("depth").over(star)).withColumn("_k", F.count(F.lit(1)).over(star)).withColumn("_r", F.row_number().over(star.orderBy("depth", "path")))
    return found.filter((F.col("_k") == 1) | (F.col("_s") < most_depth) | (F.col("_r") == 1)).select("component", "path", "depth", F.col("_k").alias("candidates"), F.col("_s").alias("depth_sum"))


def component_report(groups: DataFrame, genomes: int) -> DataFrame:
    """(component, groups, core, single, genes) of the groups of more than one gene: all, those with at least ``genomes`` genomes, and of these those with as many genes."""
    core, n = F.col("n_genomes") >= genomes, F.size("gene_ids")
    found = groups.filter(F.col("path").isNotNull() & (n > 1))
    return found.groupBy(F.col("path")[0].alias("component")).agg(F.count(F.lit(1)).alias("groups"), F.count_if(core).alias("core"), F.count_if(core & (n == genomes)).alias("single"), F.sum(n).alias("genes"))


def leaf_members(nodes: DataFrame) -> DataFrame:
    """(path, gene): each gene with its leaf; it is in all nodes above that as well."""
    inner = nodes.select(parent().alias("p")).filter("p IS NOT NULL").distinct()
    return nodes.join(inner, nodes["path"] == inner["p"], "left_anti").select("path", F.explode("gene_ids").alias("gene"))


def group_locations(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each group of more than one gene (og, gene), the node that shares most of it, then most of the node's; then the first path.

    (og, path, event, og_genomes, og_genes, node_genes, shared, of_group, of_node, child_genes); groups that share nothing
    have a null path. A gene meets its leaf alone; counts by group and leaf climb to the nodes above and are added up there.
    """
    own = groups.groupBy("og").agg(F.count_distinct("gene").alias("og_genes"), F.count_distinct(genome_of(F.col("gene"))).alias("og_genomes")).filter("og_genes > 1")
    at_leaves = groups.select("og", "gene").distinct().join(own.select("og"), "og", "left_semi").join(leaf_members(nodes), "gene").groupBy("og", "path").agg(F.count(F.lit(1)).alias("n"))
    climbed = at_leaves.select("og", F.explode(prefixes()).alias("path"), "n").groupBy("og", "path").agg(F.sum("n").alias("shared"))
    rank = F.struct((-F.col("shared")).alias("less"), F.col("n_genes").alias("node_genes"), "path")
    best = climbed.join(nodes.select("path", "n_genes"), "path").groupBy("og").agg(F.min(rank).alias("k")).select("og", F.col("k.path").alias("path"), (-F.col("k.less")).alias("shared"))
    kids = nodes.select(parent().alias("path"), "n_genes").filter("path IS NOT NULL").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_genes")), lambda x: x.cast("string")), " ").alias("child_genes"))
    place = nodes.select("path", "event", F.col("n_genes").alias("node_genes")).join(kids, "path", "left")
    out = own.join(best, "og", "left").join(place, "path", "left")
    return out.select("og", "path", "event", "og_genomes", "og_genes", "node_genes", "shared", (F.col("shared") / F.col("og_genes")).alias("of_group"), (F.col("shared") / F.col("node_genes")).alias("of_node"), F.coalesce("child_genes", F.lit("")).alias("child_genes"))


def inseparable_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst, ...) with both ends in one node of several genes and no event."""
    from kinfold.operators.evaluate import induced_edges

    return induced_edges(edges, nodes.filter("event IS NULL AND n_genes > 1").select(F.explode("gene_ids").alias("gene"), F.col("path").alias("community")))


def small_components(nodes: DataFrame, most_genes: int, nodes_above: int = 5, nodes_below: int = 1000) -> DataFrame:
    """(component, gene) of the leaves of components of a number of nodes strictly between the bounds and of at most ``most_genes`` genes."""
    inner = nodes.select(parent().alias("p")).filter("p IS NOT NULL").distinct()
    size = nodes.groupBy(F.col("path")[0].alias("component")).agg(F.count(F.lit(1)).alias("n"), F.max("n_genes").alias("g")).filter((F.col("n") > nodes_above) & (F.col("n") < nodes_below) & (F.col("g") <= most_genes))
    leaves = nodes.join(inner, nodes["path"] == inner["p"], "left_anti").select(F.col("path")[0].alias("component"), F.explode("gene_ids").alias("gene"))
    return leaves.join(size.select("component"), "component", "left_semi").distinct()
