"""Comparison and evaluation of groups and gene pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symmetric(pairs: DataFrame, a: str = "gene_a", b: str = "gene_b") -> DataFrame:
    """Distinct pairs in both directions."""
    return pairs.select(a, b).union(pairs.select(b, a)).distinct()


def same_group(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``pairs`` (gene_a, gene_b) with ``status``: SameOG, DiffOG, or NotFound; ``members`` has (og, gene)."""
    a = members.select(F.col("gene").alias("gene_a"), F.col("og").alias("og_a"))
    b = members.select(F.col("gene").alias("gene_b"), F.col("og").alias("og_b"))
    status = F.when(F.col("og_a").isNull() | F.col("og_b").isNull(), "NotFound").when(F.col("og_a") == F.col("og_b"), "SameOG").otherwise("DiffOG")
    return pairs.join(a, "gene_a", "left").join(b, "gene_b", "left").withColumn("status", status)


def recode(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """``pairs`` of original ids as gene codes; pairs with an unknown id go. ``ids`` has (orig_id, gene)."""
    a = ids.select(F.col("orig_id").alias("gene_a"), F.col("gene").alias("_a"))
    b = ids.select(F.col("orig_id").alias("gene_b"), F.col("gene").alias("_b"))
    rest = [c for c in pairs.columns if c not in ("gene_a", "gene_b")]
    return pairs.join(a, "gene_a").join(b, "gene_b").select(F.col("_a").alias("gene_a"), F.col("_b").alias("gene_b"), *rest)


def confusion(predicted: DataFrame, labelled: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, ppv, tpr of predicted pairs against labelled ones (gene_a, gene_b, label).

    Labels TP and FN are orthologs, FP and TN are not. Predicted pairs count if both genes are among the labelled; all
    pairs count in both directions. A rate without a base is null.
    """
    truth = labelled.select("gene_a", "gene_b", F.col("label").isin("TP", "FN").alias("ortholog"))
    truth = truth.union(truth.select("gene_b", "gene_a", "ortholog")).groupBy("gene_a", "gene_b").agg(F.max("ortholog").alias("pos"), F.min("ortholog").alias("all_pos"))
    genes = truth.select(F.col("gene_a").alias("g")).distinct()
    known = predicted.join(genes.withColumnRenamed("g", "gene_a"), "gene_a", "left_semi").join(genes.withColumnRenamed("g", "gene_b"), "gene_b", "left_semi")
    said = symmetric(known).withColumn("said", F.lit(True))
    both = truth.join(said, ["gene_a", "gene_b"], "left").withColumn("said", F.coalesce("said", F.lit(False)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    said_c, pos, neg = F.col("said"), F.col("pos"), ~F.col("all_pos")
    out = both.agg(n(said_c & pos).alias("tp"), n(said_c & neg).alias("fp"), n(~said_c & pos).alias("fn"), n(~said_c & neg).alias("tn"))
    return out.select("*", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("ppv"), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("tpr"))


def max_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left group the right one that shares most of its genes, then most of the right one's; then the least name.

    Groups are (og, gene) rows; groups that share none are left out. A hash join on genes takes the place of comparing all groups.
    """
    ls = left.groupBy("og").agg(F.count_distinct("gene").alias("l_size")).withColumnRenamed("og", "l_og")
    rs = right.groupBy("og").agg(F.count_distinct("gene").alias("r_size")).withColumnRenamed("og", "r_og")
    shared = left.select(F.col("og").alias("l_og"), "gene").distinct().join(right.select(F.col("og").alias("r_og"), "gene").distinct(), "gene").groupBy("l_og", "r_og").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.join(ls, "l_og").join(rs, "r_og")
    best = Window.partitionBy("l_og").orderBy(F.desc(F.col("shared") / F.col("l_size")), F.desc(F.col("shared") / F.col("r_size")), "r_og")
    return scored.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("l_og", "r_og", "shared", "l_size", "r_size")


def comparison_totals(overlaps: DataFrame) -> DataFrame:
    """Totals over left groups of more than one gene: correct, missing and erroneous genes, exact matches."""
    multi = overlaps.filter("l_size > 1")
    return multi.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("shared").alias("correct"), F.sum(F.col("l_size") - F.col("shared")).alias("missing"),
        F.sum(F.col("r_size") - F.col("shared")).alias("erroneous"), F.count_if((F.col("shared") == F.col("l_size")) & (F.col("shared") == F.col("r_size"))).alias("exact"),
    )


#: Positions of a group that meet at once, on either side: as many as Spark's join holds in memory for one key. Pairs of one task.
BLOCK, PAIRS_A_TASK = 4000, 20_000_000


def combinations(members: DataFrame, block: int = BLOCK, pairs_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """(og, gene_a, gene_b) for positions a < b within a group; ``members`` has (og, pos, gene), positions from 1 without gaps.

    Pairs grow with the square of a group's size, so blocks of its positions meet two by two, and tasks are as many as the pairs ask for.
    """
    n = F.count(F.lit(1)).cast("double")
    pairs = members.groupBy("og").agg((n * (n - 1) / 2).alias("n")).agg(F.sum("n")).first()[0] or 0
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // pairs_a_task) + 1)
    sizes = members.groupBy("og").agg(F.expr(f"(max(pos) - 1) div {block}").alias("last"))
    rows = members.join(sizes, "og").withColumn("own", F.expr(f"(pos - 1) div {block}"))
    ahead = rows.select("og", F.col("own").alias("i"), F.explode(F.sequence("own", "last")).alias("j"), "pos", "gene")
    behind = rows.select("og", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("own"))).alias("i"), F.col("own").alias("j"), "pos", "gene")
    x, y = (side.repartition(tasks, "og", "i", "j").alias(name) for side, name in ((ahead, "x"), (behind, "y")))
    same = (F.col("x.og") == F.col("y.og")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.pos") < F.col("y.pos"))
    return x.join(y.hint("merge"), same).select(F.col("x.og").alias("og"), F.col("x.gene").alias("gene_a"), F.col("y.gene").alias("gene_b"))


def top_values(pairs: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    """The ``n`` values that occur most on either side of pairs, ties by value."""
    both = pairs.select(F.explode(F.array(a, b)).alias("value"))
    return both.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def counts_up_to(rows: DataFrame, key: str, most: int = 10) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most)


def pair_filter(rows: DataFrame, label: str) -> DataFrame:
    """Rows (id1, id2, label, status, event, genome1, genome2) that are one group's, of event III-1, of a label and of two genomes."""
    return rows.filter((F.col("status") == "SameOG") & (F.col("event") == "III-1") & (F.col("label") == label) & (F.col("genome1") != F.col("genome2")))


def entropy(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Shannon entropy, base 2, of the labels in each group; a null label is a label."""
    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("p", p).groupBy(group).agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.sum("n").alias("n"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` hasn't."""
    return a.subtract(b)


def both_in(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """Pairs whose two genes are both in ``genes`` (gene)."""
    return pairs.join(genes.withColumnRenamed("gene", "gene_a"), "gene_a", "left_semi").join(genes.withColumnRenamed("gene", "gene_b"), "gene_b", "left_semi")


def component_intersections(groups: DataFrame, components: DataFrame) -> DataFrame:
    """(og, component, shared) of every group and component with a common gene."""
    return groups.join(components, "gene").groupBy("og", "component").agg(F.count_distinct("gene").alias("shared"))


def induced_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) with both ends in one community; ``members`` has (gene, community)."""
    s = members.select(F.col("gene").alias("src"), F.col("community"))
    d = members.select(F.col("gene").alias("dst"), F.col("community"))
    # Never broadcast: members come from arrays, whose lengths Spark doesn't know.
    return edges.join(s.hint("merge"), "src").join(d.hint("merge"), ["dst", "community"])


def leaf_categories(leaves: DataFrame, ids: DataFrame, categories: DataFrame) -> DataFrame:
    """(leaf, categories) for leaves (leaf, gene): distinct categories, sorted and joined by spaces, over gene -> COG -> category."""
    found = leaves.join(ids, "gene").join(categories, "cog")
    return found.groupBy("leaf").agg(F.array_join(F.array_sort(F.collect_set("category")), " ").alias("categories"))


def component_sizes(nodes: DataFrame, most: int) -> DataFrame:
    """(component, max_genes, n_nodes, leaf_genes) of components whose largest node has at most ``most`` genes."""
    leaf = F.when(F.col("is_leaf"), F.col("gene_ids"))
    out = nodes.groupBy(F.col("path")[0].alias("component")).agg(F.max("n_genes").alias("max_genes"), F.count(F.lit(1)).alias("n_nodes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(leaf)))).alias("leaf_genes"))
    return out.filter(F.col("max_genes") <= most)
