"""Best hits, reciprocal best hits, retained hits and the similarity network's edges, from normalised hits.

Rows are (q_genome, r_genome, q, r, nbs, bitscore, identity); genes are known by genome and gene. All windows and joins
are by query gene or by gene pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-3
#: Added to a gene's best score where it has no reciprocal best hit.
ABOVE_BEST = 1e-6


def _cross() -> Column:
    return F.col("q_genome") != F.col("r_genome")


def _forward() -> Column:
    """From the lower genome to the higher one; within a genome, from the lower gene."""
    return (F.col("q_genome") < F.col("r_genome")) | (~_cross() & (F.col("q") < F.col("r")))


def _pair() -> list[Column]:
    """The genes of a row, the forward end first, whichever way the row goes."""
    return [F.when(_forward(), F.col(a)).otherwise(F.col(b)) for a, b in (("q_genome", "r_genome"), ("q", "r"), ("r_genome", "q_genome"), ("r", "q"))]


def _is_best(tolerance: float) -> Column:
    # One exchange, by gene, serves both windows.
    there = F.max("nbs").over(Window.partitionBy("q_genome", "q", "r_genome"))
    best = F.coalesce(F.max(F.when(_cross(), F.col("nbs"))).over(Window.partitionBy("q_genome", "q")), F.lit(-1.0))
    return F.col("nbs") > F.when(_cross(), there).otherwise(best) - tolerance


def best_hits(nbs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Hits within ``tolerance`` of the best in each other genome; own-genome hits above the best of all others."""
    return nbs.withColumn("_best", _is_best(tolerance)).filter("_best").drop("_best")


def _transposed(hits: DataFrame, own: bool = False) -> DataFrame:
    """Cross-genome rows whose transpose is there as well, and all own-genome rows if ``own``.

    One exchange, by the unordered pair. A row's ends go through it in the pair's order with the row's way, and are turned back
    after it, so that none goes twice; own-genome rows stay where they are.
    """
    ends = ["_g", "_a", "_h", "_b"]
    rest = [c for c in hits.columns if c not in ("q_genome", "r_genome", "q", "r")]
    sided = hits.filter(_cross()).select(*[c.alias(n) for c, n in zip(_pair(), ends)], _forward().alias("_fwd"), *rest)
    pair = Window.partitionBy(*ends)
    both = sided.withColumn("_both", F.min("_fwd").over(pair) != F.max("_fwd").over(pair)).filter("_both")
    turned = {n: F.when(F.col("_fwd"), F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("q_genome", "_g", "_h"), ("r_genome", "_h", "_g"), ("q", "_a", "_b"), ("r", "_b", "_a"))}
    out = both.select(*[turned.get(c, F.col(c)) for c in hits.columns])
    return out.unionByName(hits.filter(~_cross())) if own else out


def reciprocal(hits: DataFrame) -> DataFrame:
    """Cross-genome rows whose transpose is there as well."""
    return _transposed(hits)


def retain(nbs: DataFrame, mode: str = "lrb", tolerance: float = TOLERANCE) -> DataFrame:
    """The hits that make edges: ``lrb`` at or above the gene's least reciprocal best hit, ``arb`` reciprocal best hits, ``ar`` reciprocal hits and all own-genome ones."""
    if mode == "ar":
        return _transposed(nbs, own=True)
    if mode not in ("arb", "lrb"):
        raise ValueError(f"no mode {mode}")
    # Of the best hits alone, a small part of all, both directions meet; the others stay where their gene is.
    both = reciprocal(best_hits(nbs, tolerance))
    if mode == "arb":
        return both
    gene = ["q_genome", "q"]
    best = F.coalesce(F.max(F.when(_cross(), F.col("nbs"))).over(Window.partitionBy(*gene)), F.lit(0.0))
    least = both.groupBy(*gene).agg(F.min("nbs").alias("_least"))
    kept = nbs.withColumn("_best", best).join(least, gene, "left").filter(F.col("nbs") >= F.coalesce("_least", F.col("_best") + ABOVE_BEST))
    return kept.select(*nbs.columns)


def network_edges(kept: DataFrame) -> DataFrame:
    """One row for each pair: forward from the lower genome (gene, within a genome); a pair that is there backwards only has its values as forward ones, and 0 as reverse."""
    vals, ends = ["nbs", "bitscore", "identity"], ["src_genome", "src", "dst_genome", "dst"]
    sided = kept.select(*[c.alias(n) for c, n in zip(_pair(), ends)], _forward().alias("_fwd"), *vals)
    sides = [F.max(F.when(on, F.col(v))).alias(f"{side}_{v}") for side, on in (("f", F.col("_fwd")), ("r", ~F.col("_fwd"))) for v in vals]
    both = sided.groupBy(*ends).agg(F.max(F.when(F.col("_fwd"), F.lit(True))).alias("_has"), *sides)
    back_only = F.col("_has").isNull()
    # Within a genome, the row seen first is the source: the higher gene's, if only that one has the hit.
    turn = back_only & (F.col("src_genome") == F.col("dst_genome"))
    out = [F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst")]
    for v, name in zip(vals, ["nbs", "bs", "sim"]):
        out.append(F.when(back_only, F.col(f"r_{v}")).otherwise(F.col(f"f_{v}")).alias(name))
        out.append(F.when(back_only, F.lit(0.0)).otherwise(F.coalesce(F.col(f"r_{v}").cast("double"), F.lit(0.0))).alias(f"{name}_rev"))
    return both.select("src_genome", "dst_genome", *out)


def singletons(genes: DataFrame, edges: DataFrame) -> DataFrame:
    """Genes (genome, gene) without an edge."""
    ends = edges.select(F.col("src_genome").alias("genome"), F.col("src").alias("gene")).unionByName(edges.select(F.col("dst_genome").alias("genome"), F.col("dst").alias("gene")))
    return genes.join(ends, ["genome", "gene"], "left_anti")
