"""Score normalisation for each ordered pair of genomes.

Hits are rows (q_genome, r_genome, q, r, bitscore, len_product, ...). A pair's hits, sorted by length product, fall into
bins of a fixed number of rows; a bin takes in the first row of the next. Rows at or above their bin's 95th percentile fit
``log10(score) = A log10(len_product) + B``, and every hit's score is divided by the fitted one. A pair with one hit loses
it; where all lengths are equal, A is 0 and B the mean. Ranks and counts are worked out over ranges of rows, so a pair may
be larger than a task; windows are over bins alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.plans.tables import bucketed, in_ranges, with_ranks, written

PAIR = ["q_genome", "r_genome"]
#: Hits from which a pair is binned; rows of a bin beyond these numbers of hits.
LEAST_BINNED, WIDTHS, NARROW = 100, ((5000, 1000), (1000, 200)), 20
TOP = 0.95


def retained(hits: DataFrame) -> DataFrame:
    """Rows that enter the fit; the row shared by two bins may enter twice."""
    return _retained(in_ranges(hits.filter("bitscore <> 0").select(*PAIR, "q", "r", "len_product", "bitscore"), PAIR, ["len_product", "q", "r"], drop=("q", "r")))


def _retained(ranged: DataFrame) -> DataFrame:
    """``retained`` of hits in ranges of pair, length product and genes."""
    rows = with_ranks(ranged.select(*PAIR, "len_product", "bitscore", "_part", "_at"), PAIR).filter("n > 1")
    width = F.when(F.col("n") > WIDTHS[0][0], WIDTHS[0][1]).when(F.col("n") > WIDTHS[1][0], WIDTHS[1][1]).otherwise(NARROW)
    rows = rows.withColumn("w", width).withColumn("k", F.expr("rn div w"))
    edge = (F.col("rn") > 0) & (F.col("rn") % F.col("w") == 0)
    bins = F.when(F.col("n") < LEAST_BINNED, F.array(F.lit(-1).cast("bigint"))).when(edge, F.array("k", F.col("k") - 1)).otherwise(F.array("k"))
    rows = rows.withColumn("bin", F.explode(bins))
    cut = F.percentile("bitscore", F.lit(TOP)).over(Window.partitionBy(*PAIR, "bin"))
    return rows.withColumn("cut", cut).filter("bin = -1 OR bitscore >= cut").select(*PAIR, "len_product", "bitscore")


def coefficients(hits: DataFrame) -> DataFrame:
    return _fitted(retained(hits))


def _fitted(rows: DataFrame) -> DataFrame:
    y, x = F.log10("bitscore"), F.log10("len_product")
    flat = (F.min("len_product") == F.max("len_product")).alias("flat")
    fit = rows.groupBy(*PAIR).agg(flat, F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b"), F.avg(y).alias("m"))
    return fit.select(*PAIR, F.when(F.col("flat"), 0.0).otherwise(F.col("a")).alias("a"), F.when(F.col("flat"), F.col("m")).otherwise(F.col("b")).alias("b"))


def normalize(hits: DataFrame, buckets: int | None = None) -> DataFrame:
    """``hits`` with ``nbs``; pairs without a fit vanish. Hits that are dealt by query gene into ``buckets`` partitions stay there."""
    # Read three times: to find ranges, to sort, to be divided; after that, best hits are looked for by query gene, as the buckets are.
    hits = bucketed(hits.filter("bitscore <> 0"), "hits", ["q_genome", "q"], buckets)
    return _divided(hits, coefficients(hits))


def normalize_last(hits: DataFrame, genes: list[str], order: list[Column]) -> DataFrame:
    """``normalize`` of hits of which those of one pair and the same ``genes`` (columns, which fix the length product) are one, the first in ``order``.

    Hits go through one exchange, by length product as the fit wants them; repeated ones are in one range there. The result lies in ranges of pairs.
    """
    by = ["len_product", *genes]
    nth = F.row_number().over(Window.partitionBy(*PAIR, *by).orderBy(*order))
    ranged = in_ranges(hits, PAIR, by, within=lambda rows: rows.withColumn("_nth", nth).filter("_nth = 1 AND bitscore <> 0").drop("_nth"))
    return _divided(ranged.drop("_part", "_at"), _fitted(_retained(ranged)))


def _divided(hits: DataFrame, fit: DataFrame) -> DataFrame:
    fitted = F.pow(F.lit(10.0), F.col("b")) * F.pow(F.col("len_product").cast("double"), F.col("a"))
    # Written, so that Spark knows how small it is: the hits then stay where they are.
    return hits.join(written(fit, "coefficients"), PAIR).withColumn("nbs", F.col("bitscore") / fitted).drop("a", "b")
