"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def after_pipe(c: Column) -> Column:
    """The token after the first ``|``: ``sp|P12345|NAME`` gives ``P12345``; an id without a pipe is itself."""
    return F.when(F.contains(c, F.lit("|")), F.split_part(c, F.lit("|"), F.lit(2))).otherwise(c)


def first_token(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def genome_of(gene_code: Column) -> Column:
    """``G0|g12`` gives ``G0``."""
    return F.split_part(gene_code, F.lit("|"), F.lit(1))


def og_name(n: Column) -> Column:
    return F.format_string("OG%06d", n)


def star_name(n: Column) -> Column:
    return F.format_string("CC%05d", n)


def as_percent(threshold: float) -> float:
    """Thresholds of at most 1 are fractions."""
    return threshold * 100 if threshold <= 1 else threshold


def resolution_gamma(n: Column, coefficient: float = 1.0) -> Column:
    """Initial resolution of a component of ``n`` genes: ``coefficient * 10^trunc(log10 n - 4) * 10 / n``."""
    whole = (F.log10(n.cast("double")) - 4).cast("int")  # toward 0
    return F.lit(float(coefficient)) * F.pow(F.lit(10.0), whole) * F.pow(F.lit(10.0), 1 - F.log10(n.cast("double")))


def pangenome_class(genomes: Column, genes: Column, total: Column) -> Column:
    ratio = genomes / total
    return (
        F.when(ratio < 0.15, "cloud").when(ratio < 0.95, "shell").when(ratio < 0.99, "soft core").when(ratio < 1, "core")
        .when(genomes == genes, "SOG").otherwise("HOG")
    )


def size_bucket(n: Column) -> Column:
    return F.when(n <= 2, "<=2").when(n <= 10, "<=10").when(n <= 50, "<=50").when(n <= 200, "<=200").otherwise(">200")


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two arrays."""
    shared = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"].eqNullSafe(p["b"]))
    first_other = F.array_position(shared, F.lit(False))
    n = F.when(first_other == 0, F.size(shared)).otherwise(first_other.cast("int") - 1)
    return F.slice(a, F.lit(1), n)


def earlier_date(a: Column, b: Column) -> Column:
    return F.to_date(a, "yyyy/MM/dd") < F.to_date(b, "yyyy/MM/dd")
