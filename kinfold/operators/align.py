"""An optional search of genomes against each other: shared k-mers give candidates, Smith-Waterman their best local alignment.

The result has the columns of tabular search output, so it can take the place of an outside tool's on small data. Scores
are per residue (a match, a mismatch, a gap position); bit scores and e-values follow from the parameters ``lam`` and ``k``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "query string, subject string, pident double, aln_len int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"


@dataclass(frozen=True)
class Scoring:
    match: int = 5
    mismatch: int = -3
    gap: int = 6
    lam: float = 0.25
    k: float = 0.1


def local_alignment(a: str, b: str, s: Scoring = Scoring()) -> tuple[int, int, int, int, int, int, int, int, int] | None:
    """(score, identities, columns, gap openings, mismatches, start and end in a, start and end in b; from 1), or None without any match."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    if not len(x) or not len(y):
        return None
    h = np.zeros((len(x) + 1, len(y) + 1), np.int64)
    ramp = s.gap * np.arange(len(y) + 1)
    for i in range(1, len(x) + 1):
        row = np.zeros(len(y) + 1, np.int64)
        row[1:] = np.maximum(np.maximum(h[i - 1, :-1] + np.where(y == x[i - 1], s.match, s.mismatch), h[i - 1, 1:] - s.gap), 0)
        h[i] = np.maximum.accumulate(row + ramp) - ramp  # gaps along the row
    i, j = (int(v) for v in np.unravel_index(h.argmax(), h.shape))
    score, end_a, end_b = int(h[i, j]), i, j
    if score <= 0:
        return None
    same = columns = openings = other = 0
    last = ""
    while h[i, j] > 0:
        if i and j and h[i, j] == h[i - 1, j - 1] + (s.match if x[i - 1] == y[j - 1] else s.mismatch):
            same, other, step = same + int(x[i - 1] == y[j - 1]), other + int(x[i - 1] != y[j - 1]), "d"
            i, j = i - 1, j - 1
        elif i and h[i, j] == h[i - 1, j] - s.gap:
            step, i = "u", i - 1
        else:
            step, j = "l", j - 1
        openings += step != "d" and step != last
        columns, last = columns + 1, step
    return score, same, columns, openings, other, i + 1, end_a, j + 1, end_b


def candidates(genes: DataFrame, k: int = 5, least_shared: int = 3) -> DataFrame:
    """(query, subject) of different genes with at least ``least_shared`` distinct k-mers in common; ``genes`` has (gene_code, seq)."""
    words = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.substr("seq", i, F.lit(k))))
    mers = genes.filter(F.length("seq") >= k).select("gene_code", F.explode(words).alias("w"))
    a, b = mers.select(F.col("gene_code").alias("query"), "w"), mers.select(F.col("gene_code").alias("subject"), "w")
    shared = a.join(b, "w").filter("query < subject").groupBy("query", "subject").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_shared)
    return shared.select("query", "subject").unionByName(shared.select(F.col("subject").alias("query"), F.col("query").alias("subject")))


def search(genes: DataFrame, evalue: float = 1e-5, k: int = 5, least_shared: int = 3, scoring: Scoring = Scoring()) -> DataFrame:
    """Hits of all genes (gene_code, seq) on each other, both ways, up to ``evalue`` against the total length of all."""
    total = genes.agg(F.sum(F.length("seq"))).first()[0] or 0
    pairs = candidates(genes, k, least_shared)
    sided = pairs.join(genes.select(F.col("gene_code").alias("query"), F.col("seq").alias("q")), "query").join(genes.select(F.col("gene_code").alias("subject"), F.col("seq").alias("s")), "subject").select("query", "subject", "q", "s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for query, subject, q, s in pdf.itertuples(index=False):
                got = local_alignment(q, s, scoring)
                if got is None:
                    continue
                score, same, columns, openings, other, qs, qe, ss, se = got
                e = scoring.k * len(q) * total * math.exp(-scoring.lam * score)
                if e <= evalue:
                    rows.append((query, subject, 100.0 * same / columns, columns, other, openings, qs, qe, ss, se, e, (scoring.lam * score - math.log(scoring.k)) / math.log(2)))
            yield pd.DataFrame(rows, columns=names)

    return sided.mapInPandas(run, SCHEMA)
