"""Local alignment against a plain dynamic programme, and the search."""

import random

from kinfold.operators.align import Scoring, local_alignment, search


def plain_score(a, b, s):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (s.match if x == y else s.mismatch), h[i - 1][j] - s.gap, h[i][j - 1] - s.gap)
    return max(map(max, h))


def test_alignment():
    rng, s = random.Random(1), Scoring()
    for _ in range(60):
        a, b = ("".join(rng.choices("ACDE", k=rng.randint(1, 40))) for _ in range(2))
        got, want = local_alignment(a, b, s), plain_score(a, b, s)
        assert (got[0] if got else 0) == want
        if got:
            score, same, columns, openings, other, qs, qe, ss, se = got
            gaps = columns - same - other
            assert score == same * s.match + other * s.mismatch - gaps * s.gap and qe - qs + 1 + se - ss + 1 == 2 * columns - gaps and openings <= gaps
    assert local_alignment("", "A") is None and local_alignment("A", "C") is None


def test_search(spark):
    rng = random.Random(2)
    base = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=120)) for _ in range(4)]
    genes = [(f"G{g}|g{i}", s[:60] + "W" * g + s[60:]) for g in range(3) for i, s in enumerate(base)]
    got = {(r.query, r.subject): r for r in search(spark.createDataFrame(genes, "gene_code string, seq string")).collect()}
    assert got.keys() == {(f"G{a}|g{i}", f"G{b}|g{i}") for i in range(4) for a in range(3) for b in range(3) if a != b}
    r = got["G0|g0", "G2|g0"]
    assert r.aln_len == 122 and r.gapopen == 1 and (r.qstart, r.qend, r.sstart, r.send) == (1, 120, 1, 122) and r.evalue < 1e-5
