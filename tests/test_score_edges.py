"""Scores and edges against a plain restatement in NumPy and dictionaries."""

import random

import numpy as np
import pytest

from kinfold.operators import edges, score


def make_hits(rng, sizes):
    rows = []
    for (qg, rg), n in sizes.items():
        seen = set()
        while len(seen) < n:
            q, r = int(rng.integers(0, 120)), int(rng.integers(0, 120))
            if qg != rg or q != r:
                seen.add((q, r))
        for q, r in sorted(seen):
            length = int(rng.integers(50, 400)) * int(rng.integers(50, 400))
            rows.append((qg, rg, q, r, float(rng.integers(1, 50)) * 2 + length / 1000, length, float(rng.integers(30, 100))))
    return rows


SCHEMA = "q_genome int, r_genome int, q int, r int, bitscore double, len_product long, identity double"


def plain_nbs(rows):
    out, pairs = {}, {}
    for row in rows:
        pairs.setdefault(row[:2], []).append(row)
    for pair, hits in pairs.items():
        if len(hits) <= 1:
            continue
        order = sorted(hits, key=lambda h: (h[5], h[2], h[3]))
        n, kept = len(order), []
        if n < 100:
            kept = order
        else:
            w = 1000 if n > 5000 else 200 if n > 1000 else 20
            for at in range(0, n, w):
                part = order[at : at + w + 1]
                cut = np.percentile([h[4] for h in part], 95)
                kept += [h for h in part if h[4] >= cut]
        x, y = np.log10([h[5] for h in kept]), np.log10([h[4] for h in kept])
        a, b = np.polyfit(x, y, 1) if np.ptp(x) > 0 else (0.0, y.mean())
        for h in hits:
            out[h[:4]] = h[4] / (10**b * h[5] ** a)
    return out


@pytest.fixture(scope="module")
def rows():
    sizes = {(0, 1): 1201, (1, 0): 1001, (0, 0): 100, (1, 1): 99, (0, 2): 5001, (2, 0): 1, (1, 2): 2, (2, 1): 700, (2, 2): 0}
    return make_hits(np.random.default_rng(3), sizes)


def test_normalise(spark, rows):
    got = {tuple(r[:4]): r["nbs"] for r in score.normalize(spark.createDataFrame(rows, SCHEMA)).select("q_genome", "r_genome", "q", "r", "nbs").collect()}
    want = plain_nbs(rows)
    assert got.keys() == want.keys() and (2, 0) not in {k[:2] for k in got}
    assert all(abs(got[k] - want[k]) < 1e-9 * max(1, want[k]) for k in want)


def test_one_length(spark):
    rows = [(0, 1, i, i, 10.0 + i, 400, 50.0) for i in range(5)]
    got = sorted(r.nbs for r in score.normalize(spark.createDataFrame(rows, SCHEMA)).collect())
    mean = 10 ** np.mean(np.log10([10, 11, 12, 13, 14]))
    assert np.allclose(got, [(10 + i) / mean for i in range(5)])


def nbs_frame(spark, rows):
    return spark.createDataFrame([(qg, rg, q, r, n, n * 10, 50.0) for qg, rg, q, r, n in rows], "q_genome int, r_genome int, q int, r int, nbs double, bitscore double, identity double")


def keys(df):
    return {tuple(r) for r in df.select("q_genome", "r_genome", "q", "r").collect()}


def plain_best(n):
    best, there = {}, {}
    for (qg, rg, q, _), v in n.items():
        if qg != rg:
            there[qg, q, rg] = max(v, there.get((qg, q, rg), v))
            best[qg, q] = max(v, best.get((qg, q), -1))
    return {k for k, v in n.items() if v > (there[k[0], k[2], k[1]] if k[0] != k[1] else best.get((k[0], k[2]), -1)) - 1e-3}


def test_best_hits_reciprocal_and_kept(spark):
    rng = np.random.default_rng(5)
    n = {}
    for _ in range(900):
        qg, rg, q, r = (int(x) for x in rng.integers(0, [3, 3, 14, 14]))
        if (qg, q) != (rg, r):
            n[qg, rg, q, r] = float(rng.choice([0.5, 0.5005, 0.7, 1.0, 1.2, 2.0]))
    df = nbs_frame(spark, [(*k, v) for k, v in n.items()])
    bh = plain_best(n)
    assert keys(edges.best_hits(df)) == bh
    rbh = {k for k in bh if k[0] != k[1] and (k[1], k[0], k[3], k[2]) in bh}
    assert keys(edges.reciprocal(edges.best_hits(df))) == rbh
    thr = {}
    for g in {(k[0], k[2]) for k in n}:
        own = [n[k] for k in rbh if (k[0], k[2]) == g]
        cross = [v for k, v in n.items() if (k[0], k[2]) == g and k[0] != k[1]]
        thr[g] = min(own) if own else max(cross, default=0) + 1e-6
    assert keys(edges.retain(df)) == {k for k, v in n.items() if v >= thr[k[0], k[2]]}
    assert keys(edges.retain(df, "arb")) == rbh
    assert keys(edges.retain(df, "ar")) == {k for k in n if k[0] == k[1] or (k[1], k[0], k[3], k[2]) in n}
    with pytest.raises(ValueError):
        edges.retain(df, "other")


def test_edge_table(spark):
    rows = [(0, 1, 1, 1, 0.9), (1, 0, 1, 1, 0.8), (0, 1, 2, 2, 0.7), (1, 0, 3, 3, 0.6), (0, 0, 5, 6, 0.5), (0, 0, 6, 5, 0.4), (0, 0, 8, 7, 0.3)]
    got = {(r.src_genome, r.src, r.dst_genome, r.dst): (r.nbs, r.nbs_rev) for r in edges.network_edges(nbs_frame(spark, rows)).collect()}
    assert got == {(0, 1, 1, 1): (0.9, 0.8), (0, 2, 1, 2): (0.7, 0.0), (0, 3, 1, 3): (0.6, 0.0), (0, 5, 0, 6): (0.5, 0.4), (0, 8, 0, 7): (0.3, 0.0)}
    genes = spark.createDataFrame([(0, 1), (0, 9), (1, 3)], "genome int, gene int")
    assert [tuple(r) for r in edges.singletons(genes, edges.network_edges(nbs_frame(spark, rows))).collect()] == [(0, 9)]


def test_paralogs_only(spark):
    df = nbs_frame(spark, [(0, 0, 1, 2, 0.4), (0, 0, 1, 3, 0.1)])
    assert keys(edges.best_hits(df)) == {(0, 0, 1, 2), (0, 0, 1, 3)} and keys(edges.retain(df)) == {(0, 0, 1, 2), (0, 0, 1, 3)}


def test_ranks_over_ranges(spark):
    """Many rows of one key, ties and null keys are numbered as one window would."""
    from kinfold.plans.tables import ranked

    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), rng.choice("xy"), rng.randrange(40), i) for i in range(3000)] + [("z", "z", 0, -1)]
    df = spark.createDataFrame(rows, "k string, l string, v int, i int").repartition(7)
    got = {r.i: (r.rn, r.n) for r in ranked(df, ["k", "l"], ["v", "i"]).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2:])
        want |= {r[3]: (k, len(own)) for k, r in enumerate(own)}
    assert got == want
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert ranked(df.limit(0), ["k", "l"], ["v", "i"]).count() == 0 and parts == spark.conf.get("spark.sql.shuffle.partitions")


def test_hits_stay_in_their_buckets(spark, sf):
    """Normalised hits are looked through by query gene where they are; no table name stays behind."""
    from kinfold import queries
    from kinfold.operators import edges, score

    names = {t.name for t in spark.catalog.listTables()}
    nbs = score.normalize(queries.hits(spark, sf))
    plan = edges.best_hits(nbs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "hashpartitioning" not in plan
    assert {t.name for t in spark.catalog.listTables()} == names
    kept = {tuple(r) for r in edges.retain(nbs, "arb").select("q", "r").collect()}
    assert kept and kept == {(r, q) for q, r in kept}


def test_hits_are_dealt_by_rows(spark, sf, monkeypatch):
    """The tasks that aggregate hits grow in number with the lines, beyond the session's partitions, and Spark doesn't put them together."""
    from kinfold import queries
    from kinfold.plans import tables

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert tables.tasks_for(lines, 100) == -(-lines.count() // 100) and tables.tasks_for(lines) == 4
    want = sorted(map(tuple, queries.hits(spark, sf).collect()))
    monkeypatch.setattr(queries, "tasks_for", lambda rows: tables.tasks_for(rows, 300))
    out = queries.hits(spark, sf)
    assert out.rdd.getNumPartitions() == -(-lines.count() // 300) and sorted(map(tuple, out.collect())) == want


def test_reciprocal_hits_go_once_through_the_exchange(spark):
    """The ends of a row aren't carried twice, as themselves and in the pair's order; own-genome hits stay, transposed or not."""
    import itertools

    rows = [(f"g{x // 3}", f"g{y // 3}", x, y, float(x * 10 + y), 1.0, 2.0) for x, y in itertools.permutations(range(9), 2) if (7 * x + 3 * y) % 5 < 3]
    nbs = spark.createDataFrame(rows, "q_genome string, r_genome string, q long, r long, nbs double, bitscore double, identity double")
    have = {(r[2], r[3]) for r in rows}
    both = [r for r in rows if r[0] != r[1] and (r[3], r[2]) in have]
    got, ar = edges.reciprocal(nbs), edges.retain(nbs, "ar")
    assert got.columns == ar.columns == nbs.columns
    assert sorted(map(tuple, got.collect())) == sorted(both) and both
    assert sorted(map(tuple, ar.collect())) == sorted(both + [r for r in rows if r[0] == r[1]])
    for df in (got, ar):
        assert "_w0" not in df._jdf.queryExecution().optimizedPlan().toString()
