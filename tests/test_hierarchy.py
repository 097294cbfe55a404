"""Events, orthogroups, pairs and common ancestors on hand-made hierarchies; community search on planted graphs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import scalars
from kinfold.operators import community, evaluate, hierarchy, leiden
from kinfold.operators.coarsen import coarsen
from kinfold.operators.components import connected_components


def nodes_from(spark, leaves, overlap=0):
    """``leaves``: path tuple -> genes like a1 (genome a)."""
    rows = []
    for path, genes in leaves.items():
        for g in genes.split():
            for k in range(1, len(path) + 1):
                rows.append((list(path[:k]), f"{g[0]}|{g}", g[0]))
    df = spark.createDataFrame(rows, "path array<int>, gene string, genome string")
    return hierarchy.label_events(hierarchy.attributes(df), overlap)


def events(df):
    return {tuple(r.path): r.event for r in df.collect()}


def test_event_table(spark):
    leaves = {
        (0, 0): "a1 b1", (0, 1): "a2 b2",  # same genomes
        (1, 0): "a3", (1, 1): "b3",  # none shared
        (2, 0): "a4 b4", (2, 1): "a5",  # one child has all
        (3, 0): "a6 b6", (3, 1): "b7 c7",  # some shared
        (4, 0): "a8", (4, 1): "b8", (4, 2): "c8",  # three children
        (5,): "a9 b9", (6,): "a10 a11",  # isolated
    }
    got = events(nodes_from(spark, leaves))
    assert {k[0]: v for k, v in got.items() if len(k) == 1} == {0: "II", 1: "I", 2: "III-1", 3: "III-2", 4: "III-3", 5: "I", 6: None}
    assert all(v is None for k, v in got.items() if len(k) > 1)
    assert events(nodes_from(spark, leaves, overlap=1))[(3,)] == "I" and events(nodes_from(spark, leaves, overlap=1))[(2,)] == "I"


def groups(df):
    return {tuple(r.path): (r.genome_num, r.gene_num, sorted(g.split("|")[1] for g in r.gene_ids)) for r in hierarchy.orthogroups(df).collect()}


def test_orthogroups(spark):
    leaves = {
        (0, 0, 0): "a1", (0, 0, 1): "b1", (0, 1): "a2 b2",  # an I node with one silent sibling
        (1, 0, 0, 0): "a3", (1, 0, 0, 1): "b3", (1, 0, 1): "c3", (1, 1): "d3",  # nested I nodes: the topmost
        (2, 0, 0): "a4", (2, 0, 1): "b4", (2, 1): "a5", (2, 2): "a6 b6",  # two silent siblings: none joins
        (3, 0, 0): "a7", (3, 0, 1): "b7", (3, 1, 0): "a8", (3, 1, 1): "b8", (3, 2): "c9",  # two would take the same: the first does
        (4,): "a9 a10",
    }
    df = nodes_from(spark, leaves)
    assert groups(df) == {
        (0,): (2, 4, ["a1", "a2", "b1", "b2"]), (1,): (4, 4, ["a3", "b3", "c3", "d3"]), (2, 0): (2, 2, ["a4", "b4"]), (2, 1): (1, 1, ["a5"]), (2, 2): (1, 2, ["a6", "b6"]),
        (3,): (2, 3, ["a7", "b7", "c9"]), (3, 1): (2, 2, ["a8", "b8"]), (4,): (1, 2, ["a10", "a9"]),
    }
    named = hierarchy.named_groups(hierarchy.with_singletons(hierarchy.orthogroups(df), spark.createDataFrame([("z|z1",)], "gene string"))).collect()
    order = sorted(named, key=lambda r: r.og_id)
    assert [r.og_id for r in order] == [f"OG{i:06d}" for i in range(9)] and order[0].genome_num == 4 and order[-1].gene_ids == ["z|z1"]
    assert [(r.path is None, r.genome_num) for r in order] == sorted(((r.path is None, r.genome_num) for r in order), key=lambda x: -x[1])


def test_pairs(spark):
    leaves = {
        (0, 0, 0): "a1", (0, 0, 1): "b1", (0, 1): "a2 b2",  # the sibling that joins has no cross pairs
        (1, 0): "a3 b9", (1, 1, 0): "c3 d3", (1, 1, 1): "c4",
    }
    df = nodes_from(spark, leaves)
    assert events(df)[(1,)] == "I" and events(df)[(1, 1)] == "III-1"
    got = {(r.gene_a.split("|")[1], r.gene_b.split("|")[1]) for r in hierarchy.ortholog_pairs(df, hierarchy.orthogroups(df)).collect()}
    across = {("a1", "b1")} | set(itertools.product(["a3", "b9"], ["c3", "d3", "c4"]))
    inside = {("a2", "b2"), ("b2", "a2"), ("a3", "b9"), ("b9", "a3"), ("c3", "d3"), ("d3", "c3")}
    assert got == across | inside


def test_common_ancestors(spark):
    df = nodes_from(spark, {(0, 0, 0): "a1", (0, 0, 1): "b1", (0, 1): "a2", (1, 0): "c1", (1, 1): "d1 e1"})
    pairs = spark.createDataFrame([("a|a1", "b|b1"), ("a|a1", "a|a2"), ("a|a1", "c|c1"), ("c|c1", "d|d1")], "gene_a string, gene_b string")
    got = {(r.gene_a[2:], r.gene_b[2:]): (r.status, r.event, r.total, r.diff, r.way_a, r.way_b) for r in hierarchy.common_ancestors(pairs, df).collect()}
    assert got == {
        ("a1", "b1"): ("found", "I", 2, 0, "No Path", "No Path"), ("a1", "a2"): ("found", "III-1", 2, 1, "I:1", "No Path"),
        ("a1", "c1"): ("not connected", None, None, None, None, None), ("c1", "d1"): ("inseparable", None, None, None, None, None),
    }
    below = {tuple(r.path) for r in hierarchy.subtree(df, pairs.limit(1)).collect()}
    assert below == {(0, 0), (0, 0, 0), (0, 0, 1)}


def test_group_locations_by_definition(spark):
    rng = random.Random(6)
    leaves = {(c, a, b): " ".join(f"{'abcd'[rng.randrange(4)]}{c}{a}{b}{i}" for i in range(rng.randrange(1, 5))) for c in range(4) for a in range(2) for b in range(2)}
    df = nodes_from(spark, leaves)
    nodes = {tuple(r.path): set(r.gene_ids) for r in df.collect()}
    genes = sorted(set().union(*nodes.values()))
    groups = {f"o{k}": set(rng.sample(genes, rng.randrange(1, 7))) | ({"z|none"} if k % 5 == 0 else set()) for k in range(30)} | {"gone": {"z|1", "z|2"}}
    rows = [(k, g) for k, own in groups.items() for g in own] + [("o1", g) for g in groups["o1"]]
    got = {r.og: (None if r.path is None else tuple(r.path), r.shared) for r in hierarchy.group_locations(spark.createDataFrame(rows, "og string, gene string"), df).collect()}
    want = {}
    for k, own in groups.items():
        if len(own) > 1:
            best = min(((-len(own & x), len(x), p) for p, x in nodes.items() if own & x), default=None)
            want[k] = (None, None) if best is None else (best[2], -best[0])
    assert got == want


def test_scalars(spark):
    df = spark.createDataFrame([(2,), (999,), (1000,), (5000,), (100_000,), (1_000_000,)], "n int")
    got = [r[0] for r in df.select(scalars.resolution_gamma(F.col("n"))).collect()]
    factor = lambda n: 10.0 ** int(np.log10(n) - 4)  # noqa: E731  toward 0
    assert got == pytest.approx([factor(n) * 10 / n for n in (2, 999, 1000, 5000, 100_000, 1_000_000)], rel=1e-9)
    pan = spark.createDataFrame([(1, 5), (10, 10), (97, 97), (99, 150), (100, 100), (100, 101)], "g int, n int")
    assert [r[0] for r in pan.select(scalars.pangenome_class(F.col("g"), F.col("n"), F.lit(100))).collect()] == ["cloud", "cloud", "soft core", "core", "SOG", "HOG"]


def test_evaluation(spark):
    said = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("a", "x")], "gene_a string, gene_b string")
    truth = spark.createDataFrame([("a", "b", "TP"), ("c", "d", "FP"), ("a", "c", "FN"), ("b", "d", "TN")], "gene_a string, gene_b string, label string")
    r = evaluate.confusion(said, truth).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.ppv, r.tpr) == (2, 2, 2, 2, 0.5, 0.5)
    empty = evaluate.confusion(said.limit(0), truth).first()
    assert (empty.tp, empty.ppv, empty.tpr) == (0, None, 0.0)
    left = spark.createDataFrame([("l1", g) for g in "abcd"] + [("l2", g) for g in "xy"] + [("l3", "q")], "og string, gene string")
    right = spark.createDataFrame([("r1", g) for g in "abc"] + [("r2", g) for g in "abcdz"] + [("r3", "x"), ("r4", "y")], "og string, gene string")
    got = {r.l_og: (r.r_og, r.shared, r.l_size, r.r_size) for r in evaluate.max_overlap(left, right).collect()}
    assert got == {"l1": ("r2", 4, 4, 5), "l2": ("r3", 1, 2, 1)}
    t = evaluate.comparison_totals(evaluate.max_overlap(left, right)).first()
    assert (t.groups, t.correct, t.missing, t.erroneous, t.exact) == (2, 5, 1, 1, 0)
    edges = spark.createDataFrame([("a", "b"), ("a", "x")], "src string, dst string")
    members = spark.createDataFrame([("a", 1), ("b", 1), ("x", 2)], "gene string, community int")
    assert [(r.src, r.dst) for r in evaluate.induced_edges(edges, members).collect()] == [("a", "b")]


def two_blocks(rng, n=14, genomes="abcdefg"):
    names = [[f"{genomes[i % len(genomes)]}|{b}{i}" for i in range(n)] for b in "xy"]
    out = [(u, v, 1.0) for block in names for u, v in itertools.combinations(block, 2) if rng.random() < 0.8]
    return names, out + [(names[0][0], names[1][0], 0.1)]


@pytest.mark.parametrize("quality", leiden.QUALITIES)
def test_planted_blocks(quality):
    names, edges = two_blocks(random.Random(1))
    at = {g: i for i, g in enumerate(itertools.chain(*names))}
    links = [(at[u], at[v], w) for u, v, w in edges]
    resolution = {"cmp": 0.05, "rber": 0.5}.get(quality, 1.0)
    part, q = leiden.partition(len(at), links, quality, resolution, seed=4)
    assert (part, q) == leiden.partition(len(at), links, quality, resolution, seed=4)
    assert len(set(part[:14])) == 1 and len(set(part[14:])) == 1 and part[0] != part[-1]
    g, gamma = leiden.scaled(len(at), links, quality, resolution)
    assert q == leiden.value(g, gamma, part) >= leiden.value(g, gamma, [0] * len(at))


def test_hierarchy_invariants(spark):
    rng = random.Random(2)
    edges = []
    for k in range(4):
        names, e = two_blocks(rng, 8)
        edges += [(f"{u}_{k}", f"{v}_{k}", w) for u, v, w in e]
    edges += [("a|s1", "a|s2", 1.0), ("a|p1", "b|p2", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, nbs double")
    runs = []
    for limit in (5000, 10):
        nodes = {tuple(r.path): r for r in community.hierarchy(df, in_one_task=limit).collect()}
        runs.append({k: tuple(r.gene_ids) for k, r in nodes.items()})
        kids = {}
        for p in nodes:
            if len(p) > 1:
                kids.setdefault(p[:-1], []).append(p)
        for p, c in kids.items():
            assert sorted(g for q in c for g in nodes[q].gene_ids) == list(nodes[p].gene_ids)
            assert all(set(nodes[q].genome_ids) <= set(nodes[p].genome_ids) for q in c)
        assert all(nodes[p].n_genomes == 1 or p in kids or nodes[p].n_genes > 1 for p in nodes)
    assert runs[0] == runs[1]
    roots = {k: v for k, v in runs[0].items() if len(k) == 1}
    assert len(roots) == 6 and ("a|p1", "b|p2") in roots.values() and ("a|s1", "a|s2") in roots.values()
    first = next(k for k, v in roots.items() if len(v) == 16)
    assert sorted(len(v) for k, v in runs[0].items() if len(k) == 2 and k[:1] == first) == [8, 8]


def planted(rng, n, blocks, inside=12, across=1):
    """Edges (src, dst, 1.0) of a graph of equal blocks; gene number // (n // blocks) is a gene's block."""
    size, out = n // blocks, set()
    for u in range(n):
        out |= {(u, u // size * size + rng.randrange(size)) for _ in range(inside // 2)}
        if rng.random() < across / 2:
            out.add((u, rng.randrange(n)))
    return [(f"G{u % 7}|g{u:05d}", f"G{v % 7}|g{v:05d}", 1.0) for u, v in sorted(out) if u != v]


def _in_path(spark, edges, path="0"):
    links = spark.createDataFrame(edges, "src string, dst string, w double").withColumn("path", F.lit(path)).repartition(4)
    return links, links.select("path", F.explode(F.array("src", "dst")).alias("gene")).distinct()


def test_coarse_graphs_keep_weights_and_blocks(spark):
    edges = planted(random.Random(5), 1200, 6)
    links, members = _in_path(spark, edges)
    small, few = _in_path(spark, [("G0|a", "G1|b", 2.0), ("G1|b", "G2|c", 1.0)], "7")
    place, nodes, coarse = coarsen(members.unionByName(few), links.unionByName(small), 150, 2000)
    at = {r.gene: r.node for r in place.filter("path = '0'").collect()}
    assert len(at) == place.filter("path = '0'").count() == len({g for e in edges for g in e[:2]})
    weights = {r.node: r.weight for r in nodes.filter("path = '0'").collect()}
    assert weights == {c: float(sum(1 for x in at.values() if x == c)) for c in set(at.values())} and len(weights) <= 150
    want = {}
    for a, b, w in edges:
        key = tuple(sorted((at[a], at[b])))
        want[key] = want.get(key, 0.0) + w
    assert {(r.a, r.b): r.w for r in coarse.filter("path = '0'").collect()} == want  # links within a node are its loops
    block = lambda g: int(g[-5:]) // 200
    most = {c: max(np.bincount([block(g) for g, x in at.items() if x == c], minlength=6)) for c in weights}
    assert sum(most.values()) > 0.9 * len(at)
    # A community that fits is left as it is.
    assert {(r.gene, r.node) for r in place.filter("path = '7'").collect()} == {(g, g) for g in ("G0|a", "G1|b", "G2|c")}
    assert {(r.a, r.b, r.w) for r in coarse.filter("path = '7'").collect()} == {("G0|a", "G1|b", 2.0), ("G1|b", "G2|c", 1.0)}


@pytest.mark.parametrize("quality", ["rber", "rbcv"])
def test_a_coarse_graph_has_the_quality_of_its_parts(quality):
    rng = random.Random(9)
    edges = [(u, v, 1.0 + rng.random()) for u in range(40) for v in range(u) if rng.random() < (0.5 if u % 4 == v % 4 else 0.1)]
    node = [u % 4 * 3 + u % 3 for u in range(40)]  # 12 coarse nodes
    links = {}
    for u, v, w in edges:
        key = tuple(sorted((node[u], node[v])))
        links[key] = links.get(key, 0.0) + w
    g, gamma = leiden.scaled(40, edges, quality, 0.9)
    sizes = [float(node.count(i)) for i in range(12)]
    c, coarse_gamma = leiden.scaled(12, [(a, b, w) for (a, b), w in links.items()], quality, 0.9, None if quality == "rbcv" else sizes)
    part = [i // 3 for i in range(12)]
    assert coarse_gamma == pytest.approx(gamma)
    assert leiden.value(c, coarse_gamma, part) == pytest.approx(leiden.value(g, gamma, [part[x] for x in node]))


def test_resolutions_side_by_side_narrow_the_interval(spark):
    r = [(0.1, 1, 0.0), (0.2, 3, 0.0), (0.3, 1, 0.0), (0.4, 7, 0.0), (0.5, 2, 0.0), (0.6, 9, 0.0)]
    df = spark.createDataFrame([(r, 2, 2), (r, 3, 3), (r[:1], 2, 2), (r[3:4], 2, 2), (r, 4, 5)], "r array<struct<resolution: double, parts: int, q: double>>, start int, stop int")
    fits, under, over = community._outcome(F.col("r"), F.col("start"), F.col("stop"))
    got = [tuple(x) for x in df.select(fits["resolution"], under, over).collect()]
    assert got == [(0.5, 0.1, 0.2), (0.2, 0.3, 0.4), (None, 0.1, None), (None, None, 0.4), (None, 0.3, 0.4)]


def test_a_thousand_genes_are_halved_by_tries_side_by_side(spark):
    edges = planted(random.Random(3), 1000, 2, across=0.5)
    links, members = _in_path(spark, edges)
    n = members.count()
    genes = members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.greatest("n", F.lit(1000)))  # bracketed
    got = {r.gene: r.part for r in community.divided(members, links, genes, "rber", 1.0, 0).collect()}
    block = lambda g: int(g[-5:]) // 500
    assert len(got) == n and set(got.values()) == {0, 1}
    assert sum(got[g] == block(g) for g in got) > 0.97 * n  # part 0 has the least gene


def test_ten_thousand_genes_in_one_component(spark):
    edges = planted(random.Random(4), 10_000, 25)
    links, members = _in_path(spark, edges)
    genes = members.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    got = {r.gene: r.part for r in community.divided(members, links, genes, "rber", 1.0, 0, task_nodes=1000, task_links=20_000).collect()}
    assert 20 <= len(set(got.values())) <= 50
    counts = np.zeros((50, 25), int)
    for g, p in got.items():
        counts[p, int(g[-5:]) // 400] += 1
    assert counts.sum() == 10_000 and counts.max(0).sum() > 0.95 * 10_000  # blocks stay whole; two may share a part


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("hub", [0, 5000, 250])
def test_components_with_hubs(spark, hub):
    """Hot keys, whether a hub is the least, the greatest or some other node, and stars that the steps make, meet their least neighbour apart from the rest."""
    rng = random.Random(hub)
    edges = [(hub, i) for i in range(200, 400)] + [(401, i) for i in range(402, 500)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    root = {n: n for e in edges for n in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in edges:
        x, y = sorted((top(x), top(y)))
        root[y] = x
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df, hot=20).collect()}
    assert got == {n: top(n) for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.component for r in connected_components(df).collect()} == got


def test_many_small_communities_share_a_task_s_python(spark, monkeypatch):
    """Small communities are divided as rows of sorted partitions: a call of pandas for each costs ten times the division."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    from kinfold.operators import community

    def never(*_):
        raise AssertionError("a call for each group")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", never)
    rows = [(f"G{i % 3}|{k:03}-{i}", f"G{j % 3}|{k:03}-{j}", 1.0 if (i < 2) == (j < 2) else 0.1) for k in range(60) for i in range(4) for j in range(i + 1, 4)]
    got = {tuple(r.path): sorted(r.gene_ids) for r in community.hierarchy(spark.createDataFrame(rows, "src string, dst string, nbs double")).collect()}
    want = {}
    for k in range(60):
        edges = [r for r in rows if f"|{k:03}-" in r[0]]
        for path, gene, _ in community._tree(str(k), sorted({g for e in edges for g in e[:2]}), edges, "rber", 1.0, 0):
            want.setdefault(tuple(map(int, path.split("-"))), []).append(gene)
    assert sorted(map(sorted, want.values())) == sorted(got.values()) and len(got) == len(want) > 120


def test_components_are_dealt_by_their_edges(spark, monkeypatch):
    """Steps have as many partitions as the edges ask for, and the session's settings stand again afterwards."""
    from kinfold.operators import components

    seen, write, keys = [], components.written, ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]
    monkeypatch.setattr(components, "written", lambda df, name: seen.append(int(spark.conf.get(keys[0]))) or write(df, name))
    monkeypatch.setattr(components, "ROWS_A_TASK", 5, raising=False)
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 10 != 9], "src long, dst long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: i // 10 * 10 for i in range(30)}
    assert seen[0] == 4 and set(seen[1:]) == {11}
    assert [spark.conf.get(k) for k in keys] == before


def test_inseparable_edges_broadcasts_no_genes(spark, sf):
    from kinfold import queries

    found = queries.inseparable_edges(spark, sf)
    assert found.count() >= 0
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_small_communities_come_whole_to_their_task(spark):
    """Where genes and links are both joined by community with an exchange, as large tables are, no community's rows are spread over tasks."""
    rows = [(f"G{i % 3}|{c}-{i}", f"G{j % 3}|{c}-{j}", 1.0 + (i + j) % 3) for c in range(3000) for i, j in itertools.combinations(range(4), 2)]
    edges = spark.createDataFrame(rows, "src string, dst string, nbs double")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000", "spark.sql.shuffle.partitions": "16"}
    was = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = community.hierarchy(edges).filter("size(path) = 1").select("gene_ids").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sorted(r.gene_ids for r in got) == sorted(sorted(f"G{i % 3}|{c}-{i}" for i in range(4)) for c in range(3000))


def test_tiny_graphs_that_are_the_same_are_searched_once(spark, monkeypatch):
    """A square of equal links can't be halved, which takes a search all its steps; so the same square isn't searched again."""
    calls, search = [], community.search
    monkeypatch.setattr(community, "search", lambda *a: calls.append(1) or search(*a))
    edges = [(i, j, 0.75) for i, j in itertools.combinations(range(4), 2)]
    got = [community.divide(4, list(edges), 3, "rber", 1.0, 5) for _ in range(40)]
    assert got == [community._divide(4, edges, "rber", 1.0, 5)] * 40
    assert 0 < len(calls) <= 2 * community.MOST_STEPS


def test_links_are_worked_out_once(spark):
    """The network a hierarchy is made of is a table before it is divided, so levels don't work it out again; and a community of many links isn't one task's."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def weight(x):
        made.add(1)
        return float(x)

    rows = [(f"G{i % 3}|{i:04}", f"G{(i + k) % 3}|{i + k:04}", 1.0) for i in range(1200) for k in (1, 2)]
    edges = spark.createDataFrame(rows, "src string, dst string, x double").repartition(4).select("src", "dst", weight("x").alias("nbs"))
    nodes = {tuple(r.path): r.n_genes for r in community.hierarchy(edges, task_links=2000).collect()}
    assert nodes[(0,)] == 1202 and nodes[(0, 0)] + nodes[(0, 1)] == 1202
    assert made.value == len(rows)
