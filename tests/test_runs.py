"""The whole inference run on small genomes, the registered queries against DuckDB, and the entry points."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from kinfold import queries
from kinfold.plans import annotation, evaluation
from kinfold.plans.config import Config, parse
from kinfold.plans.inference import run
from kinfold.sources.gml import read_gml

ROOT = Path(__file__).resolve().parents[1]


def test_inference(spark, tmp_path):
    import random

    rng = random.Random(5)
    (tmp_path / "genomes").mkdir()
    (tmp_path / "hits").mkdir()
    for g in range(3):
        (tmp_path / "genomes" / f"s{g}.fa").write_text("".join(f">sp|S{g}N{i}|X\n{'M' * (100 + 7 * i)}\n" for i in range(6)))
    for a in range(3):
        for b in range(3):
            lines = []
            for i in range(6):
                for j in range(6):
                    same = i == j
                    if (a != b and (same or rng.random() < 0.15)) or (a == b and i != j and rng.random() < 0.1):
                        bits = (400 if same else 60) + rng.random() * 10
                        lines.append(f"G{a}|g{i}\tG{b}|g{j}\t{90 if same else 40}\t100\t0\t0\t1\t100\t1\t100\t1e-9\t{bits:.2f}\n")
            (tmp_path / "hits" / f"G{a}-G{b}.out").write_text("".join(lines))
    c = Config(genomes=str(tmp_path / "genomes"), hits=str(tmp_path / "hits"), output=str(tmp_path / "out"))
    out = run(spark, Config(**{**c.__dict__, "sequences": True, "gml": True}))
    lines = {r.split("\t")[0]: r.split("\t")[1:] for p in (tmp_path / "out/groups_tsv").glob("part*") for r in p.read_text().splitlines()}
    ids = {r.gene_code: r.orig_id for r in out["genes"].collect()}
    assert lines == {r.og_id: [str(r.genome_num), str(r.gene_num), " ".join(ids[g] for g in r.gene_ids)] for r in out["groups"].collect()}
    for og, (_, n, names) in lines.items():
        text = "".join(p.read_text() for p in (tmp_path / f"out/group_sequences/og_id={og}").glob("part*"))
        assert [x.split("\n")[0] for x in text.split(">")[1:]] == names.split(" ") and text.count("MMM\n") == int(n)
    groups = {tuple(r.gene_ids) for r in out["groups"].collect()}
    genes = [g for ids in groups for g in ids]
    assert sorted(genes) == sorted(set(genes)) == sorted(f"G{a}|g{i}" for a in range(3) for i in range(6))
    pairs = {frozenset((r.gene_a, r.gene_b)) for r in out["pairs"].collect()}
    true = {frozenset((f"G{a}|g{i}", f"G{b}|g{i}")) for i in range(6) for a in range(3) for b in range(a)}
    assert len(pairs & true) >= 15
    check_graphs(spark, tmp_path, out)
    check_evaluation(spark, tmp_path, out, true)
    before = sorted(map(str, out["groups"].collect()))
    os.rename(tmp_path / "hits", tmp_path / "gone")  # resumed stages don't need it
    again = run(spark, Config(**{**c.__dict__, "resume": True}))
    assert sorted(map(str, again["groups"].collect())) == before


def test_inference_without_results(spark, tmp_path):
    """The built-in search stands in for an outside tool's: families of sequences with a few changes become groups."""
    import random

    rng, letters = random.Random(7), "ACDEFGHIKLMNPQRSTVWY"
    base = ["".join(rng.choices(letters, k=150 + 20 * i)) for i in range(4)]
    change = lambda s: "".join(rng.choice(letters) if rng.random() < 0.08 else x for x in s)
    (tmp_path / "genomes").mkdir()
    for g in range(3):
        (tmp_path / "genomes" / f"s{g}.fa").write_text("".join(f">sp|S{g}N{i}|X\n{change(s)}\n" for i, s in enumerate(base)))
    c = parse(["--genomes", f"{tmp_path}/genomes", "--output", f"{tmp_path}/out"])
    assert c.hits is None
    out = run(spark, c)
    assert {(r.q_genome, r.r_genome, r.q) for r in out["hits"].collect()} == {(a, b, i) for a in range(3) for b in range(3) for i in range(4) if a != b}
    assert sorted(tuple(r.gene_ids) for r in out["groups"].collect()) == sorted(tuple(f"G{g}|g{i}" for g in range(3)) for i in range(4))


def one_file(tmp_path, name):
    """The parts of a written graph, one after the other, as one file."""
    text = "".join(p.read_text() for p in sorted((tmp_path / f"out/{name}_gml").glob("part*")))
    assert text.startswith("graph\n[") and text.rstrip().endswith("]") and text.count("[") == text.count("]")
    (tmp_path / f"{name}.gml").write_text(text)
    return str(tmp_path / f"{name}.gml")


def check_graphs(spark, tmp_path, out):
    """The graphs read back from one file each have what the run has."""
    names, values = {"name": T.StringType()}, {k: T.DoubleType() for k in ("NBS", "NBSRev", "BS", "BSRev", "Sim", "SimRev")}
    v, e = read_gml(spark, one_file(tmp_path, "ssn"), names, values)
    of = {r.id: r.name for r in v.collect()}
    assert sorted(of) == list(range(18)) and sorted(of.values()) == sorted(r.gene_code for r in out["genes"].collect())
    edge = lambda a, b, r: (f"G{r.src_genome}|g{r.src}", f"G{r.dst_genome}|g{r.dst}", r.nbs, r.nbs_rev, r.bs, r.bs_rev, r.sim, r.sim_rev)
    assert sorted((of[r.source], of[r.target], r.NBS, r.NBSRev, r.BS, r.BSRev, r.Sim, r.SimRev) for r in e.collect()) == sorted(edge(0, 0, r) for r in out["network"].collect())
    nodes = {"-".join(map(str, r.path)): r for r in out["hierarchy"].collect()}
    shown = {"name": T.StringType(), "geneIDs": T.StringType(), "genesNum": T.IntegerType(), "Event": T.StringType()}
    v, e = read_gml(spark, one_file(tmp_path, "hierarchy"), shown, {})
    got = {r.name: r for r in v.collect()}
    assert {k: (x.geneIDs.split(), x.genesNum, x.Event) for k, x in got.items()} == {k: (x.gene_ids, x.n_genes, x.event) for k, x in nodes.items()}
    at = {x.id: k for k, x in got.items()}
    assert sorted((at[r.source], at[r.target]) for r in e.collect()) == sorted((k.rpartition("-")[0], k) for k in nodes if "-" in k)
    v, _ = read_gml(spark, one_file(tmp_path, "orthogroups"), shown | {"genomeIDs": T.StringType()}, {})
    ids = {r.gene_code: r.orig_id for r in out["genes"].collect()}
    group = {"-".join(map(str, r.path)): r.og_id for r in out["groups"].collect() if r.path is not None}
    want = [(group.get(k), " ".join(sorted(ids[g] for g in x.gene_ids)), " ".join(f"s{g[1:]}.fa" for g in x.genome_ids)) for k, x in nodes.items()]
    assert sorted(((r.name, r.geneIDs, r.genomeIDs) for r in v.collect()), key=str) == sorted(want, key=str)


def check_evaluation(spark, tmp_path, out, true):
    name = lambda g: f"S{g[1]}N{g.split('g')[1]}"
    (tmp_path / "labels.tsv").write_text("".join(f"TreeFamA\t{name(a)}\t{name(b)}\tTP\n" for a, b in map(sorted, true)) + "TreeFamA\tS0N1\tS1N2\tTN\nTreeFamA\tS0N1\tnone\tTP\nother\tS0N1\tS1N3\tTP\n")
    (tmp_path / "other.txt").write_text("A: S0N0 S1N0 S2N0\nB: sp|S0N1|X S1N1 gone\n")
    c = parse(["--run", f"{tmp_path}/out", "--labels", f"{tmp_path}/labels.tsv", "--output", f"{tmp_path}/eval", "--external", f"{tmp_path}/other.txt", "--marker", "TreeFamA"], evaluation.EvaluationConfig)
    for _ in range(2):
        got = evaluation.run(spark, c)
    pairs = {frozenset((r.gene_a, r.gene_b)) for r in out["pairs"].collect()}
    known = {g for p in true for g in p}
    r = got["confusion"].first()
    right = 2 * len(pairs & true)
    assert (r.tp, r.fn) == (right, 2 * len(true) - right) and r.tpr == right / (2 * len(true)) and known
    assert got["events"].count() == len(true) + 1 == sum(r.pairs for r in got["by_event"].collect()) == got["path_events"].count()
    og = {g: r.og_id for r in out["groups"].collect() for g in r.gene_ids}
    assert all((r.group_status == "SameOG") == (og[r.gene_a] == og[r.gene_b]) for r in got["events"].collect())
    best = {r.l_og: (r.shared, r.l_size) for r in got["overlaps"].collect()}
    assert best["A"][1] == 3 and best["B"][1] == 3 and best["B"][0] <= 2
    assert got["totals"].first().missing == sum(n - s for s, n in best.values())
    assert (tmp_path / "eval/events_tsv").is_dir()


def test_config():
    c = parse(["--genomes", "g", "--hits", "h", "--output", "o", "--mode", "ar", "--overlap", "1", "--resume"])
    assert (c.mode, c.overlap, c.resume, c.coefficient, c.quality) == ("ar", 1, True, 1.0, "rber")
    with pytest.raises(ValueError):
        Config(mode="x")


def test_annotation_run(spark, tmp_path):
    for name, text in {
        "g/a.faa": ">a1 x\nMMMMMMMMMM\n>a2\nMMMMMMMMMM\n", "g/b.faa": ">b1\nMMMMMMMMMM\n", "r/COG1.fa": ">k one\nMMMMMMMMMM\n", "r/COG2.fa": ">k two\nMMMMMMMMMM\n",
        "h/a.faa.out": "".join(f"{q}\t{s}\t{p}\t9\t0\t0\t1\t{e}\t1\t10\t{v}\t50\n" for q, s, p, e, v in [
            ("a1", "k_COG1", 80, 10, 1e-9), ("a1", "k_COG2", 90, 10, 1e-9), ("a1", "k_COG2", 99, 2, 1e-9), ("a1", "k_COG1", 99, 10, 0.1), ("a2", "k_COG1", 30, 10, 1e-9), ("a2", "none_COG1", 90, 10, 1e-9)]) + "END\n",
        "h/b.faa.out": "b1\tk_COG1\t70\t9\t0\t0\t1\t10\t10\t1\t1e-5\t50\n",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    args = ["--genomes", f"{tmp_path}/g", "--reference", f"{tmp_path}/r", "--output", f"{tmp_path}/out"]
    first = annotation.run(spark, parse(args, annotation.AnnotationConfig))
    assert {r.genome for r in first["unfinished"].collect()} == {"a.faa", "b.faa"} and "annotations" not in first
    assert "".join(sorted(p.read_text() for p in (tmp_path / "out/reference").glob("part*"))).count(">k_COG") == 2
    out = annotation.run(spark, parse([*args, "--hits", f"{tmp_path}/h"], annotation.AnnotationConfig))
    assert {(r.query, r.subject, r.pident, r.family) for r in out["annotations"].collect()} == {("a1", "k_COG2", 90.0, "COG2"), ("b1", "k_COG1", 70.0, "COG1")}
    assert [r.genome for r in out["unfinished"].collect()] == ["b.faa"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_duckdb(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_leiden_query(spark, sf):
    assert __spark_entry__.queries()["leiden_hierarchy"](spark, sf).count() > 0


def test_communities_of_all_parts(spark, sf):
    nodes = __spark_entry__.queries()["part_communities"](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/part.parquet").count()
    roots = [r for r in nodes if "-" not in r.node]
    assert [r.n_genes for r in roots] == [n]
    kids = {}
    for r in nodes:
        kids.setdefault(r.node.rpartition("-")[0], []).append(r.n_genes)
    assert all(sum(kids[r.node]) == r.n_genes for r in nodes if r.node in kids) and len(kids) > n / 10


def test_division_broadcasts_small_tables_only(spark, tmp_path, monkeypatch):
    """Within a division, a table whose files are under the session's limit of broadcasts but not small is joined by an exchange; the limit is there again afterwards."""
    from kinfold.operators import community
    from kinfold.plans import tables

    rows = spark.range(200_000).select("id", (F.col("id") * 7919 % 200_003).alias("x"))
    stored = tables.written(rows, "broad")
    joined = lambda: stored.join(rows, "id")._jdf.queryExecution().sparkPlan().toString()
    seen = []
    monkeypatch.setattr(community, "connected_components", lambda edges: seen.append(joined()) or 1 / 0)
    assert "BroadcastHashJoin" in joined()
    with pytest.raises(ZeroDivisionError):
        community.hierarchy(spark.createDataFrame([("G0|a", "G1|b", 1.0)], "src string, dst string, nbs double"))
    assert "BroadcastHashJoin" not in seen[0] and "BroadcastHashJoin" in joined()


def test_without_the_subpackage(tmp_path):
    """Everything else imports and registers where the subpackage and the pipeline are gone."""
    for name in ("kinfold", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "kinfold").mkdir()
    for p in (ROOT / "kinfold").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "kinfold" / p.name).symlink_to(p)
    (tmp_path / "jobs").symlink_to(ROOT / "jobs")
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rbh' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_whole_tables(spark, tmp_path):
    from itertools import combinations

    lines = [(o, p, q) for o, p, q in [(1, 1, 5), (1, 2, 50), (2, 2, 1), (2, 3, 2), (3, 7, 50), (3, 9, 50), (4, 5, 3)]]
    parts = [(p, "b", "t" if p < 4 else "u", 5 * p) for p in range(1, 10)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in queries.QUERIES["connected_components"](spark, str(tmp_path)).select("node", "component").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    pairs = {(r.gene_a, r.gene_b) for r in queries.QUERIES["og_pair_combinations"](spark, str(tmp_path)).collect()}
    assert pairs == {*combinations((1, 2, 3), 2), *combinations(range(4, 10), 2)}


def test_pairs_of_a_large_group_are_of_many_tasks(spark):
    from itertools import combinations

    from kinfold.operators import evaluate

    members = spark.createDataFrame([("a", n, 10 * n) for n in range(1, 48)] + [("b", 1, 5)] + [("c", n, n) for n in (1, 2)], "og string, pos int, gene long")
    got = evaluate.combinations(members, block=10, pairs_a_task=100)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    want = [("a", 10 * i, 10 * j) for i, j in combinations(range(1, 48), 2)] + [("c", 1, 2)]
    assert sorted((r.og, r.gene_a, r.gene_b) for r in rows) == want
    assert len({r.task for r in rows if r.og == "a"}) > 3
    assert evaluate.combinations(members.limit(0)).count() == 0
