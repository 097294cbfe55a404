"""The jobs: runs over growing input, reruns, interrupted runs, odd rows."""

import json
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import annotate_texts, registry, score_feed
from jobs.common import default_config, load_config

FEED = score_feed.Config("p_type", 1, 1000)


def scores(spark, out):
    return sorted((r["q_genome"], r["r_genome"], r["q"], r["r"], r["bitscore"], r["identity"], round(r["nbs"], 6)) for r in score_feed.read_scores(spark, f"{out}").collect())


def truth(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con.sql(sql).fetchall()


def arrive(lines, to, keep):
    """A part of the lines as a new file of the folder."""
    part = lines.filter(keep).coalesce(1)
    part.write.mode("overwrite").parquet(f"{to}-new")
    for f in Path(f"{to}-new").glob("*.parquet"):
        Path(to).mkdir(exist_ok=True)
        shutil.copy(f, f"{to}/{keep.replace(' ', '')}.parquet")


def test_feed_of_growing_input(spark, sf, tmp_path):
    lines, genes, out, mark = spark.read.parquet(f"{sf}/lineitem.parquet"), f"{sf}/part.parquet", f"{tmp_path}/out", f"{tmp_path}/mark"
    go = lambda: score_feed.run(spark, f"{tmp_path}/in", genes, out, mark, FEED)
    want = lambda: sorted(truth(registry.JOB1_SQL, lineitem=f"{tmp_path}/in/*.parquet", part=genes))
    # Later lines come first, so the order of arrival can't be what decides.
    arrive(lines, f"{tmp_path}/in", "l_orderkey % 3 = 2")
    arrive(lines, f"{tmp_path}/in", "l_orderkey % 3 = 0")
    first = go()
    assert first["batches"] == 2 and scores(spark, out) == want()
    assert go() == {"batches": 0, "hits": 0, "pairs": 0} and scores(spark, out) == want()
    before = scores(spark, out)
    arrive(lines, f"{tmp_path}/in", "l_orderkey % 3 = 1")
    second = go()
    assert second["batches"] == 1 and scores(spark, out) == want() != before
    n = lines.filter("l_partkey <> l_suppkey").count()
    assert first["hits"] + second["hits"] == n == spark.read.schema(score_feed.HITS).parquet(f"{out}/hits").count()


def test_feed_opens_and_writes_touched_pairs_only(spark, sf, tmp_path):
    lines, out, mark = spark.read.parquet(f"{sf}/lineitem.parquet"), f"{tmp_path}/out", f"{tmp_path}/mark"
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    arrive(lines, f"{tmp_path}/in", "l_linenumber > 1")
    score_feed.run(spark, f"{tmp_path}/in", f"{sf}/part.parquet", out, mark, FEED)
    files = {p: p.stat().st_mtime_ns for p in Path(f"{out}/scores").rglob("*.parquet")}
    kind = part.first()["p_type"]
    arrive(lines.join(part.filter(F.col("p_type") == kind), "l_partkey").select(*lines.columns), f"{tmp_path}/in", "l_linenumber = 1")
    done = score_feed.run(spark, f"{tmp_path}/in", f"{sf}/part.parquet", out, mark, FEED)
    kept = {p for p, t in files.items() if p.exists() and p.stat().st_mtime_ns == t}
    assert 0 < done["pairs"] < len({p.parent for p in files})
    assert kept == {p for p in files if f"q_genome={kind}/" not in str(p)}
    assert scores(spark, out) == sorted(truth(registry.JOB1_SQL, lineitem=f"{tmp_path}/in/*.parquet", part=f"{sf}/part.parquet"))


@pytest.mark.parametrize("lost", ["commit", "scores"])
def test_feed_after_an_interrupted_run(spark, sf, tmp_path, lost, monkeypatch):
    lines, out, mark = spark.read.parquet(f"{sf}/lineitem.parquet"), f"{tmp_path}/out", f"{tmp_path}/mark"
    arrive(lines, f"{tmp_path}/in", "l_orderkey % 2 = 0")
    go = lambda: score_feed.run(spark, f"{tmp_path}/in", f"{sf}/part.parquet", out, mark, FEED)
    if lost == "scores":  # the hits of an epoch are there, its scores aren't, and it isn't committed
        write = score_feed.write_partitions

        def fails(df, path, by, rows):
            if path.endswith("scores"):
                raise OSError("lost")
            write(df, path, by, rows)

        with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
            m.setattr(score_feed, "write_partitions", fails)
            go()
    else:  # all is written, but not the mark
        go()
        for f in [*Path(f"{mark}/commits").glob("0"), *Path(f"{mark}/commits").glob(".0.crc")]:
            f.unlink()
    n = spark.read.schema(score_feed.HITS).parquet(f"{out}/hits").count()
    assert go()["batches"] == 1
    assert n == spark.read.schema(score_feed.HITS).parquet(f"{out}/hits").count()
    assert scores(spark, out) == sorted(truth(registry.JOB1_SQL, lineitem=f"{tmp_path}/in/*.parquet", part=f"{sf}/part.parquet"))


def test_feed_of_odd_lines(spark, tmp_path):
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, epoch string"
    good = [(o, o % 7, o % 5, o % 3, 1.0 * o, 10.0 + o, "x") for o in range(1, 60)]
    odd = [(None, 1, 2, 1, 1.0, 5.0, "x"), (3, None, 2, 1, 1.0, 5.0, "x"), (3, 1, None, 1, 1.0, 5.0, "x"), (3, 1, 2, None, 1.0, 5.0, "x"), (3, 1, 2, 1, 1.0, None, "x"), (99, 2, 2, 1, 1.0, 5.0, "x"), (99, 77, 2, 1, 1.0, 5.0, "x"), good[4], good[4], (59, 3, 4, 2, None, 70.0, "y"), (59, 3, 4, 2, 1.0, 70.0, "y")]
    genes = [(i, f"{i % 2:02d}", 5 + i) for i in range(7)] + [(None, "00", 4), (20, None, 4)]
    spark.createDataFrame(good + odd, schema).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame(genes, "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part")
    score_feed.run(spark, f"{tmp_path}/in", f"{tmp_path}/part", f"{tmp_path}/out", f"{tmp_path}/mark", FEED)
    got = scores(spark, f"{tmp_path}/out")
    assert {g[0] for g in got} == {"00", "01"}  # names of genomes stay texts
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(truth(registry.JOB1_SQL.replace("l_quantity DESC", "l_quantity DESC NULLS LAST"), lineitem=f"{tmp_path}/in/*.parquet", part=f"{tmp_path}/part/*.parquet"), key=key)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none")
    score_feed.run(spark, f"{tmp_path}/none", f"{tmp_path}/part", f"{tmp_path}/out2", f"{tmp_path}/mark2", FEED)
    assert scores(spark, f"{tmp_path}/out2") == []


def shuffled_rows(spark, since=-1):
    """Rows that stages after ``since`` wrote to shuffles, and the last stage."""
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()
    none = jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() > since), max([s.stageId() for s in stages], default=-1)


def test_feed_moves_hits_to_be_placed_ranked_and_fitted_only(spark, sf, tmp_path):
    price = (F.col("id") * 7919 % 1000 + 1.0).alias("l_extendedprice")  # no hit repeats
    lines = spark.range(6000).select(F.col("id").alias("l_orderkey"), (F.col("id") % 200).alias("l_partkey"), F.expr("id div 200").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), price)
    arrive(lines, f"{tmp_path}/in", "l_orderkey >= 0")
    _, since = shuffled_rows(spark)
    score_feed.run(spark, f"{tmp_path}/in", f"{sf}/part.parquet", f"{tmp_path}/out", f"{tmp_path}/mark", score_feed.Config("p_brand", 1, 1000))
    moved, _ = shuffled_rows(spark, since)
    n = lines.count()
    assert 2 * n < moved < 4 * n


def test_feed_of_genes_that_repeat(spark, tmp_path):
    lines = [(o, o % 7, o % 5, o % 3, 1.0 * o, 10.0 + o % 11) for o in range(1, 80)] + [(200, 1, 2, 1, 3.0, 0.0)]
    genes = [(i, f"{i % 2:02d}", 5 + i) for i in range(7)] + [(1, "01", 6), (1, "00", 6), (2, "00", 9), (3, "01", None)]
    spark.createDataFrame(genes, "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part")
    df = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    key = lambda r: tuple((x is None, x) for x in r)
    shown = lambda rows: sorted((tuple(r) for r in rows), key=key)
    for keep in ("l_orderkey % 2 = 0", "l_orderkey % 2 = 1"):
        arrive(df, f"{tmp_path}/in", keep)
        score_feed.run(spark, f"{tmp_path}/in", f"{tmp_path}/part", f"{tmp_path}/out", f"{tmp_path}/mark", FEED)
        got = score_feed.read_scores(spark, f"{tmp_path}/out").select("q_genome", "r_genome", "q", "r", "bitscore", "identity", F.round("nbs", 6)).collect()
        want = truth(registry.JOB1_SQL, lineitem=f"{tmp_path}/in/*.parquet", part=f"{tmp_path}/part/*.parquet")
        assert len(got) == len(want) and shown(got) == shown(want)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def spans(texts, k):
    out = {}
    for w in map(words, texts):
        for i in range(max(len(w) - k + 1, 1) if w else 0):
            run = " ".join(w[i : i + k])
            a, b = out.get(run, (i, 0))
            out[run] = min(a, i), max(b, i + min(len(w), k) - 1)
    return out


def plain_annotations(records, families, c):
    out = {}
    share = lambda c: c * 100 if c <= 1 else c
    kinds = {i: [t for j, t in families if j == i and t is not None] for i in {i for i, t in families if i is not None and t is not None}}
    for key in {(s, d) for s, d, t in records if d is not None and t is not None}:
        texts = [t for s, d, t in records if (s, d) == key and t is not None]
        ours, n, found = spans(texts, c.words), sum(len(words(t)) for t in texts), []
        for item, own in kinds.items():
            theirs = spans(own, c.words)
            both = ours.keys() & theirs.keys()
            if both:
                size = lambda at: max(at[r][1] for r in both) - min(at[r][0] for r in both)
                coverage = min(size(ours) / n, size(theirs) / sum(len(words(t)) for t in own)) * 100
                identity = 100 * len(both) / len(theirs)
                if identity >= share(c.identity) and coverage >= share(c.coverage):
                    found.append((-identity, -len(both), item, coverage))
        if found:
            i, m, item, coverage = min(found)
            out[key] = (item, round(-i, 6), round(coverage, 6), -m, n)
    return out


def annotations(spark, out):
    rows = annotate_texts.read_annotations(spark, out).collect()
    got = {(r["source"], r["doc_id"]): (r["family"], round(r["identity"], 6), round(r["coverage"], 6), r["shared_runs"], r["n_words"]) for r in rows}
    assert len(got) == len(rows)
    return got


RECORDS = [
    ("a", 1, "One two THREE four five six seven"), ("a", 1, "eight nine ten"), ("b", 1, "one two three four five six seven eight"), (None, 2, "zero one, two, three, four five"),
    ("01", 3, "alpha beta"), ("1", 4, "alpha beta gamma"), ("c", None, "one two three four five"), ("c", 5, None), ("c", 6, ""), ("c", 7, "..."), ("x=y/z", 8, "été à la plage et puis encore"),
    ("b", 9, "one two three four five " * 400), ("b", 9, "one two three four five " * 400),
]
FAMILIES = [(1, "one two three four five six"), (2, "three four five six seven"), (2, "eight nine ten"), (3, "alpha beta"), (4, "alpha beta"), (5, ""), (6, None), (None, "one two three four five"), (7, "ÉTÉ été à la plage et"), (8, "two three four five one")]


def test_annotations_by_definition_and_again(spark, tmp_path):
    c = annotate_texts.Config(5, 20, 0.01, 100)
    spark.createDataFrame(RECORDS, "source string, doc_id int, text string").withColumn("item_id", F.lit("x")).withColumn("run", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame(FAMILIES, "item_id int, text string").withColumn("source", F.lit(1)).write.parquet(f"{tmp_path}/bench")
    want = plain_annotations(RECORDS, FAMILIES, c)
    assert {k: v[0] for k, v in want.items()}[("01", 3)] == 3 and len(want) >= 6
    for _ in range(2):
        done = annotate_texts.run(spark, f"{tmp_path}/docs", f"{tmp_path}/bench", f"{tmp_path}/out", c)
        assert done["records"] == len(RECORDS) and done["annotated"] == len(want)
        assert annotations(spark, f"{tmp_path}/out") == want
    counted = {(r["source"], r["family"]): r["n_records"] for r in spark.read.schema(annotate_texts.FAMILIES).parquet(f"{tmp_path}/out/families").collect()}
    assert counted == {(s, v[0]): sum(1 for (t, _), w in want.items() if t == s and w[0] == v[0]) for (s, _), v in want.items()}
    # A later run over other families leaves nothing of the first.
    spark.createDataFrame([(3, "alpha beta")], "item_id int, text string").write.parquet(f"{tmp_path}/other")
    annotate_texts.run(spark, f"{tmp_path}/docs", f"{tmp_path}/other", f"{tmp_path}/out", c)
    assert annotations(spark, f"{tmp_path}/out").keys() == {("01", 3)}
    spark.createDataFrame([], "item_id int, text string").write.parquet(f"{tmp_path}/no")
    assert annotate_texts.run(spark, f"{tmp_path}/docs", f"{tmp_path}/no", f"{tmp_path}/out", c)["annotated"] == 0


def test_annotations_of_the_tables(spark, sf, tmp_path):
    c = default_config(annotate_texts.__file__, annotate_texts.Config)
    annotate_texts.run(spark, f"{sf}/documents.parquet", f"{sf}/benchmark.parquet", f"{tmp_path}/out", c)
    docs = [(r["source"], r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain_annotations(docs, bench, c)
    assert want and annotations(spark, f"{tmp_path}/out") == want


def test_config_and_command_line(spark, sf, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"words": 3, "identity": 50, "coverage": 0, "rows_per_file": 10}))
    assert load_config(spark, f"file://{tmp_path}/c.json", annotate_texts.Config) == annotate_texts.Config(3, 50, 0, 10)
    (tmp_path / "d.json").write_text(json.dumps({"word": 3}))
    with pytest.raises(ValueError, match="word"):
        load_config(spark, f"file://{tmp_path}/d.json", annotate_texts.Config)
    root = Path(__file__).resolve().parents[1]
    said = subprocess.run([sys.executable, "-m", "jobs.annotate_texts", "--records", f"{sf}/documents.parquet", "--families", f"{sf}/benchmark.parquet", "--output", f"{tmp_path}/out"], cwd=root, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0 and "wrote" in said.stderr
    assert annotate_texts.read_annotations(spark, f"{tmp_path}/out").count() > 0


def test_runs_of_words_carry_no_words(spark):
    """A run's row has its own words alone, so the work of a text is in proportion to its length."""
    from jobs import annotate_texts

    rows = spark.createDataFrame([(1, "A b, c d"), (2, "x"), (3, "")], "id long, text string")
    found = annotate_texts.runs(rows, ["id"], 3)
    assert sorted(map(tuple, found.collect())) == [(1, "a b c", 0, 2), (1, "b c d", 1, 3), (2, "x", 0, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate " in line)
    assert "[0]" in generate or "[1]" in generate, generate  # words, the generator's input, aren't among its output
