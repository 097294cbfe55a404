"""Neighbours and votes against brute force, the mix against its targets."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinfold.llm import mixing as M
from kinfold.llm import toxicity as T
from kinfold.llm.common import text_buffer

INSULTS = ["idiot", "moron", "scum", "klown"]


def corpus(rng, n, vocab=400):
    words = [f"w{i}x" for i in range(vocab)]
    rows = []
    for i in range(n):
        w = list(rng.choice(words, rng.integers(1, 80)))
        toxic = int(rng.random() < 0.2)
        for _ in range(rng.integers(2, 5) if toxic else 0):
            w.insert(int(rng.integers(len(w) + 1)), str(rng.choice(INSULTS)) + rng.choice(["", "ei", "ent"]))
        rows.append((i, " ".join(w), toxic))
    return rows


def random_index(rng, n=700):
    rows = corpus(rng, n)
    h, doc, count = T.terms(*text_buffer(pa.array([t for _, t, _ in rows])))
    vocabulary, df = np.unique(h, return_counts=True)
    pick = rng.random(len(vocabulary)) < 0.5
    vocabulary, df = vocabulary[pick], df[pick]
    t, doc, count = T.terms(*text_buffer(pa.array([t for _, t, _ in rows])), vocabulary)
    label = np.array([y for *_, y in rows])
    return T.build(vocabulary, df, n, np.arange(n) * 3, label, t, doc, count, (int(9 * (label == 0).sum()), int((label == 1).sum()))), rows


def test_neighbours_are_exact():
    rng = np.random.default_rng(2)
    x, rows = random_index(rng)
    by_id = {i * 3: t for i, t, _ in rows}
    dense = np.zeros((len(rows), len(x.vocabulary)))
    for term in range(len(x.vocabulary)):
        a, b = x.at[term][0], x.at[term][-1]
        dense[x.example[a:b], term] = x.weight[a:b]
    assert np.allclose((dense**2).sum(axis=1)[dense.any(axis=1)], 1)
    for _, text, _ in corpus(rng, 150):
        t, _, n = T.terms(*text_buffer(pa.array([text])), x.vocabulary)
        if not len(t):
            continue
        w = T.vectors(t, np.zeros(len(t), int), n, x.idf, 1)
        q = np.zeros(len(x.vocabulary))
        q[t] = w
        cos = (dense @ q).round(12)
        want = sorted(((-c, d) for c, d in zip(cos, x.doc_id) if c > 0))
        last = want[min(len(want), T.NEIGHBOURS) - 1][0] if want else 0
        want = [v for v in want if v[0] <= last]  # those that tie for the last places, too
        ids, got, places = T.nearest(x, t, w)
        assert abs(places.sum() - min(len(want), T.NEIGHBOURS)) < 1e-9 and all(p == 1 or c == want[-1][0] for p, (c, _) in zip(places, want))
        assert np.allclose(got, [-c for c, _ in want], atol=1e-9) and [int(x.doc_id[i]) for i in ids] == [d for _, d in want]
    assert by_id and (x.bound >= 0).all()


def test_isotonic():
    v, s = T.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.allclose(s, [0, 0.5, 1]) and (np.diff(v) > 0).all()


def save(spark, path, docs, labels):
    spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, score int, label string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_toxicity_held_out(spark, tmp_path):
    rows = corpus(np.random.default_rng(4), 1500)
    docs = [(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "idiot " * 20_000), (9002, "again"), (None, "no id")]
    labels = [(i, 1, y) for i, _, y in rows] + [(77777, 1, 1), (9001, None, None), (3, 1, 0)]
    out = T.op2_toxicity(spark, save(spark, tmp_path, docs, labels)).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert all(zlib.crc32(str(e.doc_id).encode()) % 5 for r in out for e in r.evidence)
    kept = T.reject(spark.read.parquet(f"{tmp_path}/documents.parquet"), T.training_labels(spark.read.parquet(f"{tmp_path}/labels.parquet"), "toxic"))
    assert kept.columns == ["doc_id", "text", "score", "label"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if r.score < 0.5)


def test_toxicity_without_labels(spark, tmp_path):
    for k, labels in enumerate(([], [(1, 1, 1), (2, 0, 1)])):
        d = save(spark, tmp_path / str(k), [(1, "a"), (2, None)], labels)
        assert [r.score for r in T.op2_toxicity(spark, d).collect()] == [1.0 if k else 0.5] * 2
    assert T.op2_toxicity(spark, save(spark, tmp_path / "n", [], [])).count() == 0


def test_targets():
    assert M.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    got = M.targets([100, 1, 5, 0], [1, 2, 3, 1])
    assert got[1:] == [3, 15, 0] and abs(sum(got) - 106) < 1e-9


def test_mix(spark, tmp_path):
    rng = np.random.default_rng(11)
    src = ["b", "a", "é", None, "Z", "tiny"]
    docs = [(int(i), " ".join(["w"] * int(rng.integers(0, 200))), src[int(rng.choice(5, p=[0.6, 0.1, 0.1, 0.1, 0.1]))]) for i in range(900)]
    docs += [(901, None, "a"), (902, "", "b"), (903, "x y", "tiny"), (3, "again again", "a"), (904, "y\t" * 20_000, "b"), (None, "no id", None)]
    spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, s int, taken int").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    out = M.op8_mixing(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((i or -1 if i is not None else -1, len((t or "").split())) for i, t, _ in docs)
    by = {}
    for i, t, s in docs:
        by[s] = by.get(s, 0) + len((t or "").split())
    order = sorted((s for s in by if s is not None)) + [None]
    want = dict(zip(order, M.targets([by[s] for s in order], [(1.0, 2.0, 3.0)[k % 3] for k in range(len(order))])))
    taken = Counter()
    for r in out:
        taken[r.source_size, round(r.target, 6)] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for s in order:
        assert abs(taken[by[s], round(want[s], 6)] - want[s]) <= 3 * M.BLOCK_WORDS, s
    again = M.op8_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, out), key=str)
    m = M.mix(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert m.pieces.groupBy("slot").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).filter(F.col("n") > M.BLOCK_WORDS).count() == 0
    first = m.pieces.filter("slot < 100").groupBy("s").agg(F.countDistinct("slot").alias("n")).collect()
    total = sum(want.values())
    assert all(abs(r.n - 100 * want[order[r.s]] / total) < 4 for r in first)


def test_mix_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert M.op8_mixing(spark, str(tmp_path)).count() == 0
    assert M.remix(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 0
