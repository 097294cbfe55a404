"""Delta Lloyd against a plain one, compiled token counts against the tokenizers library."""

import hashlib
import math
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinfold.llm import centroids, token_count
from kinfold.llm.registry import ORACLES, QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "label int, vec_id long, embedding array<double>, cluster string, v int"


def plain_lloyd(rows, clusters, rounds):
    """(vec_id, vector) rows by definition, all vectors with all centroids each time."""
    rows = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in rows[:clusters]]

    def owner(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(points))

    for _ in range(rounds):
        mine = [owner(v)[1] for _, v in rows]
        points = [[sum(x) // len(x) for x in zip(*[v for (_, v), m in zip(rows, mine) if m == i])] if i in mine else c for i, c in enumerate(points)]
    found = [(r[0], *owner(r[1])) for r in rows]
    whole = sum(d for _, d, _ in found)
    return sorted(
        ((i, c, d, sum(e for _, e, k in found if k == c), whole, hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, d, c in found),
        key=lambda r: (r[0] is None, r),
    )


def op11(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op11_centroid_clusters"](spark, str(tmp_path))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=lambda r: (r[0] is None, r))


def test_clusters_of_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    near = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    good = [(i, [x + rng.gauss(0, 0.3) for x in near[i % 5]]) for i in range(150)]
    good += [(7, good[3][1]), (7, good[3][1]), (None, good[4][1])] + [(1000 + i, [0.25] * 64) for i in range(60)]
    bad = [(5000, [0.0] * 63), (5001, [0.0] * 65), (5002, None), (5003, []), (5004, [math.nan] + [0.0] * 63), (5005, [math.inf] * 64), (5006, [None] + [1.0] * 63)]
    got = op11(spark, tmp_path, [(1, i, v, "x", 2) for i, v in good + bad])
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in good]
    assert got == plain_lloyd(ints, 16, 3)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.sql(ORACLES["op11_centroid_clusters"]).fetchall(), key=lambda r: (r[0] is None, r)) == got


def test_few_and_no_vectors(spark, tmp_path):
    rows = [(1, 3, [1.0] * 64, "x", 2), (1, 4, [1e30] * 64, "x", 2), (1, None, [-1e30] * 64, "x", 2)]
    got = op11(spark, tmp_path / "few", rows)
    assert [(r[0], r[2]) for r in got] == [(3, 0), (4, 0), (None, 0)] and len({r[1] for r in got}) == 3
    assert op11(spark, tmp_path / "none", rows[:0]) == []


def test_a_round_of_changed_centroids_gives_what_a_whole_round_gives():
    rng = np.random.default_rng(5)
    for size in (3, 1 << 23):  # the second beyond exact products of doubles
        v, c = rng.integers(-size, size, (400, 4)), rng.integers(-size, size, (8, 4))
        owner, d = centroids.nearest(v, c, np.arange(8), np.full(400, -1), np.full(400, (1 << 63) - 1))
        for _ in range(12):
            changed = np.flatnonzero(rng.random(8) < 0.4)
            c = c.copy()
            c[changed] = rng.integers(-size, size, (len(changed), 4))
            owner, d = centroids.nearest(v, c, changed, owner, d)
            full = ((v[:, None] - c[None]) ** 2).sum(2)
            assert (owner == full.argmin(1)).all() and (d == full.min(1)).all()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = ["'", "'s", "'re", "r", "e", "l", "'ll", " ", "  ", "\n", "\t", "　", " ", "a", "the", "1", "23", "²", "Ⅳ", "é", "中", "\U0001f600", "<|endoftext|>", "<|endof", "!", "--", "aaaa", "́", "'ve", "'V", "\r\n", "\x85", "​", "\x00", "======"]


def count(texts, counter=None):
    return (counter or token_count.counter(PATH)).count(pa.array(texts, pa.string())).tolist()


def test_counts_are_the_librarys(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(6000)] + ["", None]
    assert count(texts) == [len(e.ids) for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" '\nstrevlmd19<|>")), max_size=60), max_size=6))
def test_counts_of_any_texts(texts):
    tok = Tokenizer.from_file(PATH) if not hasattr(test_counts_of_any_texts, "tok") else test_counts_of_any_texts.tok
    test_counts_of_any_texts.tok = tok
    assert count(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_texts_over_blocks_lanes_and_new_states(library, monkeypatch):
    rng = random.Random(2)
    texts = ["a" * 70_001, " " * 5000 + "x", "'" * 3001, "é'" * 4001, "".join(rng.choice("abcdefgXYZ019+/ ") for _ in range(60_000)), "<|endoftext|>" * 400, "word  " * 3000, "中" * 9999]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert count(texts) == want
    monkeypatch.setattr(token_count, "BLOCK", 101)
    monkeypatch.setattr(token_count, "LANE", 3)
    monkeypatch.setattr(token_count, "TRANSITIONS", 50)
    monkeypatch.setattr(token_count, "PIECES", 20)
    fresh = token_count.Counter(PATH)
    assert count(texts, fresh) == want and fresh.made < 300


def test_state_maps_compose():
    rng = np.random.default_rng(0)
    classes = rng.integers(2, len(token_count._CLASSES), 5000)
    state, out = 0, []
    for c in classes:
        out.append(token_count._EMIT[c, state])
        state = token_count._STEP[c, state]
    got, end = token_count.transduce(classes, 0)
    assert got.tolist() == out and end == state


def test_query_and_odd_rows(spark, tmp_path, library, sf):
    out = QUERIES["op12_token_count"](spark, sf)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = sorted((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in texts.items())
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and sorted(map(tuple, out.collect())) == want
    rows = [("x", 1, None), ("x", None, ""), ("y", 1, "two words"), ("y", 1, "two words"), ("z", 2, "very " * 300_000)]
    spark.createDataFrame(rows, "n_tokens string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_token_count"](spark, str(tmp_path)).collect()
    n = len(library.encode(rows[4][2], add_special_tokens=False).ids)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0, False), (None, 0, 0, False), (1, 9, 2, False), (1, 9, 2, False), (2, 1_500_000, n, True)], key=str)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op12_token_count"](spark, f"{tmp_path}/none").count() == 0


def test_other_schemes_are_refused():
    with pytest.raises(ValueError):
        token_count.Counter(public_tokenizers.path("word_bpe_49k.json"))
