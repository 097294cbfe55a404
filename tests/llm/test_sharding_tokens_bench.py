"""Sharding, token output and decontamination against brute force and round trips."""

import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import decontaminate as D
from kinfold.llm import sharding as S
from kinfold.llm import token_output as T

TEXTS = ["", None, "one", "one", "Zwölf Boxkämpfer's  jagen \n\n Viktor", "a b c d e f g h i j k l " * 40, "日本語 text 12's <|endoftext|> x²3  ", "it's 'tis don't  'x\n y \n  z", "…" * 50]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def tables(spark, tmp_path, docs, **more):
    frame(spark, [(i, t, "en", i, 1) for i, t in docs], "doc_id long, text string, shard string, slot long, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    for name, (rows, schema) in more.items():
        frame(spark, rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_shards(spark, tmp_path):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(2000)] + [(5, "again"), (None, "x")]
    out = S.op7_sharding(spark, tables(spark, tmp_path, docs)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    for s in range(16):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and 60 < len(slots) < 200
    assert all(r.grown_shard in (r.shard, 16) for r in out) and 60 < sum(r.grown_shard == 16 for r in out) < 190

    def want(key, n):
        u = lambda s: (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return min(range(n), key=lambda s: -math.log(u(s)))

    assert all((r.shard, r.grown_shard) == (want("" if r.doc_id is None else r.doc_id, 16), want("" if r.doc_id is None else r.doc_id, 17)) for r in out)


def test_weighted_shards(spark):
    out = S.assign(spark.range(8000).withColumnRenamed("id", "doc_id"), "doc_id", [(0, 1.0), (1, 3.0)]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 8000 for r in out}
    assert abs(share[1] - 0.75) < 0.02
    with pytest.raises(ValueError):
        S.assign(spark.range(1), "id", [(0, 0.0)])


def test_empty_tables(spark, tmp_path):
    d = tables(spark, tmp_path, [], benchmark=([], "item_id long, text string"))
    assert S.op7_sharding(spark, d).count() == D.op10_decontaminate(spark, d).count() == T.op3_token_output(spark, d).count() == 0


def test_pieces_are_the_tokenizers_own():
    enc = T.Encoder(T.default_tokenizer())
    rng = np.random.default_rng(1)
    parts = ["word", " ", "  ", "\n", "'", "'s", "é", "x²", "12", ".", ",", " .", "\t", "日", " ", "-", "_", "DON'T", "\r\n", "«", "…", "́", "\x1c"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(6000)]
    for n in (1, 40, len(texts)):
        for i in range(0, len(texts), n):
            for t, got in zip(texts[i : i + n], enc.encode(pa.array(texts[i : i + n]))):
                assert got.tobytes() == enc.whole(t), t


def test_token_files(spark, tmp_path):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(300, 0, -1)] + [(7, "again"), (None, "x y")]
    d = tables(spark, tmp_path / "in", docs)
    enc = T.Encoder(T.default_tokenizer())
    want, start = [], 0
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(np.frombuffer(enc.whole(t or ""), "<u4"), 2).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in T.op3_token_output(spark, d).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    path = str(tmp_path / "set")
    T.write(spark.read.parquet(f"{d}/documents.parquet"), path, T.default_tokenizer())
    one = T.read(spark, path, doc_ids=[8]).collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in one] == [w for w in want if w[0] == 8]
    assert one[0].ids[-1] == 2
    rows = spark.read.parquet(f"{path}/blocks").collect()
    assert len({r.dict_sha256 for r in rows}) == 1 and sum(r.n_docs for r in rows) == len(docs)


def brute(docs, items, window=10):
    W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: W.findall((t or "").translate(low))
    pats = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            pats.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(p) for p in pats}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in pats:
                    hit.update(range(k, k + n))
                    found |= pats[p] - {None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def test_decontaminate(spark, tmp_path):
    rng = np.random.default_rng(3)
    vocab = ["a", "B", "c", "é", "D9", "long-er"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(40)] + [(90, None), (91, ""), (92, "!!"), (93, "solo"), (7, "x y z w")]
    items += [(100, items[3][1]), (None, items[4][1]), (None, "none has this id but it is long enough for one window")]
    docs = [(i, text(int(rng.integers(0, 400)))) for i in range(60)] + [(60, None), (61, ""), (62, "solo"), (62, "Solo, solo"), (63, "y " * 3000 + (items[5][1] or "").upper() + " y" * 700), (64, "z none has this id but it is long enough for one window"), (None, items[3][1])]
    d = tables(spark, tmp_path, docs, benchmark=(items, "item_id long, text string"))
    got = sorted(map(tuple, D.op10_decontaminate(spark, d).collect()), key=str)
    assert got == sorted(brute(docs, items), key=str)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({D.OP10_SQL})").fetchall(), key=str) == got
    # Several packs in one pass, and several passes.
    for bounds in ({"pack_bytes": 300}, {"pack_bytes": 300, "pass_bytes": 30_000}):
        read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
        assert D._packs(read("benchmark"), 10, 300).count() > 3
        found = D.decontaminate(read("documents"), read("benchmark"), **bounds).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, len(r.item_ids)) for r in found), key=str) == sorted((r[:4] for r in brute(docs, items)), key=str)
        kept = D.keep_clean(read("documents"), read("benchmark"), **bounds)
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in brute(docs, items) if not r[5]), key=str)
    assert len(list(D._passes(D._packs(read("benchmark"), 10, 300), 30_000))) > 1


def test_ids_are_a_fresh_tokenizers():
    """Texts that shortcuts may get wrong, against a tokenizer that nothing has touched."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(T.default_tokenizer())
    bits = [0]
    while len(bits) < 8192:
        bits += [1 - b for b in bits]
    texts = ["", "x\0y", "Ünïcode wörds", "日本語 and words", "don't DON'T 'tis", "a" * 5000]
    for n in (512, 1024, 2048, 4096, 8192):
        texts += ["".join("ab"[b] for b in bits[:n]), "".join("ba"[b] for b in bits[:n])]
        texts.append(f"{texts[-2]} {texts[-1]} {texts[-2]}")
    rng = np.random.default_rng(5)
    long = " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(1, 12))) for _ in range(40_000))
    texts.append(" ".join([long] * 16)[: 5 << 20])
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in T.Encoder(T.default_tokenizer()).encode(pa.array(texts))] == want


def test_other_tokenizers_are_taken_whole(tmp_path):
    import json

    from tokenizers import Tokenizer

    said = json.loads(Path(T.default_tokenizer()).read_text())
    said["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "lower.json"
    path.write_text(json.dumps(said))
    plain, enc = Tokenizer.from_file(str(path)), T.Encoder(str(path))
    texts = ["Some WORDS here", "It's ONE", ""]
    assert not enc.cuts and [x.tolist() for x in enc.encode(pa.array(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(T.default_tokenizer())
    texts = ["one two<|endoftext|>three  four", "none here", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0]
    assert [x.tolist() for x in T.Encoder(T.default_tokenizer()).encode(pa.array(texts))] == want


def test_items_without_an_id_are_kept_out(spark):
    from kinfold.llm.decontaminate import keep_clean

    leak = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"some {leak} more"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, leak), (4, None)], "item_id long, text string")
    assert [r.doc_id for r in keep_clean(docs, items).collect()] == [2]
