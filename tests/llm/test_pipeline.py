"""The pipeline against a plain version of its stages."""

import re
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from kinfold.llm import mixing as M
from kinfold.llm import token_output as T
from kinfold.llm import toxicity as X
from test_fingerprint_neardup import brute_classes
from test_sharding_tokens_bench import brute


def corpus(rng):
    words = [f"w{i}x" for i in range(800)]
    insults = ["idiot", "moron", "scum"]
    items = [(i, " ".join(rng.choice(words, 25))) for i in range(6)]
    docs, labels = [], []
    for i in range(420):
        w, toxic = list(rng.choice(words, rng.integers(5, 70))), int(rng.random() < 0.2)
        for _ in range(3 * toxic):
            w.insert(int(rng.integers(len(w))), str(rng.choice(insults)))
        text = " ".join(w)
        if i > 50 and rng.random() < 0.15:
            text, toxic = docs[int(rng.integers(50))][1] + rng.choice(["", " end"]), None
        if rng.random() < 0.05:
            text += " " + items[int(rng.integers(6))][1]
        docs.append((i, text, "en", rng.choice(["a", "b", "c", "d"]), len(text)))
        if toxic is not None and rng.random() < 0.9:
            labels.append((i, 1, toxic))
    docs += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, "one", "en", "b", 3), (1003, "one", "en", "b", 3)]
    return [tuple(str(v) if isinstance(v, np.str_) else v for v in d) for d in docs], labels, items


def plain_mix(docs):
    size = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in docs}
    sources = sorted({d[3] for d in docs if d[3] is not None}) + [None] * any(d[3] is None for d in docs)
    total = [sum(size[d[0]] for d in docs if d[3] == s) for s in sources]
    want = M.targets(total, [(1.0, 2.0, 3.0)[i % 3] for i in range(len(sources))])
    ends = np.cumsum(want)[:-1] / sum(total)
    slots = Counter()
    for i in range(-(-sum(total) // M.BLOCK_WORDS)):
        slots[int((ends <= (i % M.FIB) * M.FIB_BEFORE % M.FIB / M.FIB).sum())] += 1
    seed = xxhash.xxh64(struct.pack("<i", 17), seed=42).intdigest()

    def signed(i):
        h = xxhash.xxh64(struct.pack("<q", size[i]), seed=xxhash.xxh64(struct.pack("<q", i), seed=seed).intdigest()).intdigest()
        return struct.unpack("<q", struct.pack("<Q", h))[0]

    out = []
    for k, s in enumerate(sources):
        at, reach = 0, slots[k] * M.BLOCK_WORDS
        own = sorted((d for d in docs if d[3] == s and size[d[0]]), key=lambda d: signed(d[0]))  # one part each
        for d in own:
            n = size[d[0]]
            taken = sum(max(0, min(n, reach - at - e * total[k])) for e in range(M.MOST))
            out += [d] * int(taken / n + 0.5)
            at += n
    return out


def test_pipeline(spark, tmp_path):
    docs, labels, items = corpus(np.random.default_rng(12))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    score = {r.doc_id: r.score for r in X.op2_toxicity(spark, str(tmp_path)).collect()}
    left = [d for d in docs if score[d[0]] < 0.5]
    assert 40 < len(docs) - len(left) < 160
    least = {i: c for i, c, _ in brute_classes([d[:2] for d in left])}
    left = [d for d in left if least[d[0]] == d[0]]
    assert len(left) < len(docs) - 60
    dirty = {r[0] for r in brute([d[:2] for d in left], items) if r[5]}
    assert dirty
    left = plain_mix([d for d in left if d[0] not in dirty])
    enc, want, start = T.Encoder(T.default_tokenizer()), [], 0
    for d in sorted(left):
        ids = np.append(enc.encode(pa.array([d[1]], pa.string()))[0], 2).astype("<u4")
        want.append((d[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]


CLASHES = ["row", "rid", "size", "s", "its", "source_size", "target", "parts", "taken", "times", "at", "h", "part", "block", "slot", "content", "kept", "kept_id", "nth", "cid", "root", "n", "k", "bands", "key", "label", "score", "_size", "_rid", "_cid", "_id", "_kept", "_nth", "a.b"]


def test_odd_rows_and_column_names(spark, tmp_path):
    """Every stage keeps other columns and their values whatever they are called, and handles nulls, repeated ids and rows, and long texts."""
    rng = np.random.default_rng(21)
    docs, labels, items = corpus(rng)
    long = " ".join(rng.choice([f"w{i}x" for i in range(800)], 60_000))
    docs = docs[:150] + [(None, "null id " * 9, None, None, None), (None, "null id " * 9, None, None, None), (None, None, None, None, None), (7, docs[7][1], "en", "a", 1), (8, "another text for an id", "en", "a", 2), (2000, long, "en", "b", 3)]
    rows = [(*d, *[f"{c}{k}" for c in CLASHES]) for k, d in enumerate(docs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, None, None), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*items, (None, items[0][1]), (99, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = [tuple(r) for r in docs.collect()]
        assert got and set(got) <= known
        if name == "near_duplicates":
            assert sum(r[1] == "null id " * 9 for r in got) == 1 and sum(r[0] == 2000 for r in got) == 1
    corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()


def test_columns_stay(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
