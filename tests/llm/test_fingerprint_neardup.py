"""SimHash and BagMinHash against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from kinfold.llm import fingerprint as P
from kinfold.llm import graph as G
from kinfold.llm import neardup as N
from kinfold.llm.common import text_buffer

W = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def bag(t):
    w = W.findall((t or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def like(a, b):
    x = sum((a & b).values())
    return x / (sum(a.values()) + sum(b.values()) - x) if a and b else 0.0


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for k in range(n):
        if out and rng.random() < 0.6:
            w = (out[rng.integers(len(out))] or "x").split(" ")
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = str(rng.choice(vocab))
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(vocab, rng.integers(1, 160))))
    return out


def save(spark, path, docs):
    spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, cid string, fingerprint int").repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in root}
    got = {r.node: r.root for r in G.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    docs = list(enumerate(corpus(rng, 120))) + [(500, None), (501, ""), (502, "é" * 9), (502, "same id"), (None, "no id at all"), (503, "x " * 30_000)]
    out = P.op1_fingerprint(spark, save(spark, tmp_path, docs)).collect()
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(out) == len(docs)
    by = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in out}
    fp = lambda t: P.hexes(P.fingerprints(pa.array([t or ""])))[0]
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        a, b = a or "", b or ""
        k = len(a) // 4
        e = a[: len(a) - k] + b[:k]
        r = by[(i, len(a), hashlib.sha256(e.encode()).hexdigest())]
        bits = lambda x, y: 1 - bin(int(x, 16) ^ int(y, 16)).count("1") / 128
        assert (r.fingerprint, r.edited_fingerprint) == (fp(a), fp(e))
        assert (r.near_edited, r.near_next) == (bits(fp(a), fp(e)), bits(fp(a), fp(b)))
        if i is not None and i % 20 == 0:
            assert r.n_near == sum(bits(fp(a), fp(t)) >= 1 - P.RADIUS / 128 for _, t in docs) - 1
        else:
            assert r.n_near is None
    assert fp("") == "0" * 32 and P.op1_fingerprint(spark, save(spark, tmp_path / "none", [])).count() == 0
    single = P.op1_fingerprint(spark, save(spark, tmp_path / "one", [(4, "a b c d e f g h")])).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_permuted_tables_find_all(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (30, 16), np.uint8)
    rows = [base[i % 30].copy() for i in range(200)]
    for r in rows:
        for b in rng.integers(0, 128, rng.integers(0, 6)):
            r[b // 8] ^= 1 << (b % 8)
    f = sorted({r.tobytes().hex() for r in rows})
    df = spark.createDataFrame([(x,) for x in f], "fingerprint string")
    for radius, blocks in ((3, 4), (4, 8), (0, 2)):
        got = sorted(map(tuple, P.near(df.limit(60), df, radius, blocks).collect()))
        d = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
        q = [r[0] for r in df.limit(60).collect()]
        assert got == sorted((a, b, d(a, b)) for a in q for b in f if d(a, b) <= radius)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(7)
    for times in (1, 3, 9):
        a = Counter({f"t{i}": int(rng.integers(1, 1 + times)) for i in range(60)})
        b = Counter({k: max(1, v + int(rng.integers(-1, 2))) for k, v in a.items() if rng.random() < 0.8}) + Counter({f"u{i}": 2 for i in range(4)})
        want, got = like(a, b), []
        for trial in range(60):
            rows = [np.array(sorted(hash((trial, k)) & (1 << 63) - 1 for k in c), np.uint64) for c in (a, b)]
            key = [{hash((trial, k)) & (1 << 63) - 1: v for k, v in c.items()} for c in (a, b)]
            count = [np.array([key[n][int(h)] for h in rows[n]]) for n in (0, 1)]
            s = N.signatures(np.concatenate(rows), np.repeat([0, 1], [len(r) for r in rows]), np.concatenate(count), 2)
            got.append((s[0] == s[1]).mean())
        assert abs(np.mean(got) - want) < 4 * np.sqrt(want * (1 - want) / (60 * N.COMPONENTS))


def test_signature_does_not_depend_on_batch():
    texts = corpus(np.random.default_rng(8), 30) + ["a", "a b c d e f g " * 50, ""]
    def sig(ts):
        h, doc, count, _ = N.multisets(*text_buffer(pa.array(ts)))
        return N.signatures(h, doc, count, len(ts))
    whole = sig(texts)
    assert all((sig([t])[0] == whole[k]).all() for k, t in enumerate(texts))


def brute_classes(docs):
    bags = [bag(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (like(bags[i], bags[j]) >= 0.8) if bags[i] and bags[j] else (not bags[i] and not bags[j] and (docs[i][1] or "").lower() == (docs[j][1] or "").lower()):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i)), sum(find(k) == find(i) for k in range(len(docs)))) for i, (d, _) in enumerate(docs)), key=str)


def test_similar_sets_and_their_parts(spark):
    """All pairs of a bucket, in one task, in parts, and dealt by further bands: the same sets as by brute force."""
    rng = np.random.default_rng(31)
    texts = []
    for _ in range(12):
        base = [f"b{int(i)}" for i in rng.integers(0, 5000, 120)]
        for _ in range(6):
            w = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 5)):
                w[at] = f"e{int(rng.integers(1 << 30))}"
            texts.append(" ".join(w + ["x y z"] * int(rng.integers(0, 4))))
    h, doc, count, ids = N.multisets(*text_buffer(pa.array(texts)))
    bags = [N._pack(h[doc == k], count[doc == k]) for k in range(len(texts))]
    root = {k: k for k in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if N.overlap(N._unpack(bags[i]), N._unpack(bags[j])) >= 0.8:
                old, new = root[i], root[j]
                root = {k: new if r == old else r for k, r in root.items()}
    want = sorted(sorted(k for k in root if root[k] == r) for r in set(root.values()))
    assert 12 < len(want) < len(texts)

    def sets(links):
        r = {k: k for k in range(len(texts))}
        for a, b in links:
            old, new = r[a], r[b]
            r = {k: new if x == old else x for k, x in r.items()}
        return sorted(sorted(k for k in r if r[k] == x) for x in set(r.values()))

    links, heads = N.similar_sets([(k, None, b) for k, b in enumerate(bags)], 0.8)
    assert sets(links) == want and len(heads) == len(want)
    stored = spark.createDataFrame([(k, b) for k, b in enumerate(bags)], "cid long, bag binary")
    keys = N.band_keys(N.signatures(h, doc, count, len(texts))).view(np.int64)
    bands = spark.createDataFrame([(int(x), k) for k, row in enumerate(keys) for x in row], "key long, cid long")
    members = spark.createDataFrame([(1, k, None) for k in range(len(texts))], "key long, cid long, root long")
    for part, most in ((512, 1024), (20, 1024), (20, 30)):
        got = [tuple(r) for r in N._meeting(members, bands, stored, 0.8, part, most).collect()]
        assert all(N.overlap(N._unpack(bags[a]), N._unpack(bags[b])) >= 0.8 for a, b in got)
        found = sets(got)
        if part == 512:
            assert found == want
        else:  # one member stands for each part's set, so a chain may stay cut, but nothing else is joined
            assert all(any(set(x) <= set(y) for y in want) for x in found) and len(found) <= len(want) + 4


def test_large_buckets_lose_no_link(spark):
    """In every bucket of more than one part: a chain whose neighbours are alike, and outsiders, one of which is like one member only."""
    chain = [Counter({i: 1 for i in range(6 * k, 6 * k + 100)}) for k in range(30)]  # neighbours 94 / 106, the next ones 88 / 112
    outside = [Counter({10_000 * (k + 1) + i: 1 for i in range(100)}) for k in range(20)]
    bags = chain + outside + [Counter({i: 1 for i in range(90 + 6 * 29 - 90 - 6, 6 * 29 + 94)})]
    stored = spark.createDataFrame([(k, bytearray(N._pack(np.array(sorted(b), np.uint64), np.ones(len(b), np.int64)))) for k, b in enumerate(bags)], "cid long, bag binary")
    want = {(i, j) for i, a in enumerate(bags) for j, b in enumerate(bags) if i < j and sum((a & b).values()) >= 0.8 * sum((a | b).values())}
    bands = spark.createDataFrame([], "key long, cid long")  # no further band brings any together
    members = spark.createDataFrame([(1, k, None) for k in range(len(bags))] + [(2, k, None) for k in range(30, 50)], "key long, cid long, root long")
    for part, most in ((4, 8), (7, 1000), (2, 4)):
        got = {tuple(sorted(r)) for r in N._meeting(members, bands, stored, 0.8, part, most).collect()}
        assert got <= want
        root = {k: k for k in range(len(bags))}
        for a, b in got:
            root = {k: root[a] if x == root[b] else x for k, x in root.items()}
        assert len({root[k] for k in [*range(30), 50]}) == 1 and len(set(root.values())) == 21


def test_different_texts_that_sum_alike(spark, tmp_path):
    """Words that polynomial hashes can't tell apart (Thue-Morse) and texts that differ in NUL bytes are different contents."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = [(1, one), (2, two), (3, "\0"), (4, "\0\0"), (5, one)]
    got = {r.doc_id: r.class_id for r in N.op9_neardup(spark, save(spark, tmp_path, docs)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_classes(spark, tmp_path):
    rng = np.random.default_rng(9)
    docs = [(int(i), t) for i, t in zip(rng.permutation(400)[:300], corpus(rng, 300))]
    docs += [(900, None), (901, ""), (902, "!!"), (903, "?"), (904, "!!"), (905, "solo"), (906, "SOLO."), (None, "solo"), (None, "none like it"), (907, "q " * 4000), (907, "q " * 4000)]
    got = [tuple(r) for r in N.op9_neardup(spark, save(spark, tmp_path, docs)).collect()]
    assert sorted(got, key=str) == brute_classes(docs)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = N.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({g[1] for g in got}, key=str)
    assert N.op9_neardup(spark, save(spark, tmp_path / "none", [])).count() == 0


def test_open_buckets_come_once_with_their_size(spark, monkeypatch):
    """Buckets of the same members are one before any member is read for them, and members know how many they are."""
    base = [f"w{i}" for i in range(120)]
    docs = [(k, " ".join(base[:100 - k] + [f"x{k}_{i}" for i in range(k + 20)])) for k in range(12)]
    seen, inner = [], N._meeting
    monkeypatch.setattr(N, "_meeting", lambda members, *a: seen.extend(members.collect()) or inner(members, *a))
    N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    buckets = {}
    for r in seen:
        buckets.setdefault(r.key, []).append(r)
    assert buckets and all(r.n == len(rows) for rows in buckets.values() for r in rows)
    assert len({frozenset(r.cid for r in rows) for rows in buckets.values()}) == len(buckets)
