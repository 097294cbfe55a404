"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are words and their leading 4 and 5 bytes. A bounded sample of labelled documents gives the examples and, by a
likelihood-ratio test of each term against the label, the vocabulary: all terms that pass, so texts are near for what matters to
the label; document frequencies of that vocabulary come from all documents. Examples lie in blocks; each term's postings are cut by block, with the term's largest weight in each. A query
first scores the blocks of the highest bounds, then every block whose bound reaches the k-th best score, so its neighbours
are exact. Votes are calibrated by an isotonic fit on the examples' own leave-one-out votes, weighted to the true share of
each class.

Defined results: a null text is an empty one; a text without vocabulary terms gets the toxic share of examples like it;
labels that are null, or of documents that aren't there, teach nothing; of several labels of a document the largest counts;
without labels of both classes every score is the share of label 1 (0.5 without labels); neighbours that
tie for the last places share these; repeated rows get a row each; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import crc_mod5, keep_rows, load, slices, small_batches, text_buffer, tidied, written
from kinfold.llm.text import mix, span_hash, words

#: Most labelled examples of each class: those of the lowest id hashes.
EXAMPLES = {1: 3000, 0: 6000}
#: The least likelihood ratio (chi-squared, one degree of freedom) of a term; in a small sample, half of what a perfect sign of the label would have there.
LEAST_RATIO = 30.0
#: Leading bytes of words that are terms as well.
PREFIXES = (4, 5)
NEIGHBOURS, BLOCK, FIRST_BLOCKS = 15, 64, 8
#: Weight of the overall share among the votes, against 1 / (0.05 + distance) of each neighbour.
PRIOR = 1.0
#: A document is rejected from this score on.
CUT = 0.5


def terms(buf: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term (hash, or place in the sorted vocabulary), text and count of each distinct term of each text."""
    w = words(buf, offsets)
    size = w.end - w.start
    h, doc = [w.hash], [w.doc]
    for k in PREFIXES:
        longer = size > k
        h.append(mix(span_hash(w.low, w.start[longer], w.start[longer] + k) + np.uint64(k)))
        doc.append(w.doc[longer])
    h, doc = np.concatenate(h), np.concatenate(doc)
    if vocabulary is not None:
        at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
        has = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
        h, doc = at[has], doc[has]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return h[first], doc[first], np.diff(np.append(first, len(h)))


class Index(NamedTuple):
    vocabulary: np.ndarray
    idf: np.ndarray
    label: np.ndarray  # of each example, in index order
    doc_id: np.ndarray
    example: np.ndarray  # postings, by term and then example
    weight: np.ndarray
    at: np.ndarray  # (terms, blocks + 1): where a term's postings of a block begin
    bound: np.ndarray  # (terms, blocks): largest weight
    share: float  # of label 1 among labelled documents
    votes: np.ndarray  # calibration: votes and scores, both rising
    scores: np.ndarray
    empty: float  # score of a text without terms


def vectors(term: np.ndarray, doc: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    w = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(doc, w * w, n))
    return w / norm[doc]


def nearest(x: Index, term: np.ndarray, weight: np.ndarray, without: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Examples, cosines and places of the k nearest (cosine above 0), nearest first; exact. All examples that tie for the last places share these."""
    bound = weight @ x.bound[term]
    order = np.argsort(-bound, kind="stable")
    ids = np.zeros(0, np.int64)
    cos = np.zeros(0)
    done = 0
    for step in (FIRST_BLOCKS, len(order)):
        blocks = order[done : done + step]
        least = np.partition(cos, len(cos) - k)[len(cos) - k] if len(cos) >= k else 0.0
        # Bounds and scores are summed in different orders; the margin covers their rounding.
        blocks = blocks[(bound[blocks] > 0) & (bound[blocks] >= least - 1e-9)]
        done += step
        if not len(blocks):
            break
        a, b = x.at[term][:, blocks].ravel(), x.at[term][:, blocks + 1].ravel()
        n = b - a
        i = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        w = np.repeat(np.repeat(weight, len(blocks)), n)
        got, which = np.unique(x.example[i], return_inverse=True)
        ids, cos = np.append(ids, got), np.append(cos, np.bincount(which, w * x.weight[i], len(got)))
    if without >= 0:
        keep = ids != without
        ids, cos = ids[keep], cos[keep]
    like = cos.round(12)
    best = np.lexsort((x.doc_id[ids], -like))
    places = np.ones(len(best))
    if len(best) > k:
        last = like[best[k - 1]]
        best = best[: int((like >= last).sum())]
        above = int((like > last).sum())
        places = np.where(np.arange(len(best)) < above, 1.0, (k - above) / (len(best) - above))
    return ids[best], np.minimum(cos[best], 1.0), places


def vote(x: Index, ids: np.ndarray, cos: np.ndarray, places: np.ndarray) -> float:
    w = places / (1.05 - cos)
    return float(((w * x.label[ids]).sum() + PRIOR * x.share) / (w.sum() + PRIOR))


def isotonic(value: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: mean value and mean y of each pool."""
    order = np.argsort(value, kind="stable")
    pools: list[list[float]] = []
    for v, t, m in zip(value[order].tolist(), y[order].tolist(), w[order].tolist()):
        pools.append([v * m, t * m, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def build(vocabulary: np.ndarray, df: np.ndarray, n_docs: int, doc_id: np.ndarray, label: np.ndarray, term: np.ndarray, doc: np.ndarray, count: np.ndarray, totals: tuple[int, int]) -> Index:
    """An index of examples (doc_id, label) with sparse term counts (term, doc, count); ``totals``: labelled documents by class."""
    n = len(doc_id)
    idf = np.log(1 + n_docs / np.maximum(df, 1))
    share = totals[1] / max(1, sum(totals)) if sum(totals) else 0.5
    w = vectors(term, doc, count, idf, n) if len(term) else np.zeros(0)
    # Examples of one leading term lie together, which keeps the bounds of blocks tight.
    lead = np.full(n, len(vocabulary))
    heavy = np.lexsort((-w, doc))
    lead[doc[heavy][::-1]] = term[heavy][::-1]
    place = np.empty(n, np.int64)
    place[np.lexsort((doc_id, lead))] = np.arange(n)
    ex = place[doc]
    order = np.lexsort((ex, term))
    term, ex, w = term[order], ex[order], w[order]
    blocks = max(1, -(-n // BLOCK))
    cell = term * blocks + ex // BLOCK
    at = np.searchsorted(cell, np.arange(len(vocabulary) * blocks + 1))
    bound = np.zeros(len(vocabulary) * blocks)
    np.maximum.at(bound, cell, w)
    at = np.column_stack([at[:-1].reshape(-1, blocks), at[blocks::blocks]]) if len(vocabulary) else np.zeros((0, blocks + 1), np.int64)
    back = np.argsort(place)
    x = Index(vocabulary, idf, label[back].astype(float), doc_id[back], ex, w, at, bound.reshape(-1, blocks), share, np.zeros(1), np.full(1, share), share)
    if not totals[0] or not totals[1] or not (label == 1).any() or not (label == 0).any():
        return x
    class_weight = np.array([totals[0] / max(1, (x.label == 0).sum()), totals[1] / max(1, (x.label == 1).sum())])
    m = class_weight[x.label.astype(int)]
    rows = np.argsort(ex, kind="stable")
    first = np.searchsorted(ex[rows], np.arange(n + 1))
    votes = np.full(n, np.nan)
    for i in range(n):
        r = rows[first[i] : first[i + 1]]
        if len(r):
            votes[i] = vote(x, *nearest(x, term[r], w[r], without=i))
    has = ~np.isnan(votes)
    smooth = lambda s: float(((m * x.label)[s].sum() + x.share) / (m[s].sum() + 1))
    if not has.any():
        return x._replace(empty=smooth(~has))
    v, s = isotonic(votes[has], x.label[has], m[has])
    # A little of the vote itself keeps the order of votes within a pool.
    return x._replace(votes=v, scores=s, empty=smooth(~has))


def score(x: Index, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, float, int]]]]:
    """Score and nearest examples (id, cosine, label) of each text."""
    buf, offsets = text_buffer(texts)
    out, evidence = np.full(len(texts), x.empty), [[] for _ in range(len(texts))]
    for i, j in slices(offsets):
        t, doc, count = terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], x.vocabulary)
        if not len(t):
            continue
        w = vectors(t, doc, count, x.idf, j - i)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        for a, b in zip(first.tolist(), np.append(first[1:], len(t)).tolist()):
            ids, cos, places = nearest(x, t[a:b], w[a:b])
            v = vote(x, ids, cos, places)
            k = i + int(doc[a])
            out[k] = 0.98 * float(np.interp(v, x.votes, x.scores)) + 0.02 * v
            evidence[k] = [(int(x.doc_id[e]), float(c), int(x.label[e])) for e, c in zip(ids[:3], cos[:3])]
    return np.clip(out, 0.0, 1.0), evidence


def likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """G statistic of a term's presence against the label."""
    total = n_pos + n_neg
    g = np.zeros(len(pos))
    for seen, size in ((pos, n_pos), (neg, n_neg)):
        for have, all_have in ((seen, pos + neg), (size - seen, total - pos - neg)):
            want = all_have * (size / total)
            g += np.where(have > 0, 2 * have * np.log(np.maximum(have, 1e-9) / np.maximum(want, 1e-9)), 0.0)
    return g


def learn(docs: DataFrame, labels: DataFrame, examples: dict[int, int] = EXAMPLES) -> Index:
    """An index from ``docs`` (doc_id, text) and ``labels`` (doc_id, label). What comes to the driver is bounded by ``examples``: their terms."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    found = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = (found.get(0, 0), found.get(1, 0))
    chosen = None
    for k, most in examples.items():
        part = known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most the sum of ``examples`` rows.
    sample = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text")

    @tidied
    def count_terms(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(2))
            for i, j in slices(offsets):
                t, doc, n = terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (t.view(np.int64), n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *lists], ["doc_id", "label", "terms", "counts"])

    bags = written(sample.mapInArrow(count_terms, "doc_id long, label int, terms array<long>, counts array<long>"), "examples")
    size = {r["label"]: r["n"] for r in bags.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    by_term = bags.select("label", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).filter("n >= 3")

    perfect = float(likelihood_ratio(np.array([float(n_pos)]), np.zeros(1), n_pos, n_neg)[0]) if n_pos and n_neg else 0.0
    least = min(LEAST_RATIO, perfect / 2)

    @tidied
    def strong(batches):
        for batch in batches:
            pos, n = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            g = likelihood_ratio(pos.astype(float), (n - pos).astype(float), n_pos, n_neg)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(g >= least))], ["t"])

    best = by_term.mapInArrow(strong, "t long").collect() if n_pos and n_neg else []
    vocabulary = np.sort(np.array([r["t"] for r in best], np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(vocabulary)

    @tidied
    def count_documents(batches):
        df, n = np.zeros(len(sent.value) + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            buf, offsets = text_buffer(batch.column(0))
            for i, j in slices(offsets):
                t, _, _ = terms(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sent.value)
                df += np.bincount(t, minlength=len(df))
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df)), pa.int32()), pa.array(df)], ["t", "df"])

    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in docs.select("text").mapInArrow(count_documents, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        df[r["t"]] = r["df"]
    return _index(bags, vocabulary, df, totals)


def _index(bags: DataFrame, vocabulary: np.ndarray, df: np.ndarray, totals: tuple[int, int]) -> Index:
    """The examples' vectors come to the driver with vocabulary terms alone."""

    @tidied
    def narrow(batches):
        for batch in batches:
            t, n = batch.column(2), batch.column(3)
            flat, count = t.values.to_numpy().view(np.uint64), n.values.to_numpy()
            off = t.offsets.to_numpy()
            flat, count, off = flat[off[0] : off[-1]], count[off[0] : off[-1]], off - off[0]
            at = np.minimum(np.searchsorted(vocabulary, flat), max(0, len(vocabulary) - 1))
            has = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
            ends = pa.array(np.append(0, np.cumsum(has))[off].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[has].astype(np.int32))) for v in (at, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "label", "terms", "counts"])

    got = bags.mapInArrow(narrow, "doc_id long, label int, terms array<int>, counts array<int>").toArrow().sort_by("doc_id")
    term, count, n = [], [], []
    for t, c in zip(got.column("terms").to_pylist(), got.column("counts").to_pylist()):
        term += t
        count += c
        n.append(len(t))
    doc = np.repeat(np.arange(len(n)), np.array(n, np.int64))
    return build(vocabulary, df[:-1], int(df[-1]), got.column("doc_id").to_numpy(), got.column("label").to_numpy(), np.array(term, np.int64), doc, np.array(count, np.int64), totals)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, evidence (nearest examples) of each row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, label)."""
    index = learn(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    @tidied
    def run(batches):
        for batch in batches:
            s, evidence = score(sent.value, batch.column(1))
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
            rows = [[{"doc_id": a, "cosine": b, "label": c} for a, b, c in e] for e in evidence]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(rows, kind)], ["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>")


def reject(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs``, its columns as they are, without the rows that score ``cut`` or more."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels))
    return keep_rows(docs, lambda texts: score(sent.value, texts)[0] < cut)


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(crc_mod5("doc_id") != 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = training_labels(load(spark, sf_dir, "labels", "doc_id", "toxic"), "toxic")
    out = toxicity(load(spark, sf_dir, "documents", "doc_id", "text"), labels)
    held = F.coalesce(crc_mod5("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")
